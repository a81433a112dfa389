"""Bulk upsert against a row-by-row model."""

import datetime
import random

import pytest
from pyspark.sql import functions as F, types as T

from larder import model
from larder.operators.upsert import COMPARED, SEQUENCE, sync_stats, upsert_reviews

T0 = datetime.datetime(2024, 1, 1)
_INTS = {"page_index", "pos", "rating", "likes"}
INCOMING = T.StructType(
    [T.StructField(n, T.IntegerType() if n in _INTS else T.StringType()) for n in SEQUENCE + COMPARED]
)


def as_of():
    return F.lit("2025-01-01").cast("timestamp")


def payload(pid, fingerprint, text):
    return {
        "author_name": None,
        "rating": 3,
        "review_text": text,
        "review_date": None,
        "profile_photo": None,
        "likes": 1,
        "provider_review_id": pid,
        "language": None,
        "review_hash": fingerprint,
        "raw_json": '{"b":1,"a":"%s"}' % text,
    }


def make(seed, places, adversarial):
    rnd = random.Random(seed)
    stored, incoming = [], []
    for place in map(str, range(places)):
        pids, hashes = set(), set()
        for k in range(rnd.randint(0, 3)):
            pid, h = rnd.choice([None, "p1", "p2", "p3"]), rnd.choice(["h1", "h2", "h3", "h4"])
            if h in hashes or (pid and pid in pids):
                continue
            hashes.add(h)
            pids.add(pid)
            row = payload(pid, h, f"{h}t{rnd.randint(0, 1)}")
            stored.append({"id": f"s{place}_{k}", "restaurant_id": place, "created_at": T0, "updated_at": T0} | row)
        for i in range(rnd.randint(1, 8)):
            pid, h = rnd.choice([None, "p1", "p2", "p3", "p4"]), rnd.choice(["h1", "h2", "h3", "h4", "h5"])
            if not adversarial:
                pid = "p" + h[1:] if rnd.random() < 0.8 else None
            row = payload(pid, h, f"{h}t{rnd.randint(0, 1)}")
            incoming.append({"restaurant_id": place, "page_index": i // 3, "pos": i % 3} | row)
    return stored, incoming


def one_by_one(stored, incoming, place):
    """Statuses, whether two rows end with the same key, and the final rows."""
    rows = [dict(row) for row in stored if row["restaurant_id"] == place]
    by_pid = {row["provider_review_id"]: row for row in rows if row["provider_review_id"]}
    by_hash = {row["review_hash"]: row for row in rows}
    statuses = {}
    for new in sorted((r for r in incoming if r["restaurant_id"] == place), key=lambda r: (r["page_index"], r["pos"])):
        pid = new["provider_review_id"]
        match = (by_pid.get(pid) if pid else None) or by_hash.get(new["review_hash"])
        if match is None:
            match, status = new | {"id": None}, "imported"
            rows.append(match)
        else:
            status = "skipped" if all(match[c] == new[c] for c in COMPARED) else "updated"
        if status != "skipped":
            match.update({c: new[c] for c in COMPARED})
            by_hash[new["review_hash"]] = match
            if pid:
                by_pid[pid] = match
        statuses[place, new["page_index"], new["pos"]] = status
    hashes = [row["review_hash"] for row in rows]
    pids = [row["provider_review_id"] for row in rows if row["provider_review_id"]]
    broken = len(set(hashes)) < len(hashes) or len(set(pids)) < len(pids)
    final = sorted((r["id"] or "", r["review_hash"], r["provider_review_id"] or "", r["review_text"]) for r in rows)
    return statuses, broken, final


def frames(spark, stored, incoming):
    old = spark.createDataFrame([tuple(r.get(f.name) for f in model.EXT_REVIEWS.fields) for r in stored], model.EXT_REVIEWS)
    new = spark.createDataFrame([tuple(r[n] for n in INCOMING.names) for r in incoming], INCOMING)
    return old, new.repartition(5)


@pytest.mark.parametrize(("seed", "adversarial", "hot_rows"), [(1, True, 10**6), (2, False, 1)])
def test_equals_row_by_row_model(spark, seed, adversarial, hot_rows):
    places = 150
    stored, incoming = make(seed, places, adversarial)
    old, new = frames(spark, stored, incoming)
    result = upsert_reviews(new, old, as_of(), hot_rows)
    got = {(r.restaurant_id, r.page_index, r.pos): r.status for r in result.outcomes.collect()}
    table = {}
    for r in result.table.collect():
        known = r.id if r.id.startswith("s") else ""
        table.setdefault(r.restaurant_id, []).append((known, r.review_hash, r.provider_review_id or "", r.review_text))
    assert len(got) == len(incoming)
    conflicts = set()
    for place in map(str, range(places)):
        statuses, broken, final = one_by_one(stored, incoming, place)
        if broken:
            conflicts.add(place)
            # What is not part of the conflict is applied as in the model.
            assert all(got[key] in (status, "rejected") for key, status in statuses.items())
        else:
            assert {key: got[key] for key in statuses} == statuses
            assert sorted(table.get(place, [])) == final
    assert {key[0] for key, status in got.items() if status == "rejected"} == conflicts
    counts = sync_stats(result.outcomes).agg(*[F.sum(s) for s in ("imported", "updated", "skipped", "rejected")])
    assert sum(counts.first()) == len(incoming)


def test_replay_skips_everything_and_keys_stay_unique(spark):
    stored, incoming = make(5, 40, False)
    seen, unique = set(), []
    for row in incoming:
        keys = {(row["restaurant_id"], row["review_hash"])}
        if not keys & seen:
            unique.append(row | {"provider_review_id": "p" + row["review_hash"][1:]})
            seen |= keys
    _, new = frames(spark, stored, unique)
    empty = spark.createDataFrame([], model.EXT_REVIEWS)
    first = upsert_reviews(new, empty, as_of())
    assert {r.status for r in first.outcomes.collect()} == {"imported"}
    again = upsert_reviews(new, first.table, as_of())
    assert {r.status for r in again.outcomes.collect()} == {"skipped"}
    assert sorted(map(str, again.table.collect())) == sorted(map(str, first.table.collect()))
    assert again.table.select("restaurant_id", "review_hash").distinct().count() == len(unique)


def test_member_order_of_the_raw_record_does_not_matter(spark):
    row = {"restaurant_id": "1", "page_index": 0, "pos": 0} | payload("p1", "h1", "x")
    old, new = frames(
        spark,
        [{"id": "s", "restaurant_id": "1", "created_at": T0, "updated_at": T0} | payload("p1", "h1", "x")],
        [row | {"raw_json": '{"a":"x", "b":1.0}'}],
    )
    assert upsert_reviews(new, old, as_of()).outcomes.first().status == "skipped"


def test_id_arriving_later_updates(spark):
    rows = [
        {"restaurant_id": "1", "page_index": 0, "pos": 0} | payload(None, "h1", "x"),
        {"restaurant_id": "1", "page_index": 0, "pos": 1} | payload("p1", "h1", "x"),
    ]
    old, new = frames(spark, [], rows)
    result = upsert_reviews(new, old, as_of())
    assert [r.status for r in result.outcomes.orderBy("pos").collect()] == ["imported", "updated"]
    assert [r.provider_review_id for r in result.table.collect()] == ["p1"]


def test_a_sync_with_a_ledger_parses_what_is_new(spark):
    import json

    from larder.operators import upsert as U

    places = spark.createDataFrame([("1", "0x1"), ("2", "0x2")], "id string, serpapi_data_id string")
    places = model.conform(places, model.PLACES)

    def body(reviews, more):
        listed = [{"review_id": i, "rating": 3, "snippet": text, "iso_date": "2024-01-01"} for i, text in reviews]
        return json.dumps({"reviews": listed} | ({"serpapi_pagination": {"next_page_token": "t"}} if more else {}))

    def landed(pages):
        rows = [(f"0x{place}", index, text) for (place, index), text in pages.items()]
        return spark.createDataFrame(rows, "target_id string, page_index int, body string")

    def state(table):
        return sorted((r.restaurant_id, r.provider_review_id, r.review_text) for r in table.collect())

    def pairs(df):
        return sorted(map(tuple, df.collect()))

    empty = spark.createDataFrame([], model.EXT_REVIEWS)
    pages = {("1", 0): body([("a", "one"), ("b", "two")], True), ("1", 1): body([("c", "three")], True), ("2", 0): body([("a", "x")], True)}
    table, ledger = empty, spark.createDataFrame([], U.LEDGER)
    steps = [
        ({("3", 0): "{}"}, [("1", 0), ("1", 1), ("2", 0)], [("1", 0), ("1", 1), ("2", 0)]),
        ({}, [], []),
        ({("1", 2): body([("d", "four")], False)}, [("1", 2)], [("1", 2)]),
        # a changed page: the place is applied from its first page on
        ({("1", 1): body([("c", "other"), ("a", "again")], True)}, [("1", 1)], [("1", 0), ("1", 1), ("1", 2)]),
        # an unreadable page leaves its place alone; the chain of the other ends earlier
        ({("2", 1): "no json", ("1", 0): body([("a", "one")], False)}, [("1", 0), ("2", 1)], [("1", 0)]),
    ]
    full = empty
    for change, parsed, applied in steps:
        pages |= change
        done = U.sync_new_pages(places, landed(pages), table, ledger, as_of())
        assert pairs(done.parsed) == parsed
        assert pairs(done.applied) == applied
        table, ledger = U.cut_lineage(done.table), done.ledger
        if change:
            full = U.cut_lineage(U.sync_reviews(places, landed(pages), full, as_of()).table)
    assert state(table) == state(full)
