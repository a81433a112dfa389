"""Fingerprints that are settled by themselves get what the joins of all identities give."""

import random

import pytest
from pyspark.sql import functions as F

from larder.functions.ids import pack_hex, unpack_hex
from larder.operators import upsert as U
from tests.test_upsert import T0, as_of, frames, payload


def _rows(seed):
    rnd = random.Random(seed)
    stored, incoming = [], []
    for place in map(str, range(40)):
        for k in range(rnd.randint(0, 6)):
            # ids of stored rows are repeated now and then, fingerprints may be empty
            row = payload(rnd.choice([None, "p1", "p2", f"q{k}"]), rnd.choice(["", "h1", f"g{k}", f"g{k}"]), f"t{rnd.randint(0, 1)}")
            stored.append({"id": f"s{place}_{rnd.randint(0, 9)}", "restaurant_id": place, "created_at": T0, "updated_at": T0} | row)
        for i in range(rnd.randint(1, 12)):
            k = rnd.randint(0, 6)
            row = payload(rnd.choice([None, f"q{k}", f"q{k}"]), rnd.choice(["", "h1", f"g{k}", f"g{k}", f"g{k}"]), f"t{rnd.randint(0, 1)}")
            incoming.append({"restaurant_id": place, "page_index": i // 3, "pos": i % 3} | row)
    return stored, incoming


def _named(rows, pairs, _hot_rows):
    """Stands for the rounds: which rows would take part."""
    none = F.lit(None).cast("string")
    target = F.lit(None).cast("struct<id:string,digest:binary,created_at:timestamp,rating:int>")
    names = {"label": none, "one_hash": F.lit(None).cast("boolean"), "target": target, "status": F.lit("tangled"), "reject_reason": none}
    return U._settled(rows.join(pairs.select("hkey", "pkey"), ["hkey", "pkey"]).withColumns(names | {"is_last": F.lit(False)}))


@pytest.mark.parametrize("hot_rows", [10**6, 3])
def test_alone_or_together(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(U, "_replay_tangled", _named)
    old, new = frames(spark, *_rows(5))
    rows = U.cut_lineage(U._narrow(new, U.SEQUENCE).drop("review_hash"))
    stored = U._touched(old, rows)
    alone, left, left_stored = U._settled_alone(rows, stored, hot_rows)
    both = alone.unionByName(U._settled_together(rows, left, left_stored, hot_rows))
    joined = U._settled_together(rows, rows.select(*left.columns), stored, hot_rows)
    as_sorted = [sorted(map(repr, df.drop("label").collect())) for df in (both, joined)]
    assert alone.count() > 50 and left.count() > 50
    assert as_sorted[0] == as_sorted[1]


def test_plain_batch_takes_no_joins(spark, monkeypatch):
    """One shuffle settles reviews whose fingerprint and provider id only occur together."""
    incoming = [{"restaurant_id": "1", "page_index": 0, "pos": i} | payload(f"p{i % 7}" if i % 7 else None, f"h{i % 7}", "t") for i in range(20)]
    stored = [{"id": "s1", "restaurant_id": "1", "created_at": T0, "updated_at": T0} | payload("p1", "h1", "t")]

    def fail(*_):
        raise AssertionError("joins of identities")

    monkeypatch.setattr(U, "_identities", fail)
    old, new = frames(spark, stored, incoming)
    got = {r.pos: r.status for r in U.upsert_reviews(new, old, as_of()).outcomes.collect()}
    assert got == {i: "imported" if i < 7 and i != 1 else "skipped" for i in range(20)}


def test_packed_texts(spark):
    texts = ["0" * 64, "ab" * 32, "AB" * 32, "ab" * 31, "", "é", "x" * 33, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", unpack_hex(pack_hex(F.col("t"))).alias("back"), F.length(pack_hex(F.col("t"))).alias("n")).collect()
    assert all(r.t == r.back for r in rows)
    assert {r.t: r.n for r in rows}["ab" * 32] == 33
