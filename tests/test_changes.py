"""Change sets against applying the requests one by one."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from larder import model
from larder.operators import changes as C
from larder.operators.quality import quality_report

T0 = datetime.datetime(2024, 1, 1)


def as_of():
    return F.lit("2025-01-01").cast("timestamp")


def frame(spark, name, rows):
    schema = model.TABLES[name]
    return spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields) for row in rows], schema)


@pytest.fixture(scope="module")
def users(spark):
    rows = [
        {
            "id": str(i),
            "username": f"user{i}",
            "email": f"user{i}@x.org",
            "hashed_password": "x",
            "is_active": i != 9,
            "is_admin": i == 0,
            "created_at": T0,
            "updated_at": T0,
        }
        for i in range(10)
    ]
    return frame(spark, "users", rows)


@pytest.fixture(scope="module")
def places(spark):
    rows = [
        {
            "id": str(i),
            "name": f"p{i}",
            "city": "c",
            "district": "d",
            "description": "old",
            "latitude": 1.0,
            "created_at": T0,
            "updated_at": T0,
        }
        for i in range(6)
    ]
    return frame(spark, "places", rows)


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [
        {
            "id": f"r{i}",
            "user_id": str(i % 5),
            "restaurant_id": str(i // 5),
            "rating": 3,
            "comment": "old",
            "created_at": T0,
            "updated_at": T0,
        }
        for i in range(10)
    ]
    return frame(spark, "user_reviews", rows)


def reasons(changed):
    return {r.seq: r.reject_reason for r in changed.outcomes.collect()}


def test_registration_in_order(spark, users):
    rnd = random.Random(4)
    asked = [
        (i, f"n{rnd.randint(0, 25):02d}", f"{'M' if i % 2 else 'm'}{rnd.randint(0, 25)}@x.org") for i in range(120)
    ]
    # A chain in which every verdict hangs on the one before.
    asked += [(200 + i, f"chain{(i + 1) // 2}", f"chain{i // 2}@x.org") for i in range(12)]
    asked += [(300, "user3", "free@x.org"), (301, "free", "USER3@x.org"), (302, "ab", "a@x.org"), (303, "abc", "nobody")]
    names = {f"user{i}" for i in range(10)}
    mails = {f"user{i}@x.org" for i in range(10)}
    expected = {302: "bad_username", 303: "bad_email"}
    for seq, name, mail in asked[:-2]:
        expected[seq] = "username_taken" if name in names else "email_taken" if mail.lower() in mails else None
        if expected[seq] is None:
            names.add(name)
            mails.add(mail.lower())
    rows = spark.createDataFrame([(*row, "x") for row in asked], "seq long, username string, email string, hashed_password string")
    changed = C.register_users(rows.repartition(4), users, as_of())
    assert reasons(changed) == expected
    table = changed.table.collect()
    assert len(table) == len(names) == len({r.email for r in table})


def test_unset_differs_from_null(spark, users, places):
    rows = [
        (1, "0", "1", {"description": None}),
        (2, "0", "2", {"name": "new"}),
        (3, "0", "2", {"name": "newer", "latitude": "2.5"}),
        (4, "0", "3", {"name": None}),
        (5, "1", "3", {"name": "x"}),
        (6, "0", "nowhere", {"name": "x"}),
        (7, "0", "4", {"latitude": None, "description": "old"}),
        (8, "0", "5", {"description": "old"}),
    ]
    asked = spark.createDataFrame(rows, "seq long, actor_id string, id string, changes map<string,string>")
    changed = C.update_places(asked, users, places, as_of())
    assert reasons(changed) == {
        1: None, 2: None, 3: None, 4: "null_field", 5: "forbidden", 6: "not_found", 7: None, 8: None,
    }
    table = {r.id: r for r in changed.table.collect()}
    later = datetime.datetime(2025, 1, 1)
    assert (table["1"].description, table["1"].name, table["1"].updated_at) == (None, "p1", later)
    assert (table["2"].name, table["2"].latitude, table["2"].description) == ("newer", 2.5, "old")
    assert (table["3"].name, table["3"].updated_at) == ("p3", T0)
    assert (table["4"].latitude, table["4"].description) == (None, "old")
    assert table["5"].updated_at == T0


def test_reviews_created_once_per_pair(spark, users, places, reviews):
    rows = [
        (1, "5", "0", 5, None),
        (2, "5", "0", 4, None),
        (3, "0", "0", 4, None),
        (4, "6", "0", 6, None),
        (5, "6", "0", 1, "x" * 1001),
        (6, "6", "none", 1, None),
        (7, "9", "0", 1, None),
        (8, "none", "0", 1, None),
        (9, "6", "0", 1, "x" * 1000),
    ]
    asked = spark.createDataFrame(rows, "seq long, actor_id string, restaurant_id string, rating int, comment string")
    changed = C.create_reviews(asked, users, places, reviews, as_of())
    assert reasons(changed) == {
        1: None, 2: "duplicate", 3: "duplicate", 4: "bad_rating", 5: "too_long", 6: "no_place",
        7: "inactive_actor", 8: "unknown_actor", 9: None,
    }
    assert changed.table.count() == 12
    report = quality_report({"users": users, "places": places, "user_reviews": changed.table})
    assert report.filter("violations > 0").collect() == []


def test_deletes_in_order(spark, users, reviews):
    rows = [
        (1, "1", "r0"),
        (2, "0", "r0"),
        (3, "0", "r0"),
        (4, "1", "r0"),
        (5, "9", "r0"),
        (6, "1", "r1"),
        (7, "1", "nothing"),
        (8, "9", "r2"),
    ]
    asked = spark.createDataFrame(rows, "seq long, actor_id string, id string")
    changed = C.delete_reviews(asked, users, reviews)
    assert reasons(changed) == {
        1: "forbidden", 2: None, 3: "not_found", 4: "not_found", 5: "inactive_actor",
        6: None, 7: "not_found", 8: "inactive_actor",
    }
    assert changed.table.count() == 8 and changed.table.columns == reviews.columns


def test_cascade_leaves_no_orphans(spark, users, places, reviews):
    favorites = frame(spark, "favorites", [{"id": "f", "user_id": "1", "restaurant_id": "0", "created_at": T0}])
    asked = spark.createDataFrame([(1, "0", "0"), (2, "0", "0"), (3, "1", "1")], "seq long, actor_id string, id string")
    tables = {"places": places, "user_reviews": reviews, "favorites": favorites, "users": users}
    cascade = C.delete_places(asked, users, tables)
    assert reasons(cascade) == {1: None, 2: "not_found", 3: "forbidden"}
    removed = {r.table_name: r.removed for r in cascade.removed.collect()}
    assert removed == {"places": 1, "user_reviews": 5, "favorites": 1}
    report = quality_report(cascade.tables).filter("rule = 'reference'")
    assert {r.violations for r in report.collect()} == {0}


def test_quality_report_finds_violations(spark, users, places):
    bad = frame(
        spark,
        "user_reviews",
        [
            {"id": "a", "user_id": "1", "restaurant_id": "0", "rating": 6, "comment": "x" * 1001, "created_at": T0, "updated_at": T0},
            {"id": "a", "user_id": "1", "restaurant_id": "0", "rating": 1, "created_at": T0, "updated_at": T0},
            {"id": "b", "user_id": "77", "restaurant_id": "88", "rating": 1, "created_at": T0, "updated_at": T0},
        ],
    )
    report = quality_report({"users": users, "places": places, "user_reviews": bad})
    found = {(r.rule, r.columns): r.violations for r in report.filter("table_name = 'user_reviews' and violations > 0").collect()}
    assert found == {
        ("max_length", "comment"): 1,
        ("rating_range", "rating"): 1,
        ("unique", "id"): 1,
        ("unique", "user_id,restaurant_id"): 1,
        ("reference", "restaurant_id"): 1,
        ("reference", "user_id"): 1,
    }


def test_toggles(spark, users, places):
    now = [{"id": f"f{i}", "user_id": "1", "restaurant_id": str(i), "created_at": T0} for i in range(3)]
    asked = [("1", "0"), ("1", "1"), ("1", "1"), ("1", "5"), ("2", "0"), ("nobody", "0"), ("9", "1"), ("1", "77")]
    rows = spark.createDataFrame([(seq, *row) for seq, row in enumerate(asked)], "seq long, actor_id string, restaurant_id string")
    favorites = frame(spark, "favorites", now)
    result = C.toggle_favorites(rows, users, places, favorites, as_of())
    after = result.table.collect()
    assert {(r.user_id, r.restaurant_id) for r in after} == {("1", "1"), ("1", "2"), ("1", "5"), ("2", "0")}
    assert {r.restaurant_id: r.id for r in after}["2"] == "f2"
    reasons = {r.seq: r.reject_reason for r in result.outcomes.collect()}
    assert reasons == {seq: None for seq in range(5)} | {5: "unknown_actor", 6: "inactive_actor", 7: "no_place"}
    report = quality_report({"users": users, "places": places, "favorites": result.table})
    assert report.filter("table_name = 'favorites' AND violations > 0").isEmpty()


def test_long_email_is_rejected(spark, users):
    asked = [(1, "someone", "a" * 250 + "@x.org", "x"), (2, "another", "a" * 249 + "@x.org", "x")]
    rows = spark.createDataFrame(asked, "seq long, username string, email string, hashed_password string")
    outcomes = {r.seq: r.reject_reason for r in C.register_users(rows, users, as_of()).outcomes.collect()}
    assert outcomes == {1: "too_long", 2: None}


def one_by_one_accounts(rows):
    """Rows that get in when applied in order."""
    names, mails, accepted = set(), set(), set()
    for seq, name, mail in sorted(rows):
        if name not in names and mail not in mails:
            names.add(name)
            mails.add(mail)
            accepted.add(seq)
    return accepted


def counted_writes(monkeypatch):
    writes, plain = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: writes.append(1) or plain(df))
    return writes


def test_a_long_chain_of_accounts_takes_few_rounds(spark, monkeypatch):
    # each row shares its name with the row before, or its address, in turn
    rows = [(k, f"n{(k + 1) // 2}", f"m{k // 2}") for k in range(10_000)]
    writes = counted_writes(monkeypatch)
    pending = spark.createDataFrame(rows, "seq long, username string, email string").repartition(4)
    got = {r.seq for r in C._accepted_accounts(pending).collect()}
    assert got == set(range(0, 10_000, 2)) == one_by_one_accounts(rows)
    assert len(writes) <= 20  # 15 steps of pointers, and what a round writes besides


def test_accounts_equal_row_by_row(spark):
    rnd = random.Random(9)
    rows = [(k, f"n{rnd.randrange(25)}", f"m{rnd.randrange(40) if k % 3 else 0}") for k in range(400)]
    rows += [(k, f"n{rnd.randrange(300)}", f"m{rnd.randrange(300)}") for k in range(400, 900)]
    pending = spark.createDataFrame(rows, "seq long, username string, email string").repartition(4)
    assert {r.seq for r in C._accepted_accounts(pending).collect()} == one_by_one_accounts(rows)
    assert C._accepted_accounts(pending.limit(0)).count() == 0


def test_quality_report_counts_real_keys_where_hashes_collide(spark, users, places, monkeypatch):
    from larder.operators import quality

    plain = quality._key
    monkeypatch.setattr(quality, "_key", lambda columns: plain(columns) if len(columns) == 1 else F.lit("same"))
    rows = [
        {"id": f"f{k}", "user_id": str(k % 5), "restaurant_id": "0", "created_at": T0}
        for k in range(7)
    ]
    report = quality_report({"users": users, "places": places, "favorites": frame(spark, "favorites", rows)})
    found = {(r.rule, r.columns): r.violations for r in report.filter("table_name = 'favorites'").collect()}
    assert found["unique", "user_id,restaurant_id"] == 2 and found["unique", "id"] == 0
