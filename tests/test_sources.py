import datetime
import json
import os
import urllib.parse

import pytest
from pyspark.sql import functions as F

from larder import model
from larder.functions import payload as P
from larder.operators import area_import as A, ingest as I, upsert as U
from larder.sources import buckets as B, pages as S, tables as T


def write_page(folder, source, index, body):
    path = folder / urllib.parse.quote(source, safe="")
    os.makedirs(path, exist_ok=True)
    text = body if isinstance(body, str) else json.dumps(body, ensure_ascii=False)
    (path / f"{index}.json").write_text(text, encoding="utf-8")


def token(text="more"):
    return {"serpapi_pagination": {"next_page_token": text}}


def test_landed_pages_and_paging(spark, tmp_path):
    write_page(tmp_path, "cafés in X/Y", 0, {"reviews": [{"a": 1}, 5, "{}", {"b": 2}]} | token())
    write_page(tmp_path, "cafés in X/Y", 1, {"reviews": [{"c": 3}], "next_page_token": " "})
    write_page(tmp_path, "cafés in X/Y", 2, {"reviews": [{"d": 4}]})
    write_page(tmp_path, "broken", 0, {"reviews": [{"a": 1}]} | token())
    write_page(tmp_path, "broken", 1, "no json")
    write_page(tmp_path, "late", 0, {"reviews": [{"a": 1}]})
    write_page(tmp_path, "late", 1, "no json")
    write_page(tmp_path, "odd", 0, {"reviews": {"a": 1}, "serpapi_pagination": [], "next_page_token": "t"})
    pages = S.read_pages(spark, str(tmp_path), "source").cache()
    assert {r.source for r in pages.collect()} == {"cafés in X/Y", "broken", "late", "odd"}
    fetched = {(r.source, r.page_index): r.source_failed for r in S.fetched_pages(pages, "source", 10).collect()}
    assert fetched == {
        ("cafés in X/Y", 0): False,
        ("cafés in X/Y", 1): False,
        ("broken", 0): True,
        ("broken", 1): True,
        ("late", 0): False,
        ("odd", 0): False,
    }
    assert S.fetched_pages(pages, "source", 0).count() == 4
    items = S.page_items(pages.filter("source = 'cafés in X/Y'"), S.REVIEW_LISTS).orderBy("page_index", "pos")
    assert [(r.page_index, r.pos, r.item) for r in items.collect()] == [
        (0, 0, '{"a":1}'),
        (0, 3, '{"b":2}'),
        (1, 0, '{"c":3}'),
        (2, 0, '{"d":4}'),
    ]
    assert S.page_items(pages.filter("source = 'odd'"), S.REVIEW_LISTS).count() == 0


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ({"local_results": [], "places": [{"a": 1}]}, []),
        ({"local_results": {"x": 1}, "place_results": [{"a": 1}], "places": [{"b": 1}]}, ['{"a":1}']),
        ({"local_results": None, "places": [{"b": 1.0}, None]}, ['{"b":1.0}']),
        ({}, []),
    ],
)
def test_first_list_wins(spark, body, expected):
    pages = spark.createDataFrame([(json.dumps(body),)], "body string")
    assert [r.item for r in S.page_items(pages, S.PLACE_LISTS).collect()] == expected


def test_payload_keys(spark):
    items = spark.createDataFrame([('{"a":1,"b":{"c":2}}',), ('{"a":null}',)], "item string")
    assert {r.key: r.payloads for r in S.payload_keys(items).collect()} == {"a": 2, "b": 1}


def items_of(spark, payloads):
    rows = [(0, i // 2, i % 2, json.dumps(p, ensure_ascii=False)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "source_rank int, page_index int, pos int, item string")


def test_import(spark):
    here = {"gps_coordinates": {"latitude": 39.5, "longitude": 32.5}}
    payloads = [
        {"title": "KÄ±rÄ±kkale Kebap", "address": "Street 1, Cankaya/Ankara", "reviews": "12", "rating": 4.5, "type": ["a"]} | here,
        {"name": " Kırıkkale Kebap ", "latitude": 39.5, "longitude": "32.5"},
        {"title": "", "name": "Cafe", "gps_coordinates": {"latitude": 0, "longitude": 5}},
        {"title": "Cafe", "gps_coordinates": [1], "latitude": 1, "longitude": 2, "operating_hours": "x"},
        {"title": "  "} | here,
        {"title": "Old"} | here,
        {"title": "x" * 300, "operating_hours": {"monday": "9â€“5", "n": 1}, "hours": {"a": 1}} | here,
    ]
    stored = spark.createDataFrame([("Old", 39.5, 32.5)], "name string, latitude double, longitude double")
    cleaned = I.clean_items(items_of(spark, payloads), "Ankara")
    result = I.import_places(cleaned, stored, F.lit("2025-01-01").cast("timestamp"))
    rows = result.outcomes.orderBy("page_index", "pos").collect()
    assert [r.status for r in rows] == ["imported", "skipped", "error", "imported", "error", "skipped", "imported"]
    assert rows[2].reject_reason == "missing_field"
    assert I.import_counts(result.outcomes).first()[:] == (3, 2, 2)
    new = {r.name: r for r in result.new_places.collect()}
    kebap = new["Kırıkkale Kebap"]
    assert (kebap.city, kebap.district, kebap.review_count, kebap.rating) == ("Ankara", "Street 1, Cankaya", 12, 4.5)
    assert (new["Cafe"].latitude, new["Cafe"].operating_hours) == (1.0, None)
    assert new["x" * 255].operating_hours == {"monday": "9–5"}
    again = I.import_places(cleaned, result.new_places.unionByName(result.new_places).select(*stored.columns), F.current_timestamp())
    assert again.new_places.filter("name <> 'Old'").count() == 0


def test_area_import(spark):
    def place(name, data_id, address="Merkez, Kırıkkale"):
        return {"title": name, "data_id": data_id, "address": address, "latitude": 1.5, "longitude": 2.5}

    def page(*places, more=True):
        return json.dumps({"local_results": list(places)} | (token() if more else {}), ensure_ascii=False)

    pages = spark.createDataFrame(
        [
            ("q0", 0, 0, page(place("A", "da"), place("B", None), place("Far", "x", "Ankara"))),
            ("q0", 0, 1, page(place("A", "da"), more=False)),
            ("q1", 1, 0, page(place("C", "dc"), {"title": "No place", "address": "KIRIKKALE kırıkkale"}, more=False)),
            ("q2", 2, 0, "broken"),
        ],
        "source_query string, source_rank int, page_index int, body string",
    )
    review = {"review_id": "r1", "rating": 5, "text": "good"}
    landed = spark.createDataFrame(
        [
            ("da", 0, json.dumps({"reviews": [review, review, {"rating": 1}]} | token())),
            ("da", 1, json.dumps({"reviews": [review | {"text": "better"}]})),
            ("dc", 0, "broken"),
            ("dz", 0, json.dumps({"reviews": [review]})),
        ],
        "target_id string, page_index int, body string",
    )
    stored = spark.createDataFrame([], model.PLACES)
    result = A.import_area(pages, landed, stored, spark.createDataFrame([], model.EXT_REVIEWS), F.lit("2025-01-01").cast("timestamp"))
    summary = result.summary.first().asDict()
    assert summary == {
        "discovered": 6,
        "invalid": 1,
        "imported": 3,
        "skipped": 1,
        "errors": 1,
        "reviews_imported": 2,
        "reviews_updated": 1,
        "reviews_skipped": 1,
        "reviews_rejected": 0,
        "searches_used": 2,
        "with_review_sync": 3,
    }
    outcomes = result.outcomes.orderBy("ordinal").collect()
    assert [(r.ordinal, r.total, r.name, r.status) for r in outcomes] == [
        (1, 5, "A", "imported"),
        (2, 5, "B", "imported"),
        (3, 5, "A", "skipped"),
        (4, 5, "C", "imported"),
        (5, 5, "No place", "error"),
    ]
    stats = {r.pages_fetched: r.changed for r in result.reviews.stats.collect()}
    assert stats == {2: 3}
    assert U.sync_totals(result.reviews.stats).first().imported == 2


def test_tables_round_trip_and_schema_evolution(spark, tmp_path):
    root = str(tmp_path)
    t0 = datetime.datetime(2024, 1, 1)
    old = spark.createDataFrame(
        [("1", "A", "c", "d", t0, t0)],
        "id string, name string, city string, district string, created_at timestamp, updated_at timestamp",
    )
    T.append_rows(old, root, "places")
    T.append_rows(model.conform(old, model.PLACES).withColumns({"id": F.lit("2"), "rating": F.lit(4.5)}), root, "places")
    both = T.read_table(spark, root, "places")
    assert both.columns == model.PLACES.names
    assert {r.id: r.rating for r in both.collect()} == {"1": None, "2": 4.5}
    assert [r.id for r in T.by_ids(both, ["2", "x"]).collect()] == ["2"]
    keys = spark.createDataFrame([("1",), ("1",)], "k string")
    assert [r.id for r in T.by_ids(both, keys).collect()] == ["1"]
    T.write_version(both.filter("id = '2'"), root + "/v2", "places")
    with pytest.raises(Exception):
        T.write_version(both, root + "/v2", "places")
    assert T.read_table(spark, root + "/v2", "places").count() == 1


def test_filters_push_down_to_the_scan(spark, tmp_path):
    root = str(tmp_path)
    t0 = datetime.datetime(2024, 1, 1)
    row = [("f", "u", "p", t0)]
    T.append_rows(spark.createDataFrame(row, model.FAVORITES), root, "favorites")
    df = T.by_ids(T.read_table(spark, root, "favorites"), ["a", "b"], "restaurant_id").select("user_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(restaurant_id" in plan and "created_at" not in plan


def test_kind_tests_do_not_mix_types(spark):
    rows = spark.createDataFrame([('{"a":"[1]","b":[1],"c":"{}","d":{}}',)], "j string")
    f = P.read_fields(F.col("j"), list("abcde"))
    got = rows.select(*[P.is_list(f[k]) for k in "abcde"], *[P.is_object(f[k]) for k in "abcde"]).first()
    assert list(got) == [False, True, False, False, False, False, False, False, True, False]


def files_of(root, name):
    """Data files by bucket."""
    found = {}
    for folder in os.listdir(f"{root}/{name}"):
        if folder.startswith("bucket="):
            found[int(folder[7:])] = {f for f in os.listdir(f"{root}/{name}/{folder}") if f.endswith(".parquet")}
    return found


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    rows = spark.range(1000).selectExpr(
        "CAST(id AS string) AS id", "CAST(id % 200 AS string) AS restaurant_id", "CAST(id AS string) AS user_id", "TIMESTAMP '2024-01-01' AS created_at"
    )
    table = B.write_buckets(rows, str(tmp_path), "favorites", 32)
    before = files_of(tmp_path, "favorites")
    keys = spark.createDataFrame([("7",), ("19",), ("nowhere",)], "restaurant_id string")
    numbers = B.touched(keys, 32)
    part = B.read_buckets(spark, table, keys)
    read = {r[0] for r in part.select(F.input_file_name()).distinct().collect()}
    assert read and all(any(f"bucket={n}/" in f for n in numbers) for f in read)
    # place 7 loses its rows, place 19 gets one more
    more = rows.filter("id = '19'").selectExpr("'new' AS id", "restaurant_id", "user_id", "created_at")
    assert B.replace_places(spark, table, part.filter("restaurant_id <> '7'").unionByName(more), keys) == numbers
    after = files_of(tmp_path, "favorites")
    for number in set(before) - set(numbers):
        assert after[number] == before[number]
    assert all(after[n].isdisjoint(before[n]) for n in set(numbers) & set(after) & set(before))
    expected = {(str(k), str(k % 200)) for k in range(1000) if k % 200 != 7} | {("new", "19")}
    assert {(r.id, r.restaurant_id) for r in B.read_buckets(spark, table).collect()} == expected
    # a bucket that loses all rows loses its files
    alone = spark.createDataFrame([(str(k),) for k in range(200)], "restaurant_id string")
    bucket = numbers[0]
    gone = alone.filter(B.bucket_of("restaurant_id", 32) == bucket)
    B.replace_places(spark, table, B.read_buckets(spark, table, gone).limit(0), gone)
    assert bucket not in files_of(tmp_path, "favorites")
    assert B.replace_places(spark, table, rows, keys.limit(0)) == []


def test_a_large_bucket_has_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "FILE_ROWS", 100)
    rows = spark.range(1000).selectExpr(
        "CAST(id AS string) AS id", "'1' AS restaurant_id", "CAST(id AS string) AS user_id", "TIMESTAMP '2024-01-01' AS created_at"
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    table = B.write_buckets(rows, str(tmp_path), "favorites", 4)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(map(len, files_of(tmp_path, "favorites").values())) > 1
    assert B.read_buckets(spark, table).count() == 1000
