import datetime

import pytest
from pyspark.sql import functions as F

from larder import model
from larder.operators import search as S
from larder.operators.profiles import ROW_BYTES, place_profiles, profile_parts
from larder.operators.reviews import ranked_reviews, unified_reviews
from larder.operators.selection import page_rows
from larder.operators.stats import combine_stats, review_stats, source_stats
from larder.operators.text_index import build_text_index, candidates, literal_runs, open_text_index, places_with_text, trigrams_of
from larder.plans.registry import domain

DAY = datetime.datetime(2024, 1, 1)


def frame(spark, schema, rows):
    data = [tuple(row.get(f.name) for f in schema.fields) for row in rows]
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def tables(spark):
    def place(i, **more):
        return {
            "id": str(i),
            "name": f"Place {i}",
            "city": "Ankara",
            "district": "Center",
            "rating": 1.0,
            "review_count": 99,
            "created_at": DAY,
            "updated_at": DAY,
        } | more

    def user(i, place, rating, comment=None):
        return {
            "id": f"u{i}",
            "user_id": f"{i}",
            "restaurant_id": str(place),
            "rating": rating,
            "comment": comment,
            "created_at": DAY + datetime.timedelta(days=i),
            "updated_at": DAY,
        }

    def ext(i, place, rating, text=None, date=None):
        return {
            "id": f"e{i}",
            "restaurant_id": str(place),
            "rating": rating,
            "review_text": text,
            "review_date": date,
            "review_hash": f"h{i}",
            "raw_json": "{}",
            "created_at": DAY,
            "updated_at": DAY,
        }

    users = [user(i, 1, 4 + (i < 23)) for i in range(50)] + [user(60, 2, 3, "great axxb soup")]
    externals = [ext(1, 3, None, "LENTIL"), ext(2, 2, 5, None, "2024-03-01"), ext(3, 2, 4, None, "2 weeks ago")]
    menu = [
        {
            "id": f"m{i}",
            "restaurant_id": str(i % 3 + 1),
            "name": f"dish {i}",
            "price": None,
            "category": "soup" if i == 4 else "main",
            "created_at": DAY,
            "updated_at": DAY,
        }
        for i in range(9)
    ]
    from decimal import Decimal

    for i, row in enumerate(menu):
        row["price"] = Decimal(f"{i}.50")
    return S.Tables(
        frame(spark, model.PLACES, [place(i) for i in range(1, 6)] + [place(6, city="", description="100% lentils")]),
        frame(spark, model.MENU_ITEMS, menu),
        frame(spark, model.USER_REVIEWS, users),
        frame(spark, model.EXT_REVIEWS, externals),
    )


def ids(df):
    return sorted(r.id for r in df.collect())


def test_minimum_rating_uses_the_unrounded_value(tables):
    # 50 reviews: 23 fives and 27 fours are 4.46, shown as 4.5.
    shown = S.matching_places(tables, S.Query()).filter("id = '1'").first()
    assert shown.average_rating == 4.5
    assert "1" not in ids(S.matching_places(tables, S.Query(minimum_rating=4.5)))
    assert ids(S.matching_places(tables, S.Query(minimum_rating=4.0))) == ["1", "2"]


def test_unrated_and_unreviewed_places(tables):
    rows = {r.id: r for r in S.search_places(tables, S.Query()).collect()}
    assert (rows["3"].average_rating, rows["3"].review_count) == (None, 1)
    assert (rows["4"].rating, rows["4"].review_count) == (None, 0)
    assert rows["2"].rating == rows["2"].average_rating == 4.0


def test_text_filters(tables):
    assert ids(S.matching_places(tables, S.Query(search="  "))) == list("123456")
    assert ids(S.matching_places(tables, S.Query(search="a%b soup"))) == ["2"]
    assert ids(S.matching_places(tables, S.Query(search="lentil"))) == ["3", "6"]
    assert ids(S.matching_places(tables, S.Query(search="100\\% l"))) == ["6"]
    assert ids(S.matching_places(tables, S.Query(search="DISH 4"))) == ["2"]
    assert ids(S.matching_places(tables, S.Query(city=""))) == ["6"]
    assert ids(S.matching_places(tables, S.Query(city="ankara"))) == []
    assert ids(S.matching_places(tables, S.Query(category="soup"))) == ["2"]
    assert S.search_total(tables, S.Query(minimum_rating=1)).first()[0] == 2


def test_wrong_arguments():
    for wrong in ({"minimum_rating": 0.5}, {"sort": "x"}, {"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            S.Query(**wrong)


@pytest.mark.parametrize("sort", S.SORTS)
def test_deep_pages_equal_top_k(spark, monkeypatch, sort):
    t = domain(spark, "/root/testdata/sf0.001")
    query = S.Query(sort=sort, limit=25, offset=37)
    plain = [tuple(r) for r in S.search_places(t, query).select("id", "average_rating").collect()]
    monkeypatch.setattr(S, "TOP_K_DEPTH", 0)
    deep = [tuple(r) for r in S.search_places(t, query).select("id", "average_rating").collect()]
    assert deep == plain and len(deep) == 25


def test_page_facts(spark):
    total = spark.createDataFrame([(13,), (0,)], "total long")
    rows = {r.total: r for r in S.page_facts(total, 6, 6).collect()}
    assert rows[13][1:] == (2, 3, True, True, 0, 12)
    assert rows[0].total_pages == 1 and not rows[0].has_next


def test_both_forms_of_statistics_agree(spark):
    t = domain(spark, "/root/testdata/sf0.001")
    names = ["restaurant_id", "rating_sum", "rated_count", "review_count", "average_rating"]
    one = review_stats(t.ext_reviews, t.user_reviews).select(*names)
    two = combine_stats(source_stats(t.ext_reviews), source_stats(t.user_reviews)).select(*names)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_unified_order(tables):
    rows = ranked_reviews(unified_reviews(tables.ext_reviews, tables.user_reviews)).filter("restaurant_id = '2'")
    got = [(r.id, r.rating) for r in rows.orderBy("position").collect()]
    # Both dates are 2024-03-01, so the external one goes first; the unreadable date goes last.
    assert got == [("e2", 5), ("u60", 3), ("e3", 4)]
    unrated = unified_reviews(tables.ext_reviews, tables.user_reviews).filter("id = 'e1'").first()
    assert (unrated.rating, unrated.created_at) == (0, DAY)


@pytest.mark.parametrize("part_bytes", [1, 250, 1 << 20])
def test_profiles_keep_everything_in_order(spark, tables, part_bytes):
    whole, numbers = {}, {}
    for row in place_profiles(tables, part_bytes).orderBy("id", "part").collect():
        menu, reviews = whole.setdefault(row.id, ([], []))
        numbers.setdefault(row.id, []).append(row.part)
        held = [len(i.id) + len(i.name) + len(i.category) + ROW_BYTES for i in row.menu_items]
        held += [sum(len(x or "") for x in (r.id, r.user_id, r.comment, r.source)) + ROW_BYTES for r in row.reviews]
        assert sum(held[:-1]) <= part_bytes
        menu += [item.id for item in row.menu_items]
        reviews += [review.id for review in row.reviews]
    assert set(whole) == set("123456")
    ranked = ranked_reviews(unified_reviews(tables.ext_reviews, tables.user_reviews))
    for place in "123":
        order = ranked.filter(F.col("restaurant_id") == place).orderBy("position")
        assert whole[place][1] == [r.id for r in order.collect()]
        assert whole[place][0] == sorted(whole[place][0]) and len(whole[place][0]) == 3
    assert whole["5"] == ([], []) and numbers["5"] == [0]
    assert all(len(set(found)) == len(found) for found in numbers.values())
    if part_bytes == 1 << 20:
        assert all(found == [0] for found in numbers.values())
    assert place_profiles(tables, part_bytes).schema == place_profiles(tables).schema


def test_profile_parts_do_not_depend_on_the_partitions(spark, tables):
    found = []
    for partitions in (1, 7):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        parts = place_profiles(tables, 300).select("id", "part", "menu_items.id", "reviews.id")
        found.append(sorted(map(str, parts.collect())))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found[0] == found[1]


def test_profile_parts_of_hot_places_are_the_same(spark, tables):
    found = [
        sorted(map(str, profile_parts(tables, 300, hot_rows).select("restaurant_id", "part", "menu_items.id", "reviews.id").collect()))
        for hot_rows in (0, 4, 1000)
    ]
    assert found[0] == found[1] == found[2]


def test_profile_rows_are_shuffled_once(spark, tables):
    """The rows of places that a task can hold are neither staged nor shuffled again for the sums and the lists."""
    plan = profile_parts(tables, 300)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "staged-" not in plan


PATTERNS = ["  ", "a%b soup", "lentil", "100\\% l", "DISH 4", "axxb", "a_xb", "zzz", "ish", "ENTI", "t", "e 3", "great%soup", "\\LENT"]


def test_index_finds_what_a_scan_finds(spark, tables):
    from larder.staging import new_folder

    path = new_folder(spark)
    S.build_index(tables, path)
    index = open_text_index(spark, path)
    for pattern in PATTERNS:
        plain, found = (ids(S.matching_places(tables, S.Query(search=pattern), x)) for x in (None, index))
        assert found == plain, pattern


def test_index_reads_candidates_only(spark, tables, monkeypatch):
    from larder.staging import new_folder

    texts = spark.range(5000).selectExpr("'t' AS source", "CAST(id % 50 AS string) AS restaurant_id", "concat('note ', id, ' end') AS text")
    index = build_text_index(texts, new_folder(spark), block_rows=64)
    assert candidates(index, trigrams_of(spark, "%e 1234 e%")).select("text").collect() == [("note 1234 end",)]
    assert candidates(index, trigrams_of(spark, "%nope%")).isEmpty()
    assert sorted(r[0] for r in places_with_text(index, "%e 12_4 e%").collect()) == sorted({str((1204 + 10 * k) % 50) for k in range(10)})
    assert index.postings.selectExpr("max(size(slots))").first()[0] <= 64
    assert places_with_text(index, "%1_3%") is None
    assert literal_runs("%a\\%b_c\\\\%") == ["a%b", "c\\"]


def test_index_lists_every_trigram_of_every_block(spark, monkeypatch):
    from larder.operators import text_index
    from larder.staging import new_folder

    found = ["", "ab", "İIß 😀😀😀x", "a\0b\0", "line\nline", "ÀÉÎ çöğ", "note " * 50, "\U0010ffff\U0010ffffz"]
    rows = [("t", str(k % 7), found[k % len(found)] + (str(k) if k % 3 else "")) for k in range(200)]
    texts = spark.createDataFrame(rows, "source string, restaurant_id string, text string")
    index = build_text_index(texts, new_folder(spark), block_rows=16)
    expected = {}
    for row in index.texts.selectExpr("block", "slot", "lower(text) AS text").collect():
        for k in range(len(row.text) - 2):
            expected.setdefault((row.text[k : k + 3], row.block), set()).add(row.slot)
    got = {(r.trigram, r.block): r.slots for r in index.postings.collect()}
    assert index.postings.count() == len(got)
    assert got == {key: sorted(slots) for key, slots in expected.items()}
    monkeypatch.setattr(text_index, "_PIECE", 5)  # pieces end inside texts
    lowered = index.texts.selectExpr("block", "slot", "lower(text) AS text").sort("block").toArrow()
    again = [row for batch in text_index._postings(iter(lowered.to_batches(7))) for row in batch.to_pylist()]
    assert {(r["trigram"], r["block"]): r["slots"] for r in again} == got and len(again) == len(got)


def test_pages_of_a_long_order(spark):
    rows = [(k * 7919 % 3001, ["b", "a", None][k % 3], k % 5) for k in range(3001)]
    df = spark.createDataFrame(rows, "id long, name string, x int").repartition(5)
    keys = [F.col("x"), F.col("name").isNull(), F.col("name"), F.col("id")]
    expected = sorted(rows, key=lambda r: (r[2], r[1] is None, r[1] or "", r[0]))
    for offset, limit in ((0, 10), (1234, 25), (2990, 40), (2999, 1), (3001, 5), (9000, 5)):
        got = [tuple(r) for r in page_rows(df, keys, offset, limit, depth=20)]
        assert got == expected[offset : offset + limit]
    assert page_rows(df.limit(0), keys, 50, 10, depth=20) == []
