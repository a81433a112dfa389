"""Registered queries: statistics and search."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.operators import search as S, stats
from larder.plans.oracle import SHOWN, over_domain
from larder.plans.registry import domain, register
from larder.sources import testdata as D
from larder.staging import new_folder

_LIST = ["id", "name", "city", "district", "category", "rating", "average_rating", "review_count", "created_at"]
_AVERAGE = SHOWN.format("rating_sum", "rated_count")
_SHOWN_PLACE = f"""
shown AS (
  SELECT p.id, p.name, p.city, p.district, p.category, {_AVERAGE} AS rating, {_AVERAGE} AS average_rating,
    coalesce(s.review_count, 0) AS review_count, p.created_at,
    rating_sum / nullif(rated_count, 0) AS exact
  FROM places p LEFT JOIN stats s ON s.restaurant_id = p.id)"""


def _columns(alias: str = "") -> str:
    return ", ".join(f"{alias}{column}" for column in _LIST)


@register(
    "review_stats",
    over_domain(
        select=f"SELECT restaurant_id, CAST(coalesce(rating_sum, 0) AS BIGINT) AS rating_sum, rated_count, "
        f"review_count, {_AVERAGE} AS average_rating FROM stats"
    ),
)
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain(spark, sf_dir)
    return stats.review_stats(t.ext_reviews, t.user_reviews).drop("average_exact")


@register(
    "review_stats_by_source",
    over_domain(
        """
e AS (SELECT restaurant_id, sum(rating) AS s, count(rating) AS n, count(*) AS c FROM ext_reviews GROUP BY 1)""",
        """
u AS (SELECT restaurant_id, sum(rating) AS s, count(rating) AS n, count(*) AS c FROM user_reviews GROUP BY 1)""",
        select=f"""
SELECT coalesce(e.restaurant_id, u.restaurant_id) AS restaurant_id, e.c AS ext_review_count,
  u.c AS user_review_count, coalesce(e.c, 0) + coalesce(u.c, 0) AS review_count,
  {SHOWN.format("(coalesce(e.s, 0) + coalesce(u.s, 0))", "(coalesce(e.n, 0) + coalesce(u.n, 0))")} AS average_rating
FROM e FULL JOIN u ON e.restaurant_id = u.restaurant_id""",
    ),
)
def review_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain(spark, sf_dir)
    both = stats.combine_stats(stats.source_stats(t.ext_reviews), stats.source_stats(t.user_reviews))
    return both.select(
        "restaurant_id", "ext_review_count", "user_review_count", "review_count", "average_rating"
    )


# A search result of the registered queries is the whole list of matches; pages are registered on their own.
def _matches(spark: SparkSession, sf_dir: str, text: bool = False, **filters) -> DataFrame:
    df = S.matching_places(domain(spark, sf_dir, text), S.Query(**filters))
    return df.withColumn("rating", F.col("average_rating")).select(*_LIST)


@register(
    "search_text",
    over_domain(
        _SHOWN_PLACE,
        select=rf"""
SELECT {_columns()} FROM shown p
WHERE p.name ILIKE '%theron%' ESCAPE '\' OR p.city ILIKE '%theron%' ESCAPE '\' OR p.district ILIKE '%theron%' ESCAPE '\'
  OR p.category ILIKE '%theron%' ESCAPE '\'
  OR EXISTS (SELECT 1 FROM menu_items m WHERE m.restaurant_id = p.id AND m.name ILIKE '%theron%' ESCAPE '\')
  OR EXISTS (SELECT 1 FROM user_reviews r WHERE r.restaurant_id = p.id AND r.comment ILIKE '%theron%' ESCAPE '\')
  OR EXISTS (SELECT 1 FROM ext_reviews x WHERE x.restaurant_id = p.id AND x.review_text ILIKE '%theron%' ESCAPE '\')""".replace(
            "%theron%", "%large%w_dget%"
        ),
    ),
)
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term has wildcards of its own and hits dishes and texts."""
    return _matches(spark, sf_dir, text=True, search=" LARGE%w_dget ")


@register(
    "search_review_text",
    over_domain(
        _SHOWN_PLACE,
        select=rf"""
SELECT {_columns()} FROM shown p
WHERE concat_ws(chr(10), p.name, p.city, p.district, p.category) ILIKE '%theron%' ESCAPE '\'
  OR p.id IN (SELECT restaurant_id FROM menu_items WHERE name ILIKE '%theron%' ESCAPE '\')
  OR p.id IN (SELECT restaurant_id FROM user_reviews WHERE comment ILIKE '%theron%' ESCAPE '\')
  OR p.id IN (SELECT restaurant_id FROM ext_reviews WHERE review_text ILIKE '%theron%' ESCAPE '\')""",
    ),
)
def search_review_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, text=True, search="theron")


_TERMS = ["theron", "LARGE%w_dget", "ring", "e_", "EUROPE", "tion the"]


@register(
    "search_indexed",
    over_domain(
        "terms AS (SELECT unnest([" + ", ".join(f"'{term}'" for term in _TERMS) + "]) AS term)",
        """
texts AS (
  SELECT id, unnest([name, city, district, category]) AS text FROM places UNION ALL SELECT restaurant_id, name FROM menu_items
  UNION ALL SELECT restaurant_id, comment FROM user_reviews UNION ALL SELECT restaurant_id, review_text FROM ext_reviews)""",
        select=r"""
SELECT DISTINCT term, id FROM terms JOIN texts ON text ILIKE '%' || term || '%' ESCAPE '\' WHERE id IN (SELECT id FROM places)""",
    ),
)
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several terms through one trigram index; one of them has no trigram and scans."""
    t = domain(spark, sf_dir, text=True)
    index = S.build_index(t, new_folder(spark))
    found = [
        S.matching_places(t, S.Query(search=term), index).select(F.lit(term).alias("term"), "id") for term in _TERMS
    ]
    return reduce(DataFrame.union, found)


@register(
    "search_category_semi",
    over_domain(
        _SHOWN_PLACE,
        select=f"SELECT {_columns()} FROM shown p WHERE EXISTS "
        "(SELECT 1 FROM menu_items m WHERE m.restaurant_id = p.id AND m.category = 'ECONOMY')",
    ),
)
def search_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, category="ECONOMY")


@register(
    "search_city_district",
    over_domain(
        _SHOWN_PLACE,
        select=f"SELECT {_columns()} FROM shown WHERE city = 'NATION_7' AND district = "
        "(SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_7')",
    ),
)
def search_city_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain(spark, sf_dir)
    district = t.places.filter(F.col("city") == "NATION_7").select("district").first()
    return _matches(spark, sf_dir, city="NATION_7", district=district[0] if district else "")


@register(
    "search_min_rating",
    over_domain(_SHOWN_PLACE, select=f"SELECT {_columns()} FROM shown WHERE exact >= 3.25"),
)
def search_min_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, minimum_rating=3.25)


def _page_sql(order: str, limit: int, offset: int, where: str = "true") -> str:
    return over_domain(
        _SHOWN_PLACE,
        select=f"SELECT {_columns()} FROM shown WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}",
    )


def _page(spark: SparkSession, sf_dir: str, **query) -> DataFrame:
    return S.search_places(domain(spark, sf_dir), S.Query(**query)).select(*_LIST)


@register("search_sorted_page_name", _page_sql("name, created_at DESC, id", 20, 40))
def page_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, sort="name", limit=20, offset=40)


@register(
    "search_sorted_page_rating", _page_sql("exact DESC NULLS LAST, created_at DESC, id", 100, 30)
)
def page_by_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, sort="rating", limit=100, offset=30)


@register("search_sorted_page_created", _page_sql("created_at DESC, id", 20, 0))
def page_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir)


# Deep pages: selected range by range instead of a bounded top-k.
for _name, _sort, _by in (
    ("name", "name", "name, created_at DESC, id"),
    ("rating", "rating", "exact DESC NULLS LAST, created_at DESC, id"),
    ("created", "created_at", "created_at DESC, id"),
):
    register(f"search_deep_page_{_name}", _page_sql(_by, 50, 700))(
        partial(_page, sort=_sort, limit=50, offset=700)
    )


_SEARCH_PAGE = """
exact >= 2.5 AND id IN (
  SELECT restaurant_id FROM menu_items WHERE name ILIKE '%ring%'
  UNION SELECT restaurant_id FROM user_reviews WHERE comment ILIKE '%ring%'
  UNION SELECT restaurant_id FROM ext_reviews WHERE review_text ILIKE '%ring%'
  UNION SELECT id FROM places WHERE concat_ws(chr(10), name, city, district, category) ILIKE '%ring%')"""


@register(
    "search_page", _page_sql("exact DESC NULLS LAST, created_at DESC, id", 50, 0, where=_SEARCH_PAGE)
)
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, minimum rating, order and page in one plan."""
    query = S.Query(search="ring", minimum_rating=2.5, sort="rating", limit=50)
    return S.search_places(domain(spark, sf_dir, text=True), query).select(*_LIST)


_TOTAL = "(SELECT count(*) AS total FROM places WHERE district = 'ASIA')"


@register("search_total", over_domain(select=f"SELECT total FROM {_TOTAL}"))
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_total(domain(spark, sf_dir), S.Query(district="ASIA"))


@register(
    "page_facts",
    over_domain(
        select=f"""
SELECT total, CAST(12 // 6 + 1 AS INTEGER) AS current_page,
  CAST(greatest(1, ceil(total / 6.0)) AS INTEGER) AS total_pages, true AS has_previous,
  12 + 6 < total AS has_next, CAST(6 AS INTEGER) AS previous_offset, CAST(18 AS INTEGER) AS next_offset
FROM {_TOTAL}"""
    ),
)
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page_facts(search_total(spark, sf_dir), limit=6, offset=12)


@register(
    "rating_fold",
    over_domain(
        f"""
fresh AS (SELECT CAST(o_custkey AS VARCHAR) AS restaurant_id,
    CAST(substring(o_orderpriority, 1, 1) AS INTEGER) + o_orderkey % 2 AS rating
  FROM orders WHERE o_orderstatus <> 'F')""",
        """
counted AS (SELECT restaurant_id, sum(CASE WHEN rating BETWEEN 1 AND 5 THEN rating END) AS s,
    count(CASE WHEN rating BETWEEN 1 AND 5 THEN 1 END) AS n, count(*) AS c FROM fresh GROUP BY 1)""",
        """
merged AS (SELECT restaurant_id, sum(rating_sum) AS rating_sum, CAST(sum(rated_count) AS BIGINT) AS rated_count,
    CAST(sum(review_count) AS BIGINT) AS review_count
  FROM (SELECT * FROM stats UNION ALL SELECT restaurant_id, s, n, c FROM counted) GROUP BY 1)""",
        select=f"SELECT restaurant_id, rated_count, review_count, {_AVERAGE} AS average_rating FROM merged",
    ),
)
def rating_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are not finished come in as new reviews, each of them twice, together with all known ones."""
    t = domain(spark, sf_dir)
    known = t.user_reviews
    rows = D.read(spark, sf_dir, "orders")
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    once = rows.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("restaurant_id"),
        (digit + (F.col("o_orderkey") % 2).cast("int")).alias("rating"),
        (F.col("o_orderkey") * 2).alias("seq"),
    )
    batch = once.unionByName(once.withColumn("seq", F.col("seq") + 1))
    folded = stats.fold_reviews(stats.review_stats(t.ext_reviews, known), known, batch)
    return folded.select("restaurant_id", "rated_count", "review_count", "average_rating")
