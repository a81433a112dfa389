"""Registered queries: provider pages, text repair, place import and review upsert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder import model
from larder.functions import payload as P
from larder.functions.dates import parse_iso
from larder.functions.text import district_in, repair_text, strip, town_key
from larder.operators import area_import as A, ingest as I, upsert as U
from larder.plans.oracle import over_domain
from larder.plans.registry import register
from larder.session import cut_lineage
from larder.sources import pages as S, testdata as D
from larder.sources.tables import by_ids
from larder.staging import release

ALL_PAGES = 2**31 - 1

_ITEMS = """
located AS (
  SELECT c_custkey AS k, c_name, n_name, r_name, r_regionkey, c_acctbal, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""", """
listed AS (
  SELECT 'places in ' || r_name AS source_query, r_regionkey AS source_rank, * FROM located
  UNION ALL SELECT 'places again', 99, * FROM located WHERE k % 7 = 0)""", """
items AS (
  SELECT *, CAST(k // 100 AS INTEGER) AS page_index,
    CAST(row_number() OVER (PARTITION BY source_rank, k // 100 ORDER BY k) AS INTEGER) AS pos,
    CASE WHEN k % 11 <> 0 THEN c_name || ' Café' END AS place_name,
    CASE WHEN k % 180 = 0 THEN 45.5 WHEN k % 90 <> 0 THEN CAST(k % 90 AS DOUBLE) END AS latitude,
    CAST(k % 180 AS DOUBLE) + 0.5 AS longitude,
    'Street ' || k || ', ' || r_name || '/' || n_name AS address
  FROM listed)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.search_items(D.place_pages(spark, sf_dir), ALL_PAGES)


@register(
    "pages_flatten",
    over_domain(
        *_ITEMS,
        select="SELECT source_query, source_rank, page_index, pos, address FROM items",
    ),
)
def pages_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of all pages in order; ``pos`` counts what is in the list, so the dropped text is 0."""
    return _items(spark, sf_dir).select(
        "source_query",
        "source_rank",
        "page_index",
        "pos",
        F.get_json_object("item", "$.address").alias("address"),
    )


_REVIEW_PAGES = """
paged AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS INTEGER) AS page_index
  FROM events)""",


@register(
    "page_cap",
    "WITH "
    + _REVIEW_PAGES[0]
    + """,
review_pages AS (
  SELECT user_id, page_index, count(*) AS n, (user_id + page_index) % 9 >= 7 AS ends FROM paged GROUP BY ALL),
fetched AS (
  SELECT p.* FROM review_pages p LEFT JOIN (
    SELECT user_id, min(page_index) AS stop FROM review_pages WHERE ends AND page_index < 4 GROUP BY 1) s
  ON s.user_id = p.user_id WHERE page_index < 4 AND (stop IS NULL OR page_index <= stop))
SELECT CAST(user_id AS VARCHAR) AS restaurant_id, page_index, n AS reviews FROM fetched""",
)
def page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages up to the page limit and the first page without a token."""
    fetched = S.fetched_pages(D.review_pages(spark, sf_dir, stops=True), "restaurant_id", 4)
    items = S.page_items(fetched.filter(~F.col("source_failed")), S.REVIEW_LISTS)
    return items.groupBy("restaurant_id", "page_index").agg(F.count(F.lit(1)).alias("reviews"))


@register(
    "payload_keys",
    over_domain(
        *_ITEMS,
        select="""
SELECT key, count(*) AS payloads FROM (SELECT unnest(list_concat(
    ['name', 'address', 'gps_coordinates', 'rating', 'reviews', 'type', 'operating_hours'],
    CASE WHEN k % 11 = 0 OR k % 2 = 0 THEN ['title'] ELSE [] END,
    CASE WHEN k % 180 = 0 THEN ['latitude'] ELSE [] END, CASE WHEN k % 2 = 0 THEN ['data_id'] ELSE [] END,
    CASE WHEN k % 3 = 0 THEN ['place_id'] ELSE [] END)) AS key FROM items) GROUP BY key""",
    ),
)
def payload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.payload_keys(_items(spark, sf_dir))


@register(
    "payload_contains",
    over_domain(
        *_ITEMS,
        select="SELECT source_rank, page_index, pos, contains(lower(address), 'nation_7') AS hit FROM items",
    ),
)
def payload_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = P.any_text_contains(F.col("item"), "Nation_7")
    return _items(spark, sf_dir).select("source_rank", "page_index", "pos", hit.alias("hit"))


@register(
    "payload_area_filter",
    over_domain(
        *_ITEMS,
        select="""
SELECT source_rank, page_index, pos FROM items WHERE (address ILIKE '%nation_1%' OR address ILIKE '%nation_3%')
  AND (address ILIKE '%asia%' OR address ILIKE '%merica%')""".replace("_1", "@_1").replace("_3", "@_3").replace(
            "%')", "%' ESCAPE '@')"
        ).replace("1%' OR", "1%' ESCAPE '@' OR").replace("asia%' OR", "asia%' ESCAPE '@' OR"),
    ),
)
def payload_area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    kept = items.filter(P.mentions_area(F.col("item"), ["nation_1", "nation_3"], ["asia", "merica"]))
    return kept.select("source_rank", "page_index", "pos")


@register("repair_roundtrip", "SELECT doc_id, text AS repaired, text AS untouched FROM documents")
def repair_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged texts come back whole, undamaged ones stay as they are."""
    documents = D.read(spark, sf_dir, "documents").select("doc_id", "text")
    return D.spread(documents, "doc_id").select(
        "doc_id",
        repair_text(D.misread(F.col("text"))).alias("repaired"),
        repair_text(F.col("text")).alias("untouched"),
    )


@register(
    "district_from_address",
    over_domain(
        _ITEMS[0],
        select="""
SELECT k, CASE k % 5 WHEN 0 THEN 'Street ' || k || ', ' || r_name WHEN 1 THEN r_name ELSE 'Unknown' END AS district
FROM located""",
    ),
)
def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, street = F.col("c_custkey"), F.concat(F.lit("Street "), F.col("c_custkey").cast("string"))
    address = (
        F.when(key % 5 == 0, F.concat(street, F.lit(", "), "r_name", F.lit(" / "), "n_name"))
        .when(key % 5 == 1, F.concat(street, F.lit(",, "), "r_name", F.lit(" , "), F.lower("n_name")))
        .when(key % 5 == 2, F.concat("n_name", F.lit(", "), "r_name"))
        .when(key % 5 == 3, F.concat(street, F.lit(", "), "r_name"))
    )
    located = D.located_customers(spark, sf_dir)
    cleaned = located.select(
        key.alias("k"), strip(repair_text(address)).alias("address"), town_key(F.col("n_name")).alias("town")
    )
    return cleaned.select("k", district_in(F.col("address"), F.col("town")).alias("district"))


@register(
    "parse_dates",
    """
SELECT event_id, CASE event_id % 9 WHEN 0 THEN date_trunc('second', ts)
  WHEN 1 THEN date_trunc('second', ts) - INTERVAL 3 HOUR WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('day', ts)
  WHEN 4 THEN date_trunc('minute', ts) WHEN 5 THEN date_trunc('millisecond', ts)
  WHEN 6 THEN date_trunc('second', ts) + INTERVAL 5 HOUR END AS parsed
FROM events""",
)
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("event_id") % 9

    def shown(pattern: str):
        return F.date_format("ts", pattern)

    text = (
        F.when(turn == 0, shown("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(turn == 1, shown("' 'yyyy-MM-dd'T'HH:mm:ss'+03:00 '"))
        .when(turn == 2, shown("yyyyMMdd"))
        .when(turn == 3, shown("yyyy-MM-dd"))
        .when(turn == 4, shown("yyyy-MM-dd HH:mm"))
        .when(turn == 5, shown("yyyy-MM-dd'T'HH:mm:ss','SSS"))
        .when(turn == 6, shown("yyyyMMdd'T'HHmmss'-0500'"))
        .when(turn == 7, shown("yyyy-MM"))
        .otherwise(F.lit("2 weeks ago"))
    )
    events = D.read(spark, sf_dir, "events")
    return events.select("event_id", parse_iso(text).alias("parsed"))


_WHOLE_CENTS = "CAST(round(value * 100) AS BIGINT)"


@register(
    "parse_numbers",
    f"""
SELECT event_id,
  CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN CAST({_WHOLE_CENTS} AS DOUBLE) WHEN 4 THEN 1.0 END AS as_double,
  CASE event_id % 6 WHEN 0 THEN CAST(floor(value) AS INTEGER) WHEN 2 THEN CAST({_WHOLE_CENTS} AS INTEGER) WHEN 4 THEN 1 END AS as_int,
  CASE event_id % 6 WHEN 0 THEN CAST(round_even(value, 0) AS INTEGER) WHEN 1 THEN CAST(round_even(value, 0) AS INTEGER)
    WHEN 2 THEN CAST({_WHOLE_CENTS} AS INTEGER) WHEN 4 THEN 1 END AS as_rating
FROM events""",
)
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, number texts, integer texts, garbage, booleans and nulls of provider JSON."""
    turn, value = F.col("event_id") % 6, F.col("value").cast("string")
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    spelled = (
        F.when(turn == 0, value)
        .when(turn == 1, F.concat(F.lit('" '), value, F.lit('"')))
        .when(turn == 2, F.concat(F.lit('"'), cents, F.lit(' "')))
        .when(turn == 3, F.concat(F.lit('"1,'), cents, F.lit('"')))
        .when(turn == 4, F.lit("true"))
        .otherwise(F.lit("null"))
    )
    rows = D.read(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit('{"n":'), spelled, F.lit("}")).alias("json")
    )
    number = P.read_fields(F.col("json"), ["n"])["n"]
    return rows.select(
        "event_id",
        P.to_double(number).alias("as_double"),
        P.to_int(number).alias("as_int"),
        P.to_rating(number).alias("as_rating"),
    )


# --- place import ------------------------------------------------------------------------------------------------

_VALID = "place_name IS NOT NULL AND latitude IS NOT NULL"
_IMPORT = """
first_seen AS (
  SELECT *, row_number() OVER (PARTITION BY place_name, latitude, longitude
    ORDER BY source_rank, page_index, pos) AS copy FROM items)""", f"""
import_status AS (
  SELECT *, CASE WHEN NOT ({_VALID}) THEN 'error'
    WHEN copy > 1 OR k % 3 = 0 THEN 'skipped' ELSE 'imported' END AS status FROM first_seen)"""


def _stored_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third place is there already, under the name the import will find."""
    places = D.places(spark, sf_dir)
    key = F.col("id").cast("long")
    return places.filter(key % 3 == 0).withColumns(
        {
            "name": F.concat("name", F.lit(" Café")),
            "latitude": F.when(key % 180 == 0, F.lit(45.5)).otherwise(F.col("latitude")),
            "longitude": F.col("longitude") + 0.5,
        }
    )


def _imported(spark: SparkSession, sf_dir: str) -> I.Imported:
    cleaned = I.clean_items(_items(spark, sf_dir), "NATION_7")
    return I.import_places(cleaned, _stored_places(spark, sf_dir), D.as_of())


@register(
    "place_import_status",
    over_domain(
        *_ITEMS,
        *_IMPORT,
        select="SELECT source_rank, page_index, pos, place_name AS name, status FROM import_status",
    ),
)
def place_import_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imported(spark, sf_dir).outcomes.drop("reject_reason")


@register(
    "place_import_counts",
    over_domain(
        *_ITEMS,
        *_IMPORT,
        select="SELECT count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'skipped') AS skipped, "
        "count(*) FILTER (status = 'error') AS errors FROM import_status",
    ),
)
def place_import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.import_counts(_imported(spark, sf_dir).outcomes)


@register(
    "place_import_rows",
    over_domain(
        *_ITEMS,
        *_IMPORT,
        select="""
SELECT place_name AS name, 'NATION_7' AS city,
  CASE WHEN n_name = 'NATION_7' THEN 'Street ' || k || ', ' || r_name ELSE 'Unknown' END AS district,
  latitude, longitude, CAST(k AS INTEGER) AS review_count, c_mktsegment AS category,
  CASE WHEN k % 2 = 0 THEN '0x' || k END AS serpapi_data_id, CAST(NULL AS VARCHAR) AS google_place_id,
  '9–5' AS tuesday, TIMESTAMP '2025-01-01' AS created_at
FROM import_status WHERE status = 'imported'""",
    ),
)
def place_import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned rows that an import appends."""
    return _imported(spark, sf_dir).new_places.select(
        "name",
        "city",
        "district",
        "latitude",
        "longitude",
        "review_count",
        "category",
        "serpapi_data_id",
        "google_place_id",
        F.col("operating_hours")["tuesday"].alias("tuesday"),
        "created_at",
    )


@register(
    "place_import_again",
    over_domain(
        *_ITEMS,
        *_IMPORT,
        select="""
SELECT n AS imported, n AS imported_again, CAST(0 AS BIGINT) AS repeated_ids,
  (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) + 2 * n AS places
FROM (SELECT count(*) AS n FROM import_status WHERE status = 'imported')""",
    ),
)
def place_import_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import, rename what came in, import the same pages again: new places with ids of their own."""
    stored = _stored_places(spark, sf_dir)
    cleaned = I.clean_items(_items(spark, sf_dir), "NATION_7")
    first = cut_lineage(I.import_places(cleaned, stored, D.as_of()).new_places)
    known = stored.unionByName(first.withColumn("name", F.concat("name", F.lit(" renamed"))))
    later = D.as_of() + F.expr("INTERVAL 1 DAY")
    second = I.import_places(cleaned, known, later).new_places
    marked = known.select("id", (F.col("created_at") == D.as_of()).alias("_first")).withColumn("_again", F.lit(False))
    every = marked.unionByName(second.select("id", F.lit(False).alias("_first"), F.lit(True).alias("_again")))
    per_id = every.groupBy("id").agg(
        F.count_if("_first").alias("_first"), F.count_if("_again").alias("_again"), F.count(F.lit(1)).alias("_rows")
    )
    return per_id.agg(
        F.sum("_first").alias("imported"),
        F.sum("_again").alias("imported_again"),
        F.count_if(F.col("_rows") > 1).alias("repeated_ids"),
        F.sum("_rows").alias("places"),
    )


_AREA = """
area AS (SELECT *, contains(address, 'NATION_7') AS kept FROM items)""", f"""
area_first AS (
  SELECT *, row_number() OVER (PARTITION BY place_name, latitude, longitude
    ORDER BY source_rank, page_index, pos) AS copy FROM area WHERE kept)""", f"""
area_status AS (
  SELECT *, CASE WHEN NOT ({_VALID}) THEN 'error' WHEN copy > 1 OR k % 3 = 0 THEN 'skipped'
    ELSE 'imported' END AS status,
    row_number() OVER (ORDER BY source_rank, page_index, pos) AS ordinal, count(*) OVER () AS total FROM area_first)""", """
area_reviews AS (
  SELECT count(*) AS n FROM area_status JOIN events e ON e.user_id = k WHERE status = 'imported' AND k % 2 = 0)"""


def _area(spark: SparkSession, sf_dir: str) -> A.AreaImport:
    return A.import_area(
        D.place_pages(spark, sf_dir),
        D.landed_review_pages(spark, sf_dir),
        _stored_places(spark, sf_dir),
        D.ext_reviews(spark, sf_dir),
        D.as_of(),
        keep=lambda item: P.any_text_contains(item, "nation_7"),
        city="NATION_7",
        search_pages=ALL_PAGES,
        pages_per_place=ALL_PAGES,
    )


@register(
    "area_import_summary",
    over_domain(
        *_ITEMS,
        *_REVIEW_PAGES,
        *_AREA,
        select="""
SELECT (SELECT count(*) FROM area) AS discovered, (SELECT count(*) FROM area WHERE NOT kept) AS invalid,
  count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'skipped') AS skipped,
  count(*) FILTER (status = 'error') AS errors, (SELECT n FROM area_reviews) AS reviews_imported,
  CAST(0 AS BIGINT) AS reviews_updated, CAST(0 AS BIGINT) AS reviews_skipped, CAST(0 AS BIGINT) AS reviews_rejected,
  (SELECT count(DISTINCT source_query) FROM items) AS searches_used,
  count(*) FILTER (status = 'imported') AS with_review_sync
FROM area_status""",
    ),
)
def area_import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches, area filter, import, review sync of the new places, all counters in one row."""
    return _area(spark, sf_dir).summary


@register(
    "area_import_progress",
    over_domain(
        *_ITEMS,
        *_REVIEW_PAGES,
        *_AREA,
        select="SELECT ordinal, total, place_name AS name, status FROM area_status",
    ),
)
def area_import_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _area(spark, sf_dir).outcomes.select("ordinal", "total", "name", "status")


# --- reviews -----------------------------------------------------------------------------------------------------

# Stored are all reviews with an even number. The batch has all reviews, some with other likes or another text, and
# then every tenth one once more. Without a provider id (every fifth) a new text makes a new review.
_UPSERT = """
batch AS (
  SELECT *, event_id % 4 = 0 AS liked, event_id % 8 = 0 AS reworded, 0 AS turn FROM ext_reviews
  UNION ALL
  SELECT *, event_id % 4 = 0, event_id % 8 = 0, 1 FROM ext_reviews WHERE event_id % 10 IN (0, 3))""", """
judged AS (
  SELECT *, CASE WHEN turn = 1 THEN 'skipped'
    WHEN event_id % 2 = 1 OR (reworded AND provider_review_id IS NULL) THEN 'imported'
    WHEN liked THEN 'updated' ELSE 'skipped' END AS status FROM batch)"""


def _stored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = D.review_items(spark, sf_dir).filter(F.col("event_id") % 2 == 0)
    rows = items.select(
        "restaurant_id", F.lit(0).alias("page_index"), F.col("event_id").alias("pos"), "item"
    )
    stored = U.typed_reviews(rows).withColumns(
        {
            "id": F.col("pos").cast("string"),
            "created_at": F.lit("2024-06-01").cast("timestamp"),
            "updated_at": F.lit("2024-06-01").cast("timestamp"),
        }
    )
    return model.conform(stored, model.EXT_REVIEWS)


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = D.review_items(spark, sf_dir)
    liked = F.when(F.col("event_id") % 4 == 0, F.lit(',"likes":1000}')).otherwise(F.lit("}"))
    reworded = F.when(
        F.col("event_id") % 8 == 0,
        F.concat(F.lit(',"review_text":" other words '), F.col("event_id").cast("string"), F.lit(' "'))
    ).otherwise(F.lit(""))
    bare = F.regexp_replace("item", r'(,"likes":\d+)?\}\z', "")
    kept = F.when(F.col("event_id") % 4 == 0, bare).otherwise(F.regexp_replace("item", r"\}\z", ""))
    changed = items.withColumn("item", F.concat(kept, reworded, liked))
    again = changed.filter((F.col("event_id") % 10).isin(0, 3))
    first = changed.select("restaurant_id", F.lit(0).alias("turn"), "event_id", "item")
    second = again.select("restaurant_id", F.lit(1).alias("turn"), "event_id", "item")
    rows = first.unionByName(second)
    return rows.select("restaurant_id", F.col("turn").alias("page_index"), F.col("event_id").alias("pos"), "item")


def _upserted(spark: SparkSession, sf_dir: str) -> U.Upserted:
    incoming = U.typed_reviews(_batch(spark, sf_dir))
    return U.upsert_reviews(incoming, _stored_reviews(spark, sf_dir), D.as_of())


@register(
    "review_fields",
    over_domain(
        select=r"""
SELECT CAST(restaurant_id AS VARCHAR) AS restaurant_id, event_id, author_name, rating,
  regexp_replace(note, '^[\s\x1c-\x1f\x85\pZ]+|[\s\x1c-\x1f\x85\pZ]+$', '', 'g') AS review_text, review_date, likes,
  provider_review_id FROM ext_reviews"""
    ),
)
def review_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = D.review_items(spark, sf_dir).select(
        "restaurant_id", F.lit(0).alias("page_index"), F.col("event_id").alias("pos"), "item"
    )
    return U.typed_reviews(items).select(
        "restaurant_id",
        F.col("pos").alias("event_id"),
        "author_name",
        "rating",
        "review_text",
        "review_date",
        "likes",
        "provider_review_id",
    )


@register(
    "review_fingerprint",
    over_domain(
        select=r"""
SELECT event_id, sha256(lower(author_name) || '|' || coalesce(CAST(rating AS VARCHAR), '') || '|' ||
  lower(regexp_replace(note, '^[\s\x1c-\x1f\x85\pZ]+|[\s\x1c-\x1f\x85\pZ]+$', '', 'g')) || '|' ||
  coalesce(lower(review_date), '')) AS review_hash FROM ext_reviews"""
    ),
)
def review_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = D.review_items(spark, sf_dir).select(
        "restaurant_id", F.lit(0).alias("page_index"), F.col("event_id").alias("pos"), "item"
    )
    return U.typed_reviews(items).select(F.col("pos").alias("event_id"), "review_hash")


@register(
    "review_upsert_status",
    over_domain(
        *_UPSERT,
        select="""
SELECT restaurant_id, turn AS page_index, event_id AS pos, status FROM judged""",
    ),
)
def review_upsert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir).outcomes.drop("reject_reason")


_COUNTED = ", ".join(
    f"count(*) FILTER (status = '{status}') AS {status}" for status in ("imported", "updated", "skipped", "rejected")
)


@register(
    "review_upsert_counts",
    over_domain(
        *_UPSERT,
        select=f"SELECT restaurant_id, {_COUNTED}, count(*) FILTER (status IN ('imported', 'updated')) AS changed "
        "FROM judged GROUP BY restaurant_id",
    ),
)
def review_upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.sync_stats(_upserted(spark, sf_dir).outcomes)


@register(
    "review_upsert_totals",
    over_domain(
        *_UPSERT,
        select=f"SELECT {_COUNTED}, count(*) FILTER (status IN ('imported', 'updated')) AS changed FROM judged",
    ),
)
def review_upsert_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.sync_totals(U.sync_stats(_upserted(spark, sf_dir).outcomes))


@register(
    "review_upsert_state",
    over_domain(
        *_UPSERT,
        """
after AS (
  SELECT restaurant_id, provider_review_id, author_name, rating,
    CASE WHEN reworded THEN 1 ELSE 0 END AS reworded, CASE WHEN liked THEN 1000 ELSE likes END AS likes,
    CASE WHEN status = 'imported' THEN TIMESTAMP '2025-01-01' ELSE TIMESTAMP '2024-06-01' END AS created_at,
    CASE WHEN status = 'skipped' THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '2025-01-01' END AS updated_at
  FROM judged WHERE turn = 0
  UNION ALL
  SELECT restaurant_id, provider_review_id, author_name, rating, 0, likes, TIMESTAMP '2024-06-01', TIMESTAMP '2024-06-01'
  FROM judged WHERE turn = 0 AND event_id % 2 = 0 AND reworded AND provider_review_id IS NULL)""",
        select="""
SELECT restaurant_id, provider_review_id, author_name, rating, CAST(reworded AS INTEGER) AS reworded,
  CAST(likes AS INTEGER) AS likes, created_at, updated_at FROM after""",
    ),
)
def review_upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir).table.select(
        "restaurant_id",
        "provider_review_id",
        "author_name",
        "rating",
        F.coalesce(F.startswith("review_text", F.lit("other words")).cast("int"), F.lit(0)).alias("reworded"),
        "likes",
        "created_at",
        "updated_at",
    )


@register(
    "review_sync_stats",
    over_domain(
        *_REVIEW_PAGES,
        select="""
SELECT CAST(user_id AS VARCHAR) AS restaurant_id, count(DISTINCT page_index) AS pages_fetched,
  count(*) FILTER (event_id % 2 = 1) AS imported, CAST(0 AS BIGINT) AS updated,
  count(*) FILTER (event_id % 2 = 0) AS skipped, CAST(0 AS BIGINT) AS rejected,
  count(*) FILTER (event_id % 2 = 1) AS changed
FROM paged JOIN places p ON p.id = CAST(user_id AS VARCHAR) WHERE user_id % 2 = 0 OR user_id % 3 = 0 GROUP BY user_id""",
    ),
)
def review_sync_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages of all places through paging, typing and upsert."""
    synced = U.sync_reviews(
        D.places(spark, sf_dir),
        D.landed_review_pages(spark, sf_dir),
        _stored_reviews(spark, sf_dir),
        D.as_of(),
        max_pages=ALL_PAGES,
    )
    return synced.stats


@register(
    "review_sync_selected",
    over_domain(
        *_REVIEW_PAGES,
        select="""
SELECT CAST(user_id AS VARCHAR) AS restaurant_id, count(*) FILTER (event_id % 2 = 1) AS changed
FROM paged JOIN places p ON p.id = CAST(user_id AS VARCHAR)
WHERE (user_id % 2 = 0 OR user_id % 3 = 0) AND p.city = 'NATION_7' GROUP BY user_id""",
    ),
)
def review_sync_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sync of the places of one city, given as a list of keys."""
    places = D.places(spark, sf_dir)
    chosen = by_ids(places, places.filter(F.col("city") == "NATION_7").select("id"))
    synced = U.sync_reviews(
        chosen,
        D.landed_review_pages(spark, sf_dir),
        _stored_reviews(spark, sf_dir),
        D.as_of(),
        max_pages=ALL_PAGES,
    )
    return synced.stats.select("restaurant_id", "changed")


_RUNS = _REVIEW_PAGES[0] + """,
eligible AS (SELECT p.* FROM paged p JOIN places q ON q.id = CAST(p.user_id AS VARCHAR) WHERE p.user_id % 2 = 0 OR p.user_id % 3 = 0),
runs AS (SELECT 1 AS run, * FROM eligible WHERE page_index = 0 UNION ALL SELECT 3, * FROM eligible WHERE page_index > 0)"""


@register(
    "review_sync_again",
    over_domain(
        _RUNS,
        select="""
SELECT run, count(DISTINCT (user_id, page_index)) AS pages_parsed, count(DISTINCT (user_id, page_index)) AS pages_applied,
  count(*) FILTER (event_id % 2 = 1) AS imported, count(*) FILTER (event_id % 2 = 0) AS skipped,
  (SELECT count(*) FROM events WHERE event_id % 2 = 0)
    + (SELECT count(*) FROM runs o WHERE o.run <= r.run AND o.event_id % 2 = 1) AS reviews
FROM runs r GROUP BY run
UNION ALL
SELECT 2, 0, 0, 0, 0, (SELECT count(*) FROM events WHERE event_id % 2 = 0) + (SELECT count(*) FROM runs WHERE run = 1 AND event_id % 2 = 1)""",
    ),
)
def review_sync_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pages, the same pages once more, then all pages: what each sync parses, applies and changes."""
    landed = cut_lineage(D.landed_review_pages(spark, sf_dir), "zstd")
    first = landed.filter("page_index = 0")
    table, ledger = _stored_reviews(spark, sf_dir), spark.createDataFrame([], U.LEDGER)
    lines, older = [], []
    for run, pages in enumerate((first, first, landed), 1):
        done = U.sync_new_pages(D.places(spark, sf_dir), pages, table, ledger, D.as_of(), max_pages=ALL_PAGES)
        table, ledger = cut_lineage(done.table, "zstd"), done.ledger
        for staged in (*older, done.pages):  # the table before and the bodies: only the new table read them
            release(staged)
        older = [table]
        totals = U.sync_totals(U.sync_stats(done.outcomes)).select("imported", "skipped")
        counts = [
            done.parsed.agg(F.count(F.lit(1)).alias("pages_parsed")),
            done.applied.agg(F.count(F.lit(1)).alias("pages_applied")),
            totals,
            cut_lineage(table.agg(F.count(F.lit(1)).alias("reviews"))),
        ]
        lines.append(reduce(lambda a, b: a.join(b, "run"), [df.withColumn("run", F.lit(run)) for df in counts]))
    return reduce(DataFrame.unionByName, lines).select(
        "run", "pages_parsed", "pages_applied", "imported", "skipped", "reviews"
    )


@register(
    "payload_repair",
    "SELECT doc_id, text AS named, text AS listed, text AS deep, '1.5' AS number, 'Ã¼' AS damaged_key FROM documents",
)
def payload_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged texts in nested lists and objects; keys, even damaged ones, and numbers stay."""
    rows = D.spread(D.read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    # one projection per step, so that no text is spelled more than once
    spelled = rows.select("doc_id", F.to_json(F.array(D.misread(F.col("text")))).alias("spelled"))
    value = F.substring("spelled", F.lit(2), F.length("spelled") - 2)
    json = F.concat(
        F.lit('{"name":'), value, F.lit(',"list":[1,'), value, F.lit(',{"more":[['), value, F.lit(',1.5]],"Ã¼":null}]}')
    )
    mended = spelled.select("doc_id", json.alias("json")).select("doc_id", P.repaired(F.col("json")).alias("j"))
    return mended.select(
        "doc_id",
        F.get_json_object("j", "$.name").alias("named"),
        F.get_json_object("j", "$.list[1]").alias("listed"),
        F.get_json_object("j", "$.list[2].more[0][0]").alias("deep"),
        F.get_json_object("j", "$.list[2].more[0][1]").alias("number"),
        F.element_at(F.json_object_keys(F.get_json_object("j", "$.list[2]")), -1).alias("damaged_key"),
    )
