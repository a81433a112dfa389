"""Registered queries: unified reviews, profiles, favorites, hours and contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from larder.functions.details import LINK_KEYS, link_parameter
from larder.operators import contacts, favorites as fav
from larder.operators.changes import Changed, toggle_favorites
from larder.operators.profiles import place_profiles
from larder.operators.reviews import ranked_reviews, unified_reviews
from larder.operators.stats import review_stats
from larder.plans.oracle import SHOWN, over_domain
from larder.plans.registry import domain, register
from larder.session import cut_lineage
from larder.sources import testdata as D
from larder.sources.tables import by_ids

_AVERAGE = SHOWN.format("rating_sum", "rated_count")
_UNIFIED = """
unified AS (
  SELECT restaurant_id, id, CAST(NULL AS VARCHAR) AS user_id, coalesce(rating, 0) AS rating, review_text AS comment,
    coalesce(CAST(review_date AS TIMESTAMP), created_at) AS created_at, author_name, likes, 'google' AS source,
    CAST(review_date AS TIMESTAMP) AS sort_ts
  FROM ext_reviews
  UNION ALL
  SELECT restaurant_id, id, user_id, rating, comment, created_at, NULL, NULL, 'user', created_at FROM user_reviews)"""
_RANKED = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY restaurant_id
    ORDER BY sort_ts DESC NULLS LAST, CASE source WHEN 'google' THEN 0 ELSE 1 END, id) AS position
  FROM unified)"""


@register(
    "unified_reviews",
    over_domain(
        _UNIFIED,
        _RANKED,
        select="SELECT restaurant_id, position, id, user_id, rating, comment, created_at, author_name, likes, source "
        "FROM ranked",
    ),
)
def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain(spark, sf_dir, text=True)
    return ranked_reviews(unified_reviews(t.ext_reviews, t.user_reviews)).select(
        "restaurant_id",
        "position",
        "id",
        "user_id",
        "rating",
        "comment",
        "created_at",
        "author_name",
        "likes",
        "source",
    )


@register("place_profiles")
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested form; ``place_profiles_flat`` and ``place_profile_reviews`` check its content."""
    return place_profiles(domain(spark, sf_dir, text=True))


@register(
    "place_profiles_flat",
    over_domain(
        _UNIFIED,
        _RANKED,
        """
menu AS (SELECT restaurant_id, count(*) AS n, sum(price) AS total FROM menu_items GROUP BY 1)""",
        """
edges AS (SELECT restaurant_id, min_by(id, position) AS first_id, max_by(id, position) AS last_id
  FROM ranked GROUP BY 1)""",
        select=f"""
SELECT p.id, p.name, p.city, {_AVERAGE} AS rating, {_AVERAGE} AS average_rating,
  coalesce(s.review_count, 0) AS review_count, coalesce(s.review_count, 0) AS listed_reviews,
  coalesce(m.n, 0) AS menu_size, CAST(coalesce(m.total, 0) AS DOUBLE) AS menu_total,
  e.first_id AS first_review_id, e.last_id AS last_review_id
FROM places p LEFT JOIN stats s ON s.restaurant_id = p.id LEFT JOIN menu m ON m.restaurant_id = p.id
LEFT JOIN edges e ON e.restaurant_id = p.id""",
    ),
)
def profiles_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures taken from the nested profiles, parts of a large place added up."""
    parts = place_profiles(domain(spark, sf_dir, text=True))
    cents = F.aggregate(
        "menu_items",
        F.lit(0).cast("decimal(20,2)"),
        lambda total, item: (total + item["price"].cast("decimal(10,2)")).cast("decimal(20,2)"),
    )
    filled = F.size("reviews") > 0
    return parts.groupBy("id", "name", "city", "rating", "average_rating", "review_count").agg(
        F.sum(F.size("reviews")).alias("listed_reviews"),
        F.sum(F.size("menu_items")).alias("menu_size"),
        F.sum(cents).cast("double").alias("menu_total"),
        F.min_by(F.try_element_at("reviews", F.lit(1))["id"], F.when(filled, F.col("part"))).alias(
            "first_review_id"
        ),
        F.max_by(F.try_element_at("reviews", F.lit(-1))["id"], F.when(filled, F.col("part"))).alias(
            "last_review_id"
        ),
    )


@register(
    "place_profile_reviews",
    over_domain(
        _UNIFIED,
        _RANKED,
        select="SELECT restaurant_id, position, id AS review_id, source, rating, created_at, md5(comment) AS comment_md5 "
        "FROM ranked",
    ),
)
def profile_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review arrays of the nested profiles, element by element."""
    shown = F.transform(
        "reviews",
        lambda r: F.struct(r["id"].alias("id"), r["source"].alias("source"), r["rating"].alias("rating"), r["created_at"].alias("created_at"),
            F.unhex(F.md5(r["comment"])).alias("digest")),
    )
    parts = cut_lineage(place_profiles(domain(spark, sf_dir, text=True), 1 << 16).select("id", "part", shown.alias("reviews")))
    earlier = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.select("id", "part", F.coalesce(F.sum(F.size("reviews")).over(earlier), F.lit(0)).alias("before"))
    listed = parts.join(sizes, ["id", "part"]).select(
        F.col("id").alias("restaurant_id"), "before", F.posexplode("reviews").alias("at", "review")
    )
    return listed.select(
        "restaurant_id",
        (F.col("before") + F.col("at") + 1).cast("long").alias("position"),
        F.col("review.id").alias("review_id"),
        "review.source",
        "review.rating",
        "review.created_at",
        F.lower(F.hex("review.digest")).alias("comment_md5"),
    )


_PART_BYTES = 4096


@register(
    "place_profile_parts",
    over_domain(
        _UNIFIED,
        _RANKED,
        """
dishes AS (SELECT * REPLACE (id || ':' || CAST(CAST(price AS DOUBLE) AS VARCHAR) AS id) FROM menu_items)""",
        """
rows_of AS (
  SELECT restaurant_id, 0 AS rank, 0 AS position, id, name AS shown, category AS more, price AS figure,
    64 + strlen(id) + strlen(name) + strlen(category) AS bytes FROM dishes
  UNION ALL
  SELECT restaurant_id, 1, position, id, source, coalesce(user_id, author_name), rating,
    64 + strlen(id) + coalesce(strlen(user_id), 0) + coalesce(strlen(comment), 0) + coalesce(strlen(author_name), 0) + strlen(source)
  FROM ranked)""",
        f"""
parted AS (
  SELECT *, coalesce(sum(bytes) OVER (PARTITION BY restaurant_id ORDER BY rank, position, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {_PART_BYTES} AS part FROM rows_of)""",
        """
listed AS (
  SELECT restaurant_id, part, string_agg(id || '/' || shown || '/' || more, ';' ORDER BY id) FILTER (rank = 0) AS menu,
    string_agg(id || '/' || shown || '/' || more, ';' ORDER BY position) FILTER (rank = 1) AS reviews,
    sum(CASE WHEN rank = 0 THEN CAST(round(figure * 100) AS BIGINT) END) AS cents, sum(CASE WHEN rank = 1 THEN figure END) AS ratings
  FROM parted GROUP BY 1, 2)""",
        select=f"""
SELECT p.id, p.name, {_AVERAGE} AS average_rating, coalesce(s.review_count, 0) AS review_count,
  CAST(coalesce(l.part, 0) AS BIGINT) AS part, coalesce(menu, '') AS menu, coalesce(reviews, '') AS reviews,
  CAST(coalesce(cents, 0) AS BIGINT) AS cents, CAST(coalesce(ratings, 0) AS BIGINT) AS ratings
FROM places p LEFT JOIN stats s ON s.restaurant_id = p.id LEFT JOIN listed l ON l.restaurant_id = p.id""",
    ),
)
def profile_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles in small parts: what each part holds, in order."""
    parts = place_profiles(domain(spark, sf_dir, text=True), _PART_BYTES)

    def joined(name: str, *fields) -> Column:
        return F.array_join(F.transform(name, lambda item: F.concat_ws("/", *[field(item) for field in fields])), ";")

    def total(name: str, value) -> Column:
        return F.aggregate(name, F.lit(0).cast("long"), lambda sum_, item: sum_ + value(item))

    return parts.select(
        "id",
        "name",
        "average_rating",
        "review_count",
        "part",
        joined("menu_items", lambda x: x["id"], lambda x: x["name"], lambda x: x["category"]).alias("menu"),
        joined("reviews", lambda x: x["id"], lambda x: x["source"], lambda x: F.coalesce(x["user_id"], x["author_name"])).alias("reviews"),
        total("menu_items", lambda x: F.round(x["price"] * 100).cast("long")).alias("cents"),
        total("reviews", lambda x: x["rating"].cast("long")).alias("ratings"),
    )


_CHOSEN = ["1", "2", "3", "50", "51", "none"]


@register(
    "place_profile_by_id",
    over_domain(
        _UNIFIED,
        select=f"""
SELECT p.id, p.name, {_AVERAGE} AS average_rating, coalesce(s.review_count, 0) AS review_count,
  (SELECT count(*) FROM unified r WHERE r.restaurant_id = p.id) AS listed_reviews,
  (SELECT CAST(coalesce(sum(length(r.comment)), 0) AS BIGINT) FROM unified r WHERE r.restaurant_id = p.id) AS comment_chars,
  (SELECT count(*) FROM menu_items m WHERE m.restaurant_id = p.id) AS menu_size
FROM places p LEFT JOIN stats s ON s.restaurant_id = p.id WHERE p.id IN ('1', '2', '3', '50', '51')""",
    ),
)
def profile_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of given places: only their rows are read."""
    parts = place_profiles(domain(spark, sf_dir, text=True), ids=_CHOSEN)
    chars = F.aggregate(
        "reviews", F.lit(0).cast("long"), lambda total, r: total + F.coalesce(F.length(r["comment"]), F.lit(0))
    )
    return parts.groupBy("id", "name", "average_rating", "review_count").agg(
        F.sum(F.size("reviews")).alias("listed_reviews"),
        F.sum(chars).alias("comment_chars"),
        F.sum(F.size("menu_items")).alias("menu_size"),
    )


@register(
    "favorite_places_of_user",
    over_domain(
        select=f"""
SELECT f.restaurant_id, p.name, p.city, {_AVERAGE} AS average_rating, coalesce(s.review_count, 0) AS review_count
FROM favorites f JOIN places p ON p.id = f.restaurant_id LEFT JOIN stats s ON s.restaurant_id = p.id
WHERE f.user_id = '42'"""
    ),
)
def favorite_places_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places one user has saved, with their statistics; reviews of other places are not read."""
    t = domain(spark, sf_dir)
    mine = fav.favorites_of(D.favorites(spark, sf_dir), "42")
    keys = mine.select("restaurant_id")
    near = [by_ids(table, keys, "restaurant_id") for table in (t.ext_reviews, t.user_reviews)]
    stats = review_stats(*near).select(F.col("restaurant_id").alias("id"), "average_rating", "review_count")
    rows = by_ids(t.places, keys).select("id", "name", "city").join(stats, "id", "left")
    rows = rows.withColumn("review_count", F.coalesce("review_count", F.lit(0).cast("long")))
    return fav.favorite_places(mine, rows).drop("user_id")


@register(
    "favorite_places",
    over_domain(
        select=f"""
SELECT f.user_id, f.restaurant_id, p.name, p.city, {_AVERAGE} AS average_rating,
  coalesce(s.review_count, 0) AS review_count
FROM favorites f JOIN places p ON p.id = f.restaurant_id LEFT JOIN stats s ON s.restaurant_id = p.id"""
    ),
)
def favorite_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain(spark, sf_dir)
    stats = review_stats(t.ext_reviews, t.user_reviews).select(
        F.col("restaurant_id").alias("id"), "average_rating", "review_count"
    )
    rows = t.places.select("id", "name", "city").join(stats, "id", "left")
    rows = rows.withColumn("review_count", F.coalesce("review_count", F.lit(0).cast("long")))
    return fav.favorite_places(D.favorites(spark, sf_dir), rows)


@register(
    "favorite_flags",
    over_domain(
        select="SELECT p.id, p.name, EXISTS (SELECT 1 FROM favorites f WHERE f.restaurant_id = p.id "
        "AND f.user_id = '42') AS is_favorite FROM places p"
    ),
)
def favorite_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = D.places(spark, sf_dir).select("id", "name")
    return fav.favorite_flags(places, D.favorites(spark, sf_dir), "42")


_TOGGLES = ("""
asked AS (
  SELECT event_id AS seq, json_extract_string(props, '$.k') AS actor,
    CASE WHEN event_id % 5 = 0 THEN 'nowhere' WHEN event_id % 3 = 0 THEN CAST(user_id + 1 AS VARCHAR)
      ELSE CAST(user_id AS VARCHAR) END AS restaurant_id
  FROM events WHERE event_type IN ('purchase', 'click'))""", """
judged AS (
  SELECT a.*, CASE WHEN u.id IS NULL THEN 'unknown_actor' WHEN NOT u.is_active THEN 'inactive_actor'
    WHEN p.id IS NULL THEN 'no_place' END AS reason
  FROM asked a LEFT JOIN users u ON u.id = a.actor LEFT JOIN places p ON p.id = a.restaurant_id)""", """
counted AS (SELECT actor, restaurant_id, count(*) AS n FROM judged WHERE reason IS NULL GROUP BY ALL)""")


def _toggled(spark: SparkSession, sf_dir: str) -> Changed:
    events = D.read(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "click"))
    # some ask for the place next door, so that favorites remain that nobody toggles
    place = F.col("user_id") + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    asked = events.select(
        F.col("event_id").alias("seq"),
        F.get_json_object("props", "$.k").alias("actor_id"),
        F.when(F.col("event_id") % 5 == 0, F.lit("nowhere")).otherwise(place.cast("string")).alias("restaurant_id"),
    )
    favorites = D.favorites(spark, sf_dir)
    return toggle_favorites(asked, D.users(spark, sf_dir), D.places(spark, sf_dir), favorites, D.as_of())


@register(
    "favorite_toggle_outcome",
    over_domain(*_TOGGLES, select="SELECT seq, reason IS NULL AS accepted, reason AS reject_reason FROM judged"),
)
def favorite_toggle_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on toggles of known and unknown actors and places."""
    return _toggled(spark, sf_dir).outcomes


@register(
    "favorite_toggle",
    over_domain(
        *_TOGGLES,
        select="""
SELECT coalesce(f.user_id, a.actor) AS user_id, coalesce(f.restaurant_id, a.restaurant_id) AS restaurant_id,
  CASE WHEN a.n IS NULL THEN f.created_at ELSE TIMESTAMP '2025-01-01' END AS created_at
FROM favorites f FULL JOIN counted a ON a.actor = f.user_id AND a.restaurant_id = f.restaurant_id
WHERE (CASE WHEN f.user_id IS NULL THEN 0 ELSE 1 END + coalesce(a.n, 0)) % 2 = 1""",
    ),
)
def favorite_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toggled(spark, sf_dir).table.select("user_id", "restaurant_id", "created_at")


@register(
    "hours_long",
    over_domain(
        select="""
SELECT id, 1 AS day_index, 'monday' AS day, city AS hours FROM places
UNION ALL SELECT id, 2, 'tuesday', c_mktsegment FROM places
UNION ALL SELECT id, 7, 'sunday', 'Closed' FROM places WHERE c_custkey % 3 <> 0"""
    ),
)
def hours_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.weekly_hours(D.places(spark, sf_dir))


@register(
    "hours_status",
    over_domain(
        select="""
SELECT id, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_open,
  CASE WHEN c_custkey % 3 <> 0 THEN 'Closed' END AS hours_on_date FROM places"""
    ),
)
def hours_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours on a Sunday."""
    return contacts.hours_status(D.places(spark, sf_dir), F.lit("2024-06-02").cast("date"))


@register(
    "clean_phone",
    over_domain(
        select=r"""
SELECT id, CASE WHEN d = '' THEN NULL WHEN d LIKE '90%' THEN '+' || d
    WHEN d LIKE '0%' THEN '+90' || substring(d, 2) WHEN length(d) = 10 THEN '+90' || d ELSE '+' || d END AS phone,
  nullif(trim(website), '') AS website
FROM (SELECT id, website, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM places)"""
    ),
)
def clean_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.clean_contacts(D.places(spark, sf_dir))


_LINKS = """
links AS (SELECT page_id, url, 'https://maps.example.org/r?hl=&data_id=0x' || page_id || '%3A' || (page_id * 7) ||
    '&place_id=' || CASE WHEN page_id % 2 = 0 THEN '+' ELSE 'p' || page_id END || '&hl=tr&query=a+b#top' AS link
  FROM pages)"""


@register(
    "link_params",
    "WITH "
    + _LINKS
    + r"""
SELECT page_id, '0x' || page_id || ':' || (page_id * 7) AS data_id,
  CASE WHEN page_id % 2 = 1 THEN 'p' || page_id END AS place_id, 'tr' AS hl, 'a b' AS query,
  CAST(NULL AS VARCHAR) AS sort_by, CAST(NULL AS VARCHAR) AS topic_id,
  nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), '') AS page,
  nullif(regexp_extract(url, '[?&]utm_source=([^&#]+)', 1), '') AS utm_source
FROM links""",
)
def link_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    link = F.concat(
        F.lit("https://maps.example.org/r?hl=&data_id=0x"),
        key.cast("string"),
        F.lit("%3A"),
        (key * 7).cast("string"),
        F.lit("&place_id="),
        F.when(key % 2 == 0, F.lit("+")).otherwise(F.concat(F.lit("p"), key.cast("string"))),
        F.lit("&hl=tr&query=a+b#top"),
    )
    pages = D.read(spark, sf_dir, "pages").select("page_id", "url", link.alias("link"))
    return pages.select(
        "page_id",
        *[link_parameter(F.col("link"), name).alias(name) for name in LINK_KEYS],
        link_parameter(F.col("url"), "page").alias("page"),
        link_parameter(F.col("url"), "utm_source").alias("utm_source"),
    )


@register(
    "sync_targets",
    over_domain(
        select="""
SELECT id AS restaurant_id, serpapi_data_id IS NOT NULL OR google_place_id IS NOT NULL AS eligible,
  coalesce(serpapi_data_id, google_place_id) AS target_id FROM places"""
    ),
)
def sync_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = contacts.sync_targets(D.places(spark, sf_dir))
    return targets.select("restaurant_id", "eligible", "target_id")
