"""Registered queries: change sets and the quality report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder import model
from larder.operators import changes as C
from larder.operators.quality import quality_report
from larder.plans.oracle import over_domain
from larder.plans.registry import register
from larder.session import cut_lineage
from larder.sources import tables as T, testdata as D
from larder.sources.buckets import read_buckets, replace_places, write_buckets
from larder.staging import new_folder

# Actors of the change sets: 1 and 26 are administrators, 10 is inactive, "nobody" does not exist.


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.read(spark, sf_dir, "orders")
    return rows.withColumns(
        {
            "k": F.col("o_orderkey"),
            "key": F.col("o_orderkey").cast("string"),
            "place": F.col("o_custkey").cast("string"),
            "digit": F.substring("o_orderpriority", 1, 1).cast("int"),
        }
    )


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.read(spark, sf_dir, "customer")
    return rows.withColumns({"k": F.col("c_custkey"), "key": F.col("c_custkey").cast("string")})


_ACTOR_REASON = """CASE WHEN u.id IS NULL THEN 'unknown_actor' WHEN NOT u.is_active THEN 'inactive_actor' END"""
_ADMIN_REASON = """CASE WHEN u.id IS NULL THEN 'unknown_actor' WHEN NOT u.is_active THEN 'inactive_actor'
    WHEN NOT u.is_admin THEN 'forbidden' END"""
_OUTCOME = "seq, reason IS NULL AS accepted, reason AS reject_reason"


# --- reviews and favorites -----------------------------------------------------------------------------------------

_NEW_REVIEWS = ("""
asked AS (
  SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 19 = 0 THEN 'nobody' ELSE CAST(o_orderkey % 20 AS VARCHAR) END AS actor,
    CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS place,
    CAST(substring(o_orderpriority, 1, 1) AS INTEGER) + o_orderkey % 3 - 1 AS rating, o_orderkey % 17 = 0 AS long
  FROM orders)""", f"""
checked AS (
  SELECT a.*, coalesce({_ACTOR_REASON}, CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'bad_rating'
    WHEN long THEN 'too_long' WHEN place = 'x' THEN 'no_place' END) AS first_reason
  FROM asked a LEFT JOIN users u ON u.id = a.actor)""", """
final AS (
  SELECT c.*, coalesce(first_reason, CASE WHEN r.id IS NOT NULL OR row_number() OVER (
      PARTITION BY actor, place, first_reason IS NULL ORDER BY seq) > 1 THEN 'duplicate' END) AS reason
  FROM checked c LEFT JOIN user_reviews r ON r.user_id = c.actor AND r.restaurant_id = c.place)""")


def _new_reviews(spark: SparkSession, sf_dir: str) -> C.Changed:
    k = F.col("k")
    asked = _orders(spark, sf_dir).select(
        k.alias("seq"),
        F.when(k % 19 == 0, "nobody").otherwise((k % 20).cast("string")).alias("actor_id"),
        F.when(k % 13 == 0, "x").otherwise(F.col("place")).alias("restaurant_id"),
        (F.col("digit") + (k % 3).cast("int") - 1).alias("rating"),
        F.when(k % 17 == 0, F.repeat(F.lit("c"), F.lit(1001))).otherwise("fine").alias("comment"),
    )
    return C.create_reviews(
        asked, D.users(spark, sf_dir), D.places(spark, sf_dir), D.user_reviews(spark, sf_dir), D.as_of()
    )


@register("create_reviews_outcome", over_domain(*_NEW_REVIEWS, select=f"SELECT {_OUTCOME} FROM final"))
def create_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_reviews(spark, sf_dir).outcomes


@register(
    "create_reviews_state",
    over_domain(
        *_NEW_REVIEWS,
        select="""
SELECT user_id, restaurant_id, rating, comment, created_at FROM user_reviews
UNION ALL SELECT actor, place, CAST(rating AS INTEGER), 'fine', TIMESTAMP '2025-01-01' FROM final WHERE reason IS NULL""",
    ),
)
def create_reviews_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_reviews(spark, sf_dir).table.select(
        "user_id", "restaurant_id", "rating", "comment", "created_at"
    )


_REVIEW_EDITS = ("""
asked AS (
  SELECT *, CASE k % 4 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE 'nobody' END AS actor,
    CASE WHEN k % 7 = 0 THEN NULL ELSE CAST((k + turn) % 6 AS VARCHAR) END AS rating,
    k % 3 <> 0 AS sets_rating, k % 2 = 0 AS sets_comment,
    CASE WHEN k % 5 = 0 THEN NULL ELSE 'edit ' || turn END AS comment
  FROM (SELECT o_orderkey AS k, 0 AS turn, o_orderkey * 4 AS seq FROM orders
        UNION ALL SELECT o_orderkey, 1, o_orderkey * 4 + 1 FROM orders WHERE o_orderkey % 5 < 2))""", f"""
final AS (
  SELECT a.*, r.id AS found, coalesce({_ACTOR_REASON},
    CASE WHEN sets_rating AND a.rating IS NULL THEN 'null_field'
      WHEN sets_rating AND a.rating = '0' THEN 'bad_rating'
      WHEN r.id IS NULL THEN 'not_found' WHEN r.user_id <> actor AND NOT u.is_admin THEN 'forbidden' END) AS reason
  FROM asked a LEFT JOIN users u ON u.id = a.actor LEFT JOIN user_reviews r ON r.id = CAST(a.k AS VARCHAR))""")


def _review_edits(spark: SparkSession, sf_dir: str) -> C.Changed:
    rows = _orders(spark, sf_dir).select("k", F.lit(0).alias("turn"))
    rows = rows.unionByName(rows.filter(F.col("k") % 5 < 2).withColumn("turn", F.lit(1)))
    k, turn = F.col("k"), F.col("turn")
    rating = F.when(k % 7 != 0, ((k + turn) % 6).cast("string"))
    comment = F.when(k % 5 != 0, F.concat(F.lit("edit "), turn.cast("string")))
    both = F.create_map(F.lit("rating"), rating, F.lit("comment"), comment)
    wanted = F.map_filter(
        both,
        lambda name, _: ((name == "rating") & (k % 3 != 0)) | ((name == "comment") & (k % 2 == 0)),
    )
    asked = rows.select(
        (k * 4 + turn).alias("seq"),
        F.when(k % 4 == 0, k.cast("string"))
        .when(k % 4 == 1, "1")
        .when(k % 4 == 2, "2")
        .otherwise("nobody")
        .alias("actor_id"),
        k.cast("string").alias("id"),
        wanted.alias("changes"),
    )
    return C.update_reviews(asked, D.users(spark, sf_dir), D.user_reviews(spark, sf_dir), D.as_of())


@register("update_reviews_outcome", over_domain(*_REVIEW_EDITS, select=f"SELECT {_OUTCOME} FROM final"))
def update_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review_edits(spark, sf_dir).outcomes


@register(
    "update_reviews_state",
    over_domain(
        *_REVIEW_EDITS,
        """
good AS (SELECT * FROM final WHERE reason IS NULL)""",
        """
last AS (
  SELECT found AS id, max_by(rating, seq) FILTER (sets_rating) AS rating, bool_or(sets_rating) AS has_rating,
    arg_max_null(comment, seq) FILTER (sets_comment) AS comment, bool_or(sets_comment) AS has_comment
  FROM good GROUP BY found)""",
        """
touched AS (
  SELECT g.found AS id, bool_or((sets_rating AND CAST(g.rating AS INTEGER) <> r.rating)
      OR (sets_comment AND g.comment IS DISTINCT FROM r.comment)) AS changed
  FROM good g JOIN user_reviews r ON r.id = g.found GROUP BY 1)""",
        select="""
SELECT r.id, CASE WHEN has_rating THEN CAST(l.rating AS INTEGER) ELSE r.rating END AS rating,
  CASE WHEN has_comment THEN l.comment ELSE r.comment END AS comment,
  CASE WHEN t.changed THEN TIMESTAMP '2025-01-01' ELSE r.updated_at END AS updated_at
FROM user_reviews r LEFT JOIN last l ON l.id = r.id LEFT JOIN touched t ON t.id = r.id""",
    ),
)
def update_reviews_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review_edits(spark, sf_dir).table.select("id", "rating", "comment", "updated_at")


_REVIEW_DELETES = ("""
asked AS (
  SELECT *, CAST(k AS VARCHAR) AS id,
    CASE WHEN turn = 0 AND k % 3 = 0 THEN '2' WHEN k % 4 = 0 THEN '10' WHEN k % 2 = 0 THEN '1' ELSE CAST(k AS VARCHAR) END AS actor
  FROM (SELECT o_orderkey AS k, 0 AS turn, o_orderkey * 4 AS seq FROM orders
        UNION ALL SELECT o_orderkey, 1, o_orderkey * 4 + 1 FROM orders
        UNION ALL SELECT o_orderkey, 2, o_orderkey * 4 + 2 FROM orders WHERE o_orderkey % 6 = 0))""", f"""
checked AS (
  SELECT a.*, {_ACTOR_REASON} AS actor_reason, r.id AS found,
    r.id IS NOT NULL AND u.is_active AND (r.user_id = actor OR u.is_admin) AS good
  FROM asked a LEFT JOIN users u ON u.id = a.actor LEFT JOIN user_reviews r ON r.id = a.id)""", """
final AS (
  SELECT *, CASE WHEN actor_reason IS NOT NULL THEN actor_reason WHEN found IS NULL THEN 'not_found'
    WHEN coalesce(bool_or(good) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
      THEN 'not_found' WHEN NOT good THEN 'forbidden' END AS reason
  FROM checked)""")


def _deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("k", F.lit(0).alias("turn"))
    rows = rows.unionByName(rows.withColumn("turn", F.lit(1))).unionByName(
        rows.filter(F.col("k") % 6 == 0).withColumn("turn", F.lit(2))
    )
    k, turn = F.col("k"), F.col("turn")
    return rows.select(
        (k * 4 + turn).alias("seq"),
        F.when((turn == 0) & (k % 3 == 0), "2")
        .when(k % 4 == 0, "10")
        .when(k % 2 == 0, "1")
        .otherwise(k.cast("string"))
        .alias("actor_id"),
        k.cast("string").alias("id"),
    )


@register("delete_reviews_outcome", over_domain(*_REVIEW_DELETES, select=f"SELECT {_OUTCOME} FROM final"))
def delete_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _deletes(spark, sf_dir)
    return C.delete_reviews(asked, D.users(spark, sf_dir), D.user_reviews(spark, sf_dir)).outcomes


@register(
    "delete_reviews_state",
    over_domain(
        *_REVIEW_DELETES,
        select="SELECT id, user_id, restaurant_id, rating FROM user_reviews WHERE id NOT IN "
        "(SELECT id FROM final WHERE reason IS NULL)",
    ),
)
def delete_reviews_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _deletes(spark, sf_dir)
    left = C.delete_reviews(asked, D.users(spark, sf_dir), D.user_reviews(spark, sf_dir)).table
    return left.select("id", "user_id", "restaurant_id", "rating")


@register(
    "create_favorites_outcome",
    over_domain(
        """
asked AS (
  SELECT event_id AS seq, json_extract_string(props, '$.k') AS actor,
    CASE WHEN event_id % 13 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS place
  FROM events WHERE event_type = 'click')""",
        f"""
checked AS (
  SELECT a.*, coalesce({_ACTOR_REASON}, CASE WHEN place = 'x' THEN 'no_place' END) AS first_reason
  FROM asked a LEFT JOIN users u ON u.id = a.actor)""",
        """
final AS (
  SELECT c.*, coalesce(first_reason, CASE WHEN f.user_id IS NOT NULL OR row_number() OVER (
      PARTITION BY actor, place, first_reason IS NULL ORDER BY seq) > 1 THEN 'duplicate' END) AS reason
  FROM checked c LEFT JOIN favorites f ON f.user_id = c.actor AND f.restaurant_id = c.place)""",
        select=f"SELECT {_OUTCOME} FROM final",
    ),
)
def create_favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = D.read(spark, sf_dir, "events").filter("event_type = 'click'")
    asked = clicks.select(
        F.col("event_id").alias("seq"),
        F.get_json_object("props", "$.k").alias("actor_id"),
        F.when(F.col("event_id") % 13 == 0, "x").otherwise(F.col("user_id").cast("string")).alias("restaurant_id"),
    )
    return C.create_favorites(
        asked, D.users(spark, sf_dir), D.places(spark, sf_dir), D.favorites(spark, sf_dir), D.as_of()
    ).outcomes


@register(
    "delete_favorites_outcome",
    over_domain(
        """
asked AS (
  SELECT event_id AS seq, json_extract_string(props, '$.k') || ':' || user_id AS id,
    CASE event_id % 3 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN '26' ELSE '2' END AS actor FROM events)""",
        f"""
checked AS (
  SELECT a.*, {_ACTOR_REASON} AS actor_reason, f.user_id AS found,
    f.user_id IS NOT NULL AND u.is_active AND (f.user_id = actor OR u.is_admin) AS good
  FROM asked a LEFT JOIN users u ON u.id = a.actor
  LEFT JOIN favorites f ON f.user_id || ':' || f.restaurant_id = a.id)""",
        _REVIEW_DELETES[2],
        select=f"SELECT {_OUTCOME} FROM final",
    ),
)
def delete_favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    turn = F.col("event_id") % 3
    asked = D.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat_ws(":", k, F.col("user_id").cast("string")).alias("id"),
        F.when(turn == 0, k).when(turn == 1, "26").otherwise("2").alias("actor_id"),
    )
    return C.delete_favorites(asked, D.users(spark, sf_dir), D.favorites(spark, sf_dir)).outcomes


# --- places --------------------------------------------------------------------------------------------------------

_ACTORS = "CASE k % 5 WHEN 0 THEN '2' WHEN 1 THEN '10' WHEN 2 THEN 'nobody' WHEN 3 THEN '1' ELSE '26' END"


def _actor():
    k = F.col("k")
    names = F.when(k % 5 == 0, "2").when(k % 5 == 1, "10").when(k % 5 == 2, "nobody")
    return names.when(k % 5 == 3, "1").otherwise("26").alias("actor_id")


@register(
    "create_places_outcome",
    over_domain(
        f"""
asked AS (SELECT c_custkey AS seq, {_ACTORS.replace("k %", "c_custkey %")} AS actor FROM customer)""",
        f"""
final AS (
  SELECT a.*, coalesce({_ADMIN_REASON}, CASE WHEN seq % 7 = 0 THEN 'missing_field' WHEN seq % 11 = 0 THEN 'too_short'
    WHEN seq % 13 = 0 THEN 'too_long' END) AS reason FROM asked a LEFT JOIN users u ON u.id = a.actor)""",
        select=f"SELECT {_OUTCOME} FROM final",
    ),
)
def create_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    none = F.lit(None).cast("string")
    asked = _customers(spark, sf_dir).select(
        k.alias("seq"),
        _actor(),
        F.when(k % 7 != 0, F.col("c_name")).alias("name"),
        F.when(k % 11 == 0, "").otherwise("Town").alias("city"),
        F.lit("Center").alias("district"),
        F.lit(1.5).alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
        none.alias("website"),
        F.when(k % 13 == 0, F.repeat(F.lit("5"), F.lit(51))).alias("phone"),
        none.alias("description"),
    )
    return C.create_places(asked, D.users(spark, sf_dir), D.places(spark, sf_dir), D.as_of()).outcomes


_PLACE_EDITS = (f"""
asked AS (
  SELECT *, {_ACTORS} AS actor, CASE WHEN k % 17 = 0 THEN 'none' || k ELSE CAST(k AS VARCHAR) END AS id
  FROM (SELECT c_custkey AS k, 0 AS turn, c_custkey * 4 AS seq FROM customer
        UNION ALL SELECT c_custkey, 1, c_custkey * 4 + 1 FROM customer WHERE c_custkey % 4 = 0))""", f"""
final AS (
  SELECT a.*, coalesce({_ADMIN_REASON}, CASE WHEN k % 7 = 0 THEN 'null_field' WHEN k % 11 = 0 THEN 'too_short'
    WHEN k % 13 = 0 THEN 'too_long' WHEN k % 19 = 0 THEN 'bad_value' WHEN k % 17 = 0 THEN 'not_found' END) AS reason
  FROM asked a LEFT JOIN users u ON u.id = a.actor)""")


def _edit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir).select("k", F.lit(0).alias("turn"))
    rows = rows.unionByName(rows.filter(F.col("k") % 4 == 0).withColumn("turn", F.lit(1)))
    k, turn = F.col("k"), F.col("turn")
    clear = F.create_map(F.lit("website"), F.lit(None).cast("string"))
    name = F.create_map(
        F.lit("name"),
        F.when(k % 7 == 0, F.lit(None).cast("string"))
        .when(k % 11 == 0, "")
        .when(k % 13 == 0, F.repeat(F.lit("n"), F.lit(256)))
        .otherwise(F.concat(F.lit("New "), turn.cast("string"))),
    )
    where = F.create_map(F.lit("latitude"), F.when(k % 19 == 0, "north").otherwise("12.25"))
    return rows.select(
        (k * 4 + turn).alias("seq"),
        _actor(),
        F.when(k % 17 == 0, F.concat(F.lit("none"), k.cast("string"))).otherwise(k.cast("string")).alias("id"),
        F.map_concat(name, where, F.when(turn == 0, clear).otherwise(F.expr("map()").cast("map<string,string>"))).alias("changes"),
    )


def _place_edits(spark: SparkSession, sf_dir: str) -> C.Changed:
    return C.update_places(_edit_requests(spark, sf_dir), D.users(spark, sf_dir), D.places(spark, sf_dir), D.as_of())


@register("update_places_outcome", over_domain(*_PLACE_EDITS, select=f"SELECT {_OUTCOME} FROM final"))
def update_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place_edits(spark, sf_dir).outcomes


_EDITED = over_domain(
    *_PLACE_EDITS,
    """
last AS (SELECT id, max(turn) AS turn FROM final WHERE reason IS NULL GROUP BY id)""",
    select="""
SELECT p.id, CASE WHEN l.id IS NULL THEN p.name ELSE 'New ' || l.turn END AS name, p.city,
  CASE WHEN l.id IS NULL THEN p.latitude ELSE 12.25 END AS latitude,
  CASE WHEN l.id IS NULL THEN p.website END AS website,
  CASE WHEN l.id IS NULL THEN p.created_at ELSE TIMESTAMP '2025-01-01' END AS updated_at
FROM places p LEFT JOIN last l ON l.id = p.id""",
)


@register("update_places_state", _EDITED)
def update_places_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place_edits(spark, sf_dir).table.select(
        "id", "name", "city", "latitude", "website", "updated_at"
    )


@register("update_places_in_buckets", _EDITED)
def update_places_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edits on a bucketed table: one city's first, then all others; each reads and rewrites the buckets it touches."""
    table = write_buckets(D.places(spark, sf_dir), new_folder(spark), "places", 16)
    users, asked = D.users(spark, sf_dir), cut_lineage(_edit_requests(spark, sf_dir))
    first = D.places(spark, sf_dir).filter("city = 'NATION_7'").select("id")
    for requests in (asked.join(first, "id", "left_semi"), asked.join(first, "id", "left_anti")):
        keys = requests.select("id")
        state = C.update_places(requests, users, read_buckets(spark, table, keys), D.as_of()).table
        replace_places(spark, table, state, keys)
    return read_buckets(spark, table).select("id", "name", "city", "latitude", "website", "updated_at")


_CASCADE = (f"""
asked AS (SELECT c_custkey AS seq, {_ACTORS.replace("k %", "c_custkey %")} AS actor, CAST(c_custkey AS VARCHAR) AS id
  FROM customer WHERE c_custkey % 10 < 5)""", """
gone AS (SELECT a.id FROM asked a JOIN users u ON u.id = a.actor WHERE u.is_active AND u.is_admin)""")


def _cascade(spark: SparkSession, sf_dir: str) -> C.Cascade:
    k = F.col("k")
    asked = _customers(spark, sf_dir).filter(k % 10 < 5).select(
        k.alias("seq"), _actor(), F.col("key").alias("id")
    )
    tables = {
        "places": D.places(spark, sf_dir),
        "menu_items": D.menu_items(spark, sf_dir),
        "user_reviews": D.user_reviews(spark, sf_dir),
        "ext_reviews": D.ext_reviews(spark, sf_dir),
        "favorites": D.favorites(spark, sf_dir),
    }
    return C.delete_places(asked, D.users(spark, sf_dir), tables)


@register(
    "cascade_delete_counts",
    over_domain(
        *_CASCADE,
        select=" UNION ALL ".join(
            f"SELECT '{name}' AS table_name, count(*) AS removed FROM {name} WHERE {key} IN (SELECT id FROM gone)"
            for name, key in [
                ("places", "id"),
                ("menu_items", "restaurant_id"),
                ("user_reviews", "restaurant_id"),
                ("ext_reviews", "restaurant_id"),
                ("favorites", "restaurant_id"),
            ]
        ),
    ),
)
def cascade_delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).removed


_LEFT = {
    "places": ("id", "name", "city", "category"),
    "menu_items": ("restaurant_id", "name", "category", ""),
    "user_reviews": ("restaurant_id", "id", "user_id", "comment"),
    "ext_reviews": ("restaurant_id", "id", "provider_review_id", "review_text"),
    "favorites": ("restaurant_id", "user_id", "", ""),
}


@register(
    "cascade_delete_states",
    over_domain(
        *_CASCADE,
        select=" UNION ALL ".join(
            f"SELECT '{name}' AS table_name, {columns[0]} AS place, "
            f"md5(concat_ws('|', {', '.join(f'coalesce({c}, {chr(39) * 2})' if c else chr(39) * 2 for c in columns[1:])})) AS digest "
            f"FROM {name} WHERE {columns[0]} NOT IN (SELECT id FROM gone)"
            for name, columns in _LEFT.items()
        ),
    ),
)
def cascade_delete_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cascade leaves in each of the five tables, texts included."""
    after = _cascade(spark, sf_dir).tables
    rows = []
    for name, (place, *others) in _LEFT.items():
        shown = [F.coalesce(F.col(c), F.lit("")) if c else F.lit("") for c in others]
        rows.append(after[name].select(F.lit(name).alias("table_name"), F.col(place).alias("place"), F.md5(F.concat_ws("|", *shown)).alias("digest")))
    return reduce(DataFrame.unionByName, rows)


@register(
    "cascade_delete_state",
    over_domain(
        *_CASCADE,
        select="SELECT user_id, restaurant_id FROM favorites WHERE restaurant_id NOT IN (SELECT id FROM gone)",
    ),
)
def cascade_delete_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).tables["favorites"].select("user_id", "restaurant_id")


# --- users ---------------------------------------------------------------------------------------------------------

# Four requests at a time: (a, x), (a, y), (b, Y), (c, x): the second fails on its name, so the third gets y.
@register(
    "register_users_outcome",
    """
WITH asked AS (SELECT o_orderkey AS seq, o_orderkey % 4 AS turn, o_orderkey // 4 AS g FROM orders),
final AS (SELECT seq, CASE WHEN g % 9 = 0 AND turn IN (0, 2) THEN 'bad_username'
  WHEN g % 7 = 0 AND turn = 2 THEN 'bad_email'
  WHEN g % 5 = 0 AND turn <= 1 AND g % 9 <> 0 THEN 'username_taken'
  WHEN turn = 1 AND g % 9 <> 0 THEN 'username_taken'
  WHEN g % 11 = 0 AND turn = 3 THEN 'too_long'
  WHEN turn = 3 AND g % 9 <> 0 AND g % 5 <> 0 THEN 'email_taken' END AS reason FROM asked)
SELECT seq, reason IS NULL AS accepted, reason AS reject_reason FROM final""",
)
def register_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, group, turn = F.col("k"), F.floor(F.col("k") / 4), F.col("k") % 4
    owner = F.when(turn <= 1, "a").when(turn == 2, "b").otherwise("c")
    name = F.concat(F.lit("new "), group.cast("string"), owner)
    taken = F.concat(F.lit("user"), group.cast("string"))
    username = (
        F.when((group % 9 == 0) & turn.isin(0, 2), "no")
        .when((group % 5 == 0) & (turn <= 1) & (group % 9 != 0), taken)
        .otherwise(name)
    )
    box = F.when(turn == 1, "y").when(turn == 2, "Y").otherwise("x")
    padding = F.when((group % 11 == 0) & (turn == 3), F.repeat(F.lit("e"), F.lit(250))).otherwise("")
    mail = F.concat(box, group.cast("string"), padding, F.lit("@Example.org"))
    asked = _orders(spark, sf_dir).select(
        k.alias("seq"),
        username.alias("username"),
        F.when((group % 7 == 0) & (turn == 2), "nowhere").otherwise(mail).alias("email"),
        F.lit("x").alias("hashed_password"),
    )
    return C.register_users(asked, D.users(spark, sf_dir), D.as_of()).outcomes


@register(
    "public_projections",
    over_domain(
        select="""
SELECT 'user' AS kind, id, username AS label, CAST(NULL AS DOUBLE) AS price FROM users
UNION ALL SELECT 'menu', id || ':' || CAST(price AS VARCHAR), name, CAST(price AS DOUBLE) FROM menu_items
UNION ALL SELECT 'favorite', user_id || ':' || restaurant_id, restaurant_id, NULL FROM favorites"""
    ),
)
def public_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of users, dishes and favorites."""
    none = F.lit(None).cast("double").alias("price")
    users = T.public_users(D.users(spark, sf_dir)).select(
        F.lit("user").alias("kind"), "id", F.col("username").alias("label"), none
    )
    priced = D.menu_items(spark, sf_dir)
    bare = F.regexp_replace("id", r":[^:]*\z", "")
    keyed = priced.withColumn("id", F.concat_ws(":", bare, F.col("price").cast("string")))
    menu = T.public_menu(keyed).select(F.lit("menu").alias("kind"), "id", F.col("name").alias("label"), "price")
    favorites = T.public_favorites(D.favorites(spark, sf_dir)).select(
        F.lit("favorite").alias("kind"), "id", F.col("restaurant_id").alias("label"), none
    )
    return users.unionByName(menu).unionByName(favorites)


# --- quality -------------------------------------------------------------------------------------------------------

# Columns that the SQL form of a table carries; the others are either empty or filled for every row.
_SQL_COLUMNS = {
    "places": "id name city district website phone category opening_hours serpapi_data_id google_place_id created_at",
    "user_reviews": "id user_id restaurant_id rating comment created_at updated_at",
    "favorites": "user_id restaurant_id created_at",
    "users": "id username email is_active is_admin",
    "ext_reviews": "id restaurant_id author_name review_date provider_review_id review_hash created_at",
}


def _quality_sql(tables: dict[str, str]) -> str:
    lines = []
    for name, columns in tables.items():
        have = columns.split()

        def line(rule: str, column: str, count: str) -> None:
            lines.append(
                f"SELECT '{name}' AS table_name, '{rule}' AS rule, '{column}' AS columns, {count} AS violations"
            )

        none = "CAST(0 AS BIGINT)"
        for field in model.TABLES[name].fields:
            if not field.nullable:
                test = f"(SELECT count(*) FROM {name} WHERE {field.name} IS NULL)"
                line("not_null", field.name, test if field.name in have else none)
        for column, limit in model.MAX_LENGTH[name].items():
            test = f"(SELECT count(*) FROM {name} WHERE length({column}) > {limit})"
            line("max_length", column, test if column in have else none)
        if name == "user_reviews":
            line("rating_range", "rating", f"(SELECT count(*) FROM {name} WHERE rating NOT BETWEEN 1 AND 5)")
        for keys in model.UNIQUE[name]:
            if name == "favorites" and keys == ["id"]:
                line("unique", "id", none)
                continue
            if name == "menu_items":
                # The id of a dish holds its price, which the SQL form keeps as a column of its own.
                keys_sql = "SELECT count(*) AS n FROM menu_items GROUP BY id, price"
                line("unique", "id", f"(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM ({keys_sql}))")
                continue
            columns, filled = ", ".join(keys), " AND ".join(f"{key} IS NOT NULL" for key in keys)
            test = f"(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {name} WHERE {filled} GROUP BY {columns}))"
            line("unique", ",".join(keys), test)
        for key, parent in model.REFERENCES.get(name, []):
            test = f"(SELECT count(*) FROM {name} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = c.{key}))"
            line("reference", key, test)
    return over_domain(select=" UNION ALL ".join(lines))


@register("quality_report", _quality_sql(_SQL_COLUMNS))
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(
        {
            "places": D.places(spark, sf_dir),
            "user_reviews": D.user_reviews(spark, sf_dir),
            "favorites": D.favorites(spark, sf_dir),
            "users": D.users(spark, sf_dir),
            "ext_reviews": D.ext_reviews(spark, sf_dir),
        }
    )


@register(
    "quality_report_menu",
    _quality_sql({"places": _SQL_COLUMNS["places"], "menu_items": "id restaurant_id name price category"}),
)
def quality_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(
        {"places": D.places(spark, sf_dir), "menu_items": D.menu_items(spark, sf_dir)}
    )
