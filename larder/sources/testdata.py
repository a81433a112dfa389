"""The driver's parquet tables read as domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder import model
from larder.functions.fingerprint import join_components
from larder.operators.ordering import with_position
from larder.session import configure

AS_OF = "2025-01-01 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a small input that would otherwise be worked on by fewer tasks than there are cores.

    An input with enough partitions of its own (any large one) is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def located_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    area = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf_dir, "customer").join(area, F.col("c_nationkey") == F.col("n_nationkey"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    created = F.timestamp_add("DAY", (key % 365).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    digits = F.lpad(_text(key), 7, "0")
    phone = (
        F.when(key % 4 == 0, F.concat(F.lit("+90 312 "), digits))
        .when(key % 4 == 1, F.concat(F.lit("0312 "), digits))
        .when(key % 4 == 2, F.concat(F.lit("(312) "), digits))
        .otherwise(F.lit("n/a"))
    )
    hours = F.create_map(
        F.lit("tuesday"),
        F.concat(F.lit(" "), "c_mktsegment", F.lit("  ")),
        F.lit("sunday"),
        F.when(key % 3 == 0, F.lit("")).otherwise(F.lit("Closed")),
        F.lit("monday"),
        F.col("n_name"),
    )
    opening = (
        F.when(key % 3 == 0, F.lit(" Open until 22:00"))
        .when(key % 3 == 1, F.lit("CLOSED today"))
        .otherwise(F.lit("By appointment"))
    )
    website = F.when(key % 5 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit(" https://example.org/"), _text(key))
    )
    located = located_customers(spark, sf_dir).select(
        _text(key).alias("id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("district"),
        (key % 90).cast("double").alias("latitude"),
        (key % 180).cast("double").alias("longitude"),
        website.alias("website"),
        phone.alias("phone"),
        (F.col("c_acctbal") / 1000).alias("rating"),
        F.col("c_mktsegment").alias("category"),
        opening.alias("opening_hours"),
        hours.alias("operating_hours"),
        F.when(key % 2 == 0, F.concat(F.lit("0x"), _text(key))).alias("serpapi_data_id"),
        F.when(key % 3 == 0, F.concat(F.lit("place"), _text(key))).alias("google_place_id"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )
    return model.conform(located, model.PLACES)


def menu_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        read(spark, sf_dir, "lineitem")
        .join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    menu = rows.select(
        F.concat_ws(":", *[_text(part) for part in parts]).alias("id"),
        _text("o_custkey").alias("restaurant_id"),
        F.col("p_name").alias("name"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
        F.col("p_type").alias("category"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )
    return model.conform(menu, model.MENU_ITEMS)


def user_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    reviews = rows.select(
        _text("o_orderkey").alias("id"),
        _text("o_orderkey").alias("user_id"),
        _text("o_custkey").alias("restaurant_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
        F.col("o_orderpriority").alias("comment"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )
    return model.conform(reviews, model.USER_REVIEWS)


def _event_rating() -> Column:
    return F.when(
        F.col("event_type") != "error", F.lit(1) + (F.floor("value") % 5).cast("int")
    )


def _event_date() -> Column:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.col("event_id") % 7 != 0, iso)


def ext_reviews(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """External reviews; ``text=False`` leaves the texts (and the join that brings them) out."""
    events = read(spark, sf_dir, "events")
    if text:
        events = spread(events, "event_id")
        documents = read(spark, sf_dir, "documents").select("doc_id", "text")
        events = events.join(documents, F.col("event_id") == F.col("doc_id"), "left")
    else:
        events = events.withColumn("text", F.lit(None).cast("string"))
    ts = F.col("ts").cast("timestamp")
    author = F.concat(F.lit("Author "), _text("user_id"))
    rating, date = _event_rating(), _event_date()
    review_id = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("r"), _text("event_id")))
    likes = F.get_json_object("props", "$.k").cast("int")
    text_part = F.coalesce(
        F.nullif(F.trim("text"), F.lit("")), F.concat(F.lit("note "), _text("event_id"))
    )
    raw = F.to_json(
        F.struct(
            F.struct(author.alias("name")).alias("user"),
            review_id.alias("review_id"),
            rating.alias("rating"),
            text_part.alias("text"),
            date.alias("iso_date"),
            likes.alias("likes"),
        )
    )
    reviews = events.select(
        _text("event_id").alias("id"),
        _text("user_id").alias("restaurant_id"),
        author.alias("author_name"),
        rating.alias("rating"),
        F.col("text").alias("review_text"),
        date.alias("review_date"),
        likes.alias("likes"),
        review_id.alias("provider_review_id"),
        join_components(author, _text(rating), text_part, date).alias("review_hash"),
        raw.alias("raw_json"),
        ts.alias("created_at"),
        ts.alias("updated_at"),
    )
    return model.conform(reviews, model.EXT_REVIEWS)


def favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases = read(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    pairs = purchases.select(
        F.get_json_object("props", "$.k").alias("user_id"),
        _text("user_id").alias("restaurant_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    kept = pairs.groupBy("user_id", "restaurant_id").agg(F.min("created_at").alias("created_at"))
    return model.conform(
        kept.withColumn("id", F.concat_ws(":", "user_id", "restaurant_id")), model.FAVORITES
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    created = F.col("o_orderdate").cast("timestamp")
    rows = read(spark, sf_dir, "orders").select(
        _text(key).alias("id"),
        F.concat(F.lit("user"), _text(key)).alias("username"),
        F.concat(F.lit("user"), _text(key), F.lit("@example.org")).alias("email"),
        F.lit("x").alias("hashed_password"),
        (key % 10 != 0).alias("is_active"),
        (key % 25 == 1).alias("is_admin"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )
    return model.conform(rows, model.USERS)


# --- provider payloads built from the tables ---------------------------------------------------------------------


def misread(text: Column) -> Column:
    """UTF-8 bytes read as Latin-1: the damage that provider texts arrive with."""
    return F.decode(text.cast("binary"), "ISO-8859-1")


def place_item() -> Column:
    """JSON of one provider place for a located customer."""
    key = F.col("c_custkey")
    name = F.concat("c_name", F.lit(" Café"))
    title = F.when(key % 11 == 0, F.lit("")).when(key % 2 == 0, misread(name))
    other = F.when(key % 11 == 0, F.lit("  ")).otherwise(name)
    return F.to_json(
        F.struct(
            title.alias("title"),
            other.alias("name"),
            F.concat(
                F.lit("Street "), _text(key), F.lit(", "), "r_name", F.lit("/"), "n_name"
            ).alias("address"),
            F.struct(
                (key % 90).alias("latitude"), ((key % 180) + F.lit(0.5)).alias("longitude")
            ).alias("gps_coordinates"),
            F.when(key % 180 == 0, F.lit(45.5)).alias("latitude"),
            (F.col("c_acctbal") / 1000).alias("rating"),
            F.concat(_text(key), F.lit("")).alias("reviews"),
            F.col("c_mktsegment").alias("type"),
            F.when(key % 2 == 0, F.concat(F.lit("0x"), _text(key))).alias("data_id"),
            F.when(key % 3 == 0, F.concat(F.lit("place"), _text(key))).alias("place_id"),
            F.create_map(F.lit("monday"), F.lit("9-5"), F.lit("tuesday"), misread(F.lit("9–5"))).alias(
                "operating_hours"
            ),
        )
    )


def _page(rows: DataFrame, keys: list[str], list_name: Column, rest: Column) -> DataFrame:
    """Items (``at``, ``item``) of a page as one JSON text; a page holds a fixed share of the key range.

    The explicit partitioning is the one the grouping needs anyway. It keeps small test pages from ending up in
    a single partition, and with them all parsing that follows.
    """
    spark = rows.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.repartition(partitions, *keys)
    items = F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda row: row["item"])
    pages = rows.groupBy(*keys).agg(F.array_join(items, ",").alias("items"))
    body = F.concat(
        F.lit('{"'), list_name, F.lit('":["not an object",'), "items", F.lit("]"), rest, F.lit("}")
    )
    return pages.select(*keys, body.alias("body"))


def place_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages, one search per region, and one more search that finds every seventh place again."""
    rows = located_customers(spark, sf_dir).select(
        F.concat(F.lit("places in "), "r_name").alias("source_query"),
        F.col("r_regionkey").alias("source_rank"),
        F.floor(F.col("c_custkey") / 100).cast("int").alias("page_index"),
        F.col("c_custkey").alias("at"),
        place_item().alias("item"),
    )
    again = rows.filter(F.col("at") % 7 == 0).withColumns(
        {"source_query": F.lit("places again"), "source_rank": F.lit(99)}
    )
    odd = F.col("page_index") % 3 == 1
    return _page(
        rows.unionByName(again),
        ["source_query", "source_rank", "page_index"],
        F.when(odd, F.lit('local_results":{"none":1},"places')).otherwise(F.lit("local_results")),
        F.lit(',"serpapi_pagination":{"next_page_token":"more"}'),
    )


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider review JSON per event: restaurant_id, event_id, item."""
    reviews = ext_reviews(spark, sf_dir)
    return reviews.select(
        "restaurant_id", F.col("id").cast("long").alias("event_id"), F.col("raw_json").alias("item")
    )


def review_pages(spark: SparkSession, sf_dir: str, stops: bool = False) -> DataFrame:
    """Review pages of ten per place; the token is nested or flat and, with ``stops``, on some pages blank or missing."""
    items = review_items(spark, sf_dir)
    placed = with_position(items, ["restaurant_id"], [F.col("event_id").asc()])
    rows = placed.select(
        "restaurant_id",
        F.floor((F.col("position") - 1) / 10).cast("int").alias("page_index"),
        F.col("event_id").alias("at"),
        "item",
    )
    stop = F.lit(stops)
    turn = (F.col("restaurant_id").cast("long") + F.col("page_index")) % 9
    token = (
        F.when(stop & (turn == 8), F.lit(',"next_page_token":"  "'))
        .when(stop & (turn == 7), F.lit(""))
        .when(turn % 2 == 1, F.lit(',"next_page_token":"more"'))
        .otherwise(F.lit(',"serpapi_pagination":{"next_page_token":" more "}'))
    )
    return _page(rows, ["restaurant_id", "page_index"], F.lit("reviews"), token)


def landed_review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review pages keyed by what the provider was asked for."""
    key = F.col("restaurant_id").cast("long")
    target = F.when(key % 2 == 0, F.concat(F.lit("0x"), "restaurant_id")).when(
        key % 3 == 0, F.concat(F.lit("place"), "restaurant_id")
    )
    pages = review_pages(spark, sf_dir).withColumn("target_id", target)
    return pages.filter(F.col("target_id").isNotNull()).drop("restaurant_id")
