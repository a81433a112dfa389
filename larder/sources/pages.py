"""Landed provider pages: one JSON text per page, keyed by where it came from and its page number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder.functions import payload as P
from larder.functions.text import nonblank
from larder.session import cut_lineage

# Members that may hold the places of a search page, in order of preference.
PLACE_LISTS = ["local_results", "place_results", "places"]
REVIEW_LISTS = ["reviews"]


def read_pages(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Pages stored as ``folder/<key value, URL-encoded>/<page_index>.json``."""
    path = F.col("_metadata.file_path")
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    folder_name = F.regexp_extract(path, r"/([^/]+)/\d+\.json\z", 1)
    # The path itself is URL-encoded once more by Spark.
    return files.select(
        F.try_url_decode(F.try_url_decode(folder_name)).alias(key),
        F.regexp_extract(path, r"/(\d+)\.json\z", 1).try_cast("int").alias("page_index"),
        F.col("value").alias("body"),
    )


def next_page_token(body: Column) -> Column:
    """Token of the nested paging object, else of the top level; blank or no text means none."""
    fields = P.read_fields(body, ["serpapi_pagination", "next_page_token"])
    nested = P.only_text(P.member(fields["serpapi_pagination"], "next_page_token"))
    return F.coalesce(nonblank(nested), nonblank(P.only_text(fields["next_page_token"])))


def page_facts(pages: DataFrame) -> DataFrame:
    """Add what one parse of a body tells about the page: ``readable``, and ``ends``, whether it names no next page."""
    return pages.withColumns(
        {"readable": P.is_object(F.try_parse_json("body")), "ends": next_page_token(F.col("body")).isNull()}
    )


def reached_pages(known: DataFrame, key: str) -> DataFrame:
    """Of pages with their facts, those up to the first that ends, with ``source_failed``.

    A source with an unreadable page among these is marked as failed as a whole.
    """
    stops = known.groupBy(key).agg(
        F.min(F.when(F.col("ends"), F.col("page_index"))).alias("_stop"),
        F.min(F.when(~F.col("readable"), F.col("page_index"))).alias("_bad"),
    )
    reached = known.join(stops, key).filter(
        F.col("_stop").isNull() | (F.col("page_index") <= F.col("_stop"))
    )
    failed = F.coalesce(F.col("_bad") <= F.coalesce("_stop", "_bad"), F.lit(False))
    return reached.withColumn("source_failed", failed).drop("_stop", "_bad")


def fetched_pages(pages: DataFrame, key: str, max_pages: int) -> DataFrame:
    """Pages that a reader following the tokens would have seen, with ``source_failed``.

    At most ``max(1, max_pages)`` pages per source, up to the first one without a token. Pages are staged with their facts, so that
    they are fetched and parsed once, though each source's end is looked for before its pages are read.
    """
    within = pages.filter(F.col("page_index") < max(1, max_pages))
    return reached_pages(cut_lineage(page_facts(within)), key).drop("readable", "ends")


def page_items(pages: DataFrame, lists: list[str]) -> DataFrame:
    """One row per object in the first member that is a list (an empty list wins too).

    Adds ``pos`` and ``item`` (JSON text); the order inside a page is ``pos``.
    """
    typed, spelled = P.read_fields(F.col("body"), lists), P.read_fields(F.col("body"), lists, "string")
    values = pages.withColumns({"_typed": typed, "_spelled": spelled})
    kinds, texts = F.lit(None), F.lit(None)
    for name in reversed(lists):
        here = P.is_list(F.col("_typed")[name])
        kinds = F.when(here, F.col("_typed")[name]).otherwise(kinds)
        texts = F.when(here, F.col("_spelled")[name]).otherwise(texts)
    elements = F.arrays_zip(
        F.from_json(texts, "array<string>").alias("text"),
        F.transform(F.try_variant_get(kinds, "$", "array<variant>"), P.is_object).alias("object"),
    )
    rows = values.select(*pages.columns, F.posexplode(elements).alias("pos", "element"))
    return rows.filter("element.object").select(
        *[name for name in pages.columns if name != "body"],
        "pos",
        F.col("element.text").alias("item"),
    )


def payload_keys(items: DataFrame) -> DataFrame:
    """How many payloads carry each top-level key."""
    keys = items.select(F.explode(F.json_object_keys("item")).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("payloads"))
