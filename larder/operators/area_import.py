"""Import of several landed searches for one area, followed by the review sync of the new places."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions import payload as P
from larder.operators.ingest import SEQUENCE, clean_items, import_counts, import_places
from larder.operators.numbering import numbered
from larder.operators.upsert import Synced, sync_reviews, sync_totals
from larder.session import cut_lineage
from larder.sources.pages import PLACE_LISTS, fetched_pages, page_items

# The town and the spellings that place an address in its university quarter. The second
# spelling of the quarter has a cedilla as a character of its own.
TOWN = "Kırıkkale"
TOWN_SPELLINGS = ["kırıkkale", "kirikkale"]
QUARTER_SPELLINGS = [
    "yenişehir",
    "yenişehir",
    "üniversite",
    "universite",
    "kırıkkale üniversitesi",
    "kirikkale universitesi",
]


def in_town(item: Column) -> Column:
    """Any text value at any depth names the town."""
    return P.any_text_contains(item, TOWN)


def in_quarter(item: Column) -> Column:
    return P.mentions_area(item, TOWN_SPELLINGS, QUARTER_SPELLINGS)


@dataclass(frozen=True)
class AreaImport:
    """``outcomes`` has the ordinal of each item among the kept ones; ``summary`` is one row."""

    outcomes: DataFrame
    new_places: DataFrame
    reviews: Synced
    summary: DataFrame


def ordinals(items: DataFrame) -> DataFrame:
    """Add ``ordinal`` and ``total``: the place of an item in the whole run, numbered in parallel.

    ``items`` is counted at once; hand in rows that are cut from their lineage.
    """
    placed = numbered(items, [F.col(name) for name in SEQUENCE], "ordinal")
    return placed.withColumn("total", F.lit(items.count()).cast("long"))


def _side_by_side(parts: list[DataFrame]) -> DataFrame:
    """Frames of one row each as one row: put under each other, then the only value of each column."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def search_items(pages: DataFrame, max_pages: int) -> DataFrame:
    """Items of all searches that could be read: source_query, source_rank, page_index, pos, item.

    A search with an unreadable page gives nothing, the others are not affected.
    """
    fetched = fetched_pages(pages, "source_query", max_pages)
    return page_items(fetched.filter(~F.col("source_failed")).drop("source_failed"), PLACE_LISTS)


def import_area(
    pages: DataFrame,
    review_pages: DataFrame,
    stored_places: DataFrame,
    stored_reviews: DataFrame,
    as_of: Column,
    keep: Callable[[Column], Column] = in_town,
    city: str = TOWN,
    search_pages: int = 3,
    pages_per_place: int = 20,
) -> AreaImport:
    """``pages``: source_query, source_rank, page_index, body. ``review_pages``: target_id, page_index, body.

    Only places that this run adds get their reviews synced.
    """
    fetched = fetched_pages(pages, "source_query", search_pages).filter(~F.col("source_failed"))
    found = page_items(fetched.drop("source_failed"), PLACE_LISTS)
    marked = cut_lineage(found.withColumn("_kept", keep(F.col("item"))))
    kept = marked.filter("_kept").drop("_kept")
    cleaned = clean_items(kept, city)
    places = import_places(cleaned, stored_places, as_of)
    outcomes = cut_lineage(places.outcomes)
    new_places = cut_lineage(places.new_places)
    reviews = sync_reviews(new_places, review_pages, stored_reviews, as_of, pages_per_place)
    failed = reviews.stats.filter("rejected > 0").agg(F.count(F.lit(1)).alias("_failed"))
    totals = sync_totals(reviews.stats).select(
        *[F.col(name).alias(f"reviews_{name}") for name in ("imported", "updated", "skipped", "rejected")]
    )
    searches = fetched.agg(F.count_distinct("source_query").alias("searches_used"))
    counted = marked.agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(~F.col("_kept")).alias("invalid")
    )
    one_row = _side_by_side([counted, import_counts(outcomes), totals, searches, failed])
    summary = one_row.withColumn("with_review_sync", F.col("imported") - F.col("_failed")).drop("_failed")
    listed = outcomes.join(ordinals(outcomes.select(*SEQUENCE)), SEQUENCE)
    return AreaImport(listed, new_places, reviews, summary)
