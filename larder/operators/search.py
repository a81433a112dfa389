"""Search over places with text, filters, minimum rating, order and paging."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.text import search_pattern
from larder.operators.ordering import flag
from larder.operators.selection import page_rows
from larder.operators.stats import review_stats
from larder.operators.text_index import TextIndex, build_text_index, places_with_text, searchable_texts
from larder.session import cut_lineage
from larder.sources.tables import by_ids

SORTS = ("name", "rating", "created_at")
DEFAULT_LIMIT, MAX_LIMIT = 20, 100
# Up to this depth a page is a bounded top-k; deeper ones are selected range by range.
TOP_K_DEPTH = 500
# Up to so many matches, only their reviews are aggregated.
FEW_PLACES = 100_000

_OWN_TEXT = ["name", "description", "city", "district", "category"]
_LIST_COLUMNS = [
    "id",
    "name",
    "city",
    "district",
    "latitude",
    "longitude",
    "website",
    "phone",
    "description",
    "rating",
    "review_count",
    "category",
    "price_level",
    "opening_hours",
    "operating_hours",
    "thumbnail",
    "google_place_id",
    "serpapi_data_id",
    "reviews_link",
    "photos_link",
    "user_review",
    "average_rating",
    "created_at",
    "updated_at",
]


@dataclass(frozen=True)
class Query:
    """Search arguments; wrong ones raise ``ValueError`` before any plan is built."""

    search: str | None = None
    city: str | None = None
    district: str | None = None
    category: str | None = None
    minimum_rating: float | None = None
    sort: str = "created_at"
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    def __post_init__(self) -> None:
        if self.minimum_rating is not None and not 1 <= self.minimum_rating <= 5:
            raise ValueError("minimum_rating must lie between 1 and 5")
        if self.sort not in SORTS:
            raise ValueError(f"sort must be one of {', '.join(SORTS)}")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit must lie between 1 and {MAX_LIMIT}")
        if self.offset < 0:
            raise ValueError("offset must not be negative")


@dataclass(frozen=True)
class Tables:
    places: DataFrame
    menu_items: DataFrame
    user_reviews: DataFrame
    ext_reviews: DataFrame


def _ids_with_text(tables: Tables, pattern: str) -> DataFrame:
    """Places with a matching dish, comment or external review: one distinct list of keys."""
    sources = [
        (tables.menu_items, "name"),
        (tables.user_reviews, "comment"),
        (tables.ext_reviews, "review_text"),
    ]
    hits = [
        df.filter(F.col(column).ilike(pattern)).select("restaurant_id") for df, column in sources
    ]
    return hits[0].unionByName(hits[1]).unionByName(hits[2]).distinct()


def build_index(tables: Tables, path: str) -> TextIndex:
    """The trigram index over all texts that a search looks at."""
    columns = {
        "places": (tables.places, "id", _OWN_TEXT),
        "menu_items": (tables.menu_items, "restaurant_id", ["name"]),
        "user_reviews": (tables.user_reviews, "restaurant_id", ["comment"]),
        "ext_reviews": (tables.ext_reviews, "restaurant_id", ["review_text"]),
    }
    return build_text_index(searchable_texts(columns), path)


def _filtered(tables: Tables, query: Query, index: TextIndex | None = None) -> DataFrame:
    """Places that pass every filter but the rating."""
    df = tables.places
    if query.city is not None:
        df = df.filter(F.col("city") == query.city)
    if query.district is not None:
        df = df.filter(F.col("district") == query.district)
    if query.category is not None:
        serving = tables.menu_items.filter(F.col("category") == query.category)
        keys = serving.select(F.col("restaurant_id").alias("id")).distinct()
        df = df.join(keys, "id", "left_semi")
    pattern = search_pattern(query.search)
    indexed = places_with_text(index, pattern) if index is not None and pattern is not None else None
    if indexed is not None:
        return df.join(indexed.withColumnRenamed("restaurant_id", "id"), "id", "left_semi")
    if pattern is not None:
        mentioned = _ids_with_text(tables, pattern).withColumnRenamed("restaurant_id", "id")
        own = F.lit(False)
        for column in _OWN_TEXT:
            own = own | F.coalesce(F.col(column).ilike(pattern), F.lit(False))
        df = flag(df, mentioned, ["id"], "_mentioned").filter(own | F.col("_mentioned"))
        df = df.drop("_mentioned")
    return df


def _with_stats(places: DataFrame, tables: Tables) -> DataFrame:
    stats = review_stats(tables.ext_reviews, tables.user_reviews).select(
        F.col("restaurant_id").alias("id"),
        "average_exact",
        "average_rating",
        F.col("review_count").alias("_reviews"),
    )
    joined = places.drop("rating", "review_count").join(stats, "id", "left")
    return joined.withColumn("review_count", F.coalesce("_reviews", F.lit(0).cast("long"))).drop("_reviews")


def _order(sort: str) -> list[Column]:
    """Total order: the id settles what the sort key leaves open."""
    newest = F.col("created_at").desc()
    first = {
        "name": [F.col("name").asc(), newest],
        "rating": [F.col("average_exact").desc_nulls_last(), newest],
        "created_at": [newest],
    }[sort]
    return first + [F.col("id").asc()]


def _ascending(sort: str) -> list[Column]:
    """The same order as keys that ascend."""
    newest = -F.unix_micros("created_at")
    average = F.col("average_exact")
    first = {"name": [F.col("name")], "rating": [average.isNull(), -average], "created_at": []}[sort]
    return [*first, newest, F.col("id")]


def matching_places(tables: Tables, query: Query, index: TextIndex | None = None) -> DataFrame:
    """All matches with their statistics, unsorted and unpaged.

    Where the filters leave few places, only the reviews of these are aggregated.
    """
    df = _filtered(tables, query, index)
    if any(x is not None for x in (query.city, query.district, query.category, search_pattern(query.search))):
        df = cut_lineage(df)
        if df.count() <= FEW_PLACES:
            keys = F.broadcast(df.select(F.col("id").alias("restaurant_id")))
            near = {
                name: getattr(tables, name).join(keys, "restaurant_id", "left_semi") for name in ("user_reviews", "ext_reviews")
            }
            tables = replace(tables, **near)
    df = _with_stats(df, tables)
    if query.minimum_rating is not None:
        df = df.filter(F.col("average_exact") >= F.lit(float(query.minimum_rating)))
    return df


def search_total(tables: Tables, query: Query, index: TextIndex | None = None) -> DataFrame:
    """One row with the number of matches. Statistics are read only where the rating filters."""
    rated = query.minimum_rating is not None
    df = matching_places(tables, query, index) if rated else _filtered(tables, query, index)
    return df.agg(F.count(F.lit(1)).alias("total"))


def search_places(tables: Tables, query: Query, index: TextIndex | None = None) -> DataFrame:
    """One page. ``rating`` and ``average_rating`` both hold the computed value.

    The page is cut from narrow rows, which hold statistics only where ratings filter or sort. Its ids (at most ``MAX_LIMIT``)
    are fetched; with them the places, and the reviews where statistics are missing, are read by a pushed-down filter.
    """
    rated = query.minimum_rating is not None or query.sort == "rating"
    found = matching_places(tables, query, index) if rated else _filtered(tables, query, index)
    figures = ["average_exact", "average_rating", "review_count"] if rated else []
    narrow = found.select("id", "name", "created_at", *figures)
    rows = page_rows(narrow, _ascending(query.sort), query.offset, query.limit, TOP_K_DEPTH)
    ids = [row["id"] for row in rows]
    df = by_ids(tables.places, ids)
    if rated:
        stats = df.sparkSession.createDataFrame(rows, narrow.schema).select("id", *figures)
        df = df.drop("rating", "review_count").join(F.broadcast(stats), "id")
    else:
        near = replace(
            tables,
            user_reviews=by_ids(tables.user_reviews, ids, "restaurant_id"),
            ext_reviews=by_ids(tables.ext_reviews, ids, "restaurant_id"),
        )
        df = _with_stats(df, near)
    shown = df.withColumn("rating", F.col("average_rating"))
    return shown.orderBy(*_order(query.sort)).select(*_LIST_COLUMNS)


def page_facts(total: DataFrame, limit: int, offset: int) -> DataFrame:
    """Page number, number of pages (at least 1) and the neighbours of a page."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("int")
    return total.select(
        "total",
        F.lit(offset // limit + 1).alias("current_page"),
        pages.alias("total_pages"),
        F.lit(offset > 0).alias("has_previous"),
        (F.lit(offset + limit) < F.col("total")).alias("has_next"),
        F.lit(max(offset - limit, 0)).alias("previous_offset"),
        F.lit(offset + limit).alias("next_offset"),
    )
