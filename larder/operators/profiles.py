"""Nested place profiles: the place, its statistics, its menu and its reviews.

A profile has one head row per place (``profile_heads``) and parts with the key (place, part), which hold its dishes and then its reviews, in
order (``profile_parts``). A running sum of the bytes of a place's rows says in which part a row lies. A part starts where the sum passes a
multiple of ``part_bytes``, so it holds at most that many bytes and the rest of one row, whatever the size of the place, and which
rows share a part depends on the place alone. Rows are shuffled once, by their place. Places of more than ``PROFILE_ROWS`` rows are sorted by ranges
of place and order instead; the sum is taken inside each task and shifted by what the place has in earlier tasks, so a place of a third of all
rows costs each task its share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from larder.operators.ordering import hot_groups, mark_hot
from larder.operators.reviews import EXTERNAL, sort_key, unified_reviews
from larder.operators.search import Tables
from larder.operators.stats import review_stats
from larder.session import cut_lineage
from larder.sources.tables import by_ids

PART_BYTES = 1 << 20
#: Places with more rows are dealt to several tasks.
PROFILE_ROWS = 100_000
#: What a row counts for besides its texts.
ROW_BYTES = 64
#: ``monotonically_increasing_id`` keeps the task above this bit.
_TASK_BIT = 33

_MENU = ["id", "name", "price", "category", "description", "created_at", "updated_at"]
_REVIEW = [
    "id",
    "user_id",
    "rating",
    "comment",
    "created_at",
    "updated_at",
    "author_name",
    "profile_photo",
    "likes",
    "source",
]


def _rows(tables: Tables) -> DataFrame:
    """Dishes and reviews as one frame (restaurant_id, latest, dish, review); what the structs tell is worked out after the shuffle."""
    menu = tables.menu_items.withColumn("price", F.col("price").cast("double"))
    reviews = unified_reviews(tables.ext_reviews, tables.user_reviews)
    dishes = menu.select("restaurant_id", F.lit(0).cast("long").alias("latest"), F.struct(*_MENU).alias("dish"))
    listed = reviews.select("restaurant_id", sort_key()[0].alias("latest"), F.struct(*_REVIEW).alias("review"))
    return dishes.unionByName(listed, allowMissingColumns=True)


def _placed(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` with their ``bytes`` and the columns of their order inside a place: dishes by id, then reviews newest first."""

    def size(name: str) -> Column:
        texts = [f.name for f in rows.schema[name].dataType.fields if isinstance(f.dataType, T.StringType)]
        return reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(name)[text]), F.lit(0)) for text in texts], F.lit(ROW_BYTES))

    is_dish = F.col("dish").isNotNull()
    keys = {
        "rank": F.when(is_dish, 0).otherwise(1),
        "turn": F.when(is_dish | (F.col("review.source") == EXTERNAL), 0).otherwise(1),
        "row_id": F.when(is_dish, F.col("dish.id")).otherwise(F.col("review.id")),
        "row_name": F.when(is_dish, F.coalesce("dish.name", F.lit(""))).otherwise(F.lit("")),
    }
    sizes = F.when(is_dish, size("dish")).otherwise(size("review")).cast("long")
    return rows.withColumns({**keys, "bytes": sizes}), ["rank", "latest", "turn", "row_id", "row_name"]


def _lists(parted: DataFrame) -> DataFrame:
    """The rows of every (restaurant_id, part) as two lists in the order of ``place``."""

    def listed(name: str) -> Column:
        """In order; a list holds only rows that have the column."""
        found = F.collect_list(F.when(F.col(name).isNotNull(), F.struct("place", name)))
        return F.transform(F.array_sort(found), lambda item: item[name])

    return parted.groupBy("restaurant_id", "part").agg(listed("dish").alias("menu_items"), listed("review").alias("reviews"))


def _parts_by_place(rows: DataFrame, part_bytes: int) -> DataFrame:
    """Parts of places that a task can hold: one shuffle by the place serves the sum, the lists and the join with the heads."""
    placed, order = _placed(rows.repartition("restaurant_id"))
    window = Window.partitionBy("restaurant_id").orderBy(*order)
    running = F.coalesce(F.sum("bytes").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = placed.select(
        "restaurant_id", "dish", "review", F.row_number().over(window).alias("place"), F.floor(running / part_bytes).alias("part")
    )
    return _lists(summed)


def _parts_by_ranges(rows: DataFrame, part_bytes: int) -> DataFrame:
    """Parts of hot places, whose rows are dealt to tasks by ranges of place and order."""
    placed, order = _placed(rows)
    order = ["restaurant_id", *order]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ordered.select("restaurant_id", "bytes", "dish", "review", F.monotonically_increasing_id().alias("place")))
    task = F.shiftright("place", _TASK_BIT).alias("task")
    sums = placed.groupBy(task, "restaurant_id").agg(F.sum("bytes").alias("held"))
    # only places that go on from one task to the next have anything before: two per task at most
    several = sums.groupBy("restaurant_id").agg(F.min("task").alias("low"), F.max("task").alias("high")).filter("low < high")
    earlier = Window.partitionBy("restaurant_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    several = several.select(F.col("restaurant_id").alias("_several"))
    shared = sums.join(several, sums["restaurant_id"].eqNullSafe(several["_several"]))
    before = shared.select(
        F.col("restaurant_id").alias("_id"), F.col("task").alias("_task"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before")
    )
    running = Window.partitionBy("task", "restaurant_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("task", task).withColumn("running", F.coalesce(F.sum("bytes").over(running), F.lit(0)))
    offset = F.col("running") + F.coalesce("before", F.lit(0))
    here = (F.col("task") == F.col("_task")) & F.col("restaurant_id").eqNullSafe(F.col("_id"))
    return _lists(summed.join(F.broadcast(before), here, "left").withColumn("part", F.floor(offset / part_bytes)))


def profile_parts(tables: Tables, part_bytes: int = PART_BYTES, hot_rows: int = PROFILE_ROWS) -> DataFrame:
    """(restaurant_id, part, menu_items, reviews): parts 0, 1, ... of every place that has rows, none of them empty but for gaps
    that a single row larger than a part leaves in the numbers."""
    rows = _rows(tables)
    hot = hot_groups(rows, ["restaurant_id"], hot_rows)
    if hot is None:
        return _parts_by_place(rows, part_bytes)
    marked = mark_hot(rows, ["restaurant_id"], hot)
    small = _parts_by_place(marked.filter(~F.col("_hot")).drop("_hot"), part_bytes)
    return small.unionByName(_parts_by_ranges(marked.filter("_hot").drop("_hot"), part_bytes))


def profile_heads(tables: Tables) -> DataFrame:
    """One row per place: its own columns, with ``rating`` and ``review_count`` computed, and ``average_rating``."""
    stats = review_stats(tables.ext_reviews, tables.user_reviews).select(
        F.col("restaurant_id").alias("id"), "average_rating", F.col("review_count").alias("_reviews")
    )
    joined = tables.places.drop("rating", "review_count").join(stats, "id", "left")
    return joined.select(
        *[c for c in tables.places.columns if c not in ("rating", "review_count")],
        F.col("average_rating").alias("rating"),
        "average_rating",
        F.coalesce("_reviews", F.lit(0).cast("long")).alias("review_count"),
    )


def place_profiles(
    tables: Tables, part_bytes: int = PART_BYTES, ids: list[str] | DataFrame | None = None
) -> DataFrame:
    """Heads and parts as one frame with the key (id, part); of the places with the given ``ids`` only, where there are any.

    Every place has a part 0, with empty arrays where it has no dishes and no reviews. The ids reach all four scans, so a few profiles
    cost no more than their rows.
    """
    if ids is not None:
        tables = Tables(
            by_ids(tables.places, ids),
            by_ids(tables.menu_items, ids, "restaurant_id"),
            by_ids(tables.user_reviews, ids, "restaurant_id"),
            by_ids(tables.ext_reviews, ids, "restaurant_id"),
        )
    head, parts = profile_heads(tables), profile_parts(tables, part_bytes)
    joined = head.join(parts, head["id"] == parts["restaurant_id"], "left")
    return joined.select(
        *head.columns,
        F.coalesce("part", F.lit(0).cast("long")).alias("part"),
        F.coalesce("menu_items", F.array().cast(parts.schema["menu_items"].dataType)).alias("menu_items"),
        F.coalesce("reviews", F.array().cast(parts.schema["reviews"].dataType)).alias("reviews"),
    )
