"""Order-dependent steps that stay exact when one group holds a large part of all rows.

A plain window sends a whole group to one task. Here the rows of groups above ``hot_rows`` are dealt to tasks by ranges of the order
instead, numbered there, and shifted by the number of rows in the tasks before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.operators.numbering import numbered
from larder.session import cut_lineage

HOT_ROWS = 1_000_000
_MAX_LOCAL_KEYS = 10_000


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int, sizes: DataFrame | None = None) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, or None where there are none. ``sizes`` are their numbers (``_rows``) if known.

    At most ``_MAX_LOCAL_KEYS`` keys come back as a local, broadcast table. Beyond that the counts stay
    a distributed frame and Spark picks the join.
    """
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = sizes.filter(F.col("_rows") > hot_rows).select(*keys)
    found = hot.limit(_MAX_LOCAL_KEYS + 1).collect()
    if not found:
        return None
    if len(found) > _MAX_LOCAL_KEYS:
        return hot
    return F.broadcast(df.sparkSession.createDataFrame(found, hot.schema))


def mark_hot(df: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """Add ``_hot``: true for rows of a hot group."""
    if hot is None:
        return df.withColumn("_hot", F.lit(False))
    right = hot.select(*[F.col(key).alias(f"_hot_{key}") for key in keys], F.lit(True).alias("_hot"))
    match = reduce(
        lambda a, b: a & b, [df[key].eqNullSafe(right[f"_hot_{key}"]) for key in keys]
    )
    joined = df.join(right, match, "left").drop(*[f"_hot_{key}" for key in keys])
    return joined.withColumn("_hot", F.coalesce("_hot", F.lit(False)))


def with_position(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "position", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """1-based position of every row in its group; ``numbering.numbered`` does the same for a whole frame.

    ``order`` must be a total order. Rows of hot groups are numbered as one frame, by ranges of keys and order, and their
    group's first number is taken off.
    """
    hot = hot_groups(df, keys, hot_rows)
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    if hot is None:
        return df.withColumn(name, plain)
    rows = mark_hot(df, keys, hot)
    small = rows.filter(~F.col("_hot")).drop("_hot").withColumn(name, plain)
    placed = numbered(rows.filter("_hot").drop("_hot"), [*[F.col(key).asc() for key in keys], *order], name)
    first = placed.groupBy(*keys).agg(F.min(name).alias("_first"))
    renamed = first.select(*[F.col(key).alias(f"_first_{key}") for key in keys], "_first")
    match = reduce(lambda a, b: a & b, [placed[key].eqNullSafe(renamed[f"_first_{key}"]) for key in keys])
    joined = placed.join(renamed, match).withColumn(name, F.col(name) - F.col("_first") + 1)
    return small.unionByName(joined.select(*df.columns, name))


def _dealt(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows dealt to tasks by ranges of keys and order, with ``_task`` and their ``_place`` in the order."""
    by = [*[F.col(key).asc() for key in keys], *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = cut_lineage(ranged.withColumn("_place", F.monotonically_increasing_id()))
    return placed.withColumn("_task", F.call_function("shiftright", "_place", F.lit(33)))


def with_previous(
    df: DataFrame, keys: list[str], order: list[Column], column: str, hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None
) -> DataFrame:
    """Add ``previous`` (``column`` of the row before in its group), ``is_first`` and ``is_last``.

    Rows of hot groups are dealt to tasks by ranges; the first row of a task meets the last one of the task before. ``sizes`` (the keys
    and ``_rows``) saves the count of the groups.
    """

    def marked(rows: DataFrame, by: list[str], at: list[Column]) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*at)
        return rows.withColumns(
            {
                "previous": F.lag(column).over(window),
                "is_first": F.row_number().over(window) == 1,
                "is_last": F.lead(F.lit(True)).over(window).isNull(),
            }
        )

    hot = hot_groups(df, keys, hot_rows, sizes)
    if hot is None:
        return marked(df, keys, order)
    rows = mark_hot(df, keys, hot)
    small = marked(rows.filter(~F.col("_hot")).drop("_hot"), keys, order)
    placed = _dealt(rows.filter("_hot").drop("_hot"), keys, order)
    parts = ["_task", *keys]
    ends = placed.groupBy(*parts).agg(F.max_by(column, "_place").alias("_end"))  # few: every hot group fills tasks
    tasks = Window.partitionBy(*keys).orderBy("_task")
    before = ends.select(
        *[F.col(name).alias(f"_before_{name}") for name in parts],
        F.lag("_end").over(tasks).alias("_before"),
        (F.row_number().over(tasks) == 1).alias("_opens"),
        F.lead(F.lit(True)).over(tasks).isNull().alias("_closes"),
    )
    match = reduce(lambda a, b: a & b, [placed[name].eqNullSafe(before[f"_before_{name}"]) for name in parts])
    joined = marked(placed, parts, [F.col("_place")]).join(F.broadcast(before), match)
    large = joined.select(
        *df.columns,
        F.when(F.col("is_first"), F.col("_before")).otherwise(F.col("previous")).alias("previous"),
        (F.col("is_first") & F.col("_opens")).alias("is_first"),
        (F.col("is_last") & F.col("_closes")).alias("is_last"),
    )
    return small.unionByName(large)


def with_last(
    df: DataFrame, keys: list[str], order: list[Column], column: str, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``name``: the latest value of ``column`` that is not NULL, of the row itself or of those before it in its group.

    Rows of hot groups are dealt to tasks by ranges of keys and order; what a task starts with comes from the last values of the tasks before.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    plain = F.last(column, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    hot = hot_groups(df, keys, hot_rows)
    if hot is None:
        return df.withColumn(name, plain)
    rows = mark_hot(df, keys, hot)
    small = rows.filter(~F.col("_hot")).drop("_hot").withColumn(name, plain)
    placed = _dealt(rows.filter("_hot").drop("_hot"), keys, order)
    own = Window.partitionBy("_task", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    known = placed.filter(F.col(column).isNotNull())
    ends = known.groupBy("_task", *keys).agg(F.max_by(column, "_place").alias("_end"))
    here = placed.select("_task", *keys).distinct()
    same = [here[key].eqNullSafe(ends[key]) for key in ["_task", *keys]]
    ends = here.join(ends, reduce(lambda a, b: a & b, same), "left").select(*[here[key] for key in ["_task", *keys]], "_end")
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(
        *[F.col(key).alias(f"_before_{key}") for key in ["_task", *keys]], F.last("_end", ignorenulls=True).over(earlier).alias("_before")
    )
    match = reduce(lambda a, b: a & b, [placed[key].eqNullSafe(before[f"_before_{key}"]) for key in ["_task", *keys]])
    local = F.last(column, ignorenulls=True).over(own)
    joined = placed.withColumn(name, local).join(before, match).withColumn(name, F.coalesce(name, "_before"))
    return small.unionByName(joined.select(*df.columns, name))


def first_wins(df: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """``sequence`` of the earliest row of each group, from a minimum that is combined before the shuffle.

    Join the result back on ``sequence``, which is unique, and not on the keys: copies of one key then
    spread over all tasks.
    """
    if len(sequence) == 1:  # a number, unlike a struct, is combined in hash tables
        return df.groupBy(*keys).agg(F.min(sequence[0]).alias(sequence[0])).select(*keys, *sequence)
    earliest = F.min(F.struct(*sequence)).alias("_first")
    return df.groupBy(*keys).agg(earliest).select(*keys, "_first.*")


def flag(df: DataFrame, chosen: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Boolean ``name``: whether the row's ``keys`` occur in ``chosen`` (unique on them)."""
    marked = chosen.select(*keys, F.lit(True).alias(name))
    return df.join(marked, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
