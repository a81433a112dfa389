"""Positions in a total order without one task that sees all rows.

The rows are dealt to tasks by ranges of the order and sorted there; the number of rows in the tasks before, one count per
task, shifts the position inside the task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.staging import stage

#: ``monotonically_increasing_id`` keeps the task above this bit and the place in the task below it.
_TASK_BIT = 33


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with ``name``, the 1-based position of every row under ``order``; equal rows follow each other in any way.

    The frame is staged, so that both readers see the same tasks.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(sorted_rows.withColumn("_place", F.monotonically_increasing_id()))
    task = F.call_function("shiftright", "_place", F.lit(_TASK_BIT))
    counts = placed.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    before = counts.select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_task", task).join(F.broadcast(before), "_task")
    within = F.col("_place").bitwiseAND((1 << _TASK_BIT) - 1) + 1
    return joined.select(*df.columns, (F.col("_before") + within).cast("long").alias(name))
