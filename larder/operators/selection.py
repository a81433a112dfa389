"""One page of a long order, without sorting what comes before it.

The order is cut at bounds taken from a small random sample, the rows of every range are counted in one pass over the narrow rows, and only the
ranges that hold the page go on, until they are few enough for a bounded top-k. Any bounds give the exact page; good ones
only make it quick: a pass leaves about one row in ``_BOUNDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

from larder.session import cut_lineage

_BOUNDS = 128


def _bounds(df: DataFrame, n: int) -> list[Row]:
    """Keys of about ``_BOUNDS`` rows, in order."""
    sample = df.sample(min(1.0, _BOUNDS / n), 7).limit(4 * _BOUNDS)
    rows = sample.orderBy("_key").collect() or df.limit(1).collect()
    return [row["_key"] for row in rows]


def _literal(key: Row, df: DataFrame) -> Column:
    fields = df.schema["_key"].dataType.fields
    return F.struct(*[F.lit(value).cast(f.dataType).alias(f.name) for value, f in zip(key, fields)])


def page_rows(df: DataFrame, keys: list[Column], offset: int, limit: int, depth: int) -> list[Row]:
    """The rows ``offset + 1`` to ``offset + limit`` of ``df`` in the ascending order of ``keys``, which tell all rows apart.

    Up to ``depth`` rows deep the page is a plain bounded top-k of one pass.
    """
    keyed = df.withColumn("_key", F.struct(*[key.alias(f"k{i}") for i, key in enumerate(keys)]))
    if offset + limit > depth:
        keyed = cut_lineage(keyed)
        n = keyed.count()
        while n > max(depth, 2 * limit) and offset < n:
            bounds = [_literal(key, keyed) for key in _bounds(keyed, n)]
            reached = F.size(F.filter(F.array(*bounds), lambda bound: bound <= F.col("_key")))
            counts = {row[0]: row[1] for row in keyed.groupBy(reached).agg(F.count(F.lit(1))).collect()}
            first, before = 0, 0
            while before + counts.get(first, 0) <= offset:
                before += counts.get(first, 0)
                first += 1
            last, held = first, counts[first]
            while before + held < offset + limit and last < len(bounds):
                last += 1
                held += counts.get(last, 0)
            if held == n:
                break
            keyed = keyed.filter(reached.between(first, last))
            offset, n = offset - before, held
    page = keyed.orderBy("_key").offset(offset).limit(limit)
    return page.drop("_key").collect()
