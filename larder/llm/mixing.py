"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, how often it should be taken, as close as possible in relative entropy to taking everything once,
such that the words taken of each source meet the source's target and no rate leaves the range from 0 to ``most``. The convex
dual of that problem has one variable per source, and its solution tilts the rates exponentially by the size of the document:
odds of rate against ``most - rate`` are 1 to ``most - 1``, times e to the power of the variable times the relative size. Newton's
iterations on the dual run as aggregates over (source, size, number of documents), a bracket around each variable keeps
them from leaping; the state is a table with one row per source.

Rates become whole copies block by block: a block is a bounded share of one source's documents, taken from the longest to the
shortest, and each document's rounding error in words is carried to the next, so that a block ends within about the size of
its shortest documents of what its rates ask for. All sums are exact decimals and all orders are total, so reruns agree.

Defined results: a null or empty text has size 0 and nothing of it is taken; a null source is a source of its own and comes
last; rows that share an id are mixed each by itself; a source without words has target 0; a text of any length is counted whole; documents
of equal size go by id, then by text; an empty table gives an empty result; other columns are not read, and are returned as they were
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from larder.llm.names import free_names
from larder.operators.numbering import numbered
from larder.staging import stage

_WHITE = " \t\n\x0b\f\r"
_SPLIT = "[\\x20\\x09-\\x0D]+"
#: Documents of one source that are rounded together, about.
_BLOCK_ROWS = 2_000
#: Tables of sources up to so many rows are broadcast.
_BROADCAST_SOURCES = 10_000
#: Relative error of a source's words at which its variable is settled.
_PRECISION = 1e-7
#: Beyond this exponent a rate is 0 or the most, to the last bit.
_EXPONENT = 700.0


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_WHITE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, _SPLIT))).cast("long")


def _exact(value: Column) -> Column:
    """A double as a decimal: sums of it do not depend on the order of addition."""
    return value.cast("decimal(30,6)")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Add ``target`` to (source, source_size): the total by weight, none above ``most`` times its size.

    Sources take the ``weights`` in turn, by code point, null last. Each round caps the sources that the common level lifts
    too high and shares what they can't take among the others.
    """
    ordered = numbered(sources, [F.col("source").asc_nulls_last()], "_position")
    turn = F.array(*[F.lit(weight) for weight in weights])
    weighted = stage(
        ordered.select(
            "source",
            "source_size",
            F.get(turn, ((F.col("_position") - 1) % len(weights)).cast("int")).alias("_weight"),
            (F.col("source_size") * most).alias("_cap"),
        )
    )
    total, level = weighted.agg(F.sum("source_size")).head()[0] or 0, 0.0
    while True:
        capped = F.col("_weight") * F.lit(level) > F.col("_cap")
        taken, open_weight = weighted.agg(
            F.coalesce(F.sum(F.when(capped, F.col("_cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("_weight"))), F.lit(0)),
        ).head()
        higher = (total - taken) / open_weight if open_weight else level
        if higher <= level:
            break
        level = higher
    return weighted.select(
        "source", "source_size", F.least(F.col("_weight") * F.lit(level), F.col("_cap").cast("double")).alias("target")
    )


def _rate(variable: Column, size: Column, mean: Column, most: int) -> Column:
    exponent = F.greatest(F.least(-variable * size / mean, F.lit(_EXPONENT)), F.lit(-_EXPONENT))
    return F.lit(float(most)) / (1 + (most - 1) * F.exp(exponent))


def balance(sized: DataFrame, aimed: DataFrame, most: int = 3) -> DataFrame:
    """The dual variable of every source: (source, source_size, target, mean, variable).

    A variable is null where no words are to be taken or all are to be taken ``most`` times: those rates are 0 and ``most``.
    The iterations go on until every source is within ``_PRECISION`` of its target, or no variable moves any more since the
    numbers around it are used up.
    """
    spread = stage(sized.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    means = spread.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("_words"), F.sum("n").alias("_docs"))
    inside = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))
    means = means.select(F.col("source").alias("_source"), (F.col("_words") / F.col("_docs")).alias("mean"))
    state = stage(
        aimed.join(means, aimed["source"].eqNullSafe(means["_source"]), "left").select(
            "source",
            "source_size",
            "target",
            F.coalesce("mean", F.lit(1.0)).alias("mean"),
            F.when(inside, F.lit(0.0)).alias("variable"),
            F.lit(None).cast("double").alias("_low"),
            F.lit(None).cast("double").alias("_high"),
        )
    )
    while True:
        known = state.select(F.col("source").alias("_source"), "mean", "variable")
        rated = spread.join(known, spread["source"].eqNullSafe(known["_source"]))
        rate = _rate(F.col("variable"), F.col("size"), F.col("mean"), most)
        words = F.col("n") * F.col("size") * rate
        sums = rated.groupBy("_source").agg(
            F.sum(_exact(words)).cast("double").alias("_words"),
            F.sum(_exact(words * (1 - rate / most) * F.col("size") / F.col("mean"))).cast("double").alias("_slope"),
        )
        state = stage(_step(state, sums))
        worst, moved = state.agg(F.max(F.abs(F.col("_off")) / F.col("target")), F.bool_or("_moved")).head()
        state = state.drop("_off", "_moved")
        if worst is None or worst <= _PRECISION or not moved:
            break
    return state.drop("_low", "_high")


def _step(state: DataFrame, sums: DataFrame) -> DataFrame:
    """One Newton step; where it leaves the bracket, the bracket's middle instead. ``_off`` is the error before the step, ``_moved`` whether it moved."""
    joined = state.join(sums, state["source"].eqNullSafe(sums["_source"]), "left").drop("_source")
    off = joined.withColumn("_off", F.when(F.col("variable").isNotNull(), F.col("_words") - F.col("target")))
    bracketed = off.withColumns(
        {
            "_low": F.when(F.col("_off") < 0, F.col("variable")).otherwise(F.col("_low")),
            "_high": F.when(F.col("_off") > 0, F.col("variable")).otherwise(F.col("_high")),
        }
    )
    newton = F.col("variable") - F.col("_off") / F.col("_slope")
    # sizes are 1 at least, so no variable needs to lie further out
    leaping = newton.isNull() | (newton <= F.col("_low")) | (newton >= F.col("_high")) | (F.abs(newton) > _EXPONENT * F.col("mean"))
    middle = (
        F.when(F.col("_low").isNull(), F.least(F.col("_high") * 2, F.col("_high") - 1))
        .when(F.col("_high").isNull(), F.greatest(F.col("_low") * 2, F.col("_low") + 1))
        .otherwise((F.col("_low") + F.col("_high")) / 2)
    )
    settled = F.abs(F.col("_off")) <= _PRECISION * F.col("target")
    following = F.when(settled, F.col("variable")).when(F.coalesce(leaping, F.lit(False)), middle).otherwise(newton)
    moved = bracketed.withColumn("_following", F.when(F.col("variable").isNotNull(), following))
    moved = moved.withColumn("_moved", ~F.col("_following").eqNullSafe(F.col("variable")))
    return moved.withColumn("variable", F.col("_following")).drop("_words", "_slope", "_following")


def _copies(block: pd.DataFrame, most: int) -> pd.DataFrame:
    """Whole copies of one block's documents, the error in words carried from the longest to the shortest."""
    block = block.sort_values(["size", "doc_id", "_hash"], ascending=[False, True, True], kind="stable")
    carried, copies = 0.0, np.zeros(len(block), np.int64)
    for k, (size, rate) in enumerate(zip(block["size"].tolist(), block["rate"].tolist())):
        if size:
            copies[k] = min(most, max(0, math.floor(rate + carried / size + 0.5)))
            carried += (rate - copies[k]) * size
    return block.assign(copies=copies).drop(columns="_block")


def _mixed(docs: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(doc_id, _hash, size, source_size, target, rate, _source, copies) of (doc_id, source, text)."""
    sized = stage(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64("text").alias("_hash"),
        )
    )
    sources = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")))
    state = balance(sized, targets(sources.drop("_docs"), weights, most), most)
    counts = sources.select(F.col("source").alias("_counted"), "_docs")
    known = state.join(counts, state["source"].eqNullSafe(F.col("_counted")))
    known = stage(known.withColumnRenamed("source", "_source").drop("_counted"))
    few = known.limit(_BROADCAST_SOURCES + 1).count() <= _BROADCAST_SOURCES
    rows = sized.join(F.broadcast(known) if few else known, sized["source"].eqNullSafe(F.col("_source")))
    blocks = F.ceil(F.col("_docs") / _BLOCK_ROWS)
    whole = F.when(F.col("target") > 0, F.lit(float(most))).otherwise(F.lit(0.0))
    rated = rows.select(
        "doc_id",
        "_hash",
        "size",
        "source_size",
        "target",
        F.coalesce(_rate(F.col("variable"), F.col("size"), F.col("mean"), most), whole).alias("rate"),
        "_source",
        F.pmod(F.xxhash64("doc_id", "_hash"), blocks).alias("_block"),
    )
    return rated.groupBy("_source", "_block").applyInPandas(
        lambda block: _copies(block, most),
        f"doc_id {dict(docs.dtypes)['doc_id']}, _hash long, size long, source_size long, target double, rate double, _source string, "
        "copies long",
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    id_column: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """(id, size, source_size, target, rate, copies, taken) of every document."""
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    mixed = _mixed(named, weights, most).drop("_hash", "_source")
    return mixed.withColumn("taken", F.col("copies") * F.col("size")).withColumnRenamed("doc_id", id_column)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The documents, each as often as the mix takes it, all columns as they were.

    Of rows that share id, source and text, each is taken as often as the one that is taken most.
    """
    mixed = _mixed(docs.select("doc_id", "source", "text"), weights, most)
    taken = mixed.groupBy("doc_id", "_source", "_hash").agg(F.max("copies").alias("copies")).filter("copies > 0")
    names = free_names(docs, "mixed_id", "mixed_source", "mixed_hash", "copies", "copy")
    known = taken.select(*[F.col(old).alias(new) for old, new in zip(("doc_id", "_source", "_hash", "copies"), names)])
    own_id, own_source, own_hash, copies, copy = names
    same = (
        F.col("doc_id").eqNullSafe(F.col(own_id))
        & F.col("source").cast("string").eqNullSafe(F.col(own_source))
        & (F.xxhash64("text") == F.col(own_hash))
    )
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copy)
    return docs.join(known, same).select(*[docs[f"`{name}`"] for name in docs.columns], each).drop(copy)
