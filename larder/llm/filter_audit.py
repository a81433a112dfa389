"""How five text filters interact in every order, from one count per set of failed filters.

A document fails a set of filters whatever their order, so one additive count per part and set (32 sets) holds all that the 120
orders need: kept, removed, redundant and lost documents of every step are sums over sets, and so is each filter's Shapley value. Four
filters look at one text; the fifth fails documents whose text an earlier document has, table-wide, and is the only one that needs a shuffle:

1. Prepass: every text's 64-bit hash puts four counts into cells of its segment of a counting Bloom sketch. Tasks count what they see, up to
   two a cell, and send the touched cells; the pieces of a segment are added up and leave one bit per cell, set where the
   count is two or more. A text with a cell that was touched once is unique, for certain, and takes no further part. The number of segments
   follows the number of documents (16 cells a document, 2 bytes of bits), so that about one unique text in 400 is kept by chance at any size.
2. Only what is left, the possible repeats, shuffles: the exact least id per full text, from a minimum that is combined before the shuffle.
3. The flags, a few bytes a document, are joined by id and counted per part and set.

The bits are broadcast up to ``BROADCAST_BYTES`` (checked: it is the number of documents times two bytes); beyond that Spark joins them by
segment, hot segments split. A text that a third of all documents share costs two counts a task and cell, one row a task in the minimum.

Defined results: a null text is an empty text, equal to other empty ones; a null ``part`` is the empty string; texts are compared and counted whole at any
length; rows with one id and one text are not duplicates of each other, those with a smaller id and the text are what they duplicate; a row without
id is never a duplicate and makes none; several labels of one id count where one of them is 1; labels of unknown ids count nowhere; a null label is none;
an empty table has no parts and gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.staging import stage

FILTERS = "ABCDE"
#: Documents a segment is made for, and its cells. Four 16-bit places of a 64-bit hash address the cells.
_SEGMENT_ROWS, _CELLS = 4096, 1 << 16
_PLACES = 4
#: Hashes that a task gathers before it sends cells.
_FLUSH = 1 << 19
#: Texts that are split together.
_TEXTS = 256
#: Bits of all segments that may be broadcast: those of 128 million documents.
BROADCAST_BYTES = 1 << 28

_SIGN = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))


def _hashed(docs: DataFrame, segments: int) -> DataFrame:
    """Add the segment and the places of a text: a hash, and a hash of the hash whose 16-bit parts are the places."""
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    return hashed.withColumns(
        {"segment": F.pmod("hash", F.lit(segments)).cast("int"), "places": F.xxhash64("hash", F.lit("places"))}
    )


def _touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one task counts: per segment its touched cells, those that were touched more often twice."""

    def pieces(segments: list[np.ndarray], places: list[np.ndarray]) -> pa.RecordBatch:
        segment = np.concatenate(segments).astype(np.uint64) << np.uint64(16)
        place = np.concatenate(places).view(np.uint16).reshape(-1, _PLACES).astype(np.uint64)
        # a text whose places fall together counts once in the cell
        place.sort(axis=1)
        own = np.concatenate((np.ones((len(place), 1), bool), place[:, 1:] != place[:, :-1]), axis=1)
        cells, counts = np.unique((place | segment[:, None])[own], return_counts=True)
        cells = np.repeat(cells, np.minimum(counts, 2))
        bounds = np.flatnonzero(np.concatenate(([True], np.diff(cells >> np.uint64(16)) != 0, [True])))
        low = cells.astype(np.uint16).astype("<u2").tobytes()
        return pa.RecordBatch.from_arrays(
            [
                pa.array((cells[bounds[:-1]] >> np.uint64(16)).astype(np.int32)),
                pa.array([low[2 * a : 2 * b] for a, b in itertools.pairwise(bounds.tolist())], pa.binary()),
            ],
            names=["segment", "cells"],
        )

    segments, places, rows = [], [], 0
    for batch in batches:
        segments.append(batch.column(0).to_numpy())
        places.append(batch.column(1).to_numpy())
        rows += batch.num_rows
        if rows >= _FLUSH:
            yield pieces(segments, places)
            segments, places, rows = [], [], 0
    if rows:
        yield pieces(segments, places)


def _merged(pieces: pa.Table) -> pa.Table:
    """The bits of one segment: set where the added counts reach two."""
    counts = np.zeros(_CELLS, np.uint8)
    for cells in pieces.column("cells"):
        found, n = np.unique(np.frombuffer(cells.as_buffer(), "<u2"), return_counts=True)
        counts[found] = np.minimum(counts[found] + n, 2)
    bits = np.packbits(counts >= 2, bitorder="little").view("<i8")
    whole = pa.ListArray.from_arrays(pa.array([0, len(bits)], pa.int32()), pa.array(bits))
    return pa.table({"segment": pieces.column("segment").slice(0, 1), "bits": whole})


def repeat_sketch(hashes: DataFrame) -> DataFrame:
    """(segment, bits) of all segments from the ``segment`` and ``places`` of every text; one row a segment."""
    pieces = hashes.select("segment", "places").mapInArrow(_touched, "segment int, cells binary")
    return pieces.groupBy("segment").applyInArrow(_merged, "segment int, bits array<long>")


def possible_repeat(bits: Column, places: Column) -> Column:
    """Whether all cells of a text were touched twice: false is certain, true may be chance."""
    result = F.lit(True)
    for k in range(_PLACES):
        place = F.shiftrightunsigned(places, 16 * k).bitwiseAND(0xFFFF).cast("int")
        word = F.get(bits, F.shiftright(place, 6))
        result = result & (F.call_function("bit_get", word, place.bitwiseAND(63)) == 1)
    return result


def _failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits 0 to 3 for the filters A to D; the text goes on only where the row may be a repeat."""
    for batch in batches:
        text, masks = batch.column("text"), []
        for start in range(0, batch.num_rows, _TEXTS):
            part = text.slice(start, _TEXTS)
            for raw, characters in zip(part.cast(pa.binary()).to_pylist(), pc.utf8_length(part).to_pylist()):
                words = raw.split()  # at the six white-space characters of ASCII
                capitals = len(raw) - len(raw.translate(None, _CAPITALS))
                masks.append(
                    (len(words) < 200)
                    | (100 * len(set(words)) < 50 * len(words)) << 1
                    | (100 * capitals > 3 * characters) << 2
                    | (_SIGN.search(raw) is not None) << 3
                )
        columns = {name: batch.column(name) for name in ("id", "part", "hash")}
        kept = pc.if_else(batch.column("maybe"), text, pa.scalar(None, pa.string()))
        yield pa.RecordBatch.from_pydict(columns | {"mask": pa.array(masks, pa.int32()), "text": kept})


def failed_filters(docs: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, mask) of every row; bit k of the mask is set where the row fails filter k of ``FILTERS``."""
    named = docs.select(
        docs[id_column].cast("long").alias("id"),
        F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"),
    )
    segments = max(1, -(-named.count() // _SEGMENT_ROWS))
    hashed = _hashed(named, segments)
    bits = stage(repeat_sketch(hashed))
    if segments * _CELLS // 8 <= BROADCAST_BYTES:
        bits = F.broadcast(bits)
    maybe = possible_repeat(F.col("bits"), F.col("places")) & F.col("id").isNotNull()
    judged = hashed.join(bits, "segment").select("id", "part", "hash", "text", maybe.alias("maybe"))
    facts = stage(judged.mapInArrow(_failures, "id long, part string, hash long, mask int, text string"))
    unique, repeats = facts.filter("text IS NULL"), facts.filter("text IS NOT NULL")
    # the first row of each text; its id may come with another text, too, which the hash tells apart
    first = repeats.groupBy("text").agg(F.min("id").alias("id"), F.first("hash").alias("hash"))
    first = first.select("id", "hash").distinct().withColumn("first", F.lit(True))
    later = F.when(F.col("first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(0)
    marked = repeats.select("id", "part", "hash", "mask").join(first, ["id", "hash"], "left")
    return unique.select("id", "part", "mask").union(marked.select("id", "part", F.col("mask").bitwiseOR(later).alias("mask")))


def mask_counts(failed: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Documents, good and toxic documents per part and set of failed filters."""
    known = labels.groupBy(labels[id_column].cast("long").alias("id")).agg(
        F.max((labels["quality"] == 1).cast("int")).alias("good"), F.max((labels["toxic"] == 1).cast("int")).alias("toxic")
    )
    counted = failed.join(known, "id", "left").groupBy("part", "mask")
    zero = F.lit(0).cast("long")
    return counted.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(F.col(name).cast("long")), zero).alias(name) for name in ("good", "toxic")],
    )


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counts of every set of failed filters."""
    orders = F.array(*[F.lit("".join(order)) for order in itertools.permutations(FILTERS)])
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = F.transform(F.split("filter_order", ""), lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(FILTERS[0])))
    earlier = F.aggregate(F.slice(bits, F.lit(1), F.col("step") - 1), F.lit(0), lambda total, bit: total.bitwiseOR(bit))
    steps = steps.withColumns({"bit": F.element_at(bits, F.col("step")), "earlier": earlier})
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0

    def total(condition: Column, name: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(name)).otherwise(F.lit(0).cast("long")))

    summed = steps.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    every_order = Window.partitionBy("part", "bit")
    return summed.withColumn("shapley", F.sum("removed").over(every_order)).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of the five filters does at each step of all their orders, per language."""
    return audit(stage(mask_counts(failed_filters(docs), labels)))
