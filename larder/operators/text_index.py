"""A trigram index over all searchable texts, kept as Parquet, so that a text search reads the texts of candidates only.

All texts (five columns of a place, dish names, comments, external reviews) are put in one order by table and place and cut into blocks of
``BLOCK_ROWS`` rows. For every trigram of the lower-cased texts and every block there is one posting list, the slots of the block
whose text has the trigram; every file holds the lists of its blocks, sorted by trigram. A search takes the trigrams of the pattern's literal runs,
intersects their lists block by block, reads the texts in these slots and checks them with ``ilike``. Lists are bounded by the block, however
frequent a trigram or large a place is. A pattern without three literal characters in a row has no trigrams: it is a scan.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.operators.numbering import numbered
from larder.session import cut_lineage

BLOCK_ROWS = 4096
#: So many blocks are named in the filter of the text scan; more are joined.
_NAMED_BLOCKS = 1000
_POSTINGS = "trigram string, block long, slots array<int>"
#: So many characters are turned into trigrams at a time.
_PIECE = 1 << 20

# The functions that run in Python workers go there by value: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class TextIndex:
    """``texts``: (block, slot, restaurant_id, text); ``postings``: (trigram, block, slots)."""

    texts: DataFrame
    postings: DataFrame


def searchable_texts(columns: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(source, restaurant_id, text) of all text columns; ``columns`` names (table, key column, text columns) per source."""
    found = [
        df.select(F.lit(source).alias("source"), F.col(key).alias("restaurant_id"), F.explode(F.array(*names)).alias("text"))
        for source, (df, key, names) in columns.items()
    ]
    return reduce(DataFrame.unionByName, found).filter("text IS NOT NULL")


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after the other, and where each text ends."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends, data = np.cumsum(lengths), b"".join(texts.cast(pa.binary()).to_pylist())
    try:
        whole = data.decode("utf-8")
    except UnicodeDecodeError:  # as Spark shows such texts
        shown = [text.decode("utf-8", "replace") for text in texts.cast(pa.binary()).to_pylist()]
        whole, ends = "".join(shown), np.cumsum([len(text) for text in shown])
    else:
        starts = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        ends = np.where(ends > 0, np.append(starts, 0)[ends - 1], 0)
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), ends


def _pairs(slots: np.ndarray, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of a trigram (21 bits per character) and a slot, piece by piece, sorted inside a piece."""
    points, ends = _code_points(texts)
    rows = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    for low in range(0, max(len(points) - 2, 0), _PIECE):
        here, of = points[low : low + _PIECE + 2], rows[low : low + _PIECE + 2]
        inside = of[2:] == of[:-2]
        present = np.zeros(0x110000, bool)
        present[here] = True
        alphabet = np.flatnonzero(present)
        rank = np.zeros(0x110000, np.int64)
        rank[alphabet] = np.arange(len(alphabet))
        wide, slot = int(len(alphabet)).bit_length(), slots[of[2:][inside]]
        low_bits = int(slot.max(initial=0)).bit_length()
        if 3 * wide + low_bits <= 63:  # nearly always: one sort of one number each
            ranks = rank[here]
            codes = (ranks[:-2] << 2 * wide | ranks[1:-1] << wide | ranks[2:])[inside]
            both = np.sort(codes << low_bits | slot)
            both = both[np.diff(both, prepend=-1) != 0]
            codes, mask = both >> low_bits, (1 << wide) - 1
            spelled = alphabet[codes >> 2 * wide] << 42 | alphabet[codes >> wide & mask] << 21 | alphabet[codes & mask]
            yield spelled, both & ((1 << low_bits) - 1)
        else:
            codes, which = np.unique((here[:-2] << 42 | here[1:-1] << 21 | here[2:])[inside], return_inverse=True)
            both = np.unique(which.astype(np.int64) << 32 | slot)
            yield codes[both >> 32], both & 0xFFFFFFFF


def _block_lists(block: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
    """The posting lists of one block."""
    if not pairs:
        return None
    if len(pairs) == 1:
        listed, slots = pairs[0]
    else:
        codes, which = np.unique(np.concatenate([codes for codes, _ in pairs]), return_inverse=True)
        both = np.unique(which.astype(np.int64) << 32 | np.concatenate([slots for _, slots in pairs]))
        listed, slots = codes[both >> 32], both & 0xFFFFFFFF
    firsts = np.flatnonzero(np.diff(listed, prepend=-1))
    codes, at = listed[firsts], np.append(firsts, len(listed)).astype(np.int32)
    mask = (1 << 21) - 1
    points = np.stack([codes >> 42, codes >> 21 & mask, codes & mask], axis=1).astype("<u4")
    spelled = points.tobytes().decode("utf-32-le", "surrogatepass")
    trigrams = pa.array([spelled[k : k + 3] for k in range(0, len(spelled), 3)], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(at), pa.array(slots.astype(np.int32)))
    return pa.RecordBatch.from_arrays([trigrams, pa.array(np.full(len(codes), block, np.int64)), lists], ["trigram", "block", "slots"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of texts (block, slot, text) that come block by block; a block is held as its distinct pairs."""
    current, pairs = None, []
    for batch in batches:
        blocks = batch["block"].to_numpy(zero_copy_only=False)
        slots = batch["slot"].to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if blocks[low] != current:
                if (lists := _block_lists(current, pairs)) is not None:
                    yield lists
                current, pairs = blocks[low], []
            found = [pair for pair in _pairs(slots[low:high], batch["text"].slice(low, high - low)) if len(pair[0])]
            pairs += found
    if (lists := _block_lists(current, pairs)) is not None:
        yield lists


def build_text_index(texts: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> TextIndex:
    """Write the index of ``texts`` (as ``searchable_texts`` gives them) to a new folder."""
    spark = texts.sparkSession
    placed = numbered(texts, [F.col(name).asc() for name in ("source", "restaurant_id", "text")])
    at = F.col("position") - 1
    block, slot = F.floor(at / block_rows).alias("block"), F.pmod(at, F.lit(block_rows)).cast("int").alias("slot")
    placed.select(block, slot, "restaurant_id", "text").write.parquet(f"{path}/texts")
    written = spark.read.parquet(f"{path}/texts")
    # ranges hold equal numbers of rows, but long texts lie together: blocks are dealt anew, each to one task
    lowered = written.select("block", "slot", F.lower("text").alias("text"))
    postings = lowered.repartition("block").sortWithinPartitions("block").mapInArrow(_postings, _POSTINGS)
    postings.sortWithinPartitions("trigram", "block").write.parquet(f"{path}/postings")
    return open_text_index(spark, path)


def open_text_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/postings"))


def literal_runs(pattern: str) -> list[str]:
    """What a ``like`` pattern demands between its wildcards."""
    runs, at = [""], 0
    while at < len(pattern):
        if pattern[at] == "\\":
            at += 1
            runs[-1] += pattern[at : at + 1]
        elif pattern[at] in "%_":
            runs.append("")
        else:
            runs[-1] += pattern[at]
        at += 1
    return [run for run in runs if run]


def trigrams_of(spark: SparkSession, pattern: str) -> list[str]:
    """The trigrams that every text with the pattern has, in the letter case of the index."""
    lowered = spark.sql("SELECT lower(:pattern)", args={"pattern": pattern}).first()[0]
    return sorted({run[k : k + 3] for run in literal_runs(lowered) for k in range(len(run) - 2)})


def candidates(index: TextIndex, trigrams: list[str]) -> DataFrame:
    """The texts that have all the trigrams."""
    lists = index.postings.filter(F.col("trigram").isin(trigrams)).groupBy("block").agg(F.collect_list("slots").alias("lists"))
    every = F.aggregate("lists", F.get("lists", F.lit(0)), F.array_intersect)
    complete = lists.filter(F.size("lists") == len(trigrams)).select("block", F.explode(every).alias("slot"))
    found = cut_lineage(complete)
    blocks = [row[0] for row in found.select("block").distinct().limit(_NAMED_BLOCKS + 1).collect()]
    texts = index.texts.filter(F.col("block").isin(blocks)) if len(blocks) <= _NAMED_BLOCKS else index.texts
    return texts.join(found, ["block", "slot"], "left_semi")


def places_with_text(index: TextIndex, pattern: str) -> DataFrame | None:
    """(restaurant_id) of the places with a matching text; None where the pattern has no trigrams."""
    trigrams = trigrams_of(index.texts.sparkSession, pattern)
    if not trigrams:
        return None
    return candidates(index, trigrams).filter(F.col("text").ilike(pattern)).select("restaurant_id").distinct()
