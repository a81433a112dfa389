"""Near duplicates by circulant MinHash.

A document is the set of its distinct five-word shingles. Two permutations give all coordinates of its signature: the first
deals the shingles to places on a ring, the second is stored once and read at every place from successive shifts, so that
coordinate k is the least value of the second permutation, shifted by k, over the places taken. Bands of coordinates are bucket
keys; documents that share a bucket are candidates, and candidates count as linked only after the exact Jaccard similarity of
their full shingle sets. With 60 bands of 10 coordinates a pair at the default limit of 0.85 misses all buckets with a
probability of 2e-6, one at 0.9 with 1e-11.

Shingles are compared by 64-bit hashes.

Equal sets are one class before anything else, found by an aggregate; only the class with its least id goes on. In a bucket
nobody is compared with everybody. Each bucket first hangs its classes under its least one; verified links are merged to
components, and a bucket whose classes are one component is done, as further links would change nothing. In the buckets still
open, a class can only have a link to another component if enough of its shingles occur in another component: with s shared
shingles, sizes n and m and the limit t, similarity t needs s >= t * n and s >= t / (1 + t) * (n + m). That is exact and comes from
aggregates. What remains is tried against the class that shares most. What is open even then is compared block by block inside the tasks, so that no
link is lost.

Defined results: a null or empty text has no shingles and no links; rows that share an id count as one document, whatever
their texts; a row with a null id is linked with nothing and stays, with a null component; every input row gives one output
row; a text of any length is one set, read in blocks; of equal similarities none is preferred, as all links count; an empty table gives an
empty result; other columns are not read, and ``keep_one`` returns them as they were whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from larder.llm.names import free_names
from larder.llm.shingles import mixed, shingle_set
from larder.operators.components import components
from larder.staging import stage

#: Places on the ring of the second permutation.
_RING_BITS = 20
#: Places are read in blocks of so many, which bounds the memory for a long text.
_BLOCK = 256
#: Documents in a block of the last comparison, and columns of an incidence matrix that are in memory together.
_BLOCK_DOCUMENTS = 256
_COLUMNS = 4_096


@dataclass(frozen=True)
class Banding:
    """Parameters: ``percent`` is the limit of the similarity in hundredths."""

    percent: int = 85
    width: int = 5
    bands: int = 60
    rows: int = 10
    seed: int = 20_250


class Circulant:
    """The two permutations and the signature they give."""

    def __init__(self, banding: Banding) -> None:
        rng = np.random.default_rng(banding.seed)
        size = banding.bands * banding.rows
        ring = rng.permutation(1 << _RING_BITS).astype(np.uint32)
        self._first = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
        self._shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate((ring, ring[:size])), size)
        self._shape = (banding.bands, banding.rows)
        self._powers = mixed(np.arange(1, banding.rows + 1, dtype=np.uint64)) | np.uint64(1)
        self._names = mixed(np.arange(banding.bands, dtype=np.uint64) + np.uint64(1 << 40))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = (mixed(shingles * self._first) >> np.uint64(64 - _RING_BITS)).astype(np.int64)
        least = self._shifted[places[:_BLOCK]].min(axis=0)
        for start in range(_BLOCK, len(places), _BLOCK):
            np.minimum(least, self._shifted[places[start : start + _BLOCK]].min(axis=0), out=least)
        return least

    def buckets(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key per band."""
        coordinates = self.signature(shingles).reshape(self._shape).astype(np.uint64)
        return mixed((coordinates * self._powers).sum(axis=1, dtype=np.uint64) ^ self._names).view(np.int64)


def _sketches(docs: DataFrame, banding: Banding) -> DataFrame:
    """Id, set size, two halves of the set's digest and bucket keys of every document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(banding)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), banding.width)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                keys.append(circulant.buckets(found) if len(found) else np.empty(0, np.int64))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(halves[:, 0].copy()),
                    pa.array(halves[:, 1].copy()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["id", "n", "one", "two", "keys"],
            )

    return docs.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(
        sketch, "id long, n long, one long, two long, keys array<long>"
    )


def _sets(docs: DataFrame, banding: Banding) -> DataFrame:
    """Id and full shingle set."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text.as_py(), banding.width).view(np.int64) for text in batch.column(1)]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "shingles"]
            )

    return docs.mapInArrow(full, "id long, shingles array<long>")


def _of_fitting_sizes(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` whose set sizes allow the similarity: the smaller set holds all that is shared."""
    one, other = (sizes.select(F.col("id").alias(name), F.col("n").alias(f"_n_{name}")) for name in ("one", "other"))
    fit = F.least("_n_one", "_n_other") * 100 >= percent * F.greatest("_n_one", "_n_other")
    return pairs.join(one, "one").join(other, "other").filter(fit).select("one", "other")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` (one, other) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("one"), F.col("shingles").alias("_left"))
    right = sets.select(F.col("id").alias("other"), F.col("shingles").alias("_right"))
    both = pairs.join(right, "other").join(left, "one")
    common = both.select(
        "one",
        "other",
        F.size(F.array_intersect("_left", "_right")).cast("long").alias("_common"),
        (F.size("_left") + F.size("_right")).cast("long").alias("_sizes"),
    )
    return common.filter(F.col("_common") * 100 >= percent * (F.col("_sizes") - F.col("_common"))).select("one", "other")


def _open(members: DataFrame) -> DataFrame:
    """The rows of the buckets that still hold several components."""
    mixed_buckets = members.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    return members.join(mixed_buckets.filter("_lo <> _hi").select("key"), "key")


def _with_bound(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of open buckets that may have a link to another component, with ``shared``, the size of what is shared at all."""
    rows = stage(_open(members))
    owners = rows.select("id", "component").distinct()
    spread = owners.join(sets, "id").select("id", "component", F.explode("shingles").alias("shingle"))
    across = (
        spread.groupBy("shingle")
        .agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
        .filter("_lo <> _hi")
        .select("shingle")
    )
    shared = stage(spread.join(across, "shingle").groupBy("id").agg(F.count(F.lit(1)).alias("shared")))
    # a link shares at least so much of either set
    enough = (rows["id"] == shared["id"]) & (shared["shared"] * 100 >= percent * rows["n"])
    return stage(_open(rows.join(shared, enough).select(*[rows[name] for name in rows.columns], "shared")))


def _links_of_blocks(rows: pa.Table, percent: int) -> pa.Table:
    """Similar pairs of different components in one or between two blocks, by products of their incidence matrices."""
    ids, components_of, sizes = (rows.column(name).to_numpy() for name in ("id", "component", "n"))
    sets = rows.column("shingles").combine_chunks()
    owner = np.repeat(np.arange(len(ids)), np.diff(sets.offsets.to_numpy()))
    values, inverse, times = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    twice = np.cumsum(times > 1) - 1
    here = times[inverse] > 1
    owner, column = owner[here], twice[inverse[here]]
    common = np.zeros((len(ids), len(ids)), np.float32)
    order = np.argsort(column, kind="stable")
    bounds = np.searchsorted(column[order], np.arange(0, int(column.max(initial=-1)) + 1 + _COLUMNS, _COLUMNS))
    for k, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        part = np.zeros((len(ids), _COLUMNS), np.float32)
        part[owner[order[low:high]], column[order[low:high]] - k * _COLUMNS] = 1
        common += part @ part.T
    found = common.astype(np.int64)
    linked = found * 100 >= percent * (sizes[:, None] + sizes[None, :] - found)
    linked &= (ids[:, None] < ids[None, :]) & (components_of[:, None] != components_of[None, :])
    one, other = np.nonzero(linked)
    return pa.table({"one": pa.array(ids[one], pa.int64()), "other": pa.array(ids[other], pa.int64())})


def _within_groups(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between different components in the groups that open buckets hold together.

    A group is cut into blocks, and each task compares two blocks; only links leave it. Which pair of blocks a task has takes up
    a row per document and block, not one per pair of documents.
    """

    def links(key: tuple, rows: pa.Table) -> pa.Table:
        return _links_of_blocks(rows, percent)

    pivots = rest.groupBy("key").agg(F.min("id").alias("pivot"))
    groups = components(rest.join(pivots, "key").select("pivot", "id").distinct(), "pivot", "id")
    groups = stage(groups.select(F.col("node").alias("id"), F.col("component").alias("group")))
    known = rest.select("id", "component", "n", "shared").distinct().join(groups, "id")
    least = known.groupBy("group").agg(F.min("n").alias("_least"))
    enough = F.col("shared") * (100 + percent) >= percent * (F.col("n") + F.col("_least"))
    fitting = stage(known.join(least, "group").filter(enough).drop("_least", "shared"))
    numbers = fitting.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / _BLOCK_DOCUMENTS).alias("blocks"))
    placed = fitting.join(numbers, "group")
    mine = placed.withColumn("_block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    spread = mine.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = spread.select(
        "group", F.least("_block", "_other").alias("low"), F.greatest("_block", "_other").alias("high"), "id", "component", "n"
    )
    return (
        keyed.join(sets, "id")
        .groupBy("group", "low", "high")
        .applyInArrow(links, "one long, other long")
    )


def _links(classes: DataFrame, docs: DataFrame, banding: Banding) -> DataFrame:
    """Components of the classes that have links: ``node`` and ``component``."""
    rows = classes.select(F.explode("keys").alias("key"), "id", "n")
    buckets = rows.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("_last"))
    shared = stage(rows.join(buckets.filter("pivot < _last").drop("_last"), "key"))
    candidates = shared.select("id").distinct()
    sets = stage(_sets(docs.join(candidates, "id", "left_semi").select("id", "text"), banding))

    def verified(pairs: DataFrame) -> DataFrame:
        return stage(_verified(_of_fitting_sizes(pairs.distinct(), classes, banding.percent), sets, banding.percent))

    def labelled(found: DataFrame) -> DataFrame:
        known = found.select(F.col("node").alias("id"), "component")
        return shared.select("key", "id", "n").join(known, "id", "left").withColumn(
            "component", F.coalesce("component", "id")
        )

    edges = verified(shared.filter("id <> pivot").select(F.col("pivot").alias("one"), F.col("id").alias("other")))
    found = stage(components(edges, "one", "other"))

    rest = _with_bound(labelled(found), sets, banding.percent)
    if rest.isEmpty():
        return found
    most = rest.groupBy("key").agg(F.max_by("id", "shared").alias("one"), F.max_by("component", "shared").alias("_its"))
    near = rest.join(most, "key").filter("component <> _its").select("one", F.col("id").alias("other"))
    edges = edges.union(verified(near))
    found = stage(components(edges, "one", "other"))

    rest = _with_bound(labelled(found), sets, banding.percent)
    if rest.isEmpty():
        return found
    edges = edges.union(stage(_within_groups(rest, sets, banding.percent)))
    return stage(components(edges, "one", "other"))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", banding: Banding = Banding()
) -> DataFrame:
    """``id_column``, ``n_shingles``, ``component_id`` (least id that links lead to) and ``kept`` of every row."""
    named = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sketches = stage(_sketches(named, banding))
    full = sketches.filter("n > 0 AND id IS NOT NULL")
    least = stage(full.groupBy("one", "two").agg(F.min("id").alias("id")))
    classes = full.join(least, ["one", "two", "id"]).select("id", "n", "keys")
    links = _links(classes, named, banding)

    # an id whose rows have different texts joins their classes
    classes_of = full.select("id", "one", "two").join(least.withColumnRenamed("id", "class"), ["one", "two"])
    repeated = (
        classes_of.groupBy("id")
        .agg(F.min("class").alias("one"), F.max("class").alias("_last"))
        .filter("one <> _last")
        .select("id", "one")
    )
    if not repeated.isEmpty():
        joined = classes_of.select("id", F.col("class").alias("other")).join(repeated, "id").select("one", "other")
        links = components(links.select(F.col("node").alias("one"), F.col("component").alias("other")).union(joined), "one", "other")

    known = links.select(F.col("node").alias("id"), "component")
    final = least.join(known, "id", "left").select("one", "two", F.coalesce("component", "id").alias("component"))
    rows = full.select("id", "n", "one", "two").join(final, ["one", "two"]).select("id", "n", "component")
    alone = sketches.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    return rows.union(alone).select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == F.col("component"))).alias("kept"),
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", banding: Banding = Banding()) -> DataFrame:
    """One document of each component, the one with the least id, all columns as they were.

    Of rows that share that id one stays, the one whose text and then whose other columns hash least.
    """
    verdicts = stage(near_duplicates(docs, id_column, text, banding))
    gone_id, many_id, hashes = free_names(docs, "gone", "many", "hashes")
    gone = verdicts.filter("NOT kept").select(F.col(id_column).alias(gone_id)).distinct()
    left = docs.join(gone, F.col(id_column) == F.col(gone_id), "left_anti")
    ids = verdicts.filter(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.count(F.lit(1)).alias(many_id))
    many = ids.filter(F.col(many_id) > 1).select(F.col(id_column).alias(many_id))
    if many.isEmpty():
        return left
    own = F.struct(F.xxhash64(id_column, text), F.xxhash64(*[F.col(f"`{name}`") for name in docs.columns]))
    repeated = left.join(many, F.col(id_column) == F.col(many_id), "left_semi").withColumn(hashes, own)
    least = repeated.groupBy(id_column).agg(F.min(hashes).alias(hashes))
    once = repeated.join(least, [id_column, hashes], "left_semi").dropDuplicates([id_column])
    once = once.select(*[F.col(f"`{name}`") for name in docs.columns])
    return left.join(many, F.col(id_column) == F.col(many_id), "left_anti").union(once)
