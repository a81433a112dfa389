"""Best-fit packing of documents into sequences of a fixed capacity by a linear grouping scheme.

The plan is made from the histogram of piece lengths, which has at most ``capacity`` rows however many documents there are:

1. Large lengths (above a sixth of the capacity) are sorted and cut into groups of equal cardinality; in the plan every length
   of a group counts as the group's largest.
2. For these few sizes the best mix of configurations (multisets of sizes that fit one sequence) is found by column
   generation on the linear program; the multiplicities are rounded down.
3. Real pieces take the places of the rounded ones, which only frees space: each place takes the largest piece left that leaves
   the places after it their groups' sizes. What rounding down left over joins the rest.
4. All other lengths, in descending order, go to the fullest sequence they fit, else to a new one.

Sequences that look alike are handled together, so the plan is a list of runs: so many pieces of one length, from one rank
on, take the same offset in as many successive sequences. Tasks look their pieces up in the plan by length and rank; the rank of a piece
among those of its length comes from counts per bucket. No task and no driver sees all pieces.

Defined results: a null or empty text is the end id alone; a longer document is cut into pieces of the capacity and a last,
shorter one; rows that share an id are packed each by itself; null ids stay null; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from larder.llm.encoding import encoder
from larder.session import batches_of
from larder.staging import stage

_TEXTS = 128
#: Words that a worker remembers, and the text that Spark hands it at once. An executor may keep several idle workers, each with its own.
_REMEMBERED = 500_000
_BATCH_BYTES = "4m"
#: Pieces of one length are ranked in buckets of the whole table's pieces of about this size, 16 at least.
_BUCKET_ROWS = 100_000
#: Configurations that column generation tries; the mix it has by then is a valid one, if not yet the best.
_COLUMNS_TRIED = 1_000


@dataclass
class Plan:
    """Runs of placed pieces, and how many sequences they fill."""

    capacity: int
    sequences: int = 0
    #: (length, first rank, first sequence, offset, number of pieces)
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    _ranks: dict[int, int] = field(default_factory=dict)

    def open(self, n: int) -> int:
        first = self.sequences
        self.sequences += n
        return first

    def place(self, length: int, sequence: int, offset: int, n: int) -> None:
        """The next ``n`` pieces of ``length`` go to as many sequences from ``sequence`` on."""
        rank = self._ranks.get(length, 0)
        self._ranks[length] = rank + n
        self.runs.append((length, rank, sequence, offset, n))


def equal_groups(histogram: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Lengths in descending order, cut into groups of equal cardinality: lists of [length, count]."""
    total, found, taken = sum(histogram.values()), [], 0
    bounds = [total * (k + 1) // groups for k in range(groups)]
    group: list[list[int]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while bounds[len(found)] == taken:  # more groups than pieces
                found.append(group)
                group = []
            n = min(left, bounds[len(found)] - taken)
            group.append([length, n])
            taken, left = taken + n, left - n
    found.append(group)
    return [group for group in found if group]


def best_configurations(sizes: list[int], demands: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(pieces of each size, number of sequences), rounded down, of the linear program's best mix."""
    k = len(sizes)
    if not k:
        return []
    basis = np.diag([float(capacity // size) for size in sizes])
    amounts = np.array([n / (capacity // size) for size, n in zip(sizes, demands)])
    depth = capacity // min(sizes)
    for _ in range(_COLUMNS_TRIED):
        prices = np.linalg.solve(basis.T, np.ones(k))
        column = _most_valuable(sizes, prices, capacity, depth)
        if prices @ column <= 1 + 1e-4:
            break
        change = np.linalg.solve(basis, column)
        usable = change > 1e-12
        ratios = np.where(usable, amounts / np.where(usable, change, 1), np.inf)
        out = int(np.argmin(ratios))
        step = ratios[out]
        amounts = np.maximum(amounts - step * change, 0)
        basis[:, out], amounts[out] = column, step
    return [
        ([int(n) for n in basis[:, c]], int(amounts[c] + 1e-9)) for c in range(k) if int(amounts[c] + 1e-9) > 0
    ]


def _most_valuable(sizes: list[int], prices: np.ndarray, capacity: int, depth: int) -> np.ndarray:
    """Pieces of each size that fit one sequence at the highest total price; ``depth`` bounds their number."""
    value, chosen = np.zeros(capacity + 1), []
    for _ in range(depth):
        better, pick = value.copy(), np.full(capacity + 1, -1)
        for i, size in enumerate(sizes):
            candidate = value[: capacity + 1 - size] + prices[i]
            wins = candidate > better[size:] + 1e-12
            better[size:][wins] = candidate[wins]
            pick[size:][wins] = i
        chosen.append(pick)
        value = better
    column, room = np.zeros(len(sizes)), capacity
    for pick in reversed(chosen):
        if pick[room] >= 0:
            column[pick[room]] += 1
            room -= sizes[pick[room]]
    return column


class _Free:
    """Sequences by free space: runs of alike ones."""

    def __init__(self) -> None:
        self._spaces: list[int] = []
        self._runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, space: int, first: int, n: int) -> None:
        if n and space:
            if space not in self._runs:
                insort(self._spaces, space)
                self._runs[space] = []
            self._runs[space].append((first, n))

    def fullest(self, length: int) -> tuple[int, int, int] | None:
        """Takes out the run with the least space that fits: (space, first sequence, number)."""
        at = bisect_left(self._spaces, length)
        if at == len(self._spaces):
            return None
        space = self._spaces[at]
        first, n = self._runs[space].pop()
        if not self._runs[space]:
            del self._runs[space]
            self._spaces.pop(at)
        return space, first, n


def make_plan(histogram: dict[int, int], capacity: int, groups: tuple[int, ...] = (32, 96), large: float = 1 / 6) -> Plan:
    """The runs for so many pieces of each length: the plan with the fewest sequences over several numbers of groups."""
    plans = [_grouped_plan(histogram, capacity, n, large) for n in groups]
    return min(plans, key=lambda plan: plan.sequences)


def _grouped_plan(histogram: dict[int, int], capacity: int, groups: int, large: float) -> Plan:
    plan, free = Plan(capacity), _Free()
    big = {length: n for length, n in histogram.items() if capacity * large < length < capacity}
    rest = {length: n for length, n in histogram.items() if length not in big}
    demands: dict[int, int] = {}
    for group in equal_groups(big, groups) if big else []:  # groups that begin with one length are of one size
        demands[group[0][0]] = demands.get(group[0][0], 0) + sum(n for _, n in group)
    sizes, left = list(demands), _Left(big)
    found = [
        ([size for size, times in zip(sizes, column) for _ in range(times)], n)
        for column, n in best_configurations(sizes, list(demands.values()), capacity)
    ]
    for slots, n in sorted(found, reverse=True):  # the largest pieces first, as best fit has them
        _fill(plan, free, slots, n, left)
    rest |= left.counts
    for length in sorted(rest, reverse=True):
        _best_fit(plan, free, length, rest[length])
    return plan


class _Left:
    """Lengths of pieces that have no place yet, and their counts."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = dict(counts)
        self._lengths = sorted(counts)

    def largest(self, room: int, used: Counter) -> int | None:
        """The largest length up to ``room``, without the ``used`` pieces."""
        at = bisect_right(self._lengths, room)
        while at and used[self._lengths[at - 1]] == self.counts[self._lengths[at - 1]]:
            at -= 1
        return self._lengths[at - 1] if at else None

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self._lengths.remove(length)


def _fill(plan: Plan, free: _Free, slots: list[int], n: int, left: _Left) -> None:
    """``n`` sequences of one configuration with places of these sizes, in descending order, as long as there is a piece for each.

    A gap behind the last place takes the largest pieces that fit, so that fewer sequences are needed than the rounded sizes ask for.
    """
    while n:
        chosen, room, later, used = [], plan.capacity, sum(slots), Counter()
        for size in slots:
            later -= size
            length = left.largest(room - later, used)
            if length is None:
                return
            chosen.append(length)
            room -= length
            used[length] += 1
        while (length := left.largest(room, used)) is not None:
            chosen.append(length)
            room -= length
            used[length] += 1
        alike = min(n, *(left.counts[length] // times for length, times in used.items()))
        first, offset = plan.open(alike), 0
        for length in chosen:
            left.take(length, alike)
            plan.place(length, first, offset, alike)
            offset += length
        free.add(room, first, alike)
        n -= alike


def _best_fit(plan: Plan, free: _Free, length: int, n: int) -> None:
    """``n`` pieces of one length, each into the fullest sequence it fits."""
    while n:
        found = free.fullest(length)
        if found:
            space, first, available = found
        else:
            space, available = plan.capacity, -(-n // (plan.capacity // length))
            first = plan.open(available)
        each = min(space // length, n)
        used = min(available, n // each)
        for k in range(each):
            plan.place(length, first, plan.capacity - space + k * length, used)
        free.add(space - each * length, first, used)
        if available > used:
            free.add(space, first + used, available - used)
        n -= each * used


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all pieces; one pass, nothing shuffled."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for low in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(low, _TEXTS)
                rows = [
                    (document, at // step, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step]))
                    for document, ids in zip(
                        part.column(0).to_pylist(),
                        (ids + end for ids in encoder(tokenizer, _REMEMBERED).encode(part.column(1).to_pylist())),
                    )
                    for at in range(0, len(ids), step)
                ]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _ranked(pieces: DataFrame, n: int) -> DataFrame:
    """Add ``rank``, from 0, among the pieces of the same length. A length that many share is ranked bucket by bucket."""
    buckets = max(16, n // _BUCKET_ROWS)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    placed = dealt.withColumn("_within", F.row_number().over(within) - 1).join(before, ["length", "_bucket"])
    return placed.withColumn("rank", (F.col("_before") + F.col("_within")).cast("long")).drop("_bucket", "_before", "_within")


def _located(ranked: DataFrame, plan: Plan) -> DataFrame:
    """Add ``sequence_id`` and ``offset``. The plan's size depends on the capacity, not on the number of documents."""
    runs = np.array(sorted(plan.runs) or np.empty((0, 5)), np.int64).reshape(-1, 5)
    shared = ranked.sparkSession.sparkContext.broadcast(runs)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        # length and rank in one number that keeps their order; no rank reaches 2**48
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            run = runs[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            columns = {name: batch.column(name) for name in batch.schema.names if name != "rank"}
            columns |= {"sequence_id": pa.array(run[:, 2] + rank - run[:, 1]), "offset": pa.array(run[:, 3].copy())}
            yield pa.RecordBatch.from_pydict(columns)

    return ranked.mapInArrow(
        locate,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 1,
    groups: tuple[int, ...] = (32, 96),
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with batches_of(docs.sparkSession, _BATCH_BYTES):
        pieces = stage(_pieces(named, tokenizer, end_id, capacity))
    histogram = {row.length: row.n for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(histogram, capacity, groups)
    ranked = _ranked(pieces, sum(histogram.values()))
    order = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return _located(ranked.select(*order), plan).withColumnRenamed("doc_id", id_column)
