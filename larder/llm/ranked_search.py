"""Ranked lexical search with the best position algorithm (BPA) over impact lists.

The documents are split as the scan deals them, so no list of a frequent term ever meets in one task: each task makes the impact lists of
its own documents, finds its best documents for every item, and the few of all tasks are merged. Two passes:

1. Every whole text is split into terms once. A row keeps its number of terms and, for the terms that items ask for, their occurrences.
   Document frequencies, the number of documents and of terms are counted over all documents from that.
2. Blocks of about ``BLOCK`` postings are read. A list holds a term's documents by falling impact, and every posting knows its position there. For each
   item, sorted access takes the next positions of all its lists; a document seen for the first time is completed by direct access to its
   other postings, which marks their positions as seen, too. The best position of a list is the end of its run of seen positions
   from the top; a document that was not seen anywhere stands below it, so the impacts at the best positions add up to a bound on its score. An item is
   finished in the block when the bound is strictly below the score of its kth document (documents with an equal score and a smaller id are still found),
   or its lists are used up. The kth document of earlier blocks counts from the start.

Scores are 64-bit integers: a term with weight ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))`` and ``tf`` occurrences adds
``w * ((10**9 tf) div (1000 tf + 8 m))``, with ``m = 25 + (75 n N) div L`` for a document of ``n`` of all ``L`` terms of ``N`` documents.

Items are read in blocks of bounded size, each a search of its own over all documents; the terms and lists of one block are what a task holds.

Defined results: terms are the runs of letters, digits and characters beyond ASCII, A-Z in lower case; a null or empty text has none, is found by nothing and, as an item,
finds nothing; texts of any length are read whole; equal scores rank by ascending id, a null id last; rows that share an id are documents,
or items, of their own; only scores above 0 are returned; an empty table of documents or items gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from larder.staging import stage

#: Postings whose impact lists are made together.
BLOCK = 1_000_000
#: Items searched in one pass over the documents, and terms they may have together.
ITEMS, TERMS = 4096, 200_000
#: Positions that the first step reads of each list; every step reads twice as many as the one before.
_DEPTH = 8
#: Texts that are split together.
_TEXTS = 256
#: Tasks' results of one item are merged in so many groups first.
_GROUPS = 32

_SPLIT = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a text in order."""
    return text.translate(_SPLIT).split()


@dataclass
class Items:
    """One block of items: their ids and, per item, the numbers of its distinct terms and how often each occurs."""

    ids: list[int | None] = field(default_factory=list)
    terms: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def add(self, item_id: int | None, text: str | None) -> None:
        found = [self.vocabulary.setdefault(term, len(self.vocabulary)) for term in terms_of((text or "").encode())]
        terms, times = np.unique(np.array(found, np.int64), return_counts=True)
        self.ids.append(item_id)
        self.terms.append(terms)
        self.times.append(times.astype(np.int64))


def item_blocks(items: DataFrame, id_column: str, text: str) -> Iterator[Items]:
    """The items in blocks of bounded size; the driver holds one at a time."""
    block = Items()
    for row in items.select(items[id_column].cast("long"), items[text].cast("string")).toLocalIterator():
        block.add(*row)
        if len(block.ids) >= ITEMS or len(block.vocabulary) >= TERMS:
            yield block
            block = Items()
    if block.ids:
        yield block


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term; ``terms`` are those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        width = max(1, len(shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(start, _TEXTS)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                sizes, keys = [], []
                for k, text in enumerate(texts):
                    found = terms_of(text) if text else []
                    sizes.append(len(found))
                    numbers = np.fromiter(map(known, found, repeat(-1)), np.int64, len(found))
                    keys.append(numbers[numbers >= 0] + k * width)
                cells, tfs = np.unique(np.concatenate(keys), return_counts=True)
                ends = np.searchsorted(cells, np.arange(len(texts) + 1) * width).astype(np.int32)
                rows = pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array((cells % width).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(tfs.astype(np.int64))),
                    ],
                    names=["id", "n", "terms", "tfs"],
                )
                yield rows.filter(pa.array([n > 0 for n in sizes], pa.bool_()))

    return docs.mapInArrow(count, "id long, n long, terms array<int>, tfs array<long>")


class Best:
    """The best documents of one item so far."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores, self.ids, self.missing = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        if len(self.scores) == self.k:
            good = scores >= self.scores[-1]
            scores, ids, missing = scores[good], ids[good], missing[good]
        if not len(scores):
            return
        scores, ids, missing = (
            np.concatenate(pair) for pair in ((self.scores, scores), (self.ids, ids), (self.missing, missing))
        )
        first = np.lexsort((ids, missing, -scores))[: self.k]
        self.scores, self.ids, self.missing = scores[first], ids[first], missing[first]

    def above(self, bound: int) -> bool:
        """Whether nothing that scores up to ``bound`` can be among the best any more."""
        return len(self.scores) == self.k and bool(self.scores[-1] > bound)


class ImpactLists:
    """The postings of one block of documents, by document and, for every term, by falling impact."""

    def __init__(self, ids: pa.Array, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, width: int, totals: tuple[int, int]) -> None:
        documents, words = totals
        self.missing = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.terms = terms
        m = 25 + (75 * n * documents) // words
        owner = np.repeat(np.arange(len(n)), counts)
        self.part = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[owner])
        order = np.lexsort((-self.part, terms))
        #: Where the list of a term begins, what it holds, and at which of its positions a posting stands.
        self.start = np.searchsorted(terms[order], np.arange(width + 1))
        self.listed, self.impact = owner[order], self.part[order]
        self.position = np.empty(len(order), np.int64)
        self.position[order] = np.arange(len(order)) - self.start[terms[order]]
        self._slot = np.full(width, -1, np.int64)

    def search(self, terms: np.ndarray, factors: np.ndarray, best: Best) -> int:
        """Add what this block has for one item to ``best``; the number of documents that were completed."""
        used = (factors > 0) & (self.start[terms + 1] > self.start[terms])
        terms, factors = terms[used], factors[used]
        if not len(terms):
            return 0
        start, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        offset = np.cumsum(size) - size
        seen, completed = np.zeros(int(size.sum()), bool), np.zeros(len(self.ids), bool)
        at = np.zeros(len(terms), np.int64)  # the best positions: so many from the top are seen
        self._slot[terms] = np.arange(len(terms))
        weight = np.concatenate((factors, [0]))  # the last one for terms that the item does not have
        bound, depth, read = int((factors * self.impact[start]).sum()), _DEPTH, 0
        while not best.above(bound):
            reach = np.minimum(at + depth, size)
            documents = self.listed[_ranges(start + at, reach - at)]
            documents = np.unique(documents[~completed[documents]])
            completed[documents] = True
            read += len(documents)
            counts = self.first[documents + 1] - self.first[documents]
            direct = _ranges(self.first[documents], counts)
            slot = self._slot[self.terms[direct]]
            sums = np.concatenate(([0], np.cumsum(weight[slot] * self.part[direct])))
            ends = np.cumsum(counts)
            best.add(sums[ends] - sums[ends - counts], self.ids[documents], self.missing[documents])
            direct, slot = direct[slot >= 0], slot[slot >= 0]
            seen[offset[slot] + self.position[direct]] = True
            for k in np.flatnonzero(at < size).tolist():
                rest = seen[offset[k] + at[k] : offset[k] + size[k]]
                unseen = int(rest.argmin())
                at[k] += len(rest) if rest[unseen] else unseen
            open_lists = at < size
            if not open_lists.any():
                break
            bound = int((factors * self.impact[start + at - 1])[open_lists].sum())
            depth *= 2
        self._slot[terms] = -1
        return read


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _searched(postings: DataFrame, block: Items, weights: np.ndarray, totals: tuple[int, int], k: int) -> DataFrame:
    """Per task and item the best ``k`` documents: (item, id, score)."""
    wanted = [(terms, times * weights[terms]) for terms, times in zip(block.terms, block.times)]
    shared = postings.sparkSession.sparkContext.broadcast((wanted, len(weights)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, width = shared.value
        best = [Best(k) for _ in wanted]

        def finish(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            columns = [rows.column(name).combine_chunks() for name in ("id", "n", "terms", "tfs")]
            counts = columns[2].value_lengths().to_numpy()
            lists = ImpactLists(
                columns[0], columns[1].to_numpy(), counts.astype(np.int64), columns[2].flatten().to_numpy(),
                columns[3].flatten().to_numpy(), width, totals,
            )
            for (terms, factors), found in zip(wanted, best):
                lists.search(terms, factors, found)

        held, size = [], 0
        for batch in batches:
            step = max(1, min(batch.num_rows, 1024))
            for start in range(0, batch.num_rows, step):
                held.append(batch.slice(start, step))
                size += len(held[-1].column(2).flatten())
                if size >= BLOCK:
                    finish(held)
                    held, size = [], 0
        if held:
            finish(held)
        sizes = [len(found.scores) for found in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(best), dtype=np.int32), sizes)),
                    pa.array(np.concatenate([found.ids for found in best]), mask=np.concatenate([found.missing for found in best])),
                    pa.array(np.concatenate([found.scores for found in best])),
                ],
                names=["item", "id", "score"],
            )

    return postings.mapInArrow(search, "item int, id long, score long")


def _ranked(found: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy("item", *group).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, block: Items, k: int) -> DataFrame:
    """(item_id, rank, id, score) of one block of items against all documents (id, text)."""
    spark = docs.sparkSession
    postings = stage(_postings(docs, block.vocabulary))
    documents, words = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = np.zeros(len(block.vocabulary), np.int64)
    for term, df in held.collect():  # as many rows as the block has terms
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    found = _searched(postings, block, weights, (documents, words), k).filter("score > 0")
    found = found.withColumn("group", F.pmod(F.xxhash64("id", "score"), F.lit(_GROUPS)))
    ranked = _ranked(_ranked(found, k, "group").drop("rank"), k)
    names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", item_column: str = "item_id", text: str = "text"
) -> DataFrame:
    """The ``k`` highest-scoring documents of every item: (item_column, rank, id_column, score)."""
    named = docs.select(docs[id_column].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    found = [stage(search_block(named, block, k)) for block in item_blocks(items, item_column, text)]
    empty = docs.sparkSession.createDataFrame([], "item_id long, rank int, id long, score long")
    result = reduce(DataFrame.union, found, empty)
    return result.select(F.col("item_id").alias(item_column), "rank", F.col("id").alias(id_column), "score")
