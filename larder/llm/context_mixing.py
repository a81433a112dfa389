"""Language-model scores by context mixing over bits.

Tokens are coded as symbols: the most frequent words of the training documents are one symbol each, other words are spelled in
bytes and closed by a blank, and a symbol ends each document. A Huffman code makes bits of symbols. Several predictors each guess
the next bit from counts of zeros and ones under a hashed context: the bits of the current symbol so far, alone or together with
the one or three symbols before it or with all letters of the word so far. A gate, made of the kind of the symbol before, the depth in the code and the longest context that has been
seen, picks one set of weights; the predictors' log odds are added under these weights to the log odds of the mix, and the weights are
learned online, block of bits after block, by logistic regression; the counts stay as they are while a text is scored. While a document is scored, its own correction of the weights follows the
errors made so far, block after block, so that every bit is predicted from what comes before it alone.

The counts are gathered from all training documents. Each task adds up its own dense tables, equal symbols under equal contexts at once; tables are merged in rounds of a
bounded number of pieces, until one is left; its size is a parameter and does not depend on the corpus. Pieces whose sums pass 32
bits are kept in 64. The weights start from a fit on all training documents,
each of which is taken out of the counts while it is predicted.

The base score is a word model with add-one smoothing. Frequent words are looked up where the text is; the counts of all others come by
a join on the word, with nothing cut off.

Defined results: a null or empty text is its end token alone; a row with a null id belongs to the training documents; rows that
share an id are scored each by itself; without training documents all words are unknown and all bits even; an empty table
gives an empty result; a text of any length is scored whole, in blocks that grow with the place in it; words of equal frequency become symbols in
their own order; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from larder.staging import stage

#: Symbols 0 to 255 are bytes; the blank closes a spelled word.
_BLANK, _END, _FIRST_WORD = 32, 256, 257
_ORDERS = (1, 3)
#: Predictors: the symbol alone, the orders, the letters of the word so far.
_PREDICTORS = 2 + len(_ORDERS)
_DEPTHS, _KINDS = 6, 2
_GATES = _KINDS * _DEPTHS * _PREDICTORS
_PIECE_BITS = 16
_MERGED = 32
#: Texts whose bits are handled together.
_TEXTS = 64
#: They have so many characters together at most, unless one text alone has more; this bounds a task's memory.
_CHARACTERS = 150_000
#: Characters of texts that are cut into words together.
_CUT = 1 << 21
#: Symbols that are counted together, and those of them whose cells are worked out together.
_COUNTED, _SPREAD = 1 << 20, 1 << 12
#: Bits that a task counts before it gives its tables away and starts new ones: no cell of 32 bits can pass this.
_FULL = (1 << 31) - 1
_WIDE = b"L"
_LIMIT = 11.0
#: Log odds are kept in steps of this size, beside a bit that says whether the cell has more than one count.
_STEP = 1 / 32


@dataclass(frozen=True)
class Mixing:
    """Parameters: words that are symbols and how often they occur at least, cells per table, documents that the starting weights
    are fitted on (None: all training documents), bits per block, rates of learning."""

    words: int = 65_536
    least: int = 2
    table_bits: int = 21
    sample: int | None = None
    block: int = 192
    fit_rate: float = 0.02
    own_rate: float = 0.02


def held_out(id_column: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 7 == 2, F.lit(False))


@dataclass(frozen=True)
class Words:
    """Lower-case words of texts, one after another, and how many each text has."""

    flat: pa.BinaryArray
    sizes: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Words:
        """Words lie between ASCII white space."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        flat = lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
        offsets = lists.offsets.to_numpy()
        return Words(flat.filter(full).cast(pa.binary()), np.diff(before[offsets - offsets[0]]))

    @staticmethod
    def listed(documents: list[list[bytes]]) -> Words:
        flat = pa.array([word for words in documents for word in words], pa.binary())
        return Words(flat, np.fromiter(map(len, documents), np.int64, len(documents)))


def _portions(batch: pa.RecordBatch, column: int, code: Code) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    """Rows that are handled together, the words of their texts and the words' symbols."""
    texts = batch.column(column)
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    bounds, held = [0], 0
    for row, length in enumerate(lengths):
        held += length
        if row > bounds[-1] and (row == bounds[-1] + _TEXTS or held > _CHARACTERS):
            bounds.append(row)
            held = length
    bounds.append(batch.num_rows)
    first = 0
    while first < len(bounds) - 1 and batch.num_rows:
        last, held = first + 1, sum(lengths[bounds[first] : bounds[first + 1]])
        while last < len(bounds) - 1 and held < _CUT:
            held += sum(lengths[bounds[last] : bounds[last + 1]])
            last += 1
        low = bounds[first]
        words = Words.of(texts.slice(low, bounds[last] - low))
        known = code.look_up(words.flat)
        at = np.concatenate(([0], np.cumsum(words.sizes)))
        for k in range(first, last):
            begin, end = bounds[k] - low, bounds[k + 1] - low
            mine = slice(at[begin], at[end])
            own = Words(words.flat[mine], words.sizes[begin:end])
            yield batch.slice(bounds[k], end - begin), own, known[mine]
        first = last


class Code:
    """Symbols of words and the Huffman code of the symbols."""

    def __init__(self, words: list[bytes], weights: np.ndarray) -> None:
        self.words = pa.array(words, pa.binary())
        heap = [(int(w), k, None) for k, w in enumerate(weights.tolist())]
        heapq.heapify(heap)
        n = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], n, (a, b)))
            n += 1
        self.nodes = n - len(weights)
        paths: list[tuple[list[int], list[int]]] = [([], [])] * len(weights)
        open_nodes = [(heap[0], [], [])]
        while open_nodes:
            (_, number, below), nodes, bits = open_nodes.pop()
            if below is None:
                paths[number] = (nodes, bits)
            else:
                mine = [*nodes, number - len(weights)]
                open_nodes.append((below[0], mine, [*bits, 0]))
                open_nodes.append((below[1], mine, [*bits, 1]))
        self.lengths = np.array([len(nodes) for nodes, _ in paths], np.int32)
        self.starts = (np.cumsum(self.lengths) - self.lengths).astype(np.int64)
        # of each step: the inner node, the class of its depth and the bit
        nodes = np.concatenate([np.array(nodes, np.int32) for nodes, _ in paths])
        bits = np.concatenate([np.array(bits, np.int32) for _, bits in paths])
        depth = np.arange(len(nodes)) - np.repeat(self.starts, self.lengths)
        self.path = (nodes << 4) | (np.minimum(depth >> 1, _DEPTHS - 1).astype(np.int32) << 1) | bits

    def look_up(self, words: pa.BinaryArray) -> np.ndarray:
        """Symbols of words; -1 for those that are spelled."""
        found = pc.index_in(words, value_set=self.words).fill_null(-1 - _FIRST_WORD)
        return found.to_numpy(zero_copy_only=False) + np.int32(_FIRST_WORD)

    def symbols(self, words: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all documents, the first symbol of each one's token, the number of symbols of each document."""
        documents = len(words.sizes)
        unknown = np.flatnonzero(known < 0)
        spelled = words.flat.take(pa.array(unknown))
        letters = pc.binary_length(spelled).to_numpy(zero_copy_only=False).astype(np.int64)
        width = np.ones(len(known), np.int64)
        width[unknown] = letters + 1
        owner = np.repeat(np.arange(documents), words.sizes)
        totals = np.bincount(owner, width, minlength=documents).astype(np.int64) + 1
        ends = np.cumsum(totals) - 1
        places = np.cumsum(width) - width + owner  # one end symbol for each document before
        symbols = np.full(int(totals.sum()), -1, np.int32)
        symbols[ends] = _END
        symbols[places] = known
        symbols[places[unknown] + letters] = _BLANK
        if len(spelled):
            _, offsets, data = spelled.buffers()
            offsets = np.frombuffer(offsets, np.int32)[spelled.offset : spelled.offset + len(spelled) + 1]
            symbols[symbols < 0] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        tokens = np.zeros(len(symbols), bool)
        tokens[places] = tokens[ends] = True
        tokens = np.flatnonzero(tokens)
        return symbols, np.repeat(tokens, np.diff(np.append(tokens, len(symbols)))), totals

    def of(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """Symbols of documents given as lists of words, and the spelled words of each."""
        words = Words.listed(documents)
        known = self.look_up(words.flat)
        return *self.symbols(words, known), _spelled(words, known)


def _spelled(words: Words, known: np.ndarray) -> list[list[bytes]]:
    """The words of each document that are no symbols."""
    unknown = np.flatnonzero(known < 0)
    spelled = words.flat.take(pa.array(unknown)).to_pylist()
    bounds = np.searchsorted(unknown, np.concatenate(([0], np.cumsum(words.sizes))))
    return [spelled[low:high] for low, high in zip(bounds, bounds[1:])]


def _spelled_counts(words: Words, known: np.ndarray) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """Of each document: the number of words that are no symbols, the different ones, and how often each occurs."""
    unknown, n = np.flatnonzero(known < 0), len(words.sizes)
    found = words.flat.take(pa.array(unknown)).dictionary_encode()
    kinds = max(1, len(found.dictionary))
    owner = np.repeat(np.arange(n), words.sizes)[unknown]
    keys, times = np.unique(owner * kinds + found.indices.to_numpy(zero_copy_only=False), return_counts=True)
    bounds = pa.array(np.searchsorted(keys, np.arange(n + 1) * kinds), pa.int32())
    rare = found.dictionary.take(pa.array(keys % kinds))
    return np.bincount(owner, minlength=n), pa.ListArray.from_arrays(bounds, rare), pa.ListArray.from_arrays(bounds, pa.array(times, pa.int64()))


@dataclass(frozen=True)
class Round:
    """Bits that are mixed together: a block of up to ``step`` bits of each document that is ``alive``, ``sizes`` of them and from ``heads`` on,
    between two places (``low``, ``high``) in the order of mixing."""

    alive: np.ndarray
    sizes: np.ndarray
    heads: np.ndarray
    step: int
    low: int
    high: int


def _by_block(sizes: np.ndarray, block: int) -> tuple[np.ndarray, list[Round]]:
    """Places of bits, first those of every document's first block, then of the second and so on, and the rounds of that.

    Blocks grow with the distance from the start, so that long documents take few rounds.
    """
    starts, found, rounds, low, begin = np.cumsum(sizes) - sizes, [], [], 0, 0
    while low < int(sizes.max(initial=0)):
        step = max(block, low // 16)
        alive = np.flatnonzero(sizes > low)
        own = np.minimum(sizes[alive] - low, step)
        ends = np.cumsum(own)
        heads = ends - own
        found.append(np.arange(int(ends[-1])) + np.repeat(starts[alive] + low - heads, own))
        rounds.append(Round(alive, own, heads, step, begin, begin + int(ends[-1])))
        low, begin = low + step, begin + int(ends[-1])
    return np.concatenate(found) if found else np.empty(0, np.int64), rounds


def _contexts(symbols: np.ndarray, heads: np.ndarray, totals: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """A hash of 32 bits per symbol for the context of every predictor but the first, and the symbol before."""
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(totals) - totals, totals)
    before = [np.where(place >= k, np.roll(symbols, k), _END).astype(np.uint64) for k in range(1, max(_ORDERS) + 1)]
    contexts = []
    for order in _ORDERS:
        context = np.full(len(symbols), order, np.uint64)
        for k in range(order):
            context = (context ^ before[k]) * np.uint64(0xD6E8FEB86659FD93)
            context ^= context >> np.uint64(32)
        contexts.append(context)
    # letters weighed by their place in the word, summed up to the current one
    inside = np.arange(len(symbols)) - heads
    powers = np.cumprod(np.full(int(inside.max(initial=0)) + 1, 0xA0761D6478BD642F, np.uint64))
    weighed = (symbols.astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15) * powers[inside]
    sums = np.cumsum(weighed) - weighed
    context = sums - sums[heads]
    contexts.append((context ^ (context >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))
    return [(context >> np.uint64(32)).astype(np.uint32) for context in contexts], before[0]


def _hashed(mixed: np.ndarray, steps: np.ndarray, table_bits: int) -> np.ndarray:
    """Cells of bits from the contexts, which are overwritten, and from the nodes times a constant."""
    mixed ^= steps
    mixed *= np.uint32(0x85EBCA6B)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0xC2B2AE35)
    mixed >>= np.uint32(32 - table_bits)
    return mixed.astype(np.int64)


_NODE_STEP = np.uint32(0x9E3779B1)


class Bits:
    """The bits of some documents with the cells of every predictor, document after document; with ``block`` also the ``order`` in which
    they are mixed, and its ``rounds``."""

    def __init__(
        self, code: Code, documents: list[list[bytes]] | Words, table_bits: int, block: int | None = None, known: np.ndarray | None = None
    ) -> None:
        words = documents if isinstance(documents, Words) else Words.listed(documents)
        symbols, heads, self.totals = code.symbols(words, code.look_up(words.flat) if known is None else known)
        self.symbols, self._table_bits = symbols, table_bits
        self._contexts, before = _contexts(symbols, heads, self.totals)
        self._lengths = code.lengths[symbols].astype(np.int64)
        self._ends = np.concatenate(([0], np.cumsum(self._lengths)))
        self._last = np.concatenate(([0], np.cumsum(self.totals)))  # symbols before each document
        self.sizes = np.diff(self._ends[self._last])
        if block:
            self.order, self.rounds = _by_block(self.sizes, block)
        kind = (((before < _END) & (before != _BLANK)) * _DEPTHS).astype(np.int16)
        shift = code.starts[symbols] - self._ends[:-1]
        self._path = np.empty(int(self._ends[-1]), np.int32)
        self.bits, self.gate = np.empty(len(self._path), np.int32), np.empty(len(self._path), np.int16)
        for low, high in self._runs():
            here, lengths = slice(self._ends[low], self._ends[high]), self._lengths[low:high]
            path = code.path[np.arange(here.start, here.stop) + np.repeat(shift[low:high], lengths)]
            self._path[here], self.bits[here] = path, path & 1
            self.gate[here] = np.repeat(kind[low:high], lengths) + ((path >> 1) & 7).astype(np.int16)

    def _runs(self) -> Iterator[tuple[int, int]]:
        """Bounds of runs of symbols of whole documents, whose bits fit into a core's cache where the documents are short."""
        low = 0
        while low < len(self.symbols):
            high = int(self._last[min(np.searchsorted(self._last, low + _SPREAD), len(self._last) - 1)])
            yield low, high
            low = high

    def parts(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """Bounds of runs of bits of whole documents and their cells, an array per predictor."""
        for low, high in self._runs():
            here, lengths = slice(self._ends[low], self._ends[high]), self._lengths[low:high]
            nodes = self._path[here] >> 4
            steps = nodes.astype(np.uint32) * _NODE_STEP
            hashed = [_hashed(np.repeat(context[low:high], lengths), steps, self._table_bits) for context in self._contexts]
            yield int(here.start), int(here.stop), [nodes.astype(np.int64), *hashed]

    @property
    def cells(self) -> list[np.ndarray]:
        found = [cells for _, _, cells in self.parts()]
        return [np.concatenate(own) for own in zip(*found)] if found else [np.empty(0, np.int64)] * _PREDICTORS

    def documents(self) -> np.ndarray:
        """The document of each bit."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def _sizes(code: Code, table_bits: int) -> list[int]:
    return [code.nodes, *[1 << table_bits] * (_PREDICTORS - 1)]


def _gather(docs: DataFrame, code: Code, mixing: Mixing) -> DataFrame:
    """Counts of zeros and ones of all cells, in pieces: (piece, task, zipped counts)."""
    shared = docs.sparkSession.sparkContext.broadcast(code)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        tables = [np.zeros(2 * size, np.int32) for size in _sizes(code, mixing.table_bits)]
        waiting: list[list[np.ndarray]] = [[] for _ in tables]
        held, counted = 0, 0

        def flush() -> None:
            for k, (table, keys) in enumerate(zip(tables, waiting)):
                if keys:
                    _count(table, code, np.concatenate(keys), mixing.table_bits if k else 0)
                keys.clear()

        for batch in batches:
            for _, words, known in _portions(batch, 0, code):
                symbols, heads, totals = code.symbols(words, known)
                bits = int(code.lengths[symbols].sum())
                if counted and counted + bits > _FULL:
                    flush()
                    yield from _pieces(tables, TaskContext.get().partitionId())
                    for table in tables:
                        table.fill(0)
                    held, counted = 0, 0
                contexts, _ = _contexts(symbols, heads, totals)
                named = symbols.astype(np.uint64)
                waiting[0].append(named)
                for keys, context in zip(waiting[1:], contexts):
                    keys.append((context.astype(np.uint64) << np.uint64(32)) | named)
                held, counted = held + len(symbols), counted + bits
                if held >= _COUNTED:
                    flush()
                    held = 0
        if counted:
            flush()
            yield from _pieces(tables, TaskContext.get().partitionId())

    return docs.select("text").mapInArrow(count, "piece int, task long, counts binary")


def _count(table: np.ndarray, code: Code, keys: np.ndarray, table_bits: int) -> None:
    """Add the bits of symbols to a table; ``keys`` are the symbols below their contexts. Equal ones are sorted together and counted at once.

    Without ``table_bits`` the nodes themselves are the cells.
    """
    keys.sort()
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    times = np.diff(np.append(new, len(keys))).astype(np.int32)
    keys = keys[new]
    for low in range(0, len(keys), _SPREAD):
        part = keys[low : low + _SPREAD]
        symbols = (part & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lengths = code.lengths[symbols].astype(np.int64)
        first = np.cumsum(lengths) - lengths
        path = code.path[np.arange(int(lengths.sum())) + np.repeat(code.starts[symbols] - first, lengths)]
        nodes = path >> 4
        cells = nodes.astype(np.int64)
        if table_bits:
            mixed = np.repeat((part >> np.uint64(32)).astype(np.uint32), lengths)
            cells = _hashed(mixed, nodes.astype(np.uint32) * _NODE_STEP, table_bits)
        np.add.at(table, 2 * cells + (path & 1), np.repeat(times[low : low + _SPREAD], lengths))


def _zipped(counts: np.ndarray) -> bytes:
    """Counts as 32-bit numbers, or, where one does not fit, as 64-bit ones behind a mark that no zipped data begins with."""
    if counts.max(initial=0) <= np.iinfo(np.int32).max:
        return zlib.compress(np.ascontiguousarray(counts, np.int32).tobytes(), 1)
    return _WIDE + zlib.compress(np.ascontiguousarray(counts, np.int64).tobytes(), 1)


def _unzipped(data: bytes) -> np.ndarray:
    if data.startswith(_WIDE):
        return np.frombuffer(zlib.decompress(data[len(_WIDE) :]), np.int64)
    return np.frombuffer(zlib.decompress(data), np.int32)


def _pieces(tables: list[np.ndarray], task: int) -> Iterator[pa.RecordBatch]:
    step = 1 << _PIECE_BITS
    flat = [table[low : low + step] for table in tables for low in range(0, len(table), step)]
    for number, part in enumerate(flat):
        if part.any():
            yield pa.RecordBatch.from_pydict(
                {
                    "piece": pa.array([number], pa.int32()),
                    "task": pa.array([task], pa.int64()),
                    "counts": pa.array([_zipped(part)], pa.binary()),
                }
            )


def _merged(pieces: DataFrame) -> DataFrame:
    """One row per piece: counts added up in rounds, of which none brings more than a bounded number of rows together."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.int64(0)
        for counts in rows.column("counts").to_pylist():
            total = total + _unzipped(counts).astype(np.int64)
        packed = _zipped(total)
        return pa.table(
            {
                "piece": pa.array([key[0].as_py()], pa.int32()),
                "task": pa.array([key[1].as_py()], pa.int64()),
                "counts": pa.array([packed], pa.binary()),
            }
        )

    def unmerged(pieces: DataFrame) -> bool:
        last, rows, kinds = pieces.agg(F.max("task"), F.count(F.lit(1)), F.countDistinct("piece")).head()
        return (last or 0) > 0 or rows > kinds  # one task may have given a piece more than once

    pieces = stage(pieces)
    while unmerged(pieces):
        grouped = pieces.withColumn("task", F.floor(F.col("task") / _MERGED)).groupBy("piece", "task")
        pieces = stage(grouped.applyInArrow(add, "piece int, task long, counts binary"))
    return pieces


@dataclass(frozen=True)
class Model:
    """What goes to the tasks: the code and the zipped pieces of the tables. Its size is bounded by the parameters."""

    name: str
    code: Code
    pieces: dict[int, bytes]
    mixing: Mixing


class Tables:
    """Counts of all cells; log odds and whether there is more than one count of each."""

    def __init__(self, known: dict[int, bytes], code: Code, mixing: Mixing, keep_counts: bool = True) -> None:
        step, self.counts, self.packed, number = 1 << _PIECE_BITS, [], [], 0
        for size in _sizes(code, mixing.table_bits):
            last = number + -(-2 * size // step)
            wide = any(known.get(k, b"").startswith(_WIDE) for k in range(number, last))
            table = np.zeros(2 * size, np.int64 if wide else np.int32)
            for low in range(0, len(table), step):
                if number in known:
                    table[low : low + step] = _unzipped(known[number])
                number += 1
            self.packed.append(self._packed(table[0::2], table[1::2]))
            if keep_counts:
                self.counts.append(table.reshape(-1, 2))

    @staticmethod
    def _packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Log odds in steps, times two, plus one where there is more than one count."""
        odds = np.rint(np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))) / np.float32(_STEP))
        many = (zeros > 1) | (ones > 1) | ((zeros > 0) & (ones > 0))  # no sum, which could pass 32 bits
        return (2 * odds.astype(np.int16) + many).astype(np.int16)

    @staticmethod
    def _inputs(packed: list[np.ndarray], found: Bits) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the mix in its order, a row per predictor and one of ones, and the gates."""
        inputs = np.empty((_PREDICTORS + 1, len(found.bits)), np.float32)
        longest = np.zeros(len(found.bits), np.int16)
        for k, values in enumerate(packed):
            if k:
                np.maximum(longest, (values & 1) * np.int16(k), out=longest)
            np.multiply((values >> 1).take(found.order), np.float32(_STEP), out=inputs[k])
        inputs[-1] = 0.3
        return inputs, (found.gate * np.int16(_PREDICTORS) + longest).take(found.order).astype(np.int64)

    def read(self, found: Bits) -> tuple[np.ndarray, np.ndarray]:
        packed = [np.empty(len(found.bits), np.int16) for _ in self.packed]
        for low, high, parts in found.parts():
            for table, cells, values in zip(self.packed, parts, packed):
                values[low:high] = table[cells]
        return self._inputs(packed, found)

    def read_without(self, found: Bits) -> tuple[np.ndarray, np.ndarray]:
        """The same for training documents, each taken out of the counts while it is looked up and put back."""
        packed = [np.empty(len(found.bits), np.int16) for _ in self.counts]
        bounds = np.concatenate(([0], np.cumsum(found.sizes)))
        ones = {table.dtype: np.ones(int(found.sizes.max(initial=0)), table.dtype) for table in self.counts}
        for low, high, parts in found.parts():
            first, last = np.searchsorted(bounds, (low, high))
            ends = (bounds[first : last + 1] - low).tolist()
            bits = found.bits[low:high]
            for table, cells, values in zip(self.counts, parts, packed):
                flat, one = table.reshape(-1), ones[table.dtype]
                spots, left = 2 * cells + bits, np.empty((len(cells), 2), table.dtype)
                # a pair of 32-bit counts is fetched as one number
                pairs, out = (table, left) if table.itemsize > 4 else (table.view(np.int64)[:, 0], left.view(np.int64)[:, 0])
                for begin, end in zip(ends, ends[1:]):
                    own = spots[begin:end]
                    np.subtract.at(flat, own, one[: end - begin])
                    pairs.take(cells[begin:end], axis=0, out=out[begin:end], mode="clip")
                    np.add.at(flat, own, one[: end - begin])
                values[low:high] = self._packed_pairs(left)
        return self._inputs(packed, found)

    @staticmethod
    def _packed_pairs(left: np.ndarray) -> np.ndarray:
        """``_packed`` of zeros and ones side by side, which may be less than nothing, in 32 bits."""
        np.maximum(left, 0, out=left)
        pairs = left.astype(np.float32)
        many = (pairs[:, 0] + pairs[:, 1]) > 1
        pairs += np.float32(0.4)
        odds = pairs[:, 1] / pairs[:, 0]
        np.log(odds, out=odds)
        odds *= np.float32(1 / _STEP)
        np.rint(odds, out=odds)
        packed = odds.astype(np.int16)
        packed *= 2
        packed += many
        return packed


_loaded: dict[str, Tables] = {}


def _tables(model: Model, keep_counts: bool = False) -> Tables:
    """The model's tables, unzipped once per worker. It is the caller's task to put them into ``_loaded`` once no count is missing."""
    tables = _loaded.pop(model.name, None)
    if tables is None or keep_counts > bool(tables.counts):
        _loaded.clear()
        tables = Tables(model.pieces, model.code, model.mixing, keep_counts)
    return tables


def first_weights() -> np.ndarray:
    weights = np.full((_PREDICTORS + 1, _GATES), 0.3, np.float32)
    weights[-1] = 0
    return weights


def mix(
    found: Bits, inputs: np.ndarray, gates: np.ndarray, weights: np.ndarray, mixing: Mixing, learn: bool = False
) -> np.ndarray:
    """Natural log probability of each document. With ``learn`` the weights themselves are updated on the way, and zeros come back."""
    signs = found.bits.take(found.order).astype(np.float32) * 2 - 1
    logs, own = np.zeros(len(found.sizes)), np.zeros((len(weights), len(found.sizes)), np.float32)
    for now in found.rounds:
        x, sign, g = inputs[:, now.low : now.high], signs[now.low : now.high], gates[now.low : now.high]
        odds = np.zeros(now.high - now.low, np.float32)
        at = g if learn else g + np.repeat(np.arange(len(now.alive)) * _GATES, now.sizes)
        for c in range(len(weights)):
            used = weights[c] if learn else (own[c, now.alive, None] + weights[c]).reshape(-1)
            weight = used[at]
            weight *= x[c]
            odds += weight
        np.clip(odds, -_LIMIT, _LIMIT, out=odds)
        odds *= -sign
        chance = np.exp(odds, out=odds)
        chance += 1
        np.divide(1, chance, out=chance)  # of the bit that comes
        if not learn:
            logs[now.alive] += np.add.reduceat(np.log(chance), now.heads, dtype=np.float64)
        error = sign * (1 - chance)
        if not learn:
            rate = np.float32(mixing.own_rate * 8 / now.step)
            own[:, now.alive] += rate * np.add.reduceat(error * x, now.heads, axis=1)
        else:
            rate = mixing.fit_rate / np.sqrt(np.maximum(np.bincount(g, minlength=_GATES), 1))
            for c in range(len(weights)):
                weights[c] += rate * np.bincount(g, error * x[c], minlength=_GATES)
    return logs


def _fit(training: DataFrame, shared, mixing: Mixing) -> np.ndarray:
    """Starting weights from the given training documents: each task learns online, the results are averaged."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        code, tables = model.code, _tables(model, True)
        weights, seen = first_weights(), 0
        for batch in batches:
            for _, words, known in _portions(batch, 0, code):
                found = Bits(code, words, mixing.table_bits, mixing.block, known)
                mix(found, *tables.read_without(found), weights, mixing, True)
                seen += len(words.sizes)
        _loaded[model.name] = tables
        if seen:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"task": [task], "seen": [seen], "weights": [weights.tobytes()]})

    learned = training.select("text").mapInArrow(learn, "task long, seen long, weights binary")
    total, seen = np.zeros(first_weights().size), 0
    for row in sorted(learned.collect(), key=lambda row: row.task):  # about a kilobyte per task
        total += np.frombuffer(row.weights, np.float32).astype(np.float64) * row.seen
        seen += row.seen
    return (total / seen).astype(np.float32).reshape(-1, _GATES) if seen else first_weights()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all tokens but the ends; words are counted per batch before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4_096):
                found = pc.value_counts(Words.of(batch.column(0).slice(low, 4_096)).flat)
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _code(counts: DataFrame, mixing: Mixing, documents: int) -> tuple[Code, dict[bytes, int]]:
    """The code, and the counts of the words that are symbols: the most frequent ones, a number that is a parameter."""
    often = counts.filter(F.col("n") >= mixing.least).orderBy(F.desc("n"), "word").limit(mixing.words)
    top = [(bytes(row.word), row.n) for row in often.collect()]
    weights = np.ones(_FIRST_WORD + len(top), np.int64)
    weights[_END] += documents
    weights[_FIRST_WORD:] += np.array([n for _, n in top], np.int64)

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            spelled = batch.column(0).to_pylist()
            sizes = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
            data = np.frombuffer(b"".join([word + b" " for word in spelled]), np.uint8)
            total += np.bincount(data, np.repeat(batch.column(1).to_numpy(), sizes), minlength=256).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"letter": pa.array(range(256), pa.int32()), "n": total})

    rare = F.col("n") < mixing.least
    if len(top) == mixing.words:
        rare |= (F.col("n") < top[-1][1]) | ((F.col("n") == top[-1][1]) & (F.col("word") > F.lit(top[-1][0])))
    spelled = counts.filter(rare).mapInArrow(letters, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    for row in spelled.collect():
        weights[row.letter] += row.n  # 256 rows
    return Code([word for word, _ in top], weights), dict(top)


def _scored(
    docs: DataFrame, shared, weights: np.ndarray, frequent: dict[bytes, int], tokens: int, kinds: int, ends: int
) -> DataFrame:
    """Model score of every row, the base score of its frequent words, and its other words with their numbers."""
    frequent_shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, mixing, tables = shared.value.code, shared.value.mixing, _tables(shared.value)
        _loaded[shared.value.name] = tables
        every = math.log10(tokens + kinds + 1)
        counts = frequent_shared.value
        of_symbol = np.zeros(len(code.lengths))
        for symbol, word in enumerate(code.words.to_pylist(), _FIRST_WORD):
            of_symbol[symbol] = math.log10(counts[word] + 1) - every
        end = math.log10(ends + 1) - every
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, words, known in _portions(batch, 2, code):
                found = Bits(code, words, mixing.table_bits, mixing.block, known)
                logs = mix(found, *tables.read(found), weights, mixing)
                n = len(words.sizes)
                owner = np.repeat(np.arange(n), found.totals)
                base = np.bincount(owner, of_symbol[found.symbols], minlength=n) + end
                n_spelled, rare, times = _spelled_counts(words, known)
                size = pc.fill_null(pc.binary_length(part.column(2)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        part.column(0),
                        part.column(1),
                        pa.array(words.sizes + 1, pa.int64()),
                        pa.array(words.sizes - n_spelled + (ends > 0), pa.int64()),
                        pa.array(base),
                        pa.array(logs / math.log(10)),
                        size,
                        rare,
                        times,
                    ],
                    names=["row", "id", "held_out", "n_tokens", "known", "base", "score", "bytes", "rare", "times"],
                )
                row += n

    return docs.select("id", "held_out", "text").mapInArrow(
        score,
        f"row long, id {dict(docs.dtypes)['id']}, held_out boolean, n_tokens long, known long, base double, score double, "
        "bytes long, rare array<binary>, times array<long>",
    )


def score_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", mixing: Mixing = Mixing()) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every document.

    Documents whose id has a remainder of 2 are not learned from.
    """
    named = docs.select(
        F.col(id_column).alias("id"), held_out(id_column).alias("held_out"), F.col(text).cast("string").alias("text")
    )
    training = named.filter("NOT held_out")
    counts = stage(word_counts(training))
    ends = training.count()
    sums = counts.agg(F.sum("n"), F.count(F.lit(1))).head()
    tokens, kinds = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    code, frequent = _code(counts, mixing, ends)
    context = docs.sparkSession.sparkContext
    # as many pieces as the parameters say
    pieces = {row.piece: bytes(row.counts) for row in _merged(_gather(training, code, mixing)).collect()}
    shared = context.broadcast(Model(uuid.uuid4().hex, code, pieces, mixing))
    fitted = training
    if mixing.sample is not None:
        fitted = training.withColumn("_hash", F.xxhash64("id", "text")).orderBy("_hash", "text").limit(mixing.sample)
    weights = _fit(fitted, shared, mixing)
    rows = stage(_scored(named, shared, weights, frequent, tokens, kinds, ends))

    pairs = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("_pair"))
    pairs = pairs.select("row", F.col("_pair.rare").alias("word"), F.col("_pair.times").alias("times"))
    found = pairs.join(counts, "word", "left")
    known = F.coalesce("n", F.lit(0))
    gathered = found.groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(known + 1) - math.log10(tokens + kinds + 1))).alias("_base"),
        F.sum(F.when(known > 0, F.col("times")).otherwise(0)).alias("_known"),
    )
    return rows.drop("rare", "times").join(gathered, "row", "left").select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
