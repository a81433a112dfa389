"""Token ids in binary files of patched frame-of-reference blocks.

Documents are dealt to shards by ranges of their id, so that the shards one after another hold the ids in ascending document
order; one task encodes one shard and writes one file. A block holds 1,024 token ids: their least is subtracted, the rest is packed at the width that holds
a chosen percentile of them, and what needs more bits puts its high bits on an exception list. The index at the end of a file
says where each block starts and where each document begins, so that any range is read without decoding what lies before it.

Layout, all little-endian: ``magic``; the blocks; the index (block starts u64, document ids i64, whether a document has an id
u8, number of token ids u64 of each document); number of blocks u64, of documents u64, of token ids u64; ``magic``. A block: least u32, width u8,
number of ids u16, number of exceptions u16; packed words u64; places of the exceptions u16; their high bits u32.

A task writes under a name of its own and renames at the end, so that lost executors and repeated tasks leave whole files only;
their content does not depend on the attempt.

Defined results: a null or empty text is the end id alone; rows that share an id stand side by side, by text; rows without an id
come first; a text of any length is encoded whole; an empty table gives no file and an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from larder.llm.encoding import encoder
from larder.staging import new_folder, stage

_MAGIC = b"PFORIDS1"
_HEAD = struct.Struct("<IBHH")
_TAIL = struct.Struct("<QQQ8s")
BLOCK = 1024
_LANE = 64
#: Blocks that are packed or unpacked together.
_CHUNK = 1024
#: Texts that are encoded together.
_TEXTS = 512


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; exact below 2**52."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values of ``width`` bits each, as rows of 64-bit words."""
    lanes = np.ascontiguousarray(values.astype(np.uint64).reshape(-1, _LANE).T)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for k in range(_LANE):
        word, shift = divmod(k * width, 64)
        words[word] |= lanes[k] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``_pack``."""
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    values = np.empty((_LANE, lanes.shape[1]), np.uint64)
    for k in range(_LANE):
        word, shift = divmod(k * width, 64)
        values[k] = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            values[k] |= lanes[word + 1] << np.uint64(64 - shift)
    values &= np.uint64((1 << width) - 1)
    return np.ascontiguousarray(values.T).reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray, percentile: int = 90) -> list[bytes]:
    """The blocks of ``ids`` (32-bit unsigned); only the last may be short."""
    n = len(ids)
    count = -(-n // BLOCK)
    padded = np.zeros(count * BLOCK, np.uint32)
    padded[:n] = ids
    if n < len(padded):
        padded[n:] = ids[n - n % BLOCK :].min()
    rows = padded.reshape(count, BLOCK)
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    place = min(BLOCK - 1, BLOCK * percentile // 100)
    widths = _bit_lengths(np.partition(rest, place, axis=1)[:, place])
    blocks: list[bytes] = [b""] * count
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        values = rest[own]
        packed = _pack(values & np.uint32((1 << width) - 1), width) if width else np.empty((len(own), 0), np.uint64)
        high = values >> np.uint32(width) if width < 32 else np.zeros_like(values)
        at_row, at_place = np.nonzero(high)
        bounds = np.searchsorted(at_row, np.arange(len(own) + 1))
        for k, block in enumerate(own.tolist()):
            odd = slice(bounds[k], bounds[k + 1])
            size = min(BLOCK, n - block * BLOCK)
            head = _HEAD.pack(int(least[block]), width, size, bounds[k + 1] - bounds[k])
            places = at_place[odd].astype("<u2")
            blocks[block] = b"".join((head, packed[k].astype("<u8").tobytes(), places.tobytes(), high[k, places].astype("<u4").tobytes()))
    return blocks


def decode_blocks(data: memoryview, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``data``."""
    heads = [_HEAD.unpack_from(data, start) for start in starts]
    rows = np.empty((len(starts), BLOCK), np.uint32)
    for width in {head[1] for head in heads}:
        own = [k for k, head in enumerate(heads) if head[1] == width]
        if not width:
            rows[own] = 0
            continue
        size = 8 * width * BLOCK // _LANE
        words = np.frombuffer(b"".join([data[starts[k] + _HEAD.size :][:size] for k in own]), "<u8")
        rows[own] = _unpack(words.reshape(len(own), -1), width)
    for k, (least, width, _, odd) in enumerate(heads):
        if odd:
            at = starts[k] + _HEAD.size + 8 * width * BLOCK // _LANE
            places = np.frombuffer(data, "<u2", odd, at)
            rows[k, places] |= np.frombuffer(data, "<u4", odd, at + 2 * odd) << np.uint32(width)
        rows[k] += np.uint32(least)
    flat = rows.reshape(-1)
    return flat[: (len(starts) - 1) * BLOCK + heads[-1][2]] if starts else flat


class ShardWriter:
    """Appends documents to one file."""

    def __init__(self, path: str) -> None:
        self._path = path
        self._files, self._place = _located(path)
        self._temporary = f"{self._place}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
        self._files.create_dir(self._place.rpartition("/")[0], recursive=True)
        self._out = self._files.open_output_stream(self._temporary)
        self._out.write(_MAGIC)
        self._at, self._waiting, self._held = len(_MAGIC), [], 0
        self._starts: list[int] = []
        self._documents: list[int | None] = []
        self._sizes: list[int] = []

    def add(self, document: int | None, ids: bytes) -> None:
        self._documents.append(document)
        self._sizes.append(len(ids) // 4)
        self._waiting.append(ids)
        self._held += len(ids) // 4
        if self._held >= _CHUNK * BLOCK:
            self._write(self._held // BLOCK * BLOCK)

    def _write(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self._waiting), "<u4")
        blocks = encode_blocks(ids[:n]) if n else []
        sizes = np.array([len(block) for block in blocks], np.int64)
        self._starts.append(self._at + np.cumsum(sizes) - sizes)
        self._out.write(b"".join(blocks))
        self._at += int(sizes.sum())
        self._waiting, self._held = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> tuple[int, int, int]:
        """Numbers of documents, token ids and bytes."""
        self._write(self._held)
        starts = np.concatenate(self._starts)
        index = b"".join(
            (
                starts.astype("<u8").tobytes(),
                np.array([document or 0 for document in self._documents], "<i8").tobytes(),
                np.array([document is not None for document in self._documents], "u1").tobytes(),
                np.array(self._sizes, "<u8").tobytes(),
            )
        )
        total = sum(self._sizes)
        tail = _TAIL.pack(len(starts), len(self._documents), total, _MAGIC)
        self._out.write(index + tail)
        self._out.close()
        self._files.move(self._temporary, self._place)
        return len(self._documents), total, self._at + len(index) + len(tail)


class ShardReader:
    """Random access to one file."""

    def __init__(self, path: str) -> None:
        files, place = _located(path)
        self._file = files.open_input_file(place)
        size = self._file.size()
        blocks, documents, self.n_tokens, magic = _TAIL.unpack(self._part(size - _TAIL.size, size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is not a whole file of token ids")
        widths = (8 * blocks, 8 * documents, documents, 8 * documents)
        begin = size - _TAIL.size - sum(widths)
        index = self._part(begin, size - _TAIL.size)
        a, b, c = np.cumsum(widths[:3]).tolist()
        self._starts = [*np.frombuffer(index[:a], "<u8").tolist(), begin]
        has_id = np.frombuffer(index[b:c], "u1")
        self.documents = [i if ok else None for i, ok in zip(np.frombuffer(index[a:b], "<i8").tolist(), has_id)]
        self.sizes = np.frombuffer(index[c:], "<u8").astype(np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes

    def _part(self, start: int, stop: int) -> bytes:
        return self._file.read_at(stop - start, start)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Token ids of the places from ``start`` to ``stop`` in the shard; only their blocks are read."""
        first, last = start // BLOCK, -(-stop // BLOCK)
        if stop <= start:
            return np.empty(0, np.uint32)
        offset = self._starts[first]
        data = memoryview(self._part(offset, self._starts[last]))
        found = decode_blocks(data, [at - offset for at in self._starts[first:last]])
        return found[start - first * BLOCK : stop - first * BLOCK]

    def each(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Document, its first place and its ids, in order; about one chunk is in memory at a time."""
        held, at, low = np.empty(0, np.uint32), 0, 0
        for document, first, size in zip(self.documents, self.firsts.tolist(), self.sizes.tolist()):
            stop = first + size
            if stop > at:
                upto = min(self.n_tokens, max(stop, at + _CHUNK * BLOCK) // BLOCK * BLOCK + BLOCK)
                held, low = np.concatenate((held[first - low :], self.ids(at, upto))), first
                at = upto
            yield document, first, held[first - low : stop - low]


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, of a plain path as well."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the shards under ``folder``; returns (shard, path, documents, tokens, bytes), one row per file."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, number = None, TaskContext.get().partitionId()
        end, path = np.array([end_id], "<u4").tobytes(), f"{folder}/{TaskContext.get().partitionId():06d}.pfor"
        for batch in batches:
            for start in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(start, _TEXTS)
                encoded = encoder(tokenizer).encode(part.column(1).to_pylist())
                writer = writer or ShardWriter(path)
                for document, ids in zip(part.column(0).to_pylist(), encoded):
                    writer.add(document, ids + end)
        if writer:
            yield pa.RecordBatch.from_pydict(
                {"shard": [number], "path": [path]} | {k: [v] for k, v in zip(("documents", "tokens", "bytes"), writer.close())},
            )

    named = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    ordered = named.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    return stage(
        ordered.mapInArrow(shard, "shard long, path string, documents long, tokens long, bytes long")
    )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone; start counts from the first shard on."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, sums = ShardReader(path), []
                for _, _, ids in reader.each():
                    sums.append(zlib.crc32(np.ascontiguousarray(ids, "<u4")))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.documents, pa.int64()),
                        pa.array(reader.firsts + before),
                        pa.array(reader.sizes),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )

    # one narrow row per file, not per document
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).cast("long").alias("before"))
    # a task per file: its row says nothing of the work behind it
    return placed.repartition(max(1, manifest.count())).mapInArrow(
        read, "id long, start long, n_tokens long, ids_crc32 long"
    )


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write all documents as token files into ``folder`` (a new one in the shared folder) and describe what the files hold."""
    spark: SparkSession = docs.sparkSession
    return read_token_files(write_token_files(docs, tokenizer, end_id, folder or new_folder(spark)))
