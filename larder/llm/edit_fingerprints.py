"""Document fingerprints by a randomised edit embedding.

One random walk is shared by all texts: in step j it writes the character it stands on and moves on by a random bit that
depends on j and on the character. Texts that differ by few edits are read in step again soon after each edit, so the Hamming
distance of what is written follows the edit distance of the texts. A fingerprint samples what is written: of every octave of
steps the same 32 steps, each as four bits of the character. Texts of any length thus share their early octaves, and the likeness of two
fingerprints weighs each sample by the steps it stands for.

For a search, groups of sampled characters are bucket keys (bands), and what shares a bucket is verified by the edit distance of the texts
themselves.

Defined results: a null text counts as an empty one, whose fingerprint is empty; rows that share an id follow each other
by the hash of their text; rows without an id come first; a table of one row has itself as the next document; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from larder.staging import stage

#: The walk's random bits repeat after so many steps.
_PERIOD = 4096
_END = 255
_PER_OCTAVE = 32
_OCTAVES = 36
_SEED = 7_041
#: Texts are walked together up to so many characters.
_CHARACTERS = 4_000_000
#: Below so many texts, single steps of plain Python cost less than vector operations.
_FEW = 24
_PAD = 16


@cache
def _bits() -> np.ndarray:
    """Row j: whether the walk moves on from each class of characters in step j. The end never moves on."""
    bits = np.random.default_rng(_SEED).integers(0, 2, (_PERIOD, 256))
    bits[:, _END] = 0
    return bits


@cache
def _samples() -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps in ascending order, and the number of steps each stands for."""
    rng = np.random.default_rng(_SEED + 1)
    steps, weights = [np.arange(_PER_OCTAVE)], [np.ones(_PER_OCTAVE)]
    low = _PER_OCTAVE
    for _ in range(_OCTAVES):
        steps.append(np.sort(low + rng.choice(low, _PER_OCTAVE, replace=False) if low < 1 << 22 else low + np.unique(rng.integers(0, low, _PER_OCTAVE))))
        weights.append(np.full(len(steps[-1]), low / len(steps[-1])))
        low *= 2
    return np.concatenate(steps), np.concatenate(weights)


def _classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts as classes from 0 to 254, an end after each text; where each text starts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    classes = (((points * np.uint32(2_654_435_761)) >> np.uint32(11)) % np.uint32(_END)).astype(np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    return np.insert(classes, ends, _END), ends - lengths + np.arange(len(texts))


def walk(texts: list[str]) -> np.ndarray:
    """Sampled classes, a row per text; ``_END`` where the walk was over."""
    buffer, position = _classes(texts)
    steps, bits = _samples()[0].tolist(), _bits()
    found = np.full((len(texts), len(steps)), _END, np.uint8)
    alive, step, sample = np.arange(len(texts)), 0, 0
    while True:
        going = buffer[position] != _END
        if not going.all():
            alive, position = alive[going], position[going]
        if len(alive) <= _FEW:
            break
        here, move = np.empty(len(alive), np.uint8), np.empty(len(alive), np.int64)
        for step in range(step, step + 64):
            np.take(buffer, position, out=here, mode="clip")
            if step == steps[sample]:
                found[alive, sample] = here
                sample += 1
            np.take(bits[step % _PERIOD], here, out=move, mode="clip")
            position += move
        step += 1
    if len(alive):
        data, rows = buffer.tobytes(), [row.tobytes() for row in bits.astype(np.uint8)]
        for text, at in zip(alive.tolist(), position.tolist()):
            _finish(data, rows, at, step, sample, steps, found[text])
    return found


def _finish(data: bytes, rows: list[bytes], at: int, step: int, sample: int, steps: list[int], found: np.ndarray) -> None:
    """The rest of one text's walk."""
    while data[at] != _END:
        target = steps[sample]
        while step < target:
            at += rows[step % _PERIOD][data[at]]
            step += 1
        found[sample] = data[at]
        at += rows[step % _PERIOD][data[at]]
        step += 1
        sample += 1


def _nibbles(found: np.ndarray) -> np.ndarray:
    """Four bits of each sampled class; ``_PAD`` after the end."""
    return np.where(found == _END, _PAD, (found * np.uint8(0x9D)) >> np.uint8(4)).astype(np.uint8)


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Weighted share of equal samples, row by row, of those that either text reaches; 1 for two empty texts."""
    reached = (one != _PAD) | (other != _PAD)
    weights = _samples()[1][: one.shape[1]]
    total, equal = reached @ weights, (reached & (one == other)) @ weights
    return np.where(total > 0, equal / np.where(total > 0, total, 1), 1.0)


def as_text(nibbles: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal digits, one per sample."""
    digits = np.frombuffer(b"0123456789abcdef ", np.uint8)[nibbles]
    return [row.tobytes().decode().rstrip() for row in digits]


def from_text(fingerprints: list[str]) -> np.ndarray:
    """The inverse of ``as_text``."""
    width = max(map(len, fingerprints), default=0)
    digits = np.frombuffer("".join(text.ljust(width) for text in fingerprints).encode(), np.uint8)
    values = np.full(256, _PAD, np.uint8)
    values[np.frombuffer(b"0123456789abcdef", np.uint8)] = np.arange(16)
    return values[digits].reshape(len(fingerprints), width)


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many characters (or all) of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_COLUMNS = [
    ("id", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
]
_SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _described(ids: list[int | None], texts: list[str], following: list[str]) -> list[list]:
    """The columns of some documents with their next ones."""
    n, changed = len(texts), [edited(*pair) for pair in zip(texts, following)]
    # a text's next one mostly is the next in the list
    shared = all(texts[k + 1] is following[k] for k in range(n - 1))
    nibbles = _nibbles(walk(texts + changed + (following[-1:] if shared else following)))
    own, other = nibbles[:n], nibbles[n : 2 * n]
    coming = np.concatenate((own[1:], nibbles[2 * n :])) if shared else nibbles[2 * n :]
    return [
        ids,
        [len(text) for text in texts],
        [hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() for text in changed],
        as_text(own),
        as_text(other),
        likeness(own, other).tolist(),
        likeness(own, coming).tolist(),
    ]


def _with_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task, in order. Its last row has no next one here; the texts of its first and last rows go along."""
    task, ids, texts, held, first = TaskContext.get().partitionId(), [], [], 0, True

    def flush(last: bool) -> pa.RecordBatch:
        nonlocal first
        n = len(texts) - (not last)
        columns = _described(ids[:n], texts[:n], texts[1:n] + [texts[n] if not last else ""])
        edge = [None] * n
        is_first = [first and k == 0 for k in range(n)]
        is_last = [last and k == n - 1 for k in range(n)]
        edge = [texts[k] if is_first[k] or is_last[k] else None for k in range(n)]
        first = False
        arrays = [pa.array(values, kind) for values, (_, kind) in zip(columns, _COLUMNS)]
        arrays += [pa.array([task] * n, pa.int64()), pa.array(is_first), pa.array(is_last), pa.array(edge, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in _COLUMNS] + ["task", "is_first", "is_last", "edge"])

    for batch in batches:
        for document, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(document)
            texts.append(text or "")
            held += len(texts[-1])
            if held >= _CHARACTERS and len(texts) > 1:
                yield flush(False)
                ids, texts = ids[-1:], texts[-1:]
                held = len(texts[0])
    if texts:
        yield flush(True)


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            document, text, following = (batch.column(c)[k].as_py() for c in range(3))
            columns = _described([document], [text], [following])
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, (_, kind) in zip(columns, _COLUMNS)],
                names=[name for name, _ in _COLUMNS],
            )


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness to each other and to the next document's.

    Texts are dealt to tasks by ranges of the id, once. Only the last row of a task has its next one elsewhere: the first row
    of the next task that has rows. These few rows are completed by a join on the number of that task.
    """
    named = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    order = ["id", "_hash", "text"]
    sorted_rows = named.withColumn("_hash", F.xxhash64("text")).repartitionByRange("id", "_hash").sortWithinPartitions(*order)
    rows = stage(
        sorted_rows.select("id", "text").mapInArrow(
            _with_edges, f"{_SCHEMA}, task long, is_first boolean, is_last boolean, edge string"
        )
    )
    tasks = rows.filter("is_last").select("task")  # one narrow row per task
    least = tasks.agg(F.min("task")).head()[0]
    following = tasks.select("task", F.coalesce(F.lead("task").over(Window.orderBy("task")), F.lit(least)).alias("_next"))
    firsts = rows.filter("is_first").select(F.col("task").alias("_next"), F.col("edge").alias("_following"))
    lasts = rows.filter("is_last").select("task", "id", "edge").join(following, "task").join(firsts, "_next")
    completed = lasts.select("id", "edge", "_following").mapInArrow(_with_next, _SCHEMA)
    names = [name for name, _ in _COLUMNS]
    return rows.filter("NOT is_last").select(*names).union(completed).withColumnRenamed("id", id_column)


def band_keys(fingerprint: str, bands: int = 12, rows: int = 6) -> F.Column:
    """Bucket keys of a fingerprint column: each is made of ``rows`` sampled digits from its later half, where most steps lie.

    A text has the keys of its last octave and of the one before it, so that texts whose walks end in neighbouring octaves
    share those of the shorter one.
    """
    rng = np.random.default_rng(_SEED + 2)
    octaves = F.greatest(F.ceil(F.length(fingerprint) / _PER_OCTAVE), F.lit(1))
    keys = []
    for band in range(bands):
        back = rng.choice(3 * _PER_OCTAVE, rows, replace=False)
        for last in (octaves, F.greatest(octaves - 1, F.lit(1))):
            # places count back from the last whole octave, so that texts of like length share them
            start = F.greatest((last - 1) * _PER_OCTAVE, F.lit(_PER_OCTAVE))
            digits = [F.substring(fingerprint, (start - F.lit(int(b)) % start).cast("int"), F.lit(1)) for b in back]
            keys.append(F.xxhash64(F.lit(band), last, *digits))
    return F.array_distinct(F.array(*keys))


def near_texts(
    queries: DataFrame, docs: DataFrame, limit: float = 0.8, bands: int = 12, rows: int = 6
) -> DataFrame:
    """Pairs (query_id, doc_id, likeness) of different texts that share a bucket and whose edit similarity is ``limit`` at least.

    Both frames have (id, text, fingerprint), ``text`` unique: give classes of equal texts once, by their least id. The edit
    similarity is 1 - edit distance / length of the longer text.
    """
    left = queries.select(F.col("id").alias("query_id"), F.col("fingerprint").alias("_one"), F.explode(band_keys("fingerprint", bands, rows)).alias("_key"))
    right = docs.select(F.col("id").alias("doc_id"), F.col("fingerprint").alias("_other"), F.explode(band_keys("fingerprint", bands, rows)).alias("_key"))
    pairs = left.join(right, "_key").filter("query_id <> doc_id").drop("_key").distinct()

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            both = from_text(one + other)
            found = likeness(both[: len(one)], both[len(one) :])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found)], names=["query_id", "doc_id", "likeness"]
            )

    likely = pairs.select("query_id", "_one", "doc_id", "_other").mapInArrow(alike, "query_id long, doc_id long, likeness double")
    texts = queries.select(F.col("id").alias("query_id"), F.col("text").alias("_text"))
    others = docs.select(F.col("id").alias("doc_id"), F.col("text").alias("_other_text"))
    full = likely.join(texts, "query_id").join(others, "doc_id")
    longer = F.greatest(F.length("_text"), F.length("_other_text"))
    allowed = F.floor(longer * (1 - limit) + 1e-9).cast("int")
    distance = F.call_function("levenshtein", "_text", "_other_text", allowed)
    return full.filter(distance >= 0).select("query_id", "doc_id", "likeness")
