"""Token counts of whole texts: batches of equal bytes go to the tokenizer library inside Arrow functions that return lengths only.

A function gets a column of texts and gives back one number per row; ids never leave the task. The texts of an Arrow batch are dealt to
batches of about ``BATCH_BYTES`` each: short texts share a batch, a longer text is split at safe boundaries and fills several. A
boundary is safe where no token, no merge and no normalisation step of the tokenizer reaches across it, which is read from the
tokenizer's description; where none is known (another pre-tokenizer, a text without white space) a text is encoded whole.
Inside a batch the texts are split further, down to the shortest safe parts, and every distinct part is encoded once; a worker
remembers the lengths of parts until it knows ``REMEMBERED`` of them.

The rows stay where the scan put them: nothing is shuffled, and a task's memory depends on the batch and not on the table.

Defined results: a null or empty text has 0 bytes and 0 tokens; a text of any length is counted whole; rows that share an id, or are equal,
are counted each; there is no order, so there are no ties; an empty table gives an empty result; all other columns
are passed through, except those named like a result, which are replaced.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of text that are encoded together.
BATCH_BYTES = 1 << 20
#: Parts whose lengths a worker remembers.
REMEMBERED = 1_000_000

#: Byte-level tokenizers put a single space to the word behind it.
_LEADING_SPACE = re.compile(r"(?<=\S)(?= \S)")
_SINGLE_SPACE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")  # the mark stands for a space in a text, too
_ENDS_WORDS = re.compile(r"[ \n]")


class Lengths:
    """Numbers of tokens of texts under one vocabulary file, without special tokens of its own, truncation or padding."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        if path.endswith(".model"):
            self._encode, self.boundary = _pieces(path)
        else:
            self._encode, self.boundary = _tokens(path)
        self._remembered = remembered
        self._known: dict[str, int] = {}

    def cut(self, text: str, size: int) -> list[str]:
        """``text`` in parts of about ``size`` characters, cut at safe boundaries; their lengths add up to that of the text."""
        if self.boundary is None or len(text) <= size:
            return [text]
        parts, start = [], 0
        while len(text) - start > size:
            at = self.boundary.search(text, start + size)
            if at is None:
                break
            parts.append(text[start : at.start()])
            start = at.end()
        return [*parts, text[start:]]

    def split(self, text: str) -> list[str]:
        """The shortest parts whose lengths add up to that of the text."""
        if self.boundary is _ENDS_WORDS:
            return text.replace("\n", " ").split(" ")
        return self.boundary.split(text)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text of one batch."""
        if self.boundary is None:
            return self._encode(texts)
        parts = [self.split(text) for text in texts]
        flat = list(itertools.chain.from_iterable(parts))
        found = list(map(self._known.get, flat))
        if None in found:
            new = list({part for part, n in zip(flat, found) if n is None})
            if len(self._known) + len(new) > self._remembered:
                self._known = {}
                new = list(set(flat))
            self._known.update(zip(new, self._encode(new)))
            found = list(map(self._known.__getitem__, flat))
        ends = itertools.accumulate(map(len, parts))
        total = [0, *itertools.accumulate(found)]
        starts = [0, *ends]
        return [total[high] - total[low] for low, high in itertools.pairwise(starts)]


def _tokens(path: str) -> tuple[Callable[[list[str]], list[int]], re.Pattern | None]:
    """Encoder and safe boundary of a file of the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    with open(path) as file:
        described = json.load(file)

    def encode(parts: list[str]) -> list[int]:
        return [len(found.ids) for found in library.encode_batch_fast(parts, add_special_tokens=False)]

    # an added token that holds white space, or takes it along, reaches across words
    if any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["normalized"] for x in described["added_tokens"]):
        return encode, None
    return encode, _boundary(described)


def _boundary(described: dict) -> re.Pattern | None:
    steps = described["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = steps["normalizers"] if steps["type"] == "Sequence" else [steps]
    splits = described["pre_tokenizer"] or {}
    if not steps and splits.get("type") == "ByteLevel" and splits["use_regex"] and not splits["add_prefix_space"]:
        return _LEADING_SPACE
    # white space becomes a space, and only what is no white space is kept, in tokens that hold none
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if spaces not in steps or any(x["type"] not in ("NFC", "Replace", "Lowercase") or x["type"] == "Replace" and x != spaces for x in steps):
        return None
    first = splits.get("pretokenizers", [{}])[0]
    kept = first.get("pattern", {}).get("Regex", " ")
    if first.get("type") != "Split" or first["behavior"] != "Removed" or not first["invert"] or " " in kept:
        return None
    return _ENDS_WORDS


def _pieces(path: str) -> tuple[Callable[[list[str]], list[int]], re.Pattern | None]:
    """Encoder and safe boundary of a sentencepiece model."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=path)

    def encode(parts: list[str]) -> list[int]:
        return list(map(len, library.encode(parts, num_threads=1)))

    # words begin with the space's mark: where no piece has it after another character, none reaches across a space,
    # and where a text begins like a word, what follows a space is a text of its own
    across = any(re.search("[^▁]▁", library.id_to_piece(k)) for k in range(library.vocab_size()))
    alike = encode(["a b"]) == [sum(encode(["a", "b"]))]
    return encode, None if across or not alike else _SINGLE_SPACE


def batches(sizes: np.ndarray, target: int) -> list[tuple[int, int]]:
    """Runs of rows (from, to) of nearly equal bytes, about ``target`` each; a larger row is a run of its own."""
    total = np.cumsum(sizes)
    if not len(total):
        return []
    each = max(1.0, total[-1] / max(1, round(total[-1] / target)))
    # a row belongs to the run in which its middle byte lies
    run = ((total - sizes / 2) // each).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))).tolist()
    return list(zip(starts, [*starts[1:], len(total)]))


def _lengths_of(column: pa.Array, lengths: Lengths, target: int) -> list[int]:
    sizes = column.cast(pa.binary()).fill_null(b"")
    sizes = np.array(pc.binary_length(sizes).to_numpy(zero_copy_only=False), np.int64)
    counts: list[int] = []
    for low, high in batches(sizes, target):
        texts = [text or "" for text in column.slice(low, high - low).to_pylist()]
        if high - low == 1 and sizes[low] > target:
            counts.append(sum(lengths.count([part])[0] for part in lengths.cut(texts[0], target)))
        else:
            counts += lengths.count(texts)
    return counts


_loaded: dict[str, Lengths] = {}


def token_count(text: Column | str, tokenizer: str, batch_bytes: int = BATCH_BYTES) -> Column:
    """Number of tokens of every text, as a column; ``tokenizer`` is a ``.json`` or ``.model`` file that every worker can read."""

    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = Lengths(tokenizer)
        for column in columns:
            yield pa.array(_lengths_of(column, _loaded[tokenizer], batch_bytes), pa.int64())

    return F.arrow_udf(count, "long")(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and, where a ``limit`` is given, ``over_limit``."""
    content = F.coalesce(docs[text].cast("string"), F.lit(""))
    counted = docs.withColumns({"n_bytes": F.octet_length(content).cast("long"), "n_tokens": token_count(content, tokenizer)})
    return counted if limit is None else counted.withColumn("over_limit", F.col("n_tokens") > limit)
