"""Token ids of whole texts with a public tokenizer, for use inside Spark tasks.

A tokenizer spends most of its time on words it has seen before. Where the tokenizer never joins characters across the white
space between two words, the ids of a text are those of its words one after another, and a worker can remember words. Each
batch looks up which of its words are new and has the library encode these in one call. A text whose white space is not plain
goes through the library as a whole. Either way the ids are the library's.
"""

from __future__ import annotations

import itertools
import json
import os

import numpy as np

#: A worker forgets what the current batch does not need when it knows so many words, unless its caller names another number; this
#: bounds its memory and changes no result.
_REMEMBERED = 1_500_000
_MARK = "¦"
#: Two white-space characters in a row, and all but the space and the line feed.
_IRREGULAR = ["  ", "\n\n", " \n", "\n ", *[chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]]


class Encoder:
    """Encodes batches of texts to the bytes of little-endian unsigned 32-bit ids, without special tokens."""

    def __init__(self, path: str, remembered: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        with open(path) as file:
            described = json.load(file)
        #: Whether a word keeps the space before it; else white space only ends words.
        self._spaced = described["normalizer"] is None
        self._known: dict[str, bytes] = {}
        self._remembered = remembered
        self._feed = self._whole("\n")
        # what stands between new words that are encoded together; regular words hold no line feed
        self._mark = "\n" if self._spaced else f"\n{_MARK}\n"

    def _whole(self, text: str) -> bytes:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _keys(self, text: str | None) -> list[str] | None:
        """The words to look up, those at the start of a line with the line feed before them; None for irregular white space.

        Only one space or line feed at a time, between words, is regular.
        """
        if not text:
            return []
        if not self._spaced:
            return text.replace("\n", " ").split(" ")
        if text[0] in " \n" or text[-1] in " \n" or any(odd in text for odd in _IRREGULAR):
            return None
        return ("\n" + text.replace("\n", " \n")).split(" ")

    def _learn(self, keys: set[str]) -> None:
        if not self._spaced:
            self._encode_joined(list(keys), list(keys), b"")
            return
        starts = [key for key in keys if key[0] == "\n"]
        others = [key for key in keys if key[0] != "\n"]
        self._encode_joined(starts, [key[1:] for key in starts], self._feed)
        self._encode_joined(others, [" " + key for key in others], b"")

    def _encode_joined(self, keys: list[str], words: list[str], before: bytes) -> None:
        """Encode new words in one text, with a mark between any two; one by one where a word holds the mark."""
        separator = np.frombuffer(self._whole(self._mark), "<u4")
        width, odd = len(separator), []
        for start in range(0, len(words), 20_000):
            part = list(range(start, min(start + 20_000, len(words))))
            if not self._spaced:
                odd += [k for k in part if _MARK in words[k]]
                part = [k for k in part if _MARK not in words[k]]
            joined = self._mark.join([words[k] for k in part])
            ids = np.array(self._library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            hits = np.flatnonzero(ids == separator[-1])
            if len(hits) != len(part) - 1:
                odd += part
                continue
            starts = np.concatenate(([0], hits + 1)).tolist()
            ends = np.concatenate((hits - (width - 1), [len(ids)])).tolist()
            data = ids.tobytes()
            self._known.update(
                zip([keys[k] for k in part], [before + data[4 * a : 4 * b] for a, b in zip(starts, ends)])
            )
        for k in odd:
            self._known[keys[k]] = before + self._whole(words[k])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        keys = [self._keys(text) for text in texts]
        flat = list(itertools.chain.from_iterable(found for found in keys if found))
        ids = list(map(self._known.get, flat))
        new = [k for k, found in enumerate(ids) if found is None]
        if new:
            if len(self._known) + len(new) > (self._remembered or _REMEMBERED):
                self._known = {key: found for key, found in zip(flat, ids) if found is not None}
            self._learn({flat[k] for k in new})
            for k in new:
                ids[k] = self._known[flat[k]]
        result, at = [], 0
        for text, found in zip(texts, keys):
            if found is None:
                result.append(self._whole(text))
                continue
            joined = b"".join(ids[at : at + len(found)])
            at += len(found)
            # the first word has been looked up as if it began a line
            result.append(joined[len(self._feed) :] if self._spaced and found else joined)
        return result


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, remembered: int | None = None) -> Encoder:
    """One encoder per worker, vocabulary file and number of words to remember."""
    key = path, remembered
    if key not in _encoders:
        _encoders[key] = Encoder(path, remembered)
    return _encoders[key]
