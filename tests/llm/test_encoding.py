"""Remembered words against the library on whole texts."""

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from larder.llm import encoding

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    None,
    "",
    " ",
    "\n",
    "a",
    "don't stop  now\n\nplease ",
    "tab\there\r\nNBSP end   wide",
    "<|endoftext|> in a text<|endoftext|>",
    "mark ¦ and x¦y ¦¦",
    "ΟΔΟΣ ΣΑΣ. É é ﬁ 𝒳 👍🏽 \x1c \x85 ​ zero",
    "a\n b \nc",
    "12 345 !!! ---",
    " lead",
    "trail\n",
    "x\t  y z\tw",
]


@pytest.fixture(params=FILES)
def both(request):
    path = public_tokenizers.path(request.param)
    return encoding.Encoder(path), Tokenizer.from_file(path)


def plain(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_odd_texts(both):
    own, library = both
    for _ in range(2):
        assert own.encode(ODD) == [plain(library, text) for text in ODD]
    assert own.encode([]) == []


def test_documents(both):
    own, library = both
    texts = [text for (text,) in duckdb.execute("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    assert own.encode(texts) == [plain(library, text) for text in texts]


def test_memory_is_bounded(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(encoding, "_REMEMBERED", 7)
    for text in ("a b c d e f g h i j k", "k j i\nh g", "a z"):
        assert own.encode([text, "b c"]) == [plain(library, text), plain(library, "b c")]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet="aB'st1.! \n\t¦é́Σ<|>", max_size=14), max_size=4))
@pytest.mark.parametrize("file", FILES)
def test_any_text(file, texts):
    path = public_tokenizers.path(file)
    own = encoding.encoder(path)
    assert own.encode(texts) == [plain(own._library, text) for text in texts]


@pytest.mark.parametrize("file", FILES)
def test_caller_bounds_the_memory(file):
    path = public_tokenizers.path(file)
    own, library = encoding.encoder(path, 9), Tokenizer.from_file(path)
    assert own is encoding.encoder(path, 9) and own is not encoding.encoder(path)
    texts = [f"w{k} w{k + 1} a b" for k in range(40)]
    assert [own.encode([text])[0] for text in texts] == [plain(library, text) for text in texts]
    assert len(own._known) <= 9
