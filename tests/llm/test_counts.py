"""Token counts, ranked search and the filter audit against the libraries and plain Python."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from larder.llm import filter_audit as A, ranked_search as R, token_counts as T
from larder.llm.catalog import QUERIES
from llm import odd

SF = "/root/testdata/sf0.001"
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    model = Tokenizer.from_file(path)
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


def strange_texts():
    rng = random.Random(5)
    signs = ["a", "B", "'s", " ", "  ", "\n", "\t", " ", "é", "é", "́", "İ", "Σ", "ß", "<|endoftext|>", "<|startoftext|>", "👍🏽", "12", "…", "▁", " ", "\x00", "漢字"]
    return ["".join(rng.choices(signs, k=rng.randrange(1, 40))) for _ in range(300)]


@pytest.mark.parametrize("name", FILES)
def test_op11_equals_the_library(spark, name):
    plain = library(name)
    texts = strange_texts() + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    lengths = T.Lengths(public_tokenizers.path(name))
    assert lengths.boundary is not None
    assert lengths.count(texts) == [plain(text) for text in texts]
    for text in texts:
        assert sum(lengths.count(lengths.cut(text, 7))) == plain(text)


def test_op11_forgets_and_encodes_whole_texts():
    path, plain = public_tokenizers.path(FILES[0]), library(FILES[0])
    texts = strange_texts()
    few = T.Lengths(path, remembered=5)
    assert few.count(texts[:150]) + few.count(texts[150:]) == [plain(text) for text in texts]
    few.boundary = None
    assert few.count(texts) == [plain(text) for text in texts]
    assert few.cut("a b c d", 1) == ["a b c d"]


def test_op11_query(spark):
    plain = library(FILES[0])
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op11_token_counts"](spark, SF)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = found.collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = plain(docs[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


def test_op11_odd_documents(spark):
    plain = library(FILES[0])
    docs = odd.frame(spark).withColumn("n_tokens", F.lit("mine"))
    found = T.count_tokens(docs, public_tokenizers.path(FILES[0]), limit=3)
    assert sorted(found.columns) == sorted([*docs.columns, "n_bytes", "over_limit"])
    rows = found.collect()
    assert len(rows) == len(odd.rows())
    for r in rows:
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), plain(r.text or ""))
        assert r.over_limit == (r.n_tokens > 3)
    assert T.count_tokens(odd.frame(spark, []), public_tokenizers.path(FILES[0])).collect() == []
    few = docs.select(T.token_count("text", public_tokenizers.path(FILES[0]), batch_bytes=50).alias("n"), "text").collect()
    assert all(r.n == plain(r.text or "") for r in few)


def test_op11_batches_are_balanced_by_bytes():
    rng = random.Random(1)
    sizes = np.array([rng.randrange(0, 200) for _ in range(5000)] + [5000, 0, 0, 3000])
    found = T.batches(sizes, 1000)
    assert [a for a, _ in found] == [0, *[b for _, b in found[:-1]]] and found[-1][1] == len(sizes)
    assert all(sizes[a:b].sum() <= 1400 or b - a <= 15 for a, b in found)
    assert T.batches(sizes[:0], 1000) == []
    assert T.batches(np.zeros(9, int), 1000) == [(0, 9)]


def plain_search(docs, items, k=10):
    """All scores, sorted."""
    split = lambda text: re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    held = [(i, Counter(split(text))) for i, text in docs]
    held = [(i, tf) for i, tf in held if tf]
    total, words = len(held), sum(sum(tf.values()) for _, tf in held)
    df = Counter(term for _, tf in held for term in tf)
    result = []
    for item, text in items:
        wanted, scores = Counter(split(text)), []
        for i, tf in held:
            m = 25 + 75 * sum(tf.values()) * total // words
            score = 0
            for term, times in wanted.items():
                if term in tf:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[term] + 1)))
                    score += times * w * (10**9 * tf[term] // (1000 * tf[term] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        result += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(scores[:k], 1)]
    return result


def in_order(rows):
    return sorted(rows, key=str)


def test_op12_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = QUERIES["op12_ranked_search"](spark, SF)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert in_order(map(tuple, found.collect())) == in_order(plain_search(docs, items))


@pytest.mark.parametrize("block,items,terms", [(1_000_000, 4096, 200_000), (40, 2, 200_000), (1, 4096, 3)])
def test_op12_odd_documents_and_small_blocks(spark, monkeypatch, block, items, terms):
    monkeypatch.setattr(R, "ITEMS", items)
    monkeypatch.setattr(R, "TERMS", terms)
    monkeypatch.setattr(R, "BLOCK", block)
    rows = odd.rows() + [(20 + k, "tie one", "en", "s", 1, "", 0, [], 0.5) for k in range(15)]
    wanted = [(1, "One two TIE tie"), (1, "one"), (None, "wörds 👍🏽 two"), (3, None), (4, "#$ "), (5, rows[0][1]), (6, "line absent here")]
    queries = spark.createDataFrame([(*x, 5, "clash") for x in wanted], "item_id long, text string, score int, id string")
    found = R.ranked_search(odd.frame(spark, rows), queries)
    expected = plain_search([row[:2] for row in rows], wanted)
    assert in_order(map(tuple, found.collect())) == in_order(expected)
    nothing = odd.frame(spark, [])
    assert R.ranked_search(nothing, queries).collect() == []
    assert R.ranked_search(odd.frame(spark), queries.limit(0)).collect() == []


def lists_of(documents, width):
    import pyarrow as pa

    counts = np.array([len(d) for d in documents])
    terms = np.array([t for d in documents for t in sorted(d)], np.int64)
    tfs = np.array([d[t] for d in documents for t in sorted(d)], np.int64)
    n = np.array([sum(d.values()) for d in documents])
    return R.ImpactLists(pa.array(range(len(documents))), n, counts, terms, tfs, width, (len(documents), int(n.sum())))


def test_op12_bound_stops_early_and_keeps_ties():
    rng = random.Random(3)
    # one rare term with high scores over a background of a frequent one
    documents = [Counter({0: rng.randrange(1, 4), 1 + rng.randrange(40): 1}) for _ in range(20_000)]
    for k in range(30):
        documents[rng.randrange(20_000)][50] += 8
    lists, best = lists_of(documents, 60), R.Best(10)
    factors = np.array([3, 9000])
    read = lists.search(np.array([0, 50]), factors, best)
    assert read < 4000
    scores = np.zeros(len(documents), np.int64)
    owner = np.repeat(np.arange(len(documents)), np.diff(lists.first))
    for term, factor in zip((0, 50), factors):
        at = lists.terms == term
        np.add.at(scores, owner[at], factor * lists.part[at])
    expected = np.lexsort((np.arange(len(scores)), -scores))[:10]
    assert best.ids.tolist() == expected.tolist() and best.scores.tolist() == scores[expected].tolist()
    # many equal scores: the smallest ids
    equal, best = lists_of([Counter({0: 1})] * 500, 1), R.Best(10)
    equal.search(np.array([0]), np.array([7]), best)
    assert best.ids.tolist() == list(range(10))
    # a block that can't reach the kth document of an earlier one is not read
    assert equal.search(np.array([0]), np.array([1]), best) == 0


WHITE = r"[\x20\x09-\x0D]+"


def plain_audit(docs, labels):
    good = {i for i, quality, _ in labels if quality == 1} - {None}
    toxic = {i for i, _, bad in labels if bad == 1} - {None}
    sets = {}
    seen = {}
    for i, text, _ in docs:
        if i is not None:
            seen[text or ""] = min(i, seen.get(text or "", i))
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in re.split(WHITE, text) if w]
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": i is not None and seen[text] < i,
        }
        sets.setdefault(lang or "", []).append(({f for f, bad in failed.items() if bad}, i in good, i in toxic))
    result, shapley = [], Counter()
    for part, rows in sets.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [r for r in rows if letter in r[0] and not r[0] & before]
                shapley[part, letter] += len(removed)
                result.append(
                    [part, order, step, sum(not r[0] & {*before, letter} for r in rows), len(removed),
                     sum(letter in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {letter} for r in rows),
                     sum(r[1] for r in removed), sum(r[2] for r in removed)]
                )
    return [(*row, shapley[row[0], row[1][row[2] - 1]]) for row in result]


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_op13_odd_documents(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(A, "BROADCAST_BYTES", 0)
    rows = odd.rows() + [(100 + k, " ".join(odd.words(1, 120)), "en", "s", 1, "", 0, [], 0.5) for k in range(400)]
    rows += [(k, " ".join(odd.words(k, 220)), ["en", None, ""][k % 3], "s", 1, "", 0, [], 0.5) for k in range(600, 900)]
    marks = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (150, 1, None), (None, 1, 1), (12_345, 1, 1), (650, 0, 1), (651, 1, 0)]
    labels = spark.createDataFrame([(*mark, "clash") for mark in marks], "doc_id long, quality int, toxic int, mask string")
    docs = odd.frame(spark, rows).withColumns({"mask": F.lit("mine"), "hash": F.lit(1), "segment": F.lit(0), "part": F.lit("x")})
    found = A.filter_audit(docs, labels)
    assert sorted(found.columns) == sorted(COLUMNS)
    expected = plain_audit([row[:3] for row in rows], marks)
    assert sorted(map(tuple, found.select(COLUMNS).collect())) == sorted(expected)


def test_op13_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_audit(odd.frame(spark, []), labels).collect() == []
    rows = [(i, "same", "en", "s", 1, "", 0, [], 0.5) for i in (1, 2, None)]
    failed = A.failed_filters(odd.frame(spark, rows)).collect()
    assert sorted((r.id or 0, r.mask) for r in failed) == [(0, 1), (1, 1), (2, 17)]


def test_op13_sketch_clears_most_unique_texts_and_no_repeat(spark):
    texts = spark.range(40_000).selectExpr("CAST(id AS string) AS text")
    texts = texts.union(texts.filter("CAST(text AS long) % 10 = 0")).repartition(5)
    hashed = A._hashed(texts, 44_000 // 4096 + 1)
    bits = A.repeat_sketch(hashed)
    judged = hashed.join(bits, "segment").withColumn("maybe", A.possible_repeat(F.col("bits"), F.col("places")))
    repeated = F.col("text").cast("long") % 10 == 0
    row = judged.agg(
        F.count_if(repeated & F.col("maybe")), F.count_if(repeated), F.count_if(~repeated & F.col("maybe")), F.count_if(~repeated)
    ).first()
    assert row[0] == row[1] == 8000
    assert row[3] == 36_000 and row[2] < 0.02 * row[3]
