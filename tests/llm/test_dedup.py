"""Near duplicates and fingerprints against plain Python."""

import hashlib
from itertools import combinations

import numpy as np
import pytest

from larder.llm import edit_fingerprints as E
from larder.llm import minhash as M
from larder.llm.catalog import QUERIES
from llm import odd

SF = "/root/testdata/sf0.001"


def shingles(text):
    found = (text or "").encode().lower().split()
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def classes(rows, percent=85):
    """(id, text) rows to {id: least id that links lead to}, comparing everything with everything."""
    sets, parent = {}, {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingles(text))
        parent[i] = i

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        for x in sets[a]:
            for y in sets[b]:
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    one, other = sorted((top(a), top(b)))
                    parent[other] = one
    return {i: top(i) for i in parent}


def test_op1_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wanted = classes([(r.doc_id, r.text) for r in docs.collect()])
    found = QUERIES["op1_minhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: r.component_id for r in found} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert len(found) == docs.count() and len(set(wanted.values())) < len(wanted)
    sizes = {r.doc_id: len(shingles(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_shingles for r in found} == sizes


def test_chains_and_a_group_that_is_not_one_component(spark):
    """A base, copies with few edits, which link to it, and copies with more, which link to nothing or to each other."""
    base = odd.words(5, 200)
    rows = [(0, " ".join(base))]
    for k in range(1, 90):
        changed = list(base)
        for e in range(1 + k % 6):
            changed[(37 * k + 31 * e) % 200] = f"edit{k}x{e}"
        rows.append((k, " ".join(changed)))
    step = list(base)
    for k in range(90, 110):  # each differs little from the one before
        step[(k * 9) % 200] = f"step{k}"
        rows.append((k, " ".join(step)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in M.near_duplicates(docs).collect()}
    wanted = classes(rows)
    assert found == wanted and len(set(wanted.values())) > 5


def test_last_comparison_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "_BLOCK_DOCUMENTS", 4)
    monkeypatch.setattr(M, "_COLUMNS", 50)
    base = odd.words(8, 100)
    rows = [(k, " ".join([*base[: 100 - k], *[f"n{k // 2}x{i}" for i in range(k)]])) for k in range(30)]
    sets = {i: M.shingle_set(text) for i, text in rows}
    frame = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in sets.items()], "id long, shingles array<long>")
    rest = spark.createDataFrame(
        [(key, i, len(s), i, len(s)) for i, s in sets.items() for key in (1, 2)],
        "key long, id long, n long, component long, shared long",
    )
    found = {(r.one, r.other) for r in M._within_groups(rest, frame, 85).collect()}
    wanted = {
        (a, b)
        for a, b in combinations(sets, 2)
        if 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))
    }
    assert found == wanted and wanted


def test_signature_estimates_similarity():
    circulant = M.Circulant(M.Banding())
    one = M.shingle_set(" ".join(odd.words(1, 3000)))
    mixed = np.sort(np.concatenate((one[:2000], M.shingle_set(" ".join(odd.words(2, 3000)))[:1000])))
    exact = len(np.intersect1d(one, mixed)) / len(np.union1d(one, mixed))
    assert abs((circulant.signature(one) == circulant.signature(mixed)).mean() - exact) < 0.08
    assert (circulant.signature(one) == circulant.signature(one.copy())).all()


def test_odd_documents(spark):
    found = M.near_duplicates(odd.frame(spark)).collect()
    assert len(found) == len(odd.rows())
    by_id = {r.doc_id: r.component_id for r in found}
    assert by_id[2] == by_id[3] == 1 and by_id[10] == 9
    assert all(by_id[i] == i for i in (4, 5, 6, 7, 8, 12))
    assert {r.n_shingles for r in found if r.doc_id in (4, 5, 6)} == {0}
    assert all(r.component_id is None and r.kept for r in found if r.doc_id is None)
    left = M.keep_one(odd.frame(spark))
    assert left.columns == odd.frame(spark).columns and odd.untouched(left)
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 8, 9, 11, 12, 13] and ids.count(None) == 2


def test_nothing(spark):
    empty = odd.frame(spark, [])
    assert M.near_duplicates(empty).count() == 0 and M.keep_one(empty).count() == 0
    assert E.fingerprints(empty).count() == 0


def plain_walk(text):
    steps, bits = E._samples()[0].tolist(), E._bits()
    classes = [((ord(c) * 2_654_435_761 % 2**32) >> 11) % 255 for c in text]
    at, step, found = 0, 0, []
    wanted = set(steps)
    while at < len(classes):
        if step in wanted:
            found.append(classes[at])
        at += int(bits[step % E._PERIOD][classes[at]])
        step += 1
    return "".join("0123456789abcdef"[(c * 0x9D & 255) >> 4] for c in found)


@pytest.mark.parametrize("few", [0, 24, 1000])
def test_walk_equals_plain_walk(few, monkeypatch):
    monkeypatch.setattr(E, "_FEW", few)
    texts = ["", "a", "ab" * 700, " ".join(odd.words(3, 900)), "é👍" * 50, "x" * 5000, *[" ".join(odd.words(k, 3 * k)) for k in range(40)]]
    assert E.as_text(E._nibbles(E.walk(texts))) == [plain_walk(text) for text in texts]


def test_op3_against_plain_python(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    found = {r.doc_id: r for r in QUERIES["op3_edit_fingerprints"](spark, SF).collect()}
    assert len(found) == len(docs)
    for k, (i, text) in enumerate(docs):
        coming = docs[(k + 1) % len(docs)][1]
        changed = text[: len(text) - len(text) // 4] + coming[: len(text) // 4]
        row = found[i]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert row.fingerprint == plain_walk(text) and row.edited_fingerprint == plain_walk(changed)
    same = {}
    for i, text in docs:
        assert same.setdefault(text, found[i].fingerprint) == found[i].fingerprint
    long = [found[i] for i, text in docs if len(text) > 200]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.98 * len(long)


def test_op3_odd_documents(spark, monkeypatch):
    found = E.fingerprints(odd.frame(spark)).collect()
    assert len(found) == len(odd.rows())
    by_id = {r.doc_id: r for r in found}
    assert by_id[4].fingerprint == by_id[5].fingerprint == "" and by_id[4].near_edited == 1.0
    assert by_id[1].fingerprint == by_id[2].fingerprint != by_id[3].fingerprint
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in found)
    single = E.fingerprints(odd.frame(spark, odd.rows()[:1])).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


def test_near_texts_finds_edited_texts(spark):
    base = [(k, " ".join(odd.words(100 + k, 400))) for k in range(40)]
    edited = [(100 + k, text[:900] + "edit " + text[905:]) for k, text in base]
    rows = [(i, text, E.as_text(E._nibbles(E.walk([text])))[0]) for i, text in base + edited]
    docs = spark.createDataFrame(rows, "id long, text string, fingerprint string")
    queries = docs.filter("id % 20 = 0")
    found = {(r.query_id, r.doc_id) for r in E.near_texts(queries, docs).collect()}
    wanted = {(q, q + 100 if q < 100 else q - 100) for q in [0, 20, 100, 120]}
    assert found <= wanted and len(found) >= 0.75 * len(wanted)


def searched(spark, pairs, **bands):
    """Share of pairs of texts that a search finds, and how many of them end in different octaves."""
    rows = [(2 * k + side, text) for k, pair in enumerate(pairs) for side, text in enumerate(pair)]
    prints = E.as_text(E._nibbles(E.walk([text for _, text in rows])))
    docs = spark.createDataFrame([(*row, found) for row, found in zip(rows, prints)], "id long, text string, fingerprint string")
    found = {(r.query_id, r.doc_id) for r in E.near_texts(docs.filter("id % 2 = 0"), docs, **bands).collect()}
    across = sum(-(-len(prints[k]) // 32) != -(-len(prints[k + 1]) // 32) for k in range(0, len(prints), 2))
    return sum((2 * k, 2 * k + 1) in found for k in range(len(pairs))) / len(pairs), across


def test_near_texts_across_octaves(spark):
    texts = [" ".join(odd.words(300 + k, 20 + 11 * k)) for k in range(60)]
    share, across = searched(spark, [(text, text + " " + text[: len(text) // 5]) for text in texts])
    assert across >= 5 and share == 1


def test_near_texts_with_edits_all_over(spark):
    """What shares a bucket is judged by the edit distance alone, however unlike the fingerprints are."""
    texts = [" ".join(odd.words(500 + k, 200)) for k in range(30)]
    pairs = [(text, "".join("#" if i % 6 == 3 else c for i, c in enumerate(text))) for text in texts]
    assert searched(spark, pairs, bands=64, rows=2)[0] >= 0.9
