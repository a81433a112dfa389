"""Mixing, language-model scores and the pipeline against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import context_mixing as C, mixing as X
from larder.llm.catalog import QUERIES
from larder.staging import stage
from llm import odd
from llm.test_dedup import shingles

SF = "/root/testdata/sf0.001"


def size(text):
    return len([w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    ordered = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(ordered)}
    found, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in ordered if s not in found]
        left = total - sum(found.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return found | share
        found |= {s: most * sizes[s] for s in over}


def check_mix(rows, docs):
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += size(text)
    aims = plain_targets(sizes)
    assert len(rows) == len(docs)
    taken = Counter()
    source_of = defaultdict(set)
    for i, text, source in docs:
        source_of[i, size(text)].add(source)
    for r in rows:
        (source,) = source_of[r.doc_id, r.size] if len(source_of[r.doc_id, r.size]) == 1 else (None,)
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        if len(source_of[r.doc_id, r.size]) == 1:
            assert r.source_size == sizes[source] and r.target == pytest.approx(aims[source])
            taken[source] += r.taken
    return taken, aims


def test_op8_on_documents(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op8_source_mix"](spark, SF).collect()
    taken, aims = check_mix(rows, docs)
    for source, aim in aims.items():
        smallest = min(size(text) for _, text, own in docs if own == source and size(text))
        assert abs(taken[source] - aim) <= 0.01 * aim + smallest
    again = QUERIES["op8_source_mix"](spark, SF).collect()
    assert sorted(rows) == sorted(again)


def test_op8_odd_documents(spark):
    docs = [(row[0], row[1], row[3]) for row in odd.rows()]
    check_mix(X.mix(odd.frame(spark)).collect(), docs)
    assert X.mix(odd.frame(spark, [])).count() == 0
    only = X.mix(odd.frame(spark, odd.rows()[:1])).collect()
    assert [r.taken for r in only] == [120]
    without = X.mix(odd.frame(spark, odd.rows()[3:6])).collect()
    assert [r.taken for r in without] == [0, 0, 0]
    repeated = X.mixed_documents(odd.frame(spark))
    assert repeated.columns == odd.frame(spark).columns and repeated.count() > 0
    assert odd.untouched(repeated)
    assert X.mixed_documents(odd.frame(spark, [])).count() == 0


def test_op8_precision_with_one_long_text_among_short_ones(spark):
    rows = [(k, "a", "word " * (1 + k % 2)) for k in range(3000)] + [(5000, "a", "word " * 900_000), (5001, "b", "word " * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = docs.select("source", X.word_count(F.col("text")).alias("size"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = {r.source: r for r in X.balance(sized, X.targets(sources)).collect()}
    for source, row in state.items():
        taken = 0.0
        for _, name, text in rows:
            size = len(text) // 5
            if name == source:
                taken += size * 3 / (1 + 2 * math.exp(max(-700, min(700, -row.variable * size / row.mean))))
        assert abs(taken - row.target) <= 1.1e-7 * row.target


def test_op8_copies_are_taken_per_source(spark):
    rows = [(1, "same words here", "a")] * 2 + [(1, "same words here", "b")] + [(k, f"other words {k}", "b") for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted, taken = Counter(), Counter()
    for r in X._mixed(docs, (1, 2, 3), 3).collect():
        key = (r.doc_id, r._source)
        wanted[key] = max(wanted[key], r.copies)
    for r in X.mixed_documents(docs).collect():
        taken[r.doc_id, r.source] += 1
    times = Counter((i, source) for i, _, source in rows)
    assert taken == Counter({key: n * times[key] for key, n in wanted.items() if n})


def test_targets_share_the_excess(spark):
    sizes = {"a": 100, "b": 1, "c": 50, "é": 2000, "z": 0, None: 10}
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    found = {r.source: r.target for r in X.targets(frame).collect()}
    wanted = plain_targets(sizes)
    assert found == {s: pytest.approx(n) for s, n in wanted.items()}
    assert found["b"] == 3 and found["z"] == 0


def test_rates_solve_the_dual(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(n)) for s in "ab" for n in rng.lognormal(5, 1, 400)]
    sized = spark.createDataFrame(rows, "source string, size long")
    sizes = {s: sum(n for own, n in rows if own == s) for s in "ab"}
    aims = {"a": 0.3 * sizes["a"], "b": 2.9 * sizes["b"]}
    aimed = spark.createDataFrame([(s, sizes[s], aims[s]) for s in "ab"], "source string, source_size long, target double")
    for r in X.balance(sized, aimed).collect():
        own = np.array([n for s, n in rows if s == r.source])
        rates = 3 / (1 + 2 * np.exp(-r.variable * own / r.mean))
        assert (rates * own).sum() == pytest.approx(aims[r.source], rel=1e-5)


def plain_base(docs):
    tokens = {i: [*(text or "").encode().lower().split(), None] for i, text in docs}
    counts = Counter()
    for i, found in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(found)
    n, v = sum(counts.values()), len(counts)
    return {
        i: (len(found), sum(counts[t] > 0 for t in found), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in found))
        for i, found in tokens.items()
    }


def test_op9_on_documents(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wanted = plain_base(docs)
    rows = QUERIES["op9_context_mixing"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, known, total, base = wanted[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.score < 0
    held = [r for r in rows if r.held_out]
    bits = -sum(r.score for r in held) * math.log2(10) / sum(len((dict(docs)[r.doc_id] or "").encode()) for r in held)
    assert bits < 3.5  # eight bits a byte without a model


def test_op9_odd_documents_and_small_tables(spark):
    small = C.Mixing(words=4, table_bits=12, sample=5, block=16)
    rows = C.score_documents(odd.frame(spark), mixing=small).collect()
    assert len(rows) == len(odd.rows())
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].n_tokens == by_id[5].n_tokens == by_id[6].n_tokens == 1 and by_id[4].score == by_id[5].score
    assert by_id[1].score == by_id[2].score and all(math.isfinite(r.score) for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert C.score_documents(odd.frame(spark, []), mixing=small).count() == 0
    unlearned = C.score_documents(odd.frame(spark).filter(C.held_out("doc_id")), mixing=small).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in unlearned)


def test_probabilities_of_all_symbols_sum_to_one():
    """Every next symbol after a text, given its bits, takes a share of what is left: the code is complete."""
    code = C.Code([b"a", b"bc", b"def"], np.arange(1, C._FIRST_WORD + 4))
    assert (0.5 ** code.lengths.astype(float)).sum() == pytest.approx(1)
    found = C.Bits(code, [[b"a", b"xyz", b"bc"], [], [b"zz"]], 10)
    symbols, heads, totals, spelled = code.of([[b"a", b"xyz", b"bc"], [], [b"zz"]])
    assert symbols.tolist() == [257, *b"xyz ", 258, 256, 256, *b"zz ", 256]
    assert heads.tolist() == [0, 1, 1, 1, 1, 5, 6, 7, 8, 8, 8, 11] and totals.tolist() == [7, 1, 4]
    assert spelled == [[b"xyz"], [], [b"zz"]]
    assert len(found.bits) == code.lengths[symbols].sum() == len(found.cells[-1])


def test_counts_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "_MERGED", 3)
    rng = np.random.default_rng(1)
    tables = [rng.integers(0, 9, 50).astype(np.int32) for _ in range(20)]
    rows = [(p, t, zlib.compress((tables[t] * p).tobytes())) for t in range(20) for p in (1, 2)]
    merged = C._merged(spark.createDataFrame(rows, "piece int, task long, counts binary")).collect()
    found = {r.piece: np.frombuffer(zlib.decompress(r.counts), np.int32) for r in merged}
    assert len(merged) == 2 and all((found[p] == sum(tables) * p).all() for p in (1, 2))


def test_counts_pass_32_bits(spark):
    """Sums beyond 2^31 stay sums, through two rounds, and their log odds have the right sign and size."""
    code = C.Code([b"a", b"b"], np.ones(C._FIRST_WORD + 2))
    table = np.zeros(2 * code.nodes, np.int32)
    table[0:4] = [2**31 - 1, 5, 2**31 - 1, 2**31 - 1]
    rows = [(0, t, zlib.compress(table.tobytes())) for t in range(40)]
    merged = C._merged(spark.createDataFrame(rows, "piece int, task long, counts binary")).collect()
    tables = C.Tables({r.piece: bytes(r.counts) for r in merged}, code, C.Mixing(table_bits=8))
    assert len(merged) == 1 and tables.counts[0][:2].tolist() == [[40 * (2**31 - 1), 200], [40 * (2**31 - 1)] * 2]
    assert tables.packed[0][0] >> 1 == round(math.log(200.4 / (40 * (2**31 - 1))) / C._STEP) and tables.packed[0][1] == 1
    full = np.full(1, 2**31 - 1, np.int32)
    assert C.Tables._packed(full, full).tolist() == [1]


def test_full_tables_are_given_away(spark, monkeypatch):
    """A task that gives its tables away many times counts what it would have counted in one piece."""
    code = C.Code([b"a", b"b"], np.ones(C._FIRST_WORD + 2))
    mixing = C.Mixing(table_bits=8)
    docs = spark.createDataFrame([(f"a b q{k} " * 40,) for k in range(200)], "text string").coalesce(1)
    whole = {r.piece: bytes(r.counts) for r in C._merged(C._gather(docs, code, mixing)).collect()}
    monkeypatch.setattr(C, "_FULL", 10_000)
    assert C._gather(docs, code, mixing).count() > len(whole)
    parts = C._merged(C._gather(docs, code, mixing)).collect()
    assert len(parts) == len(whole)
    for r in parts:
        assert (C._unzipped(bytes(r.counts)) == C._unzipped(whole[r.piece])).all()


def test_blocks_see_only_what_comes_before():
    """A document's score up to some place does not depend on what follows it."""
    code = C.Code([b"a", b"b"], np.ones(C._FIRST_WORD + 2))
    mixing = C.Mixing(table_bits=8, block=8)
    tables = C.Tables({}, code, mixing)
    words = [b"a", b"b", b"q"] * 30
    one, two = C.Bits(code, [words], 8, 8), C.Bits(code, [words, [b"zzz"] * 50, words], 8, 8)
    alone = C.mix(one, *tables.read(one), C.first_weights(), mixing)
    together = C.mix(two, *tables.read(two), C.first_weights(), mixing)
    assert alone[0] == pytest.approx(together[0], rel=1e-6) and together[0] == pytest.approx(together[2], rel=1e-6)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, step in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r for r in kept.collect()}
        kept = stage(step(spark, kept, SF))
        assert kept.columns == columns, name
        after = kept.collect()
        assert 0 < len(after) and all(before[r.doc_id] == r for r in after)
        if name == "near_dedup":
            sets = {i: shingles(r.text) for i, r in before.items()}
            left = {r.doc_id for r in after}
            assert len(left) == len(after)
            for i in sets.keys() - left:  # what is gone has a near copy
                assert any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets if j != i)
            for i in left:
                assert not any(j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in left)
        elif name != "mix_sources":
            assert len({r.doc_id for r in after}) == len(after) >= 0.7 * len(before)
    packed = corpus_pipeline.STAGES[4][1](spark, kept, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in kept.collect())


def test_pipeline_takes_odd_documents(spark):
    docs = odd.frame(spark).drop("id", "n", "key", "_row")
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF))
    assert docs.count() > 0
    nothing = odd.frame(spark, []).drop("id", "n", "key", "_row")
    for _, step in corpus_pipeline.STAGES:
        nothing = stage(step(spark, nothing, SF))
    assert nothing.count() == 0


def test_op9_starting_weights_come_from_all_training_documents(spark, monkeypatch):
    fitted, fit = [], C._fit

    def counted(training, shared, mixing):
        fitted.append(training.count())
        return fit(training, shared, mixing)

    monkeypatch.setattr(C, "_fit", counted)
    docs = spark.createDataFrame([(k, f"one two {k}") for k in range(1_500)], "doc_id long, text string")
    C.score_documents(docs, mixing=C.Mixing(words=4, table_bits=12, block=16))
    assert fitted == [docs.filter(~C.held_out("doc_id")).count()] and fitted[0] > 1_000


def test_documents_leave_the_counts_without_sorting_cells(monkeypatch):
    code, mixing = C.Code([b"a", b"b"], np.ones(C._FIRST_WORD + 2)), C.Mixing(table_bits=6, block=8)
    found = C.Bits(code, [[b"a", b"b", b"q"] * 30, [], [b"zz", b"a"] * 9, [b"a"]], 6, 8)
    tables, rng = C.Tables({}, code, mixing), np.random.default_rng(5)
    for counts in tables.counts:
        counts[:] = rng.integers(0, 40, counts.shape)
    packed, document = [], found.documents()
    for counts, cells in zip(tables.counts, found.cells):
        own = Counter(zip(document.tolist(), cells.tolist(), found.bits.tolist()))
        left = [
            [max(int(counts[c, bit]) - own[d, c, bit], 0) for bit in (0, 1)] for d, c in zip(document.tolist(), cells.tolist())
        ]
        packed.append(tables._packed(*np.array(left, np.float32).T))
    monkeypatch.delattr(np, "unique")
    for one, other in zip(tables.read_without(found), tables._inputs(packed, found)):
        assert (one == other).all()


def test_counting_costs_what_the_texts_have_and_not_the_tables(spark, monkeypatch):
    """Every different symbol under a context is spread over its bits once per task; no table is added up as a whole."""
    code, mixing = C.Code([b"a", b"b"], np.ones(C._FIRST_WORD + 2)), C.Mixing(table_bits=12)
    texts = ["a b q" * 50, None, " A\x0bb\x1c é", "", "zz " * 9]
    found = C.Bits(code, [(text or "").encode().lower().split() for text in texts], 12)
    wanted = [np.zeros((size, 2), np.int64) for size in C._sizes(code, 12)]
    for table, cells in zip(wanted, found.cells):
        np.add.at(table, (cells, found.bits), 1)
    dense, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *args, minlength=0: dense.append(minlength) or bincount(x, *args, minlength=minlength))
    batches = []

    class Docs:
        sparkSession = spark

        def select(self, _):
            return self

        def mapInArrow(self, function, _):
            monkeypatch.setattr(C.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
            batches.extend(function(iter([C.pa.RecordBatch.from_pydict({"text": C.pa.array(texts)})])))

    C._gather(Docs(), code, mixing)
    pieces = {b.column(0)[0].as_py(): b.column(2)[0].as_py() for b in batches}
    for one, other in zip(C.Tables(pieces, code, mixing).counts, wanted):
        assert (one == other).all()
    assert max(dense, default=0) < 2 << 12


def test_counts_are_whole_again_after_a_fit():
    code, mixing = C.Code([b"a", b"b"], np.ones(C._FIRST_WORD + 2)), C.Mixing(table_bits=6, block=8)
    tables = C.Tables({}, code, mixing)
    for counts in tables.counts:
        counts[:] = 3
    tables.read_without(C.Bits(code, [[b"a", b"b", b"q"] * 30, [], [b"a"]], 6, 8))
    assert all((counts == 3).all() for counts in tables.counts)


def test_words_are_those_of_python():
    texts = ["a b q", None, " A\x0bb\x1c É é\x85x\t\n", "", "\r\f", "zz" * 9]
    words = C.Words.of(C.pa.array(texts))
    wanted = [(text or "").encode().lower().split() for text in texts]
    assert words.flat.to_pylist() == [word for own in wanted for word in own]
    assert words.sizes.tolist() == [len(own) for own in wanted]
