"""Packing and token files against the library and plain checks."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm import packing as P, token_files as T
from larder.llm.catalog import QUERIES
from larder.session import batches_of
from larder.staging import new_folder
from llm import odd

SF = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(name) for name in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def histogram(case):
    rng = random.Random(case)
    draw = [
        lambda: int(min(4096, max(1, rng.lognormvariate(6.2, 1.1)))),
        lambda: rng.randrange(1, 4097),
        lambda: rng.randrange(700, 4096),
        lambda: rng.choice([1400, 2000, 900, 50]),
        lambda: 4096,
        lambda: 2049,
        lambda: 1,
    ][case]
    found = defaultdict(int)
    for _ in range(3000):
        found[draw()] += 1
    return dict(found)


@pytest.mark.parametrize("case", range(7))
def test_plans_place_everything_without_gaps(case):
    wanted = histogram(case)
    plan = P.make_plan(wanted, 4096)
    used, ranks = defaultdict(list), defaultdict(set)
    for length, rank, first, offset, n in plan.runs:
        for k in range(n):
            used[first + k].append((offset, length))
            assert rank + k not in ranks[length]
            ranks[length].add(rank + k)
    assert {length: len(found) for length, found in ranks.items()} == wanted
    assert all(max(found) == len(found) - 1 for found in ranks.values())
    for found in used.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096
    assert set(used) == set(range(plan.sequences))
    # best-fit decreasing as the yardstick
    free = []
    for length in sorted((x for x, n in wanted.items() for _ in range(n)), reverse=True):
        fits = [k for k, room in enumerate(free) if room >= length]
        if fits:
            free[min(fits, key=free.__getitem__)] -= length
        else:
            free.append(4096 - length)
    assert plan.sequences <= len(free)


@pytest.mark.parametrize("case", [0, 1, 2])
def test_plans_come_from_groups(case):
    """Best fit is a yardstick alone: the plan is made of configurations, also where best fit needs as few sequences."""
    wanted = histogram(case)
    plain, free = P.Plan(4096), P._Free()
    for length in sorted(wanted, reverse=True):
        P._best_fit(plain, free, length, wanted[length])
    plan = P.make_plan(wanted, 4096)
    assert plan.runs != plain.runs
    assert plan.sequences <= plain.sequences


def test_plan_of_nothing_and_groups_of_equal_cardinality():
    assert P.make_plan({}, 4096).sequences == 0
    groups = P.equal_groups({10: 5, 20: 1, 30: 7}, 4)
    assert [sum(n for _, n in group) for group in groups] == [3, 3, 3, 4]
    assert groups[0] == [[30, 3]] and groups[2][0] == [30, 1]
    assert len(P.equal_groups({5: 2}, 8)) == 2


def check_packing(rows, docs, capacity):
    library = Tokenizer.from_file(WORD)
    wanted = defaultdict(int)
    for i, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            wanted[i, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    found, places = defaultdict(int), defaultdict(list)
    for r in rows:
        found[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert found == wanted
    for of_one in places.values():
        at = 0
        for offset, length in sorted(of_one):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), -(-sum(r.length for r in rows) // capacity)


def test_op5_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, least = check_packing(QUERIES["op5_best_fit_packing"](spark, SF).collect(), docs, 4096)
    assert used <= least * 1.01 + 1


def test_op5_odd_documents(spark):
    docs = [(row[0], row[1]) for row in odd.rows()]
    check_packing(P.pack(odd.frame(spark), WORD, capacity=64).collect(), docs, 64)
    assert P.pack(odd.frame(spark, []), WORD).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 50_257, 2**32])
@pytest.mark.parametrize("percentile", [50, 90])
def test_blocks_round_trip(n, high, percentile):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, high, n) ** rng.choice([1, 0.3], n)).astype(np.uint32)
    blocks = T.encode_blocks(ids, percentile)
    starts = np.cumsum([0, *map(len, blocks)])[:-1].tolist()
    assert (T.decode_blocks(memoryview(b"".join(blocks)), starts) == ids).all()
    assert len(blocks) == -(-n // T.BLOCK)


def test_outliers_go_to_the_exception_list():
    ids = np.full(1024, 1000, np.uint32)
    ids[::2] += 7
    ids[5] = 2**31
    (block,) = T.encode_blocks(ids)
    least, width, n, exceptions = T._HEAD.unpack_from(block)
    assert (least, width, n, exceptions) == (1000, 3, 1024, 1)
    assert len(block) == T._HEAD.size + 1024 * 3 // 8 + 6


def test_writer_and_reader(tmp_path, monkeypatch):
    monkeypatch.setattr(T, "_CHUNK", 2)
    rng = np.random.default_rng(1)
    docs = [(None if k == 3 else k, rng.integers(0, 50_000, rng.integers(0, 4000)).astype("<u4")) for k in range(20)]
    writer = T.ShardWriter(str(tmp_path / "a" / "0.pfor"))
    for i, ids in docs:
        writer.add(i, ids.tobytes())
    documents, tokens, size = writer.close()
    assert (documents, tokens) == (20, sum(len(ids) for _, ids in docs))
    assert size == (tmp_path / "a" / "0.pfor").stat().st_size
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["0.pfor"]
    reader = T.ShardReader(str(tmp_path / "a" / "0.pfor"))
    for (i, ids), (document, first, found) in zip(docs, reader.each(), strict=True):
        assert document == i and (found == ids).all()
        assert (reader.ids(first, first + len(ids)) == ids).all()
    everything = np.concatenate([ids for _, ids in docs])
    assert (reader.ids(1500, 9000) == everything[1500:9000]).all()


def check_files(rows, docs):
    library = Tokenizer.from_file(BYTE)
    found = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rows))
    start, seen = 0, []
    for first, i, n, crc in found:
        assert first == start
        start += n
        seen.append((i, n, crc))
    wanted = []
    for i, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        wanted.append((i, len(ids), zlib.crc32(ids.tobytes())))
    order = lambda row: (row[0] is not None, row[0] or 0, *row[1:])
    assert sorted(seen, key=order) == sorted(wanted, key=order)
    assert [i for i, _, _ in seen if i is not None] == sorted(i for i, _ in docs if i is not None)
    assert None not in [i for i, _, _ in seen[sum(i is None for i, _ in docs) :]]


def test_op10_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_files(QUERIES["op10_token_files"](spark, SF).collect(), docs)


def test_op10_odd_documents(spark):
    rows = T.round_trip(odd.frame(spark), BYTE, 0, new_folder(spark)).withColumnRenamed("id", "doc_id").collect()
    check_files(rows, [(row[0], row[1]) for row in odd.rows()])
    assert T.round_trip(odd.frame(spark, []), BYTE).count() == 0


def test_packing_gets_texts_in_batches_of_bounded_bytes(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name), []
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 1000).alias("text")).coalesce(1)
    own = P._pieces

    def counted(*args):
        seen.append(spark.conf.get(name))
        return own(*args)

    monkeypatch.setattr(P, "_pieces", counted)
    assert P.pack(docs, WORD).count() == 64
    assert seen == [P._BATCH_BYTES] and spark.conf.get(name) == before

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    with batches_of(spark, "30k"):
        assert max(row.n for row in docs.select("text").mapInArrow(rows, "n long").collect()) < 32
