"""Skew-safe numbering against brute force, with groups far above the hot limit."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators.ordering import first_wins, flag, with_last, with_position, with_previous


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = [
        (rnd.choice("aaaaaab"), rnd.choice([None, *range(40)]), f"{i:05d}", rnd.randint(0, 3)) for i in range(600)
    ]
    return data, spark.createDataFrame(data, "g string, t int, id string, v int").repartition(7).cache()


def order():
    return [F.col("t").asc_nulls_last(), F.col("id")]


def key(row):
    return (row[1] is None, row[1] or 0, row[2])


@pytest.mark.parametrize("hot", [3, 150, 10**6])
def test_position_in_groups(rows, hot):
    data, df = rows
    expected = {}
    for group in {r[0] for r in data}:
        for at, row in enumerate(sorted((r for r in data if r[0] == group), key=key), 1):
            expected[row[2]] = at
    got = with_position(df, ["g"], order(), "at", hot)
    assert got.columns == ["g", "t", "id", "v", "at"]
    assert {r.id: r["at"] for r in got.collect()} == expected


@pytest.mark.parametrize("hot", [3, 10**6])
def test_previous(rows, hot):
    data, df = rows
    expected = {}
    for group in {r[0] for r in data}:
        ordered = sorted((r for r in data if r[0] == group), key=key)
        for at, row in enumerate(ordered):
            before = ordered[at - 1][3] if at else None
            expected[row[2]] = (before, at == 0, at == len(ordered) - 1)
    got = with_previous(df, ["g"], order(), "v", hot)
    assert {r.id: (r.previous, r.is_first, r.is_last) for r in got.collect()} == expected


@pytest.mark.parametrize("hot", [3, 10**6])
def test_last(rows, hot):
    data, df = rows
    marked = df.withColumn("w", F.when(F.col("v") == 0, F.col("id")))
    expected = {}
    for group in {r[0] for r in data}:
        last = None
        for row in sorted((r for r in data if r[0] == group), key=key):
            last = row[2] if row[3] == 0 else last
            expected[row[2]] = last
    got = with_last(marked, ["g"], order(), "w", "last", hot)
    assert got.columns == ["g", "t", "id", "v", "w", "last"]
    assert {r.id: r["last"] for r in got.collect()} == expected


def test_first_wins_goes_back_over_the_sequence(rows):
    data, df = rows
    first = first_wins(df, ["g", "v"], ["id"])
    marked = flag(df, first.select("id"), ["id"], "wins").filter("wins").collect()
    expected = {(g, v): min(r[2] for r in data if (r[0], r[3]) == (g, v)) for g, _, _, v in data}
    assert {(r.g, r.v): r.id for r in marked} == expected
