"""Global positions against a sort in memory."""

from pyspark.sql import functions as F

from larder.operators.numbering import numbered


def test_positions(spark):
    rows = [(i * 7919 % 1000, None if i % 50 == 0 else f"x{i % 13}") for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b string").repartition(7)
    order = [F.col("b").desc_nulls_last(), F.col("a").asc()]
    found = [(r.a, r.b) for r in sorted(numbered(df, order).collect(), key=lambda r: r.position)]
    assert sorted(r.position for r in numbered(df, order, "position").collect()) == list(range(1, 1001))
    last = [r for r in rows if r[1] is None]
    rest = [r for r in rows if r[1] is not None]
    wanted = sorted(sorted(rest), key=lambda r: r[1], reverse=True) + sorted(last)
    assert found == wanted


def test_ties_and_nothing(spark):
    df = spark.createDataFrame([(1,)] * 30, "a long").repartition(5)
    assert sorted(r.n for r in numbered(df, [F.col("a")], "n").collect()) == list(range(1, 31))
    assert numbered(df.limit(0), [F.col("a")]).count() == 0
