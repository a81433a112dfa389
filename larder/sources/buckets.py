"""Domain tables laid out by a hash of the place, so that a change rewrites, and a lookup reads, only the buckets it touches.

``<root>/<name>/bucket=<k>/*.parquet``: the bucket of a row is a hash of its place (of its id, where the table has no place). A new state of
some places is written by ``replace_places``: the buckets of these places are written anew in one job that swaps them in when it
commits; files of other buckets stay as they are. Children lie in buckets of the same hash and number as their places, so
a change of a place touches the same bucket in all tables. A large place makes its bucket large, but not the work on it: inside a bucket, rows are spread over
as many files as their number asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from larder import model

BUCKETS = 64
#: Rows of a file, about: a bucket with more is spread over several files.
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class Buckets:
    """One bucketed table; the number of buckets is fixed when the table is made."""

    root: str
    name: str
    number: int = BUCKETS

    @property
    def path(self) -> str:
        return f"{self.root}/{self.name}"

    @property
    def key(self) -> str:
        return "restaurant_id" if "restaurant_id" in model.TABLES[self.name].fieldNames() else "id"


def bucket_of(key: Column | str, number: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(number)).cast("int")


def _write(df: DataFrame, table: Buckets) -> None:
    """Rows of a bucket go to as many tasks as it has files to make."""
    rows = model.conform(df, model.TABLES[table.name]).withColumn("bucket", bucket_of(table.key, table.number))
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("_files"))  # one row per bucket
    spread = rows.join(F.broadcast(sizes), "bucket").withColumn("_file", F.pmod(F.xxhash64("id"), F.col("_files")))
    dealt = spread.repartition("bucket", "_file").drop("_files", "_file")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table.path)


def write_buckets(df: DataFrame, root: str, name: str, number: int = BUCKETS) -> Buckets:
    """Make a bucketed table of a whole state."""
    table = Buckets(root, name, number)
    _write(df, table)
    return table


def read_buckets(spark: SparkSession, table: Buckets, places: DataFrame | None = None) -> DataFrame:
    """The table, or the buckets that hold the given ``places`` (one column of keys): other folders are not listed or read."""
    schema = T.StructType([*model.TABLES[table.name].fields, T.StructField("bucket", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(table.path)
    if places is not None:
        rows = rows.filter(F.col("bucket").isin(touched(places, table.number)))
    return rows.select(*model.TABLES[table.name].fieldNames())


def touched(places: DataFrame, number: int) -> list[int]:
    """Buckets of the keys in the only column of ``places``."""
    found = places.select(bucket_of(F.col(places.columns[0]), number).alias("bucket")).distinct()
    return sorted(row.bucket for row in found.collect())  # as many as there are buckets at most


def replace_places(spark: SparkSession, table: Buckets, state: DataFrame, places: DataFrame) -> list[int]:
    """Put the rows of ``state`` in place of all buckets that hold one of ``places``; returns these buckets.

    ``state`` is a new state of at least these buckets, most simply the outcome of a job over ``read_buckets(spark, table, places)``; rows of other
    buckets are left out. A bucket without rows loses its folder.
    """
    numbers = touched(places, table.number)
    if not numbers:
        return []
    rows = model.conform(state, model.TABLES[table.name]).filter(bucket_of(table.key, table.number).isin(numbers))
    held = {row.bucket for row in rows.select(bucket_of(table.key, table.number).alias("bucket")).distinct().collect()}
    _write(rows, table)
    for number in set(numbers) - held:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table.path}/bucket={number}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return numbers
