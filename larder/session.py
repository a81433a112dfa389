"""Session settings the jobs rely on, and the one place where lineage is cut."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from larder.staging import stage

# Results depend on UTC; the next three let Spark split hot join keys at run time. The JVM never compiles a method of more than 8,000 bytes;
# stages that would get one, as parsing and cleaning do, are generated projection by projection instead, in small methods.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings to a session that already exists."""
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A small session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("larder")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Jobs that run inside hand rows to Python in Arrow batches of about ``size`` bytes, or of one row where that is larger."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The frame as written to the cluster's shared folder, so lost executors cost no rerun and readers take what they need."""
    return stage(df, codec)
