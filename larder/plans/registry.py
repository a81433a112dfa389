"""Collects the registered queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from larder.operators.search import Tables
from larder.sources import testdata as D

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Zone-free timestamps, so that the result does not depend on the caller's session zone."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def register(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def add(job: Job) -> Job:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain(job(spark, sf_dir))

        run.__name__, run.__doc__ = getattr(job, "__name__", name), job.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return job

    return add


def domain(spark: SparkSession, sf_dir: str, text: bool = False) -> Tables:
    return Tables(
        D.places(spark, sf_dir),
        D.menu_items(spark, sf_dir),
        D.user_reviews(spark, sf_dir),
        D.ext_reviews(spark, sf_dir, text=text),
    )
