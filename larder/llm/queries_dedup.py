"""Registered queries: near duplicates and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm.check_sql import NEAR_DUPLICATES
from larder.llm.edit_fingerprints import fingerprints
from larder.llm.minhash import near_duplicates
from larder.llm.registry import register, table


@register("op1_minhash_near_dedup", NEAR_DUPLICATES)
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under Jaccard similarity of five-word shingles of at least 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op3_edit_fingerprints")
def edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))
