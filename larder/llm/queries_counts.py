"""Registered queries: token counts, ranked search, filter audit."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larder.llm import check_sql
from larder.llm.filter_audit import filter_audit
from larder.llm.ranked_search import ranked_search
from larder.llm.registry import register, table
from larder.llm.token_counts import count_tokens


@register("op11_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048).drop("text")


@register("op12_ranked_search", check_sql.RANKED_SEARCH)
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op13_filter_audit", check_sql.FILTER_AUDIT)
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters do in each of their 120 orders, per language."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
