"""Registered queries: mixing of sources and language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm.context_mixing import score_documents
from larder.llm.mixing import mix
from larder.llm.registry import register, table


@register("op8_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, sources weighing 1, 2 and 3 in turn."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


@register("op9_context_mixing")
def context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text under the word model and under the mixed bit predictors."""
    return score_documents(table(spark, sf_dir, "documents"))
