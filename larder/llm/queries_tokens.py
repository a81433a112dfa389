"""Registered queries: token files and packing. The vocabulary files stay where the package of public tokenizers has them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larder.llm.packing import pack
from larder.llm.registry import register, table
from larder.llm.token_files import round_trip


@register("op10_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, as read back from the files."""
    docs = table(spark, sf_dir, "documents")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


@register("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 token ids."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
