"""From raw documents to packed training sequences, one written table per stage.

Quality rules and language identification reject documents, near-duplicate detection keeps one document of each group, the mix
repeats or drops documents so that sources meet their targets, and packing gives every piece its place in a sequence.

Defined results, stage by stage, are those of the operators: null and empty texts have no words and go in the first stage; texts of any length are
read whole; rows that share an id and a text are judged alike, of rows that share an id one stays after the third stage; ties go by id; an
empty table passes all stages; columns that the stages don't know are returned as they were by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larder.llm.language import keep_identified
from larder.llm.minhash import Banding, keep_one
from larder.llm.mixing import mixed_documents
from larder.llm.packing import pack
from larder.llm.quality import keep_good
from larder.llm.registry import table
from larder.staging import stage

#: A pair at a similarity of 0.8 shares one of 75 bands of 8 coordinates but for a probability of 1e-6.
NEAR = Banding(percent=80, bands=75, rows=8)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an accepted language go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one(docs, banding=NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays as often as the mix takes it."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 token ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Iterations and tokenizers have no SQL form; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
