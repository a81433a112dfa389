"""Registered queries: quality rules, URL filters, licence scans, language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.llm import check_sql, language
from larder.llm.licences import TEMPLATES, bigrams, normalised, scan_licences
from larder.llm.quality import quality_verdicts
from larder.llm.registry import register, table
from larder.llm.url_filters import PATTERNS, domain_rule, judge_urls

URL_RULES = [
    domain_rule("allow", "org"),
    domain_rule("block", "example.org", "/es/"),
    domain_rule("block", "example.org", "/en/1"),
    domain_rule("allow", "com", "/fr/"),
    domain_rule("block", "com", "/de/"),
]


@register("op2_url_filters", check_sql.url_filters([*URL_RULES, *PATTERNS]))
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern")


_TEMPLATES = {name: bigrams(normalised(text)) for name, text in TEMPLATES.items()}


@register("op4_licence_scan", check_sql.licence_scan(_TEMPLATES))
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every whole text."""
    scanned = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", "licence", F.col("dice"), F.array_join("licences", ", ").alias("licences"))


@register("op7_quality_rules", check_sql.quality_rules())
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    judged = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@register("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from its text, declared language and source."""
    found = language.identify(language.of_documents(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "language", "posterior", "declared", "n_trigrams", "kept")


@register("page_languages")
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every web page from its text, markup, address suffix and host."""
    found = language.identify(language.of_pages(table(spark, sf_dir, "pages")))
    return found.select("page_id", "host", "language", "posterior", "declared", "n_trigrams", "kept")
