"""Internal and external reviews as one list per place, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.dates import parse_iso
from larder.operators.ordering import HOT_ROWS, with_position

EXTERNAL, USER = "google", "user"

_SHAPE = [
    "restaurant_id",
    "id",
    "user_id",
    "rating",
    "comment",
    "created_at",
    "updated_at",
    "author_name",
    "profile_photo",
    "likes",
    "source",
    "sort_ts",
]


def from_external(ext_reviews: DataFrame) -> DataFrame:
    """A missing rating is shown as 0. A date that cannot be read sorts last, though ``created_at`` is shown."""
    parsed = ext_reviews.withColumn("sort_ts", parse_iso(F.col("review_date")))
    shown = F.coalesce("sort_ts", "created_at")
    return parsed.select(
        "restaurant_id",
        "id",
        F.lit(None).cast("string").alias("user_id"),
        F.coalesce("rating", F.lit(0)).alias("rating"),
        F.col("review_text").alias("comment"),
        shown.alias("created_at"),
        shown.alias("updated_at"),
        "author_name",
        "profile_photo",
        "likes",
        F.lit(EXTERNAL).alias("source"),
        "sort_ts",
    )


def from_users(user_reviews: DataFrame) -> DataFrame:
    missing = F.lit(None)
    return user_reviews.select(
        "restaurant_id",
        "id",
        "user_id",
        "rating",
        "comment",
        "created_at",
        "updated_at",
        missing.cast("string").alias("author_name"),
        missing.cast("string").alias("profile_photo"),
        missing.cast("int").alias("likes"),
        F.lit(USER).alias("source"),
        F.col("created_at").alias("sort_ts"),
    )


def unified_reviews(ext_reviews: DataFrame, user_reviews: DataFrame) -> DataFrame:
    return from_external(ext_reviews).unionByName(from_users(user_reviews)).select(*_SHAPE)


def sort_key() -> list[Column]:
    """Ascending key: readable dates newest first, then external before user reviews, then the id."""
    latest_first = F.coalesce(-F.unix_micros("sort_ts"), F.lit(2**63 - 1))
    return [latest_first, F.when(F.col("source") == EXTERNAL, 0).otherwise(1), F.col("id")]


def ranked_reviews(reviews: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``position``, 1 for the first review shown at a place."""
    return with_position(reviews, ["restaurant_id"], sort_key(), "position", hot_rows)
