"""Opening hours and contact details of all places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.details import dial_number, hours_on, is_open, review_target, week_hours
from larder.functions.text import nonblank


def weekly_hours(places: DataFrame) -> DataFrame:
    """At most seven rows per place, in week order."""
    rows = places.select("id", F.explode(week_hours(F.col("operating_hours"))).alias("row"))
    return rows.select("id", "row.day_index", "row.day", "row.hours")


def hours_status(places: DataFrame, date: Column) -> DataFrame:
    return places.select(
        "id",
        is_open(F.col("opening_hours")).alias("is_open"),
        hours_on(F.col("operating_hours"), date).alias("hours_on_date"),
    )


def clean_contacts(places: DataFrame) -> DataFrame:
    return places.select(
        "id", dial_number(F.col("phone")).alias("phone"), nonblank(F.col("website")).alias("website")
    )


def sync_targets(places: DataFrame) -> DataFrame:
    """What to ask the review provider for; ``eligible`` is false without any id or link."""
    target = review_target(F.col("serpapi_data_id"), F.col("google_place_id"), F.col("reviews_link"))
    present = F.lit(False)
    for column in ("serpapi_data_id", "google_place_id", "reviews_link"):
        present = present | F.coalesce(F.col(column) != "", F.lit(False))
    return places.select(
        F.col("id").alias("restaurant_id"),
        present.alias("eligible"),
        *[column.alias(name) for name, column in target.items()],
        F.coalesce(target["data_id"], target["place_id"]).alias("target_id"),
    )
