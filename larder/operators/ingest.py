"""Provider places to table rows: clean, validate, drop what is known, report every input row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from larder import model
from larder.functions import payload as P
from larder.functions.ids import stable_id
from larder.functions.text import (
    clean_text,
    clip,
    district_in,
    nonblank,
    repair_columns,
    repair_map,
    strip,
    town_key,
)
from larder.operators.ordering import first_wins, flag
from larder.session import cut_lineage

SEQUENCE = ["source_rank", "page_index", "pos"]
IDENTITY = ["name", "latitude", "longitude"]

_MEMBERS = [
    "title",
    "name",
    "address",
    "gps_coordinates",
    "latitude",
    "longitude",
    "rating",
    "reviews",
    "review_count",
    "phone",
    "website",
    "description",
    "hours",
    "operating_hours",
    "type",
    "category",
    "price",
    "place_id",
    "google_maps_place_id",
    "data_id",
    "serpapi_data_id",
    "thumbnail",
    "reviews_link",
    "photos_link",
    "user_review",
]

_TEXTS = [
    "name",
    "phone",
    "website",
    "description",
    "opening_hours",
    "category",
    "price_level",
    "google_place_id",
    "serpapi_data_id",
    "thumbnail",
    "reviews_link",
    "photos_link",
    "user_review",
]

# Longest cleaned text per column where the table itself sets no limit.
_LONG_TEXT = {"opening_hours": 4000, "user_review": 4000}


def place_payload(items: DataFrame) -> DataFrame:
    """Typed provider fields beside the sequence columns; a first choice that is empty falls through.

    The item is parsed once. Each step is a projection of its own, because a choice is read several times.
    """
    kept = [name for name in items.columns if name != "item"]
    fields = items.select(*kept, P.read_fields(F.col("item"), _MEMBERS).alias("f")).select(*kept, "f.*")
    gps = F.col("gps_coordinates")
    chosen = fields.withColumns(
        {
            "name": P.truthy_or(F.col("title"), F.col("name")),
            "latitude": P.truthy_or(P.member(gps, "latitude"), F.col("latitude")),
            "longitude": P.truthy_or(P.member(gps, "longitude"), F.col("longitude")),
            "review_count": P.truthy_or(F.col("reviews"), F.col("review_count")),
            "category": P.truthy_or(F.col("type"), F.col("category")),
            "google_place_id": P.truthy_or(F.col("place_id"), F.col("google_maps_place_id")),
            "serpapi_data_id": P.truthy_or(F.col("data_id"), F.col("serpapi_data_id")),
            "opening_hours": F.col("hours"),
            "price_level": F.col("price"),
        }
    )
    typed = chosen.select(
        *kept,
        P.only_text(F.col("address")).alias("address"),
        *[P.to_double(F.col(name)).alias(name) for name in ("latitude", "longitude", "rating")],
        P.to_int(F.col("review_count")).alias("review_count"),
        repair_map(P.to_text_map(F.col("operating_hours"))).alias("operating_hours"),
        *[P.text_of(F.col(name)).alias(name) for name in _TEXTS],
    )
    return repair_columns(typed, [*_TEXTS, "address"])


def clean_items(items: DataFrame, city: str) -> DataFrame:
    """Cleaned columns and ``reject_reason`` per item, cut from their lineage.

    Several steps read the result, and the filters of these steps must not be pushed through the cleaning,
    where Catalyst would write the whole cleaning out once per filter.
    """
    limits = {**model.MAX_LENGTH["places"], **_LONG_TEXT}
    town = F.coalesce(clean_text(F.lit(city), 100), clip(F.lit(city), 100))
    # Texts are repaired once as provider values and once more as cleaned values: damage may be twofold.
    again = repair_columns(place_payload(items), [*_TEXTS, "address"])
    cleaned = again.withColumns(
        {name: clip(nonblank(F.col(name)), limits[name]) for name in _TEXTS}
        | {"address": strip(F.col("address"))}
    )
    located = cleaned.withColumns(
        {"city": town, "district": district_in(F.col("address"), town_key(F.lit(city)))}
    )
    missing = F.col("name").isNull() | F.col("latitude").isNull() | F.col("longitude").isNull()
    judged = located.drop("address").withColumn("reject_reason", F.when(missing, F.lit("missing_field")))
    return cut_lineage(judged)


@dataclass(frozen=True)
class Imported:
    """``outcomes``: one row per input with ``status``; ``new_places``: the rows to append."""

    outcomes: DataFrame
    new_places: DataFrame


def import_places(cleaned: DataFrame, stored: DataFrame, as_of: Column) -> Imported:
    """First occurrence of a (name, latitude, longitude) that is not stored yet wins.

    Only one row per key, found by a minimum that is combined before the shuffle, meets the stored table. The
    verdict goes back over the unique sequence columns, so copies of one place do not gather in one task.
    """
    valid = cleaned.filter(F.col("reject_reason").isNull())
    known = stored.select(*IDENTITY).distinct()
    fresh = first_wins(valid, IDENTITY, SEQUENCE).join(known, IDENTITY, "left_anti")
    judged = flag(cleaned, fresh.select(*SEQUENCE), SEQUENCE, "_new").withColumn(
        "status",
        F.when(F.col("reject_reason").isNotNull(), "error")
        .when(F.col("_new"), "imported")
        .otherwise("skipped"),
    )
    new_rows = judged.filter("_new").withColumns(
        {
            # a place may be renamed and imported again, so the run and the row are part of the id
            "id": stable_id(*[F.col(name) for name in IDENTITY + SEQUENCE], as_of),
            "created_at": as_of,
            "updated_at": as_of,
        }
    )
    return Imported(
        judged.select(*SEQUENCE, "name", "status", "reject_reason"),
        model.conform(new_rows, model.PLACES),
    )


def import_counts(outcomes: DataFrame) -> DataFrame:
    """One row: imported, skipped, errors."""
    return outcomes.agg(
        F.count_if(F.col("status") == "imported").alias("imported"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
