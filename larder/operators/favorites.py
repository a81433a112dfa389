"""Favorite places of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.ids import stable_id
from larder.operators.ordering import flag

_PAIR = ["user_id", "restaurant_id"]


def favorites_of(favorites: DataFrame, user_id: str) -> DataFrame:
    return favorites.filter(F.col("user_id") == user_id)


def favorite_places(favorites: DataFrame, places: DataFrame) -> DataFrame:
    """Favorites with the place (profile or list row) they point at."""
    keyed = places.withColumnRenamed("id", "restaurant_id").drop("created_at", "updated_at")
    return favorites.select(*_PAIR).join(keyed, "restaurant_id")


def favorite_flags(places: DataFrame, favorites: DataFrame, user_id: str) -> DataFrame:
    """Every place with ``is_favorite`` for one user."""
    mine = favorites_of(favorites, user_id).select(F.col("restaurant_id").alias("id")).distinct()
    return flag(places, mine, ["id"], "is_favorite")


def toggled(favorites: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Favorites after accepted requests: each one removes a pair that is there and adds one that is not.

    Only whether the number of toggles of a pair is odd matters, so one aggregation settles the batch.
    """
    current = favorites.select(*_PAIR, "id", "created_at", F.lit(0).cast("long").alias("_toggles"))
    asked = requests.select(
        *_PAIR,
        F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(1).cast("long").alias("_toggles"),
    )
    pairs = current.unionByName(asked).groupBy(*_PAIR)
    settled = pairs.agg(
        F.sum("_toggles").alias("_toggles"), F.max("id").alias("id"), F.max("created_at").alias("created_at")
    )
    present = (F.col("id").isNotNull().cast("long") + F.col("_toggles")) % 2 == 1
    untouched = F.col("_toggles") == 0
    return settled.filter(present).select(
        F.when(untouched, F.col("id"))
        .otherwise(stable_id(F.col("user_id"), F.col("restaurant_id"), as_of))
        .alias("id"),
        *_PAIR,
        F.when(untouched, F.col("created_at")).otherwise(as_of).alias("created_at"),
    )
