"""Reading and writing the domain tables as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder import model


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan of a domain table with its declared schema (no inference, columns pruned by Catalyst)."""
    return spark.read.schema(model.TABLES[name]).parquet(f"{root}/{name}")


def by_ids(df: DataFrame, ids: list[str] | DataFrame, column: str = "id") -> DataFrame:
    """Rows with the given keys: a pushed-down IN list, or a semi-join for a frame of keys."""
    if isinstance(ids, DataFrame):
        keys = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
        return df.join(keys, column, "left_semi")
    return df.filter(F.col(column).isin(list(ids)))


def append_rows(df: DataFrame, root: str, name: str) -> None:
    model.conform(df, model.TABLES[name]).write.mode("append").parquet(f"{root}/{name}")


def write_version(df: DataFrame, root: str, name: str) -> None:
    """Write a whole new table state to a fresh folder; an existing one is never overwritten."""
    model.conform(df, model.TABLES[name]).write.mode("error").parquet(f"{root}/{name}")


def public_users(users: DataFrame) -> DataFrame:
    return users.select("id", "username", "email", "is_active", "is_admin", "created_at")


def public_menu(menu_items: DataFrame) -> DataFrame:
    return menu_items.select(
        "id",
        "name",
        F.col("price").cast("double").alias("price"),
        "category",
        "description",
        "created_at",
        "updated_at",
    )


def public_favorites(favorites: DataFrame) -> DataFrame:
    return favorites.select("id", "user_id", "restaurant_id", "created_at")
