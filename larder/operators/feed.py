"""What changed in a table of reviews, and statistics that follow it without reading the reviews again.

A feed has one row per changed review: its id and two images, ``before`` (null for a new review) and ``after`` (null for a deleted one). An
image holds what statistics depend on. The change jobs take it from the rows that they have judged anyway. Statistics are
sums and counts, so the images enter as signed rows: minus one before, plus one after. Only places that a feed names get another row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from larder.operators.stats import with_average

IMAGE = "struct<restaurant_id:string,rating:int>"
_SUMS = ["rating_sum", "rated_count", "review_count"]


def image(place: Column | str, rating: Column | str) -> Column:
    place, rating = (F.col(x) if isinstance(x, str) else x for x in (place, rating))
    return F.struct(place.cast("string").alias("restaurant_id"), rating.cast("int").alias("rating"))


def no_image() -> Column:
    return F.lit(None).cast(IMAGE)


def feed_rows(df: DataFrame, review_id: Column | str, before: Column, after: Column) -> DataFrame:
    """(id, before, after) of the rows whose images differ."""
    review_id = F.col(review_id) if isinstance(review_id, str) else review_id
    rows = df.select(review_id.alias("id"), before.cast(IMAGE).alias("before"), after.cast(IMAGE).alias("after"))
    return rows.filter(~F.col("before").eqNullSafe(F.col("after")))


def signed_sums(feeds: list[DataFrame]) -> DataFrame:
    """What the feeds add to the sums of every place they name."""
    images = F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("image")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("image")))
    rows = reduce(DataFrame.unionByName, feeds).select(F.inline(images)).filter("image IS NOT NULL")
    sign, rating = F.col("sign").cast("long"), F.col("image.rating")
    zero = F.lit(0).cast("long")
    return rows.groupBy(F.col("image.restaurant_id").alias("restaurant_id")).agg(
        F.sum(F.coalesce(sign * rating, zero)).alias("rating_sum"),
        F.sum(F.when(rating.isNotNull(), sign).otherwise(zero)).alias("rated_count"),
        F.sum(sign).alias("review_count"),
    )


def follow(stats: DataFrame, feeds: list[DataFrame], gone: DataFrame | None = None) -> DataFrame:
    """Statistics after the ``feeds``, and without the places ``gone`` (id); ``stats`` has one row per place with reviews.

    The changes are aggregated first, so a place costs one row of the join however many of its reviews changed.
    """
    old = stats.select("restaurant_id", *[F.col(name).alias(f"_{name}") for name in _SUMS])
    if gone is not None:
        old = old.join(gone.select(F.col("id").alias("restaurant_id")), "restaurant_id", "left_anti")
    if feeds:
        zero = F.lit(0).cast("long")
        both = old.join(signed_sums(feeds), "restaurant_id", "full")
        old = both.select("restaurant_id", *[(F.coalesce(f"_{name}", zero) + F.coalesce(name, zero)).alias(name) for name in _SUMS])
    else:
        old = old.withColumnsRenamed({f"_{name}": name for name in _SUMS})
    return with_average(old.filter("review_count > 0"))
