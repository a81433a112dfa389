"""Review statistics per place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.ratings import exact_average, shown_average


def _triple(prefix: str = "") -> list[Column]:
    return [
        F.sum(F.col("rating").cast("long")).alias(f"{prefix}rating_sum"),
        F.count("rating").alias(f"{prefix}rated_count"),
        F.count(F.lit(1)).alias(f"{prefix}review_count"),
    ]


def source_stats(reviews: DataFrame) -> DataFrame:
    """Sum of ratings, number of rated reviews and number of all reviews of one source."""
    return reviews.groupBy("restaurant_id").agg(*_triple())


def combine_stats(ext_stats: DataFrame, user_stats: DataFrame) -> DataFrame:
    """Full outer join of two statistics that are already one row per place."""
    left = ext_stats.select(
        "restaurant_id", *[F.col(c).alias(f"ext_{c}") for c in ("rating_sum", "rated_count", "review_count")]
    )
    right = user_stats.select(
        "restaurant_id", *[F.col(c).alias(f"user_{c}") for c in ("rating_sum", "rated_count", "review_count")]
    )

    def both(name: str) -> Column:
        zero = F.lit(0).cast("long")
        return F.coalesce(F.col(f"ext_{name}"), zero) + F.coalesce(F.col(f"user_{name}"), zero)

    joined = left.join(right, "restaurant_id", "full")
    return with_average(
        joined.withColumns({name: both(name) for name in ("rating_sum", "rated_count", "review_count")})
    )


def with_average(stats: DataFrame) -> DataFrame:
    """Add ``average_exact`` (for filters and sorts) and ``average_rating`` (as shown)."""
    exact = exact_average(F.col("rating_sum"), F.col("rated_count"))
    return stats.withColumn("average_exact", exact).withColumn(
        "average_rating", shown_average(F.col("average_exact"))
    )


def review_stats(ext_reviews: DataFrame, user_reviews: DataFrame) -> DataFrame:
    """Statistics over both sources in one aggregation.

    The same figures as ``combine_stats``, but the reviews are put under each other first: one shuffle of
    partly aggregated rows, and a place with very many reviews costs no more than any other.
    """
    rows = ext_reviews.select("restaurant_id", "rating").unionByName(
        user_reviews.select("restaurant_id", "rating")
    )
    stats = rows.groupBy("restaurant_id").agg(*_triple())
    return with_average(stats.withColumn("rating_sum", F.coalesce("rating_sum", F.lit(0).cast("long"))))


def fold_reviews(stats: DataFrame, known_ids: DataFrame, new_reviews: DataFrame) -> DataFrame:
    """Statistics after new reviews came in, without reading the old ones again.

    Reviews whose id is known, or came earlier in the batch, do not count. Only ratings from 1 to 5 enter
    the average.
    """
    counted = F.when(F.col("rating").between(1, 5), F.col("rating"))
    unique = new_reviews.groupBy("id").agg(
        F.min(F.struct("seq", "restaurant_id", counted.alias("rating"))).alias("_row")
    )
    fresh = unique.join(known_ids.select("id").distinct(), "id", "left_anti").select("_row.*")
    names = ["rating_sum", "rated_count", "review_count"]
    both = stats.select("restaurant_id", *names).unionByName(
        source_stats(fresh).withColumn("rating_sum", F.coalesce("rating_sum", F.lit(0).cast("long")))
    )
    return with_average(both.groupBy("restaurant_id").agg(*[F.sum(n).alias(n) for n in names]))
