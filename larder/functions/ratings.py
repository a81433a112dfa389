"""One rule for averages: the exact quotient, shown with one digit, halves to the even digit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_WHOLE = "decimal(20,0)"


def exact_average(rating_sum: Column, rated_count: Column) -> Column:
    """Unrounded quotient, NULL where nothing is rated."""
    return rating_sum.cast(_WHOLE) / F.nullif(rated_count.cast(_WHOLE), F.lit(0).cast(_WHOLE))


def shown_average(average: Column) -> Column:
    return F.bround(average, 1).cast("double")
