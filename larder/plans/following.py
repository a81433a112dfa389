"""Registered queries: statistics that follow change sets without reading the reviews again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.operators import stats as S
from larder.operators.feed import follow
from larder.plans import changing as C, loading as L
from larder.plans.oracle import SHOWN, over_domain
from larder.plans.registry import domain, register
from larder.sources import testdata as D
from larder.session import cut_lineage

_NEW_STATE = "SELECT restaurant_id, rating FROM user_reviews"
_AFTER = {
    "created": over_domain(
        *C._NEW_REVIEWS, select=f"{_NEW_STATE} UNION ALL SELECT place, CAST(rating AS INTEGER) FROM final WHERE reason IS NULL"
    ),
    "updated": over_domain(
        *C._REVIEW_EDITS,
        """
last AS (
  SELECT found AS id, max_by(rating, seq) FILTER (sets_rating) AS rating, bool_or(sets_rating) AS has_rating
  FROM final WHERE reason IS NULL GROUP BY found)""",
        select="""
SELECT r.restaurant_id, CASE WHEN has_rating THEN CAST(l.rating AS INTEGER) ELSE r.rating END AS rating
FROM user_reviews r LEFT JOIN last l ON l.id = r.id""",
    ),
    "deleted": over_domain(
        *C._REVIEW_DELETES, select=f"{_NEW_STATE} WHERE id NOT IN (SELECT id FROM final WHERE reason IS NULL)"
    ),
    "places deleted": over_domain(*C._CASCADE, select=f"{_NEW_STATE} WHERE restaurant_id NOT IN (SELECT id FROM gone)"),
    "merged": over_domain(
        *L._UPSERT,
        select="""
SELECT restaurant_id, rating FROM judged WHERE turn = 0
UNION ALL SELECT restaurant_id, rating FROM judged WHERE turn = 0 AND event_id % 2 = 0 AND reworded AND provider_review_id IS NULL""",
    ),
}


@register(
    "review_stats_after_changes",
    " UNION ALL ".join(
        f"""
SELECT '{change}' AS change, restaurant_id, CAST(coalesce(s, 0) AS BIGINT) AS rating_sum, n AS rated_count, c AS review_count,
  {SHOWN.format("s", "n")} AS average_rating
FROM (SELECT restaurant_id, sum(rating) AS s, count(rating) AS n, count(*) AS c FROM ({sql}) GROUP BY 1)"""
        for change, sql in _AFTER.items()
    ),
)
def review_stats_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored statistics after each of five change sets, from the change feeds."""
    t = domain(spark, sf_dir)
    none = t.ext_reviews.limit(0)
    users = cut_lineage(S.review_stats(none, t.user_reviews))
    merged = cut_lineage(S.review_stats(L._stored_reviews(spark, sf_dir), t.user_reviews.limit(0)))
    deleted = C.C.delete_reviews(C._deletes(spark, sf_dir), D.users(spark, sf_dir), t.user_reviews)
    after = {
        "created": follow(users, [C._new_reviews(spark, sf_dir).feed]),
        "updated": follow(users, [C._review_edits(spark, sf_dir).feed]),
        "deleted": follow(users, [deleted.feed]),
        "places deleted": follow(users, [], C._cascade(spark, sf_dir).gone),
        "merged": follow(merged, [L._upserted(spark, sf_dir).feed]),
    }
    rows = [df.drop("average_exact").withColumn("change", F.lit(change)) for change, df in after.items()]
    return reduce(DataFrame.unionByName, rows)
