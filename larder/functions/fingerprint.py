"""Fingerprint and typed fields of one provider review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions import payload as P
from larder.functions.text import nonblank, strip

_TYPED = [
    "author_name",
    "rating",
    "review_text",
    "review_date",
    "profile_photo",
    "likes",
    "provider_review_id",
    "language",
    "review_hash",
    "raw_json",
]

_MEMBERS = [
    "user",
    "review_id",
    "rating",
    "review_text",
    "text",
    "snippet",
    "extracted_snippet",
    "iso_date",
    "date",
    "likes",
    "language",
]


def join_components(author: Column, rating: Column, text: Column, date: Column) -> Column:
    """SHA-256 over the four parts, each stripped and lower-cased; a missing part counts as empty."""

    def component(part: Column) -> Column:
        return F.coalesce(F.lower(strip(part)), F.lit(""))

    joined = F.concat_ws("|", *[component(part) for part in (author, rating, text, date)])
    return F.sha2(joined, 256)


def typed_fields(items: DataFrame, keep: list[str], default_language: str | None) -> DataFrame:
    """``keep`` and the typed columns of the review JSON in ``item``; the raw record stays as ``raw_json``.

    One parse for the typed values and one for the rating as it is spelled (5 and 5.0 give different
    fingerprints). Each step is a projection of its own: a value is worked out once and the generated code
    stays small.
    """
    item = F.col("item")
    parsed = items.select(
        *keep,
        item.alias("raw_json"),
        P.read_fields(item, _MEMBERS).alias("f"),
        P.read_fields(item, ["rating"], "string")["rating"].alias("rating_spelled"),
    ).select(*keep, "raw_json", "rating_spelled", "f.*")
    user, snippet = F.col("user"), F.col("extracted_snippet")
    members = parsed.withColumns(
        {
            "user_name": P.member(user, "name"),
            "user_photo": P.member(user, "thumbnail"),
            "nested_text": P.member(snippet, "original"),
            "any_date": P.truthy_or(F.col("iso_date"), F.col("date")),
        }
    )
    texts = {
        "author_name": "user_name",
        "profile_photo": "user_photo",
        "text1": "review_text",
        "text2": "text",
        "text3": "snippet",
        "text4": "nested_text",
        "review_date": "iso_date",
        "provider_review_id": "review_id",
        "language": "language",
    }
    plain = members.select(
        *keep,
        "raw_json",
        "rating_spelled",
        *[P.only_text(F.col(source)).alias(name) for name, source in texts.items()],
        P.text_of(F.col("user_name")).alias("any_author"),
        P.text_of(F.col("any_date")).alias("any_date"),
        P.to_rating(F.col("rating")).alias("rating"),
        P.to_int(F.col("likes")).alias("likes"),
    )
    candidates = ["text1", "text2", "text3", "text4"]
    stripped = ["author_name", "profile_photo", "review_date", "language", *candidates]
    cleaned = plain.withColumns({name: nonblank(F.col(name)) for name in stripped})
    review_id = F.col("provider_review_id")
    language = F.coalesce("language", nonblank(F.lit(default_language).cast("string")))
    filled = cleaned.withColumns(
        {
            "review_text": F.coalesce(*candidates),
            "language": language,
            "provider_review_id": F.when(strip(review_id) != "", review_id),
        }
    )
    fingerprint = join_components(
        F.col("any_author"), F.col("rating_spelled"), F.col("review_text"), F.col("any_date")
    )
    return filled.withColumn("review_hash", fingerprint).select(*keep, *_TYPED)
