"""Opening hours, phone numbers and link parameters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from larder.functions.text import nonblank

# Day keys in week order.
WEEK = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

# Parameters that a review link may carry.
LINK_KEYS = ["data_id", "place_id", "hl", "sort_by", "topic_id", "query"]

COUNTRY_PREFIX = "90"


def is_open(opening_hours: Column) -> Column:
    """True for text that starts with ``open``, False for ``closed``, else NULL."""
    lowered = F.lower(nonblank(opening_hours))
    return F.when(F.startswith(lowered, F.lit("open")), True).when(
        F.startswith(lowered, F.lit("closed")), False
    )


def week_hours(operating_hours: Column) -> Column:
    """Array of (day_index, day, hours) in week order; days without text are left out."""
    rows = F.array(
        *[
            F.struct(
                F.lit(index).alias("day_index"),
                F.lit(day).alias("day"),
                nonblank(F.try_element_at(operating_hours, F.lit(day))).alias("hours"),
            )
            for index, day in enumerate(WEEK, start=1)
        ]
    )
    return F.filter(rows, lambda row: row["hours"].isNotNull())


def hours_on(operating_hours: Column, date: Column) -> Column:
    """Hours text of the weekday of a date."""
    return nonblank(F.try_element_at(operating_hours, F.lower(F.date_format(date, "EEEE"))))


def dial_number(phone: Column) -> Column:
    """``+`` and digits; local spellings get the country prefix. NULL without digits."""
    digits = F.regexp_replace(phone, "[^0-9]", "")
    local = (
        F.when(F.startswith(digits, F.lit(COUNTRY_PREFIX)), digits)
        .when(
            F.startswith(digits, F.lit("0")),
            F.concat(F.lit(COUNTRY_PREFIX), F.substr(digits, F.lit(2))),
        )
        .when(F.char_length(digits) == 10, F.concat(F.lit(COUNTRY_PREFIX), digits))
        .otherwise(digits)
    )
    return F.when(digits != "", F.concat(F.lit("+"), local))


def link_parameter(link: Column, key: str) -> Column:
    """First value of a query parameter, decoded and stripped; NULL where blank.

    Parameters with an empty value do not count, so a later one of the same name is read.
    """
    query = F.regexp_extract(link, r"^[^?#]*\?([^#]*)", 1)
    raw = F.regexp_extract(query, rf"(?:^|&){key}=([^&]+)", 1)
    return nonblank(F.try_url_decode(F.nullif(raw, F.lit(""))))


def nonempty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def review_target(places_data_id: Column, places_place_id: Column, link: Column) -> dict[str, Column]:
    """Where reviews of a place are asked for: stored ids win over ids in the link, data id over place id."""
    data_id = F.coalesce(nonempty(places_data_id), link_parameter(link, "data_id"))
    place_id = F.when(
        data_id.isNull(), F.coalesce(nonempty(places_place_id), link_parameter(link, "place_id"))
    )
    extra = {key: link_parameter(link, key) for key in ("hl", "sort_by", "topic_id", "query")}
    return {"data_id": data_id, "place_id": place_id, **extra}
