"""ISO 8601 text to timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from larder.functions.text import strip

_COMPLETE = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})?)?\z"
)
_ZONE = r"(Z|[+-]\d{2}:\d{2})\z"

# (pattern, replacement), applied in this order, to bring the accepted spellings to one.
_SPELLINGS = [
    (r"^(\d{4})(\d{2})(\d{2})(?=\z|[T ])", "$1-$2-$3"),
    (r"^(.{10}[T ]\d{2})(\d{2})(\d{2})?(?=\z|[+\-Z.,])", "$1:$2:$3"),
    (r"^(.{10}[T ]\d{2}):?(?=\z|[+\-Z])", "$1:00"),
    (r"^(.{10}[T ]\d{2}:\d{2}):?(?=\z|[+\-Z])", "$1:00"),
    (r"^(.{19}),(?=\d)", "$1."),
    (r"(?<=\d)([+-]\d{2})(\d{2})\z", "$1:$2"),
    (r"(?<=:\d{2}|\.\d{1,9})([+-]\d{2})\z", "$1:00"),
]


def _read(spelled: Column) -> Column:
    """Timestamp of text in the one complete spelling; NULL for any other text."""
    with_zone = (
        F.when(spelled.rlike(_ZONE) & spelled.rlike(r"^.{10}[T ]"), spelled)
        .when(F.char_length(spelled) == 10, F.concat(spelled, F.lit("T00:00:00Z")))
        .otherwise(F.concat(spelled, F.lit("Z")))
    )
    return F.when(spelled.rlike(_COMPLETE), with_zone.try_cast("timestamp"))


def parse_iso(text: Column) -> Column:
    """Timestamp of an ISO date or date-time; without a zone it is UTC. Other text gives NULL.

    A bare year, a bare month, a bare time and relative text such as ``2 weeks ago`` are refused, although
    Spark's own cast would take some of them. ISO week dates are not read. Only text that is not in the usual
    spelling goes through the rewriting.
    """
    spelled = strip(text)
    for pattern, replacement in _SPELLINGS:
        spelled = F.regexp_replace(spelled, pattern, replacement)
    return F.when(text.rlike(_COMPLETE), _read(text)).otherwise(_read(spelled))
