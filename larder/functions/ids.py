"""Row ids that come out the same when a lost task is run again."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_id(*parts: Column) -> Column:
    """UUID-shaped id from the parts that identify the new row."""
    joined = F.concat_ws("\x1f", *[F.coalesce(part.cast("string"), F.lit("\x00")) for part in parts])
    return F.regexp_replace(
        F.md5(joined), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def short_digest(text: Column) -> Column:
    """128 bits of SHA-256 in 16 bytes: tells texts apart where a text itself would be shuffled many times."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def place_key(kind: str, name: Column) -> Column:
    """What stands for a name of a kind at the place ``restaurant_id``; NULL where either is NULL."""
    return short_digest(F.concat("restaurant_id", F.lit(f"\x1f{kind}"), name))


def pack_hex(text: Column) -> Column:
    """A text in few bytes: 64 lower-case hex digits, which a fingerprint is, take 33."""
    digits = F.concat(F.lit(b"x"), F.unhex(text))
    return F.when(text.rlike(r"^[0-9a-f]{64}\z"), digits).otherwise(F.concat(F.lit(b"t"), text.cast("binary")))


def unpack_hex(packed: Column) -> Column:
    """The text that ``pack_hex`` was given."""
    rest = F.substring(packed, 2, 2**31 - 1)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"x"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
