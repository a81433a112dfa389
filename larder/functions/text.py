"""Text cleaning as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# All Unicode white space, not only the blank that ``trim`` removes.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

# Characters that code page 1252 keeps in 0x80-0x9F, and the code points of those bytes.
_CP1252 = [
    (char, chr(byte))
    for byte in range(0x80, 0xA0)
    for char in bytes([byte]).decode("cp1252", "ignore")
]
_CP1252_CHARS = "".join(char for char, _ in _CP1252)
_CP1252_BYTES = "".join(byte for _, byte in _CP1252)


def strip(text: Column) -> Column:
    """Text without white space at its ends; the pattern runs only where an end has some."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    stripped = F.regexp_replace(text, rf"^{_SPACE}++|{_SPACE}++\z", "")
    return F.when(ends.rlike(_SPACE), stripped).otherwise(text)


def nonblank(text: Column) -> Column:
    """Stripped text, NULL where nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def clip(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def _bytes_as_utf8(latin1: Column) -> Column:
    return F.try_validate_utf8(F.encode(latin1, "ISO-8859-1").cast("string"))


def _read_latin1_as_utf8(text: Column) -> Column:
    one_byte = F.when(~text.rlike(r"[^\x{00}-\x{ff}]"), text)
    return F.coalesce(_bytes_as_utf8(one_byte), text)


def _read_cp1252_as_utf8(text: Column) -> Column:
    # Characters that the code page lacks stay beyond 0xFF after the translation.
    wide = text.rlike(r"[^\x{00}-\x{ff}]")
    as_latin1 = F.when(wide, F.translate(text, _CP1252_CHARS, _CP1252_BYTES)).otherwise(text)
    fits = ~text.rlike(r"[\x{80}-\x{9f}]") & ~as_latin1.rlike(r"[^\x{00}-\x{ff}]")
    return F.coalesce(_bytes_as_utf8(F.when(fits, as_latin1)), text)


def _only_beyond_ascii(text: Column, step: Column) -> Column:
    return F.when(text.rlike(r"[^\x{00}-\x{7f}]"), step).otherwise(text)


def repair_text(text: Column) -> Column:
    """Undo UTF-8 that was read as Latin-1 or as code page 1252.

    Each step applies only where every character fits the code page and the bytes are valid UTF-8;
    plain ASCII is passed through at the price of one scan.
    """
    return _only_beyond_ascii(text, _read_cp1252_as_utf8(_read_latin1_as_utf8(text)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, for use inside lambdas, where Spark works out every mention anew."""
    return F.get(F.transform(F.array(value), lambda once: use(once)), F.lit(0))


def repair_text_once(text: Column) -> Column:
    """``repair_text`` for a text that is costly to work out, inside lambdas."""

    def repaired(given: Column) -> Column:
        return _only_beyond_ascii(given, bound(_read_latin1_as_utf8(given), _read_cp1252_as_utf8))

    return bound(text, repaired)


def repair_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``repair_text`` for many columns, one projection per step, so that no input is worked out twice."""
    for step in (_read_latin1_as_utf8, _read_cp1252_as_utf8):
        df = df.withColumns(
            {name: _only_beyond_ascii(F.col(name), step(F.col(name))) for name in names}
        )
    return df


def repair_map(values: Column) -> Column:
    """Repair every value of a map; keys stay."""
    return F.transform_values(values, lambda _, value: repair_text(value))


def clean_text(text: Column, length: int) -> Column:
    """Repaired and stripped text of at most ``length`` characters, NULL where blank."""
    return clip(nonblank(repair_text(text)), length)


def clean_email(email: Column) -> Column:
    return F.lower(email)


def search_pattern(term: str | None) -> str | None:
    """``ilike`` pattern for a search term, or None where the term is blank.

    ``%`` and ``_`` in the term stay wildcards and a backslash escapes. Before any other character a
    backslash means nothing, and is left out because Spark refuses it there.
    """
    stripped = term.strip() if term else ""
    if not stripped:
        return None
    raw, out, at = f"%{stripped}%", [], 0
    while at < len(raw):
        if raw[at] == "\\":
            follower = raw[at + 1 : at + 2]
            out.append("\\" + follower if follower and follower in "%_\\" else follower)
            at += 2
        else:
            out.append(raw[at])
            at += 1
    return "".join(out)


def town_key(city: Column) -> Column:
    return F.lower(strip(repair_text(city)))


def district_in(address: Column, town: Column) -> Column:
    """District named in an address that is repaired and stripped, ``Unknown`` where none is.

    ``.../District/City`` gives the part before the city. Otherwise the comma part before the first one
    that mentions the city counts. ``town`` comes from ``town_key``.
    """

    def parts(separator: str) -> Column:
        return F.filter(
            F.transform(F.split(address, separator), strip), lambda part: part != F.lit("")
        )

    by_slash, by_comma = parts("/"), parts(",")
    ends_in_town = F.lower(F.try_element_at(by_slash, F.lit(-1))) == town
    before_town = F.when(ends_in_town, F.try_element_at(by_slash, F.lit(-2)))
    first_hit = F.array_position(
        F.transform(by_comma, lambda part: F.contains(F.lower(part), town)), F.lit(True)
    )
    # Position 0 means no hit, position 1 has nothing before it; both become NULL.
    at = F.nullif(F.greatest(first_hit - 1, F.lit(0)), F.lit(0)).cast("int")
    found = F.coalesce(
        F.when(F.contains(address, F.lit("/")), before_town), F.try_element_at(by_comma, at)
    )
    return F.coalesce(clip(found, 100), F.lit("Unknown"))


def district_from_address(address: Column, city: Column) -> Column:
    return district_in(strip(repair_text(address)), town_key(city))
