"""Provider JSON: typed fields are read as VARIANT, so that a text, a number and a list stay apart."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from larder.functions.text import bound, repair_text_once, strip

# Keys are consumed by the first branch (an empty group); the second captures text values at any depth.
_TEXT_VALUES = r'"(?:[^"\\]|\\.)*"\s*:|"((?:[^"\\]|\\.)*)"'
_DECIMAL = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\z"
_INTEGER = r"^[+-]?\d+(_\d+)*\z"
_ZERO = r"^-?0(\.0*)?([eE][+-]?\d+)?\z"


def read_fields(json: Column, names: list[str], kind: str = "variant") -> Column:
    """One parse of an object: a struct with a field per name. Absent fields are NULL."""
    return F.from_json(json, ", ".join(f"`{name}` {kind}" for name in names))


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_text(value: Column) -> Column:
    return F.coalesce(kind_of(value) == "STRING", F.lit(False))


def is_list(value: Column) -> Column:
    return F.coalesce(F.startswith(kind_of(value), F.lit("ARRAY")), F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(kind_of(value), F.lit("OBJECT")), F.lit(False))


def _is_number(value: Column) -> Column:
    return kind_of(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def _as_string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def text_of(value: Column) -> Column:
    """Any value as text: booleans are spelled True / False, lists and objects as JSON."""
    return F.when(kind_of(value) == "BOOLEAN", F.initcap(_as_string(value))).otherwise(
        _as_string(value)
    )


def only_text(value: Column) -> Column:
    """The text where the value is a text, NULL for every other type."""
    return F.when(is_text(value), _as_string(value))


def truthy(value: Column) -> Column:
    """False for null, 0, an empty text, false, an empty list and an empty object."""
    spelled = F.to_json(value)
    empty = spelled.isin("null", '""', "false", "[]", "{}") | spelled.rlike(_ZERO)
    return F.coalesce(~empty, F.lit(False))


def truthy_or(first: Column, second: Column) -> Column:
    return F.when(truthy(first), first).otherwise(second)


def member(value: Column, name: str) -> Column:
    """A member of an object; NULL where the value is no object."""
    return F.try_variant_get(value, f"$['{name}']", "variant")


def to_double(value: Column) -> Column:
    """Number, boolean or number-like text to double, NULL for the rest."""
    text = strip(_as_string(value))
    special = F.lower(F.regexp_replace(text, r"^[+-]", ""))
    sign = F.when(F.startswith(text, F.lit("-")), -1.0).otherwise(1.0)
    from_text = (
        F.when(text.rlike(_DECIMAL), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
        .when(special.isin("inf", "infinity"), sign * F.lit("Infinity").cast("double"))
        .when(special == "nan", F.lit("NaN").cast("double"))
    )
    return (
        F.when(kind_of(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        .when(_is_number(value), F.try_variant_get(value, "$", "double"))
        .when(is_text(value), from_text)
    )


def to_int(value: Column) -> Column:
    """Numbers lose their fraction; a text must be an integer literal (``12.0`` and ``1,234`` are NULL)."""
    text = strip(_as_string(value))
    number = F.try_variant_get(value, "$", "double")
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return (
        F.when(kind_of(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int"))
        .when(_is_number(value), whole.try_cast("int"))
        .when(
            is_text(value) & text.rlike(_INTEGER),
            F.replace(text, F.lit("_"), F.lit("")).try_cast("int"),
        )
    )


def to_rating(value: Column) -> Column:
    """Nearest whole number, halves to the even one; NULL where it is no finite number."""
    number = to_double(value)
    return F.when(~F.isnan(number), F.rint(number)).try_cast("int")


def to_text_map(value: Column) -> Column:
    """Members of an object that are texts; NULL where the value is no object."""
    members = F.try_variant_get(value, "$", "map<string,variant>")
    texts = F.map_filter(members, lambda _, item: is_text(item))
    return F.when(is_object(value), F.transform_values(texts, lambda _, item: _as_string(item)))


def canonical(json: Column) -> Column:
    """JSON text with sorted members and normal numbers: equal objects give equal text."""
    return F.coalesce(F.to_json(F.try_parse_json(json)), json)


def text_values(json: Column) -> Column:
    """All text values at any depth, keys and numbers left out, escapes resolved by a re-parse first."""
    return F.regexp_extract_all(canonical(json), F.lit(_TEXT_VALUES), F.lit(1))


def any_text_contains(json: Column, term: str) -> Column:
    """True where a text value at any depth contains the term, letter case aside."""
    wanted = F.lower(F.lit(term))
    return F.exists(text_values(json), lambda text: F.contains(F.lower(text), wanted))


def top_level_text(json: Column) -> Column:
    """Lower-cased values of the top level, joined by blanks; nested ones as their JSON text."""
    values = F.map_values(F.from_json(json, "map<string,string>"))
    return F.lower(F.array_join(F.transform(values, lambda v: F.coalesce(v, F.lit("none"))), " "))


def mentions_area(json: Column, town_spellings: list[str], area_spellings: list[str]) -> Column:
    """True where the top-level text names the town and one of its areas."""
    text = top_level_text(json)

    def any_of(spellings: list[str]) -> Column:
        hit = F.lit(False)
        for spelling in spellings:
            hit = hit | F.contains(text, F.lit(spelling.lower()))
        return hit

    return F.coalesce(any_of(town_spellings) & any_of(area_spellings), F.lit(False))


# A text with the colon that makes it a key, or all that is no text. Nothing is ever read twice, so long texts are no problem.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?+|[^"]++'


def repaired(json: Column) -> Column:
    """JSON text in which every text value at any depth is repaired; keys, numbers, order and spelling of all else stay.

    A value is decoded and spelled anew only where it is not plain ASCII or holds escapes. NULL and text that is no JSON stay as they are.
    """

    def spelled(token: Column) -> Column:
        text = F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0))
        inner = bound(F.to_json(F.array(repair_text_once(text))), lambda whole: F.substring(whole, F.lit(2), F.length(whole) - 2))
        return F.coalesce(inner, token)

    def mended(token: Column) -> Column:
        is_text = F.startswith(token, F.lit('"')) & ~F.endswith(token, F.lit(":"))
        return F.when(is_text & token.rlike(r"[^\x{00}-\x{7f}]|\\u"), spelled(token)).otherwise(token)

    tokens = F.regexp_extract_all(json, F.lit(_TOKEN), F.lit(0))
    return F.when(F.try_parse_json(json).isNotNull(), F.array_join(F.transform(tokens, mended), "")).otherwise(json)
