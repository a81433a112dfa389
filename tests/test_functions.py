"""Edge rows per rule, expected values written by hand."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from larder.functions import payload as P
from larder.functions.dates import parse_iso
from larder.functions.details import dial_number, hours_on, is_open, link_parameter, review_target, week_hours
from larder.functions.fingerprint import join_components, typed_fields
from larder.functions.ratings import exact_average, shown_average
from larder.functions.text import (
    clean_text,
    district_from_address,
    repair_columns,
    repair_text,
    search_pattern,
    strip,
)
from larder.operators.area_import import in_quarter, in_town


def apply(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", function(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


REPAIRS = [
    ("KÄ±rÄ±kkale", "Kırıkkale"),
    ("CafÃ©", "Café"),
    ("â‚¬5", "€5"),
    ("café", "café"),
    ("plain", "plain"),
    ("Ã", "Ã"),
    ("Kırıkkale", "Kırıkkale"),
    ("", ""),
    (None, None),
    ("ÃƒÂ©", "Ã©"),
]


def test_repair_matches_python_codecs(spark):
    def by_codecs(text):
        for encoding in ("latin1", "cp1252"):
            try:
                text = text.encode(encoding).decode("utf-8")
            except UnicodeError:
                pass
        return text

    texts = [text for text, _ in REPAIRS]
    expected = [None if text is None else by_codecs(text) for text in texts]
    assert expected == [after for _, after in REPAIRS]
    assert apply(spark, texts, repair_text) == expected
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    assert [r.v for r in repair_columns(rows, ["v"]).orderBy("i").collect()] == expected


def test_strip_takes_all_white_space(spark):
    texts = ["  a b \n", "\x1c\x85x　", "​z", "   ", "", "in side"]
    assert apply(spark, texts, strip) == [t.strip() for t in texts]


def test_clean_text(spark):
    assert apply(spark, ["  abcdef ", " ", None, "CafÃ© x"], lambda c: clean_text(c, 5)) == [
        "abcde",
        None,
        None,
        "Café ",
    ]


@pytest.mark.parametrize(
    ("address", "district"),
    [
        ("Street 1, Cankaya/Ankara", "Street 1, Cankaya"),
        ("Street 1, Cankaya, Ankara", "Cankaya"),
        ("Ankara, Cankaya", "Unknown"),
        (None, "Unknown"),
        ("", "Unknown"),
        ("A / B / ANKARA ", "B"),
        ("/Ankara", "Unknown"),
        ("x/y, Old Town, Ankara Center", "Old Town"),
        ("a, , Ankara", "a"),
        ("d" * 150 + "/Ankara", "d" * 100),
    ],
)
def test_district(spark, address, district):
    assert apply(spark, [address], lambda c: district_from_address(c, F.lit("Ankara"))) == [district]


def test_search_pattern():
    assert search_pattern(None) is None
    assert search_pattern("  ") is None
    assert search_pattern(" a%b ") == "%a%b%"
    assert search_pattern("a\\%b") == "%a\\%b%"
    assert search_pattern("a\\b") == "%ab%"
    assert search_pattern("a\\\\") == "%a\\\\%"
    assert search_pattern("a\\") == "%a\\%"


NUMBERS = [
    # JSON, double, int, rating
    ("4.5", 4.5, 4, 4),
    ("3.5", 3.5, 3, 4),
    ('"4.5"', 4.5, None, 4),
    ('"x"', None, None, None),
    ('"12.0"', 12.0, None, 12),
    ("4.7", 4.7, 4, 5),
    ("-4.7", -4.7, -4, -5),
    ('"1,234"', None, None, None),
    ('" 12 "', 12.0, 12, 12),
    ('"1_000"', 1000.0, 1000, 1000),
    ('"1.5d"', None, None, None),
    ("true", 1.0, 1, 1),
    ("null", None, None, None),
    ("[1]", None, None, None),
    ("{}", None, None, None),
    ('"nan"', float("nan"), None, None),
    ("12345678901234", 12345678901234.0, None, None),
]


@pytest.mark.parametrize(("spelled", "as_double", "as_int", "as_rating"), NUMBERS)
def test_numbers(spark, spelled, as_double, as_int, as_rating):
    row = spark.createDataFrame([(f'{{"n":{spelled}}}',)], "j string")
    n = P.read_fields(F.col("j"), ["n"])["n"]
    got = row.select(P.to_double(n), P.to_int(n), P.to_rating(n)).first()
    assert repr(list(got)) == repr([as_double, as_int, as_rating])


def test_truthy_or_skips_what_is_empty(spark):
    first = ["null", "0", "0.0", '""', "false", "[]", "{}", "-0.0", "1", '"a"', "[0]", '{"a":0}', "true", '"0"']
    rows = spark.createDataFrame([(i, f'{{"a":{v},"b":"other"}}') for i, v in enumerate(first)], "i int, j string")
    f = P.read_fields(F.col("j"), ["a", "b"])
    picked = rows.select("i", F.to_json(P.truthy_or(f["a"], f["b"])).alias("o")).orderBy("i").collect()
    assert [r.o for r in picked] == ['"other"'] * 8 + ["1", '"a"', "[0]", '{"a":0}', "true", '"0"']


def test_dates(spark):
    utc = datetime.datetime
    cases = [
        ("2024-05-01T10:00:00Z", utc(2024, 5, 1, 10)),
        ("2024-05-01T10:00:00+03:00", utc(2024, 5, 1, 7)),
        ("2024-05-01T10:00:00+0300", utc(2024, 5, 1, 7)),
        ("2024-05-01T10:00:00+03", utc(2024, 5, 1, 7)),
        (" 2024-05-01 10:00 ", utc(2024, 5, 1, 10)),
        ("2024-05-01T10", utc(2024, 5, 1, 10)),
        ("2024-05-01T10:00Z", utc(2024, 5, 1, 10)),
        ("2024-05-01", utc(2024, 5, 1)),
        ("20240501", utc(2024, 5, 1)),
        ("20240501T101112", utc(2024, 5, 1, 10, 11, 12)),
        ("2024-05-01T10:00:00,5", utc(2024, 5, 1, 10, 0, 0, 500000)),
        ("2024-05-01T10:00:00.123456", utc(2024, 5, 1, 10, 0, 0, 123456)),
        ("2024", None),
        ("2024-05", None),
        ("T10:00:00", None),
        ("2 weeks ago", None),
        ("2024-13-01", None),
        ("2024-05-01T25:00:00", None),
        ("", None),
        (None, None),
    ]
    got = apply(spark, [text for text, _ in cases], lambda c: parse_iso(c).cast("timestamp_ntz"))
    assert got == [when for _, when in cases]


def test_fingerprint_of_missing_parts(spark):
    import hashlib

    got = spark.range(1).select(
        join_components(F.lit(None).cast("string"), F.lit("5"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    )
    assert got.first()[0] == hashlib.sha256(b"|5||").hexdigest()


def test_typed_review_fields(spark):
    import hashlib

    review = {
        "user": {"name": " Ada ", "thumbnail": ""},
        "review_id": " r1 ",
        "rating": 4.5,
        "text": 7,
        "snippet": "  ",
        "extracted_snippet": {"original": " Good Food "},
        "iso_date": "",
        "date": "2 weeks ago",
        "likes": "3",
        "language": " tr ",
    }
    rows = spark.createDataFrame([("p", json.dumps(review))], "id string, item string")
    got = typed_fields(rows, ["id"], None).first()
    assert (got.author_name, got.rating, got.review_text) == ("Ada", 4, "Good Food")
    assert (got.review_date, got.profile_photo, got.likes, got.language) == (None, None, 3, "tr")
    assert got.provider_review_id == " r1 "
    assert got.review_hash == hashlib.sha256(b"ada|4.5|good food|2 weeks ago").hexdigest()
    odd = spark.createDataFrame([("p", '{"user":"x","rating":"bad","language":" "}')], "id string, item string")
    got = typed_fields(odd, ["id"], "en").first()
    assert (got.author_name, got.rating, got.review_text, got.language) == (None, None, None, "en")


def test_average_is_exact_and_half_even(spark):
    rows = spark.createDataFrame([(87, 20), (89, 20), (0, 0), (10, 3)], "s long, n long")
    got = [r[0] for r in rows.select(shown_average(exact_average(F.col("s"), F.col("n")))).collect()]
    assert got == [4.4, 4.4, None, 3.3]


def test_hours(spark):
    hours = {"tuesday": " 9-5 ", "sunday": "Closed", "monday": ""}
    rows = spark.createDataFrame([(hours,)], "h map<string,string>")
    week = rows.select(week_hours(F.col("h"))).first()[0]
    assert [(r.day, r.hours) for r in week] == [("tuesday", "9-5"), ("sunday", "Closed")]
    on = rows.select(hours_on(F.col("h"), F.lit("2024-06-04").cast("date"))).first()[0]
    assert on == "9-5"
    assert apply(spark, ["Open now", " closed", "soon", None], is_open) == [True, False, None, None]


def test_phone(spark):
    texts = ["+90 312 123 45 67", "0312 123 45 67", "3121234567", "12345", "n/a", None]
    assert apply(spark, texts, dial_number) == ["+903121234567"] * 3 + ["+12345", None, None]


def test_links(spark):
    link = "https://x.org/r?data_id=&data_id=0x1%3A2&hl=tr&place_id=%20#data_id=no"
    assert apply(spark, [link], lambda c: link_parameter(c, "data_id")) == ["0x1:2"]
    assert apply(spark, [link], lambda c: link_parameter(c, "place_id")) == [None]
    assert apply(spark, ["https://x.org/r?bad=%zz&query=a+b"], lambda c: link_parameter(c, "query")) == ["a b"]
    row = spark.createDataFrame([("", "p1", link)], "d string, p string, l string")
    target = review_target(F.col("d"), F.col("p"), F.col("l"))
    assert row.select(target["data_id"], target["place_id"], target["hl"]).first()[:] == ("0x1:2", None, "tr")


def test_area_filters(spark):
    inside = json.dumps({"a": [{"b": "KIRIKKALE, Kırıkkale Merkez"}]}, ensure_ascii=False)
    key_only = json.dumps({"Kırıkkale": 1}, ensure_ascii=False)
    escaped = json.dumps({"a": "Kırıkkale"})
    assert apply(spark, [inside, key_only, escaped], in_town) == [True, False, True]
    quarter = json.dumps({"a": "Kirikkale", "b": {"Üniversite": 1}}, ensure_ascii=False)
    no_quarter = json.dumps({"a": "Kırıkkale", "b": "center"}, ensure_ascii=False)
    cedilla = json.dumps({"a": "kırıkkale yenişehir"}, ensure_ascii=False)
    assert apply(spark, [quarter, no_quarter, cedilla], in_quarter) == [True, False, True]


def walked(value):
    """Repair of all text values, by a plain walk."""
    if isinstance(value, str):
        return dict(REPAIRS).get(value, value)
    if isinstance(value, list):
        return [walked(item) for item in value]
    if isinstance(value, dict):
        return {key: walked(item) for key, item in value.items()}
    return value


def test_deep_repair_equals_a_plain_walk(spark):
    rnd = random.Random(4)
    texts = [text for text, _ in REPAIRS if text is not None] + ["a\"b", "back\\\\slash", "tab\there", ": \"x\": "]

    def grown(depth):
        kind = rnd.randrange(7 if depth else 4)
        if kind < 2:
            return rnd.choice(texts)
        if kind < 4:
            return rnd.choice([1, 2.5, True, None, -3e10])
        if kind < 6:
            return [grown(depth - 1) for _ in range(rnd.randrange(4))]
        return {rnd.choice(texts) + str(k): grown(depth - 1) for k in range(rnd.randrange(4))}

    values = [{"top": grown(6), "list": [grown(5), grown(3)]} for _ in range(60)]
    bodies = [json.dumps(v, ensure_ascii=k % 2 == 0, indent=[None, 1][k % 3 == 0]) for k, v in enumerate(values)]
    found = apply(spark, [*bodies, None, "no json Ã©", "[\"CafÃ©\"]"], P.repaired)
    assert [json.loads(text) for text in found[: len(values)]] == [walked(value) for value in values]
    assert found[len(values) :] == [None, "no json Ã©", "[\"Café\"]"]
    long = json.dumps({"a": ["x\\" * 50_000 + "CafÃ©", {"b": "CafÃ© " * 20_000}]}, ensure_ascii=False)
    assert json.loads(apply(spark, [long], P.repaired)[0])["a"][1]["b"] == "Café " * 20_000


def test_repaired_payload_spells_each_text_once(spark):
    rows = spark.createDataFrame([('{"a":"cafÃ©","b":["ünï \\u00fc",null]}',), ("no JSON é",), (None,)], "j string")
    mended = rows.select(P.repaired(F.col("j")).alias("j"))
    assert [row.j for row in mended.collect()] == ['{"a":"café","b":["ünï ü",null]}', "no JSON é", None]
    # a mention inside a lambda is a piece of work
    assert str(P.repaired(F.col("j"))).count("from_json") == 1
