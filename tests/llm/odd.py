"""Documents with every oddity, for all operators."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, key array<int>, _row double"


def words(seed, n):
    rng = random.Random(seed)
    parts = ["ba", "ko", "ti", "ru", "se", "mi", "la", "vo"]
    return [rng.choice(parts) + rng.choice(parts) + rng.choice(["", "n", "s"]) for _ in range(n)]


def rows():
    base = words(1, 120)
    near = [*base[:60], "other", *base[61:]]
    texts = {
        1: " ".join(base),
        2: " ".join(base),
        3: " ".join(near).upper(),
        4: None,
        5: "",
        6: " \n\t ",
        7: " ".join(words(2, 30_000)),
        8: "Ünïcode wörds — ﬁne 👍🏽 ΟΔΟΣ\r\nline\x0btwo\x0cend\x00",
        9: "one two three",
        10: "one two three",
        11: "same line here\n" * 40,
        12: "x" * 50_000,
        13: "#$%& ***" * 60,
    }
    found = [
        (i, text, None if i == 9 else ["en", "de", "xx"][i % 3], None if i % 4 == 0 else f"src{i % 3}", None)
        for i, text in texts.items()
    ]
    found += [found[0], found[0], (None, " ".join(base), "en", "src1", 3), (None, None, None, None, None), (9, "another text", "en", "src0", 1)]
    return [row + ("clash", k, [k], 0.5) for k, row in enumerate(found)]


#: Columns that operators might take for their own.
CLASHING = ["_gone", "_many", "_hash", "_copy", "_its", "_in", "_words", "gone", "Hashes", "copies", "mixed_id"]


def frame(spark, only=None):
    made = spark.createDataFrame(rows() if only is None else only, SCHEMA).repartition(3)
    return made.withColumns({name: F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for name in CLASHING})


def untouched(kept):
    """Whether the clashing columns hold what they were made with."""
    return all(r[name] == f"{name} of {'none' if r.doc_id is None else r.doc_id}" for r in kept.collect() for name in CLASHING)
