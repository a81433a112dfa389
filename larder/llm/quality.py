"""Quality rules with risk-controlled cutoffs.

Every document gets counts by SQL functions alone. Each rule rejects a document whose value lies above a cutoff. Which
cutoff holds is decided on the labelled rows, per stratum: a cutoff may be used only if an exact binomial test shows that it
rejects at most ``risk / number of rules`` of the good documents. All tests of all strata share ``error`` by Bonferroni's
correction, so that with probability ``1 - error`` no stratum loses more than ``risk`` of its good documents. Among the
cutoffs that pass, the one that rejects most bad documents is taken, and of equals the highest. Where none passes, or no labels
exist, the rule rejects nothing.

The labels are used for nothing else, so all of them are a holdout. The test takes them as independent draws.

Defined results: a null text counts as an empty one; a null stratum is a stratum of its own; a label that is null, or labels
of one id that contradict each other, are left out; every input row gives one output row, repeated ids included; a text of any
length is counted whole; of cutoffs that catch equally much the higher one is taken; an empty table gives an empty result; other columns pass
through untouched, and ``keep_good`` returns them whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from larder.staging import stage

WHITE = " \t\n\x0b\f\r"
_SPLIT = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: More strata than this are joined instead of broadcast.
_BROADCAST_STRATA = 10_000


@dataclass(frozen=True)
class Rule:
    """A document fails if ``value`` is above the chosen one of ``cutoffs``."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


#: Cutoffs are fixed beforehand: picking them from the labelled rows would void the test.
RULES = (
    Rule("symbols", "n_symbols / n_words", (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)),
    Rule("capitals", "n_capitals / word_chars", (0.1, 0.15, 0.2, 0.3, 0.5, 0.7)),
    Rule("copied_lines", "n_dup_lines / n_lines", (0.05, 0.1, 0.2, 0.3, 0.5)),
    Rule("repeats", "n_repeat_words / n_words", (0.05, 0.1, 0.2, 0.3, 0.4)),
    Rule("long_words", "word_chars / n_words", (8.0, 9.0, 10.0, 12.0, 15.0)),
)


def _repeat_words(words: Column) -> Column:
    """Number of words in a window of three that the text has twice or more.

    A window becomes one long: hash above, place below. Sorted, equal windows are neighbours; sorting once more by place
    gives the covered words. That costs n log n in any text. Two different windows are taken as equal only if all bits above
    the place agree, which are 44 in a text of a million words and 54 in one of a thousand.
    """
    width = F.ceil(F.log2(F.size(words) + F.lit(1))).cast("int")
    places = F.call_function("shiftleft", F.lit(1).cast("bigint"), width) - 1

    def packed(mask: Column) -> Column:
        window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        each = F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: window(i).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("bigint")),
        )
        return F.sort_array(each)

    def repeated(sorted_windows: Column, mask: Column) -> Column:
        same = lambda x, i: F.coalesce(x.bitwiseXOR(F.get(sorted_windows, i)).bitwiseAND(F.bitwise_not(mask)) == 0, F.lit(False))
        twice = F.filter(sorted_windows, lambda x, i: ((i > 0) & same(x, i - 1)) | same(x, i + 1))
        return F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask)))

    def covered(starts: Column) -> Column:
        fresh = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(fresh, F.lit(0).cast("bigint"), lambda total, x: total + x)

    counted = _bound(places, lambda mask: _bound(packed(mask), lambda s: _bound(repeated(s, mask), covered)))
    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(counted)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules use. No shuffle, no Python: one pass over the whole texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(body, WHITE, "")
    without = lambda characters: F.length(body) - F.length(F.translate(body, characters, ""))
    trimmed = lambda line: F.btrim(line, F.lit(WHITE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(trimmed(body), _SPLIT))
    by_words = _bound(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeats")))
    lines = F.filter(F.split(body, "\n"), lambda line: trimmed(line) != "")
    by_lines = _bound(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds")))
    counted = docs.withColumns({"_words": by_words, "_lines": by_lines})
    return counted.withColumns(
        {
            "n_words": F.col("_words.n").cast("long"),
            "word_chars": F.length(bare).cast("long"),
            "n_symbols": without(_SYMBOLS).cast("long"),
            "n_dup_lines": (F.col("_lines.n") - F.col("_lines.kinds")).cast("long"),
            "n_repeat_words": F.col("_words.repeats").cast("long"),
            "n_lines": F.col("_lines.n").cast("long"),
            "n_capitals": without(_CAPITALS).cast("long"),
        }
    ).drop("_words", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _value(rule: Rule) -> Column:
    """The rule's value; 0 where the text has no word."""
    return F.coalesce(F.expr(rule.value.replace(" / ", " / nullif(") + ", 0)"), F.lit(0.0)).cast("double")


def _tail(n: Column, k: Column, risk: float) -> Column:
    """P(X <= k) for X binomial with ``n`` draws of probability ``risk``; 1 where k is no less than expected."""
    step = F.log(F.lit(risk / (1 - risk)))
    start = n * F.log(F.lit(1 - risk))

    def add(state: Column, i: Column) -> Column:
        term = state["log"] + F.log((n - i + 1) / i) + step
        return F.struct(term.alias("log"), (state["sum"] + F.exp(term)).alias("sum"))

    tail = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), k),
        F.struct(start.alias("log"), F.exp(start).alias("sum")),
        add,
        lambda state: state["sum"],
    )
    return F.when(k >= n * risk, F.lit(1.0)).when(k == 0, F.exp(start)).otherwise(F.least(tail, F.lit(1.0)))


def choose_cutoffs(
    counted: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    id_column: str = "doc_id",
    rules: tuple[Rule, ...] = RULES,
    risk: float = 0.05,
    error: float = 0.05,
) -> DataFrame:
    """One row per stratum with labels: ``stratum`` and an array ``cutoffs``, one per rule, null where none is safe.

    ``counted`` has the counts of ``with_counts``; ``labels`` has the id and ``quality`` (1 good, 0 bad). Only sums per
    stratum, combined before the shuffle, leave the tasks.
    """
    agreed = (
        labels.groupBy(id_column)
        .agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
        .filter("_low = _high AND _low IN (0, 1)")
        .select(F.col(id_column).alias("_id"), (F.col("_low") == 1).alias("_good"))
    )
    values = counted.filter(~base_failed()).select(
        F.col(id_column).alias("_id"),
        F.col(stratum).alias("stratum"),
        F.array(*[_value(rule) for rule in rules]).alias("_values"),
    )
    tests = [(place, cutoff) for place, rule in enumerate(rules) for cutoff in rule.cutoffs]

    def hits(of_good: bool) -> Column:
        side = F.col("_good") if of_good else ~F.col("_good")
        return F.array(*[F.count_if(side & (F.col("_values")[place] > cutoff)) for place, cutoff in tests])

    sums = stage(
        values.join(agreed, "_id")
        .groupBy("stratum")
        .agg(F.count_if("_good").alias("n_good"), hits(True).alias("_lost"), hits(False).alias("_caught"))
    )
    allowed = risk / len(rules)
    level = error / max(1, sums.count() * len(tests))
    tested = sums.select(
        "stratum",
        F.transform(
            F.sequence(F.lit(0), F.lit(len(tests) - 1)),
            lambda i: F.struct(
                F.get(F.array(*[F.lit(place) for place, _ in tests]), i).alias("rule"),
                F.get(F.col("_caught"), i).alias("caught"),
                F.get(F.array(*[F.lit(cutoff) for _, cutoff in tests]), i).alias("cutoff"),
                _tail(F.col("n_good"), F.get(F.col("_lost"), i), allowed).alias("tail"),
            ),
        ).alias("_tests"),
    )
    best = lambda place: F.array_max(
        F.transform(
            F.filter("_tests", lambda t: (t["rule"] == place) & (t["tail"] <= level) & (t["caught"] > 0)),
            lambda t: F.struct(t["caught"], t["cutoff"]),
        )
    )["cutoff"]
    return tested.select("stratum", F.array(*[best(place) for place in range(len(rules))]).alias("cutoffs"))


def judge(
    counted: DataFrame, cutoffs: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Add ``base_failed``, ``failed_rules`` (names) and ``kept`` to counted documents."""
    few = cutoffs.limit(_BROADCAST_STRATA + 1).count() <= _BROADCAST_STRATA
    limits = cutoffs.select(F.col("stratum").alias("_stratum"), F.col("cutoffs").alias("_cutoffs"))
    joined = counted.join(
        F.broadcast(limits) if few else limits, counted[stratum].eqNullSafe(F.col("_stratum")), "left"
    )
    failed = F.filter(
        F.array(
            *[
                F.when(_value(rule) > F.get("_cutoffs", F.lit(place)), F.lit(rule.name))
                for place, rule in enumerate(rules)
            ]
        ),
        lambda name: name.isNotNull(),
    )
    return joined.withColumns({"base_failed": base_failed(), "failed_rules": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    ).drop("_stratum", "_cutoffs")


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """Id, counts and verdict of every document; the counts are computed once and staged, as they are narrow."""
    counted = stage(with_counts(docs.select("doc_id", "lang", "text")).drop("text"))
    cutoffs = stage(choose_cutoffs(counted, labels, risk=risk, error=error))
    return judge(counted, cutoffs)


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """The documents that pass, all columns as they were.

    Counts are staged beside what they depend on, text and stratum; a filter on them would repeat the counting for each place
    that mentions a count.
    """
    keys = {"_id": docs["doc_id"], "_in": docs["lang"], "_hash": F.xxhash64(docs["text"])}
    rows = docs.select("doc_id", "lang", "text", keys["_hash"].alias("_hash"))
    counted = stage(with_counts(rows).drop("text"))
    cutoffs = stage(choose_cutoffs(counted, labels, risk=risk, error=error))
    failed = judge(counted, cutoffs).filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("lang").alias("_in"), "_hash")
    gone = stage(failed.distinct())
    same = [column.eqNullSafe(gone[name]) for name, column in keys.items()]
    return docs.join(gone, same[0] & same[1] & same[2], "left_anti")
