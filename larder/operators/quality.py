"""Violations of the table rules, counted over whole tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from larder import model
from larder.session import cut_lineage


def _row_rules(name: str) -> list[tuple[str, str, Column]]:
    """(rule, column, broken?) for rules that look at one row."""
    rules = [
        ("not_null", f.name, F.col(f.name).isNull())
        for f in model.TABLES[name].fields
        if not f.nullable
    ]
    rules += [
        ("max_length", column, F.char_length(F.col(column)) > limit)
        for column, limit in model.MAX_LENGTH[name].items()
    ]
    if name == "user_reviews":
        inside = F.col("rating").between(model.MIN_RATING, model.MAX_RATING)
        rules.append(("rating_range", "rating", ~inside))
    return rules


@dataclass(frozen=True)
class _Rule:
    table: str
    rule: str
    columns: list[str]


def _key(columns: list[str]) -> Column:
    """What rows are counted by: the value of one column, or a 64-bit hash of several."""
    return F.col(columns[0]).cast("string") if len(columns) == 1 else F.xxhash64(*columns).cast("string")


def _complete(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(column).isNotNull() for column in columns])


def _entries(name: str, tables: dict[str, DataFrame], rules: list[_Rule]) -> DataFrame:
    """(rule, key, parent) for all that one scan of a table has to count."""
    broken = {(rule, column): condition for rule, column, condition in _row_rules(name)}
    found = []

    def entry(condition: Column, number: int, key: Column, parent: bool) -> None:
        found.append(F.when(condition, F.struct(F.lit(number).alias("rule"), key.alias("key"), F.lit(parent).alias("parent"))))

    for number, rule in enumerate(rules):
        if rule.table == name and rule.rule == "unique":
            entry(_complete(rule.columns), number, _key(rule.columns), False)
        elif rule.table == name and rule.rule == "reference":
            entry(_complete(rule.columns), number, _key(rule.columns), False)
        elif rule.table == name:
            entry(broken[rule.rule, rule.columns[0]], number, F.lit(""), False)
        if rule.rule == "reference" and dict(model.REFERENCES[rule.table])[rule.columns[0]] == name:
            entry(F.col("id").isNotNull(), number, _key(["id"]), True)
    return tables[name].select(F.explode(F.array_compact(F.array(*found))).alias("e")).select("e.*")


def _rules(tables: dict[str, DataFrame]) -> list[_Rule]:
    rules = []
    for name in tables:
        rules += [_Rule(name, rule, [column]) for rule, column, _ in _row_rules(name)]
        rules += [_Rule(name, "unique", keys) for keys in model.UNIQUE[name]]
        rules += [_Rule(name, "reference", [key]) for key, parent in model.REFERENCES.get(name, []) if parent in tables]
    return rules


def _recounted(suspects: DataFrame, table: DataFrame, rule: _Rule, number: int) -> DataFrame:
    """Rows beyond the first of each key, among the rows whose hash occurs twice."""
    hashes = suspects.filter(F.col("rule") == number).select(F.col("key").alias("_key"))
    rows = table.filter(_complete(rule.columns)).select(*rule.columns, _key(rule.columns).alias("_key"))
    sizes = rows.join(hashes, "_key", "left_semi").groupBy(*rule.columns).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.lit(number).alias("rule"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("violations"))


def quality_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per rule: table_name, rule, columns, violations.

    ``unique`` counts the rows beyond the first of each key, ``reference`` the rows without a parent. One scan of each table gives an entry per
    rule and row that has anything to count; these are added up per rule and key, all tables together, and only what violates a rule is kept. Keys of
    several columns are counted by a hash; where one occurs twice, a second scan of that table counts the rows with such hashes by their real keys.
    """
    rules = _rules(tables)
    entries = reduce(DataFrame.unionByName, [_entries(name, tables, rules) for name in tables])
    sums = entries.groupBy("rule", "key").agg(F.count_if(~F.col("parent")).alias("n"), F.bool_or("parent").alias("known"))
    kind = F.get(F.array(*[F.lit(rule.rule) for rule in rules]), F.col("rule"))
    surplus = F.when(kind == "unique", F.col("n") - 1).when((kind == "reference") & F.col("known"), 0).otherwise(F.col("n"))
    bad = cut_lineage(sums.select("rule", "key", surplus.alias("violations")).filter("violations > 0"))
    hashed = [k for k, rule in enumerate(rules) if rule.rule == "unique" and len(rule.columns) > 1]
    suspects = bad.filter(F.col("rule").isin(hashed))
    counted = [bad.filter(~F.col("rule").isin(hashed)).groupBy("rule").agg(F.sum("violations").alias("violations"))]
    twice = {row[0] for row in suspects.select("rule").distinct().collect()}  # one row per rule at most
    counted += [_recounted(suspects, tables[rules[k].table], rules[k], k) for k in hashed if k in twice]
    lines = [(k, rule.table, rule.rule, ",".join(rule.columns)) for k, rule in enumerate(rules)]
    spark = next(iter(tables.values())).sparkSession
    named = spark.createDataFrame(lines, "rule_number int, table_name string, rule string, columns string")
    totals = reduce(DataFrame.unionByName, counted).withColumnRenamed("rule", "rule_number")
    report = named.join(F.broadcast(totals), "rule_number", "left")  # one row per rule
    return report.select("table_name", "rule", "columns", F.coalesce("violations", F.lit(0).cast("long")).alias("violations"))
