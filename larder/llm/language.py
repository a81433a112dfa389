"""Language identification by fusing evidence in Bayes' rule.

Four kinds of evidence are added as logarithms: the likelihood of the text under character trigram models, the language that the
document or its markup declares, the suffix of its address, and a prior of its host. Models of declarations and suffixes are smoothed
conditional frequencies, estimated over all rows with the text's own posterior as soft counts. The host prior is smoothed along the levels of the host name: a
host leans on its parent domain, this on its own parent, the last on all rows, each with the weight of ``lean`` rows; the row's own
count is left out. These counts are grouped aggregates over all rows.

Trigrams are hashed to a fixed number of cells. The trigram models are fitted on at most ``sample`` rows per language, those with
the least hash of their text among the rows that declare it: a bounded model of labelled rows. All else covers all rows.

A document is rejected if its text has no letter, if its best language stays below ``least`` in posterior probability, or is not
an accepted one.

Defined results: a null or empty text is no evidence for any language and is rejected; a null or unknown declaration, suffix or host adds nothing
but what rows with the same gap tell; every input row gives one output row; a text of any length is read whole; of languages that are
equally likely the first in the list is taken; an empty table gives an empty result; other columns are not read, and ``keep_identified`` returns them as
they were whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.staging import stage

_CELL_BITS = 16
#: Trigrams of one text depend on each other; their joint weight is that of so many independent ones at most.
_INDEPENDENT = 40.0
#: Tables of hosts up to so many rows are broadcast.
_BROADCAST_HOSTS = 10_000


@dataclass(frozen=True)
class Evidence:
    """Parameters of the fusion."""

    languages: tuple[str, ...] = ("de", "en", "es", "fr")
    accepted: tuple[str, ...] = ("de", "en", "es", "fr")
    sample: int = 2_000
    lean: float = 20.0
    least: float = 0.6


def _cells(text: str | None) -> np.ndarray:
    """Hashed trigrams of the letters; every other run of characters counts as one space."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.empty(0, np.uint32)
    letters = np.where((points > 0xBF) | ((points >= 97) & (points <= 122)), points, np.uint32(32))
    other = letters == 32
    kept = letters[~other | np.concatenate(([True], ~other[:-1]))]
    if len(kept) < 3:
        return np.empty(0, np.uint32)
    mixed = kept[:-2] * np.uint32(0x9E3779B1) + kept[1:-1] * np.uint32(0x85EBCA77) + kept[2:] * np.uint32(0xC2B2AE3D)
    return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - _CELL_BITS)


def fit_trigrams(labelled: DataFrame, evidence: Evidence) -> np.ndarray:
    """Log probabilities (language, cell) from rows (language, text) of a bounded sample per language."""
    wanted = labelled.filter(F.col("language").isin(*evidence.languages) & F.col("text").isNotNull())
    sizes = wanted.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per language
    rate = F.lit(0.0)
    for row in sizes:
        rate = F.when(F.col("language") == row.language, F.lit(2.0 * evidence.sample / row.n)).otherwise(rate)
    # a threshold on the hash leaves about twice the sample before anything is shuffled
    hashed = wanted.withColumn("_hash", F.xxhash64("text"))
    likely = hashed.filter(F.pmod("_hash", F.lit(1 << 30)) < rate * float(1 << 30)).dropDuplicates(["language", "_hash"])
    order = Window.partitionBy("language").orderBy(F.pmod("_hash", F.lit(1 << 30)), "_hash")
    chosen = likely.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= evidence.sample)
    languages = {language: k for k, language in enumerate(evidence.languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), 1 << _CELL_BITS), np.int64)
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[languages[language]] += np.bincount(_cells(text), minlength=1 << _CELL_BITS)
        row, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row), pa.array(cell), pa.array(counts[row, cell])], names=["row", "cell", "n"]
        )

    counted = chosen.select("language", "text").mapInArrow(count, "row long, cell long, n long")
    summed = counted.groupBy("row", "cell").agg(F.sum("n").alias("n")).toPandas()  # languages x cells at most
    table = np.full((len(languages), 1 << _CELL_BITS), 0.1)
    table[summed["row"], summed["cell"]] += summed["n"]
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _with_likelihood(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """Replace ``text`` by ``n_trigrams`` and ``likelihood``, a log likelihood per language, 0 for the best."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))
    others = [name for name in rows.columns if name != "text"]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes if name != "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            found = np.zeros((batch.num_rows, cells.shape[1]))
            sizes = np.zeros(batch.num_rows, np.int64)
            for k, text in enumerate(batch.column(batch.schema.get_field_index("text"))):
                own = _cells(text.as_py())
                sizes[k] = len(own)
                if len(own):
                    mean = cells[own].mean(axis=0, dtype=np.float64)
                    found[k] = (mean - mean.max()) * min(len(own), _INDEPENDENT)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.reshape(-1)), cells.shape[1]).cast(pa.list_(pa.float64()))
            arrays = [batch.column(batch.schema.get_field_index(name)) for name in others]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(sizes), lists], names=[*others, "n_trigrams", "likelihood"]
            )

    return rows.mapInArrow(score, f"{schema}, n_trigrams long, likelihood array<double>")


def _posterior(logs: Column) -> Column:
    """Probabilities from unnormalised logarithms."""
    def normal(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        return F.transform(values, lambda x: x / total)

    powers = F.transform(F.array(logs), lambda x: F.transform(x, lambda v: F.exp(v - F.array_max(x))))
    return F.get(F.transform(powers, normal), F.lit(0))


def _sums(languages: int) -> list[Column]:
    return [F.sum(F.get("_soft", F.lit(k)).cast("decimal(30,9)")).cast("double").alias(f"_s{k}") for k in range(languages)]


def _conditional(scored: DataFrame, column: str, languages: int) -> DataFrame:
    """log P(value | language) of each value of ``column``, smoothed by one row per language: (value, _log_<column>)."""
    counts = scored.groupBy(F.col(column).alias("_value")).agg(*_sums(languages))
    whole = counts.agg(*[F.sum(f"_s{k}") for k in range(languages)], F.count(F.lit(1))).head()
    values = whole[languages] + 1
    logs = F.array(*[F.log((F.col(f"_s{k}") + 1.0) / F.lit((whole[k] or 0.0) + values)) for k in range(languages)])
    return counts.select("_value", logs.alias(f"_log_{column}"))


def _joined(scored: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
    few = table.limit(_BROADCAST_HOSTS + 1).count() <= _BROADCAST_HOSTS
    side = F.broadcast(table) if few else table
    return scored.join(side, scored[column].eqNullSafe(side["_value"]), "left").drop("_value")


def _levels(host: Column, depth: int) -> Column:
    """The host cut to its last ``depth`` labels; the whole host where it has no more."""
    return F.substring_index(host, ".", -depth)


def _with_prior(scored: DataFrame, evidence: Evidence, depth: int = 4) -> DataFrame:
    """Add ``_prior``: log probabilities of the languages of the row's host, without the row itself."""
    k = len(evidence.languages)
    whole = scored.agg(*_sums(k), F.count(F.lit(1))).head()
    rows = max(float(whole[k]), 1.0)
    start = [((whole[i] or 0.0) + 1.0 / k) / (rows + 1.0) for i in range(k)]
    with_all = scored.withColumn("_prior", F.array(*[F.lit(p) for p in start]))
    for level in range(1, depth + 1):
        name = F.col("host") if level == depth else _levels(F.col("host"), level)
        # a host without so many labels has had its count already
        counted = F.lit(False) if level == 1 else name == _levels(F.col("host"), level - 1)
        placed = with_all.withColumn("_level", name)
        counts = stage(placed.groupBy(F.col("_level").alias("_value")).agg(*_sums(k), F.count(F.lit(1)).alias("_rows")))
        joined = _joined(placed, counts, "_level", "_rows")
        leaning = F.array(
            *[
                F.greatest(F.col(f"_s{i}") - F.get("_soft", F.lit(i)), F.lit(0.0)) + evidence.lean * F.get("_prior", F.lit(i))
                for i in range(k)
            ]
        )
        total = F.col("_rows") - 1 + evidence.lean
        smoothed = F.transform(leaning, lambda x: x / total)
        with_all = joined.withColumn("_prior", F.when(F.col("host").isNull() | counted, F.col("_prior")).otherwise(smoothed)).select(
            *scored.columns, "_prior"
        )
    return with_all


def identify(rows: DataFrame, evidence: Evidence = Evidence()) -> DataFrame:
    """Language of rows (id columns, ``text``, ``declared``, ``suffix``, ``host``).

    Adds ``language``, ``posterior``, ``n_trigrams`` and ``kept`` to all columns but the text.
    """
    table = fit_trigrams(rows.select(F.col("declared").alias("language"), "text"), evidence)
    k = len(evidence.languages)
    scored = _with_likelihood(rows, table)
    scored = stage(scored.withColumn("_soft", _posterior(F.col("likelihood"))))
    fused = _with_prior(scored, evidence)
    for column in ("declared", "suffix"):
        fused = _joined(fused, stage(_conditional(scored, column, k)), column, f"_log_{column}")
    logs = F.array(
        *[
            F.get("likelihood", F.lit(i)) + F.get("_log_declared", F.lit(i)) + F.get("_log_suffix", F.lit(i)) + F.log(F.get("_prior", F.lit(i)))
            for i in range(k)
        ]
    )
    ended = fused.withColumn("_posterior", _posterior(logs))
    best = F.array_max("_posterior")
    names = F.array(*[F.lit(language) for language in evidence.languages])
    language = F.get(names, (F.array_position("_posterior", best) - 1).cast("int"))
    others = [name for name in rows.columns if name != "text"]
    known = ended.select(
        *others,
        F.when(F.col("n_trigrams") > 0, language).alias("language"),
        F.when(F.col("n_trigrams") > 0, best).alias("posterior"),
        "n_trigrams",
    )
    good = F.col("language").isin(*evidence.accepted) & (F.col("posterior") >= evidence.least)
    return known.withColumn("kept", F.coalesce(good, F.lit(False)))


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents as rows for ``identify``: the source is the host, its last label the suffix."""
    source = F.lower("source")
    return docs.select(
        "doc_id",
        F.col("text").cast("string").alias("text"),
        F.lower("lang").alias("declared"),
        F.when(source.contains("."), F.substring_index(source, ".", -1)).alias("suffix"),
        source.alias("host"),
    )


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages as rows for ``identify``: text without markup, declared language of the markup, suffix and host of the URL."""
    bare = F.regexp_replace("html", "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->|<[^>]*>", " ")
    plain = F.regexp_replace(bare, "&[a-zA-Z#0-9]{1,10};", " ")
    host = F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))
    host = F.when(host != "", host)
    declared = F.lower(F.regexp_extract("html", "(?i)<html\\b[^>]*\\blang\\s*=\\s*[\"']?([a-zA-Z]{2,3})", 1))
    return pages.select(
        "page_id",
        plain.alias("text"),
        F.when(declared != "", declared).alias("declared"),
        F.substring_index(host, ".", -1).alias("suffix"),
        host.alias("host"),
    )


def keep_identified(docs: DataFrame, evidence: Evidence = Evidence()) -> DataFrame:
    """The documents whose language is known and accepted, all columns as they were.

    Rows that share id and text share the verdict.
    """
    rows = of_documents(docs).withColumn("_hash", F.xxhash64("text"))
    verdicts = identify(rows, evidence).filter("NOT kept").select("doc_id", "_hash").distinct()
    gone = stage(verdicts.withColumnsRenamed({"doc_id": "_id", "_hash": "_its"}))
    same = docs["doc_id"].eqNullSafe(gone["_id"]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(gone["_its"])
    return docs.join(gone, same, "left_anti")
