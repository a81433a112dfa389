"""Quality rules, URL filters, licence scans and language identification against plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larder.llm import language as L, licences as C, quality as Q, url_filters as U
from larder.llm.catalog import QUERIES
from larder.llm.queries_filters import URL_RULES
from llm import odd

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\f\r"


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def counts_of(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_op7_counts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, SF).collect()}
    assert found.keys() == docs.keys()
    for i, text in docs.items():
        assert counts_of(found[i]) == plain_counts(text)
        n, _, _, _, repeats = plain_counts(text)
        assert found[i].base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (found[i].kept and found[i].base_failed)


def test_op7_odd_documents(spark):
    docs = odd.frame(spark)
    found = Q.with_counts(docs).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(found) == len(odd.rows())
    for r in found:
        assert counts_of(r) == plain_counts(r.text)
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and odd.untouched(kept)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 1, 2, 3, 7]
    nothing = odd.frame(spark, [])
    assert Q.keep_good(nothing, labels.limit(0)).count() == 0
    assert Q.quality_verdicts(docs, labels.limit(0)).filter("kept").count() == 7


@pytest.mark.parametrize(("n", "k", "risk"), [(10, 0, 0.1), (400, 7, 0.03), (5000, 20, 0.01), (50, 9, 0.1)])
def test_exact_binomial_tail(spark, n, k, risk):
    wanted = 1.0 if k >= n * risk else sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
    row = spark.range(1).select(Q._tail(F.lit(n).cast("long") + F.col("id"), F.lit(k).cast("long") + F.col("id"), risk)).head()
    assert row[0] == pytest.approx(wanted, rel=1e-9)


def test_cutoffs_are_certified_per_stratum(spark):
    """Stratum a: symbols separate good from bad. Stratum b: good documents have symbols too. Stratum c: too few labels."""
    rows, labels = [], []
    for i in range(3000):
        stratum, good = ("a", "b")[i % 2] if i < 2900 else "c", i % 3 > 0
        share = 0.3 if not good or (stratum == "b" and i % 5 == 0) else 0.0
        rows.append((i, stratum, 200, 900, int(200 * share), 0, 0, 10, 0))
        labels.append((i, int(good)))
    counted = spark.createDataFrame(
        rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, n_lines long, n_capitals long",
    )
    chosen = {r.stratum: r.cutoffs for r in Q.choose_cutoffs(counted, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert chosen["a"][0] == 0.2  # the highest that still catches all bad ones
    assert chosen["b"][0] is None and chosen["c"][0] is None
    assert all(cutoff is None for cutoff in chosen["a"][1:])
    judged = Q.judge(counted, Q.choose_cutoffs(counted, spark.createDataFrame(labels, "doc_id long, quality int")))
    assert {r.doc_id for r in judged.filter("NOT kept").collect()} == {i for i in range(2900) if i % 2 == 0 and i % 3 == 0}


def plain_verdict(url):
    _, mark, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest).group() if mark else ""
    path = re.match(r"[^?#]*", rest[len(host) :]).group() if mark else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        rule
        for rule in URL_RULES
        for own, _, start in [rule.name.partition("/")]
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start)
    ]
    best = max(fits, key=lambda rule: len(rule.name), default=None)
    return host, path, best and best.name, best and best.verdict


URLS = [
    None,
    "",
    "no scheme.org/es/",
    "http://example.org/es/1",
    "HTTP://EXAMPLE.ORG/ES/1",
    "http://a.b.Example.org/en/123?x=/es/",
    "http://example.org/en/2",
    "http://notexample.org/es/",
    "http://org/",
    "http://org",
    "http://x.com/fr/a#b",
    "http://x.com/fr",
    "http://x.com/de/://y.org/",
    "http://ads.x.net/",
    "http://x.net/privacy/ads/",
    "http://loads.net/",
    "http://spam-farm.net?q",
    "://",
    "http://e\nx.org/es/",
    "http://x.com:80/fr/",
]


def test_op2_equals_plain_python(spark):
    pages = spark.createDataFrame(
        [(i, url, "clash", "clash") for i, url in enumerate([*URLS, *URLS])], "page_id long, url string, name string, rule string"
    )
    found = U.judge_urls(pages.repartition(3), URL_RULES).collect()
    assert len(found) == len(URLS) * 2
    for r in found:
        host, path, rule, verdict = plain_verdict(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.name == "clash"
        assert r.verdict == verdict or verdict is None
    by_url = {r.url: r for r in found}
    assert by_url["http://ads.x.net/"].verdict == by_url["http://spam-farm.net?q"].verdict == "block"
    assert by_url["http://x.net/privacy/ads/"].verdict == by_url["http://loads.net/"].verdict == by_url[None].verdict == "allow"
    assert U.judge_urls(pages.limit(0), URL_RULES).count() == 0
    registered = QUERIES["op2_url_filters"](spark, SF).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(registered) == len(urls)
    for r in registered:
        host, path, rule, verdict = plain_verdict(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and verdict in (None, r.verdict)


def test_url_index_uses_the_rarest_token_and_joins_long_lists(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i}.com/a{i % 3}/") for i in range(60)], "page_id long, url string")
    rules = [U.domain_rule("block", f"h{i}.com", "/a0/") for i in range(0, 60, 2)]
    wanted = {i for i in range(0, 60, 2) if i % 3 == 0}
    for limit in (20_000, 0):
        monkeypatch.setattr(U, "_BROADCAST_RULES", limit)
        found = U.judge_urls(pages, rules, ()).filter("verdict = 'block'").collect()
        assert {r.page_id for r in found} == wanted
    urls = pages.select(F.split(F.concat(U.host_of(F.col("url")), U.path_of(F.col("url"))), "[^a-z0-9]+").alias("_tokens"))
    assert {r.token for r in U._index(urls, rules).collect()} == {f"h{i}" for i in range(0, 60, 2)}


def plain_licences(text, limit=0.8):
    sets = {name: set(C.bigrams(C.normalised(t))) for name, t in C.TEMPLATES.items()}
    text = text or ""
    found = {}
    for passage in [*text.split("\n"), *re.split(r"\n[ \t\r]*\n\s*", text), text]:
        own = set(C.bigrams(C.normalised(passage)))
        for name, other in sets.items():
            dice = 2 * len(own & other) / (len(own) + len(other))
            if dice >= limit:
                found[name] = max(dice, found.get(name, 0))
    return found


def test_op4_equals_plain_python(spark):
    texts = {
        0: "prose first\nReleased under the MIT License.\nmore",
        1: "released   UNDER the mit-license!",
        2: C.TEMPLATES["MIT notice"].replace("any person", "all people"),
        3: "a\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU "
        "General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.\n \nb",
        4: "MIT",
        5: "Released under the MIT License. " * 30,
        6: "\n".join(C.TEMPLATES.values()),
        7: "the license is released under the sun",
    }
    rows = [*texts.items(), *[(100 + k, row[1]) for k, row in enumerate(odd.rows())]]
    docs = spark.createDataFrame([(i, text, "clash") for i, text in rows], "doc_id long, text string, licence string")
    found = {r.doc_id: r for r in C.scan_licences(docs.repartition(3)).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        wanted = plain_licences(text)
        assert sorted(wanted) == found[i].licences, i
        if wanted:
            best = max(wanted.values())
            assert found[i].dice == pytest.approx(best)
            assert found[i].licence == min(name for name, dice in wanted.items() if dice == best)
        else:
            assert found[i].licence is None and found[i].dice is None
    assert found[5].licence == "MIT" and found[3].licence == "GPL-3.0 notice"
    assert C.scan_licences(docs.limit(0)).count() == 0


def test_op6_on_documents_and_pages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op6_language_id"](spark, SF).collect()
    assert len(found) == len(docs)
    right = [r.language == docs[r.doc_id].lang for r in found]
    assert sum(right) >= 0.98 * len(right)
    pages = QUERIES["page_languages"](spark, SF).collect()
    assert len(pages) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r.language for r in pages)


def test_op6_held_out_texts_without_declaration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(1000)
    hidden = docs.withColumn("_true", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 4 > 0, F.col("lang")))
    found = {r.doc_id: r.language for r in L.identify(L.of_documents(hidden)).collect()}
    true = {r.doc_id: r.lang for r in docs.collect() if r.doc_id % 4 == 0}
    assert sum(found[i] == lang for i, lang in true.items()) >= 0.97 * len(true)


def test_op6_host_prior_and_declaration_decide_where_text_does_not(spark):
    rows = [(i, f"der die das und nicht mit von {i}" if i % 2 else f"the of and to in is that {i}", ["en", "de"][i % 2], f"{['en', 'de'][i % 2]}.site.org") for i in range(80)]
    rows += [(100, "ok 1", None, "de.site.org"), (101, "ok 1", None, "en.site.org"), (102, "12 345", None, "de.site.org")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string").withColumn("suffix", F.lit("org"))
    found = {r.doc_id: r for r in L.identify(frame, L.Evidence(languages=("de", "en"), accepted=("de",))).collect()}
    assert found[100].language == "de" and found[101].language == "en"
    assert found[102].language is None and not found[102].kept
    assert found[100].kept and not found[101].kept


def test_op6_odd_documents(spark):
    found = L.identify(L.of_documents(odd.frame(spark))).collect()
    assert len(found) == len(odd.rows())
    assert all(not r.kept and r.language is None for r in found if r.doc_id in (4, 5, 6))
    kept = L.keep_identified(odd.frame(spark))
    assert kept.columns == odd.frame(spark).columns and odd.untouched(kept)
    assert not {r.doc_id for r in kept.collect()} & {4, 5, 6}
    assert L.keep_identified(odd.frame(spark, [])).count() == 0
