"""Review batches of many places merged into the stored external reviews.

A review is known by its provider id or else by its fingerprint. Rows act in page order: each one meets the
state that the rows before it left. Most fingerprints come with one provider id, or none, which comes with no other fingerprint;
these are settled in one shuffle by fingerprint. Other plain identities (one fingerprint, or one provider id with
fingerprints of its own) are settled with aggregates and joins. The rest, where the result depends on how
ids and fingerprints alternate, is settled in rounds (``operators/tangled.py``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder import model
from larder.functions import payload as P
from larder.functions.fingerprint import typed_fields
from larder.functions.ids import pack_hex, place_key, short_digest, stable_id, unpack_hex
from larder.functions.text import nonblank
from larder.operators.contacts import sync_targets
from larder.operators.components import components
from larder.operators.feed import feed_rows, image
from larder.operators.ordering import HOT_ROWS, hot_groups, mark_hot, with_previous
from larder.operators.tangled import STORED, replay
from larder.session import cut_lineage
from larder.sources.pages import REVIEW_LISTS, fetched_pages, page_facts, page_items, reached_pages

SEQUENCE = ["restaurant_id", "page_index", "pos"]

# A stored review counts as changed where one of these differs.
COMPARED = [
    "author_name",
    "rating",
    "review_text",
    "review_date",
    "profile_photo",
    "likes",
    "provider_review_id",
    "language",
    "review_hash",
    "raw_json",
]

_EDGE = ["hkey", "pkey"]


def typed_reviews(items: DataFrame, default_language: str | None = None) -> DataFrame:
    """Provider review JSON to the columns of an external review, beside the sequence columns."""
    return typed_fields(items, SEQUENCE, default_language)


def state_digest() -> Column:
    """Digest of the compared columns; member order inside the raw record does not matter."""
    fields = [
        P.canonical(F.col(name)).alias(name) if name == "raw_json" else F.col(name)
        for name in COMPARED
    ]
    return short_digest(F.to_json(F.struct(*fields)))


def _narrow(reviews: DataFrame, extra: list[str]) -> DataFrame:
    """What matching needs; ``pid`` is an empty text without provider id.

    ``hkey`` and ``pkey`` stand for fingerprint and provider id at their place wherever rows are shuffled, in 16 bytes each. The fingerprint
    itself is packed (``packed``).
    """
    known = F.when(nonblank(F.col("provider_review_id")).isNotNull(), F.col("provider_review_id"))
    named = reviews.select(
        *extra,
        F.coalesce(known, F.lit("")).alias("pid"),
        "review_hash",
        pack_hex(F.col("review_hash")).alias("packed"),
        "rating",
        state_digest().alias("digest"),
    )
    pkey = F.when(F.col("pid") == "", F.lit(b"")).otherwise(place_key("p", F.col("pid")))
    return named.withColumns({"hkey": place_key("h", F.col("review_hash")), "pkey": pkey})


def _is_bare() -> Column:
    return F.col("pkey") == F.lit(b"")


def _touched(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Narrow stored rows of the places of ``rows`` that a fingerprint (``hashed``) or a provider id can find.

    The places are staged, so that they are known to be few and the stored rows stay where they are.
    """
    old = _narrow(stored, ["id", "restaurant_id", "created_at"])
    places = cut_lineage(rows.select("restaurant_id").distinct())
    here = old.join(places, "restaurant_id", "left_semi")
    hashed = F.coalesce(F.col("review_hash") != "", F.lit(False))
    named = here.select(*STORED, "restaurant_id", hashed.alias("hashed"))
    return cut_lineage(named).filter(F.col("hashed") | ~_is_bare())  # before, the filter would work the JSON out once more


def _plain_marks(rows: DataFrame, stored: DataFrame, hot_rows: int) -> DataFrame:
    """Hashes ``h64`` of fingerprints to be settled by themselves (``hot`` false) and of those with more than ``hot_rows`` rows (true).

    A fingerprint is settled by itself where all rows and stored rows with it agree on the provider id, no other fingerprint comes with that
    id, and no other one's stored row has the same id as its own. Nothing else can then meet its rows. Keys go by 64-bit hashes; where two
    fingerprints share one, or two provider ids do, these are only found not to be alone. All aggregates are of numbers, combined before the shuffle.
    """
    p64 = F.when(_is_bare(), F.lit(0).cast("long")).otherwise(F.xxhash64("pkey"))
    edge = [F.xxhash64("hkey").alias("h64"), F.xxhash64(F.lit(1), "hkey").alias("check"), p64.alias("p64")]
    old = stored.withColumn("s64", F.xxhash64("restaurant_id", "id"))
    low, high = F.min("h64").alias("low"), F.max("h64").alias("high")
    by_id = old.filter("id IS NOT NULL").select("s64", edge[0]).groupBy("s64").agg(low, high)
    repeated = cut_lineage(by_id.filter("low <> high").select("s64"))
    none = F.lit(0).cast("long").alias("n")
    edges = rows.filter("hkey IS NOT NULL").select(*edge, F.lit(1).cast("long").alias("n")).union(old.select(*edge, none))
    clash = old.join(repeated, "s64", "left_semi").select(*edge[:2], F.bitwise_not(p64).alias("p64"), none)
    by_hash = edges.union(clash).groupBy("h64").agg(
        F.min("p64").alias("p64"), F.max("p64").alias("_p"), F.min("check").alias("_low"), F.max("check").alias("_high"), F.sum("n").alias("n")
    )
    single = by_hash.filter((F.col("p64") == F.col("_p")) & (F.col("_low") == F.col("_high")) & F.col("n").between(1, hot_rows))
    asked = single.filter("p64 <> 0").select("p64", "h64", F.lit(1).alias("asks"))
    by_pid = edges.filter("p64 <> 0").select("p64", "h64", F.lit(0).alias("asks")).union(asked).groupBy("p64").agg(low, high, F.max("asks").alias("asks"))
    alone = by_pid.filter("low = high AND asks = 1").select(F.col("low").alias("h64")).union(single.filter("p64 = 0").select("h64"))
    hot = by_hash.filter(F.col("n") > hot_rows).select("h64", F.lit(True).alias("hot"))
    return cut_lineage(alone.select("h64", F.lit(False).alias("hot")).union(hot))


def _settled_alone(rows: DataFrame, stored: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdicts of the rows whose fingerprint is settled by itself, and the other rows and stored rows.

    Marks, stored rows and rows of a fingerprint meet in one shuffle, in this order, and the row before gives the verdict. Hot fingerprints
    are left to others beforehand.
    """
    marks = _plain_marks(rows, stored, hot_rows)
    h64 = F.xxhash64("hkey").alias("h64")
    new = rows.filter("hkey IS NOT NULL").select(*SEQUENCE, *_EDGE, "digest", h64, F.lit(2).alias("kind"))
    old = stored.select(*STORED, "restaurant_id", "hashed", h64, F.lit(1).alias("kind"))
    every = new.unionByName(old, allowMissingColumns=True)
    hot = hot_groups(marks, ["h64"], 0, marks.filter("hot").select("h64", F.lit(1).alias("_rows")))
    given = mark_hot(every, ["h64"], hot)
    alone = marks.filter("NOT hot").select("h64", F.lit(0).alias("kind"), F.lit(True).alias("alone"))
    met = given.filter(~F.col("_hot")).unionByName(alone, allowMissingColumns=True)
    order = Window.partitionBy("h64").orderBy("kind", "page_index", "pos", "id", "digest", "created_at", "rating")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    target = F.when(F.col("kind") == 1, F.struct("id", "digest", "created_at", "rating"))
    placed = met.withColumns(
        {
            "alone": F.coalesce(F.max("alone").over(so_far), F.lit(False)),
            "target": F.last(target, ignorenulls=True).over(so_far),
            "previous": F.lag("digest").over(order),
            "is_first": F.coalesce(F.lag("kind").over(order) != 2, F.lit(True)),
            "is_last": F.lead("kind").over(order).isNull(),
        }
    )
    alone, of_row = F.col("alone"), _changes()
    judged = placed.filter("kind = 2 OR NOT alone").withColumns(_verdict())
    met = judged.select(
        *SEQUENCE,
        "kind",
        "hashed",
        "alone",
        *[F.when(~alone, F.col(name)).alias(name) for name in (*_EDGE, "digest")],
        F.when(alone, F.col("target.id")).otherwise(F.col("id")).alias("stored_id"),
        F.when(alone, F.col("target.created_at")).otherwise(F.col("created_at")).alias("stored_created"),
        F.when(alone, F.col("target.rating")).otherwise(F.col("rating")).alias("stored_rating"),
        F.when(alone, F.col("status")).alias("status"),
        (alone & of_row).alias("changes"),
    )
    if hot is not None:
        names = {"id": "stored_id", "created_at": "stored_created", "rating": "stored_rating"}
        apart = given.filter("_hot").withColumnsRenamed(names).withColumn("alone", F.lit(False))
        met = met.unionByName(apart.select(*[name for name in met.columns if name in apart.columns]), allowMissingColumns=True)
    met = cut_lineage(met)
    none = F.lit(None).cast("string")
    done = met.filter("alone").select(
        *SEQUENCE,
        none.alias("label"),
        F.lit(True).alias("one_hash"),
        "stored_id",
        "stored_created",
        "stored_rating",
        "status",
        none.alias("reject_reason"),
        "changes",
    )
    left = met.filter("NOT alone")
    old = left.filter("kind = 1").withColumnsRenamed({"stored_id": "id", "stored_created": "created_at", "stored_rating": "rating"})
    return done, left.filter("kind = 2").select(*SEQUENCE, *_EDGE, "digest"), old.select(*STORED, "restaurant_id", "hashed")


def _verdict() -> dict[str, Column]:
    """Status of a plain row from the row before and the stored row ``target``."""
    before = F.when(F.col("is_first"), F.col("target.digest")).otherwise(F.col("previous"))
    status = (
        F.when(F.col("is_first") & F.col("target.id").isNull(), "imported")
        .when(before == F.col("digest"), "skipped")
        .otherwise("updated")
    )
    return {"status": status}


def _changes() -> Column:
    """Whether a row is the last word on its review and differs from what is stored of it."""
    return F.col("is_last") & (F.col("target.id").isNull() | (F.col("target.digest") != F.col("digest")))


def _stored_by(stored: DataFrame, usable: Column, key: str, prefix: str) -> DataFrame:
    """One of the ``usable`` stored rows per key, as a struct named ``prefix``."""
    return stored.filter(usable).groupBy(key).agg(F.max(F.struct(*STORED)).alias(prefix))


def _identities(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Per distinct (fingerprint, provider id) at a place: ``label`` of its identity with its number of rows and the stored row, or
    no label where it is tangled, and the stored rows of both keys.

    Works on distinct pairs, so any number of copies of one review weighs as much as one. Aggregates and not
    windows, as one fingerprint may come with very many provider ids. What has no partner to look at takes no part in a join.
    """
    bare = _is_bare()
    pairs = rows.filter("hkey IS NOT NULL").groupBy("restaurant_id", *_EDGE).agg(F.count(F.lit(1)).alias("n"))
    by_hash = pairs.groupBy("hkey").agg(
        F.count_if(~bare).alias("h_pids"), F.bool_or(bare).alias("h_bare"), F.sum("n").alias("h_rows")
    )
    by_hash = by_hash.join(_stored_by(stored, F.col("hashed"), "hkey", "at_hash"), "hkey", "left")
    seen = cut_lineage(pairs.join(by_hash, "hkey"))
    several_pids = F.col("h_pids") > 1
    named = seen.filter(~bare)
    by_pid = (
        named.groupBy("pkey")
        .agg(
            (F.count(F.lit(1)) > 1).alias("p_spread"),
            F.bool_or(F.col("h_bare") | several_pids).alias("p_shares"),
            F.min("at_hash.id").alias("p_low"),
            F.max("at_hash.id").alias("p_high"),
            F.sum("n").alias("p_rows"),
        )
        .join(_stored_by(stored, ~bare, "pkey", "at_pid"), "pkey", "left")
    )
    both = cut_lineage(named.join(by_pid, "pkey").unionByName(seen.filter(bare), allowMissingColumns=True))
    # What the provider id of a fingerprint knows, for the rows that carry no provider id themselves.
    spread = F.coalesce("p_spread", F.lit(False))
    alone = F.col("h_pids") + F.col("h_bare").cast("int") == 1
    around = both.filter(~alone).groupBy("hkey").agg(F.bool_or(spread).alias("n_spread"), F.max("at_pid").alias("n_pid"))
    lone = both.filter(alone).withColumns({"n_spread": spread, "n_pid": F.col("at_pid")})
    known = both.filter(~alone).join(around, "hkey").unionByName(lone)
    own, other = F.col("at_hash.id"), F.col("n_pid.id")
    stored_agree = (
        other.isNull() | (own == other) | (own.isNull() & ~F.col("h_bare"))
    )
    one_hash = ~several_pids & ~F.col("n_spread") & F.coalesce(stored_agree, F.lit(False))
    at_pid = F.col("at_pid.id")
    hashes_agree = F.col("p_low").isNull() | (
        (F.col("p_low") == at_pid) & (F.col("p_high") == at_pid)
    )
    one_pid = ~bare & F.col("p_spread") & ~F.col("p_shares")
    one_pid = F.coalesce(one_pid & F.coalesce(hashes_agree, F.lit(False)), F.lit(False))
    labelled = known.select(
        "restaurant_id",
        *_EDGE,
        F.when(one_hash, F.col("hkey")).when(one_pid, F.col("pkey")).alias("label"),
        F.when(one_hash, F.col("h_rows")).otherwise(F.col("p_rows")).alias("label_rows"),
        F.coalesce("n_pid", "at_hash").alias("target"),
        "at_pid",
        "at_hash",
    )
    # A stored row that two identities lay claim to ties them together.
    claims = labelled.select(
        "restaurant_id",
        "label",
        F.explode(F.array_distinct(F.array("at_pid.id", "at_hash.id", "target.id"))).alias("stored_id"),
    ).filter(F.col("stored_id").isNotNull())
    contested = (
        claims.groupBy("restaurant_id", "stored_id")
        .agg(
            F.min("label").alias("low"),
            F.max("label").alias("high"),
            F.bool_or(F.col("label").isNull()).alias("tangled"),
        )
        .filter((F.col("low") != F.col("high")) | F.col("tangled"))
        .select("restaurant_id", F.col("stored_id").alias("_stored"), F.lit(True).alias("_contested"))
    )
    # mostly empty: staged, it is known to be small and the pairs stay where they are
    checked = labelled.withColumn("_stored", F.col("target.id")).join(
        cut_lineage(contested), ["restaurant_id", "_stored"], "left"
    )
    tangled = F.col("label").isNull() | F.col("_contested").isNotNull()
    return checked.select(
        *_EDGE,
        F.when(~tangled, F.col("label")).alias("label"),
        "label_rows",
        F.when(~tangled, F.col("target")).alias("target"),
        F.when(tangled, F.struct("restaurant_id", "at_pid", "at_hash")).alias("tangle"),
    )


def _components(edges: DataFrame) -> DataFrame:
    """Add ``linked`` to tangled pairs: those linked by a fingerprint, a provider id or a stored row share it."""

    def stored(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), place_key("s", F.col(name)))

    nodes = F.array_compact(
        F.array(F.col("hkey"), F.when(F.col("pkey") != F.lit(b""), F.col("pkey")), stored("at_pid.id"), stored("at_hash.id"))
    )
    links = edges.select(F.col("hkey").alias("one"), F.explode(nodes).alias("other"))
    found = components(links, "one", "other").select(F.col("node").alias("hkey"), F.col("component").alias("linked"))
    return edges.join(found, "hkey")


def _replay_tangled(rows: DataFrame, pairs: DataFrame, hot_rows: int) -> DataFrame:
    """Verdicts of tangled rows; a conflict rejects what is linked with it."""
    linked = _components(pairs.select(*_EDGE, "tangle.*")).drop("restaurant_id")
    names = [*SEQUENCE, "pid", unpack_hex(F.col("packed")).alias("review_hash"), "digest", "at_pid", "at_hash", "linked"]
    judged = replay(rows.join(linked, _EDGE).select(*names), hot_rows).withColumnRenamed("stored", "target")
    return _settled(judged.withColumn("one_hash", F.lit(None).cast("boolean")))


def _settled(judged: DataFrame) -> DataFrame:
    """The columns that all verdicts share, with the stored row ``target`` taken apart.

    Plain rows have no ``label`` but ``one_hash``, whether their identity goes by the fingerprint or by the provider id.
    """
    return judged.select(
        *SEQUENCE,
        "label",
        "one_hash",
        F.col("target.id").alias("stored_id"),
        F.col("target.created_at").alias("stored_created"),
        F.col("target.rating").alias("stored_rating"),
        "status",
        "reject_reason",
        _changes().alias("changes"),
    )


def _settled_together(rows: DataFrame, left: DataFrame, stored: DataFrame, hot_rows: int) -> DataFrame:
    """Verdicts of the rows ``left``, whose identities depend on several fingerprints or provider ids; ``rows`` are all narrow rows."""
    identities = cut_lineage(_identities(left, stored))
    labelled = identities.filter(F.col("label").isNotNull())
    known = left.join(labelled.select(*_EDGE, "label", "target"), _EDGE)
    plain = with_previous(
        known.select(*SEQUENCE, "digest", "label", "target", (F.col("label") == F.col("hkey")).alias("one_hash")),
        ["label"],
        [F.col("page_index"), F.col("pos")],
        "digest",
        hot_rows,
        labelled.select("label", F.col("label_rows").alias("_rows")).distinct(),
    )
    none = F.lit(None).cast("string")
    settled = _settled(plain.withColumns(_verdict() | {"reject_reason": none, "label": none}))
    tangled = identities.filter(F.col("label").isNull())
    if tangled.isEmpty():
        return settled
    return settled.unionByName(_replay_tangled(rows, tangled, hot_rows))


@dataclass(frozen=True)
class Upserted:
    """``outcomes``: one row per incoming review with ``status`` and ``reject_reason``; ``table``: the new state; ``feed``: what changed."""

    outcomes: DataFrame
    table: DataFrame
    feed: DataFrame


def upsert_reviews(
    incoming: DataFrame, stored: DataFrame, as_of: Column, hot_rows: int = HOT_ROWS
) -> Upserted:
    """Statuses ``imported``, ``updated``, ``skipped`` and ``rejected`` (reason ``key_conflict``).

    ``incoming`` has the sequence columns, unique together, and the columns of ``COMPARED``. The narrow rows are
    cut from their lineage, as several aggregates read them and the JSON should be parsed once.
    """
    rows = cut_lineage(_narrow(incoming, SEQUENCE).drop("review_hash"))
    judged, left, left_stored = _settled_alone(rows, _touched(stored, rows), hot_rows)
    if not left.isEmpty():
        judged = judged.unionByName(_settled_together(rows, left, left_stored, hot_rows))
    changed = judged.filter("changes").drop("changes")

    def new_id(pid: str) -> Column:
        plain_label = F.when(F.col("one_hash"), F.concat(F.lit("h"), "review_hash")).otherwise(F.concat(F.lit("p"), pid))
        return F.coalesce("stored_id", stable_id(F.col("restaurant_id"), F.coalesce("label", plain_label), as_of))

    before = F.when(F.col("stored_id").isNotNull(), image("restaurant_id", "stored_rating"))
    named = rows.select(*SEQUENCE, "rating", unpack_hex(F.col("packed")).alias("review_hash"), "pid")
    feed = feed_rows(changed.join(named, SEQUENCE), new_id("pid"), before, image("restaurant_id", "rating"))
    written = incoming.join(changed, SEQUENCE).withColumns(
        {
            "id": new_id("provider_review_id"),
            "created_at": F.coalesce("stored_created", as_of),
            "updated_at": as_of,
        }
    )
    replaced = changed.filter(F.col("stored_id").isNotNull()).select(F.col("stored_id").alias("id"))
    kept = stored.join(replaced, "id", "left_anti")
    table = model.conform(kept, model.EXT_REVIEWS).unionByName(model.conform(written, model.EXT_REVIEWS))
    return Upserted(judged.select(*SEQUENCE, "status", "reject_reason"), table, feed)


def sync_stats(outcomes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Per place: imported, updated, skipped, rejected, changed and, where pages are given, pages_fetched."""
    counts = outcomes.groupBy("restaurant_id").agg(
        *[
            F.count_if(F.col("status") == status).alias(status)
            for status in ("imported", "updated", "skipped", "rejected")
        ]
    )
    if pages is not None:
        fetched = pages.groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("pages_fetched"))
        counts = fetched.join(counts, "restaurant_id", "left").fillna(
            0, ["imported", "updated", "skipped", "rejected"]
        )
    return counts.withColumn("changed", F.col("imported") + F.col("updated"))


def sync_totals(stats: DataFrame) -> DataFrame:
    """One row of sums over all places; 0 where there are none."""
    names = ["imported", "updated", "skipped", "rejected", "changed"]
    return stats.agg(*[F.coalesce(F.sum(name), F.lit(0).cast("long")).alias(name) for name in names])


@dataclass(frozen=True)
class Synced:
    outcomes: DataFrame
    table: DataFrame
    stats: DataFrame


def pages_of_places(places: DataFrame, landed: DataFrame) -> DataFrame:
    """Landed review pages (target_id, page_index, body) of the places that ask for them."""
    wanted = sync_targets(places).filter(F.col("eligible") & F.col("target_id").isNotNull())
    return wanted.select("restaurant_id", "target_id").join(landed, "target_id").drop("target_id")


def sync_reviews(
    places: DataFrame,
    landed: DataFrame,
    stored: DataFrame,
    as_of: Column,
    max_pages: int = 10,
    default_language: str | None = None,
) -> Synced:
    """Review sync of all given places at once.

    A place with an unreadable page among its fetched ones is left alone as a whole. To sync a selection, hand
    in ``tables.by_ids(places, ids)``.
    """
    fetched = fetched_pages(pages_of_places(places, landed), "restaurant_id", max_pages)
    good = fetched.filter(~F.col("source_failed")).drop("source_failed")
    incoming = typed_reviews(page_items(good, REVIEW_LISTS), default_language)
    result = upsert_reviews(incoming, stored, as_of)
    return Synced(result.outcomes, result.table, sync_stats(result.outcomes, good))


LEDGER = "restaurant_id string, page_index int, digest string, readable boolean, ends boolean, applied boolean"


@dataclass(frozen=True)
class Resynced:
    """``parsed``: the pages whose bodies had to be read as JSON for their facts; ``applied``: those whose reviews were merged.

    ``pages`` are the bodies as they were staged, which only ``table`` reads; whoever has written the table may release them.
    """

    outcomes: DataFrame
    table: DataFrame
    ledger: DataFrame
    parsed: DataFrame
    applied: DataFrame
    pages: DataFrame


def sync_new_pages(
    places: DataFrame,
    landed: DataFrame,
    stored: DataFrame,
    ledger: DataFrame,
    as_of: Column,
    max_pages: int = 10,
    default_language: str | None = None,
) -> Resynced:
    """Review sync that leaves alone what an earlier sync has applied.

    The ``ledger`` (see ``LEDGER``; an empty frame at first) holds a digest and the facts of every page. A page with a known digest is not parsed. Where a
    place has only further pages, these are applied; where a page that was applied has changed, or is no longer reached since the chain
    of tokens now ends before it, all pages of the place are applied again, as older ones may then be the last to speak of a review. The table is
    that of a full sync; a full sync also touches ``updated_at`` of reviews that its own pages change back and forth.
    A place with an unreadable page is left alone and keeps its entries.
    """
    pages = pages_of_places(places, landed).filter(F.col("page_index") < max(1, max_pages))
    # staged, as five steps read the pages, most of them without the bodies
    hashed = cut_lineage(pages.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)), "zstd")
    page = ["restaurant_id", "page_index"]
    ledger = cut_lineage(ledger)
    known = ledger.select(*page, "digest", "readable", "ends")
    old = hashed.join(known, [*page, "digest"])
    new = page_facts(hashed.join(known, [*page, "digest"], "left_anti").select(*page, "digest", "body"))
    facts = cut_lineage(new.select(*page, "digest", "readable", "ends"))
    every = facts.unionByName(old.select(*facts.columns))
    good = cut_lineage(reached_pages(every, "restaurant_id").filter(~F.col("source_failed")).select(*facts.columns))
    before = ledger.filter("applied").select(*page, F.col("digest").alias("_before"))
    there = good.select("restaurant_id").distinct()
    same = before.join(good, page, "left").withColumn("_same", F.coalesce(F.col("digest") == F.col("_before"), F.lit(False)))
    changed = same.join(there, "restaurant_id", "left_semi").filter(~F.col("_same")).select("restaurant_id").distinct()
    fresh = good.join(before, page, "left_anti").join(changed, "restaurant_id", "left_anti")
    applied = cut_lineage(good.join(changed, "restaurant_id", "left_semi").unionByName(fresh).select(*page))
    bodies = hashed.drop("digest").join(applied, page)
    incoming = typed_reviews(page_items(bodies, REVIEW_LISTS), default_language)
    result = upsert_reviews(incoming, stored, as_of)
    # places that were read whole get new entries, others keep theirs and add the facts of pages that were parsed
    kept = ledger.join(there, "restaurant_id", "left_anti")
    looked = every.join(good.select(*page, F.lit(True).alias("applied")), page, "left").withColumn("applied", F.coalesce("applied", F.lit(False)))
    fresh_facts = looked.join(kept.select(*page), page, "left_anti")
    entries = cut_lineage(kept.unionByName(fresh_facts.select(*kept.columns)))
    return Resynced(result.outcomes, result.table, entries, facts.select(*page), applied, hashed)
