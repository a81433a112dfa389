"""Change sets: creates, partial updates and deletes of many actors applied in one job.

A change set has a unique ``seq``; the result is what applying its rows one by one in that order gives. Every job
returns the verdict on each row (``accepted`` and ``reject_reason``) and the new table state.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from larder import model
from larder.functions.ids import stable_id
from larder.functions.text import clean_email
from larder.operators import favorites as pairs
from larder.operators.feed import feed_rows, image, no_image
from larder.operators.ordering import first_wins, flag
from larder.session import cut_lineage

# Columns that a place change may set, and the shortest allowed text.
PLACE_FIELDS = ["name", "city", "district", "latitude", "longitude", "website", "phone", "description"]
REVIEW_FIELDS = ["rating", "comment"]
_REQUIRED = {"name", "city", "district", "rating"}
_USERNAME_LENGTH = (3, 50)
_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


@dataclass(frozen=True)
class Changed:
    """``outcomes``: a verdict per request; ``table``: the new state; ``feed``: changed reviews (see ``feed.py``), None for other tables."""

    outcomes: DataFrame
    table: DataFrame
    feed: DataFrame | None = None


def _first_reason(*rules: tuple[Column, str]) -> Column:
    """Reason of the first rule that is broken; an unknown condition does not break a rule."""
    return F.coalesce(*[F.when(broken, F.lit(reason)) for broken, reason in rules])


def _either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _with_actor(requests: DataFrame, users: DataFrame) -> DataFrame:
    actors = users.select(
        F.col("id").alias("actor_id"), F.col("is_active").alias("_active"), F.col("is_admin").alias("_admin")
    )
    return requests.join(actors, "actor_id", "left")


def _actor_rules(admin_only: bool) -> list[tuple[Column, str]]:
    rules = [(F.col("_active").isNull(), "unknown_actor"), (~F.col("_active"), "inactive_actor")]
    return rules + ([(~F.col("_admin"), "forbidden")] if admin_only else [])


def _exists(requests: DataFrame, parents: DataFrame, column: str, name: str) -> DataFrame:
    return flag(requests, parents.select(F.col("id").alias(column)), [column], name)


def _verdicts(judged: DataFrame) -> DataFrame:
    return judged.select(
        "seq", F.col("reject_reason").isNull().alias("accepted"), "reject_reason"
    )


# --- creates ---------------------------------------------------------------------------------------------------


def create_places(requests: DataFrame, users: DataFrame, places: DataFrame, as_of: Column) -> Changed:
    """``requests``: seq, actor_id and the settable columns. Administrators only."""
    limits = model.MAX_LENGTH["places"]
    required = [name for name in PLACE_FIELDS if name in _REQUIRED]
    texts = [name for name in PLACE_FIELDS if name in limits]
    judged = _with_actor(requests, users).withColumn(
        "reject_reason",
        _first_reason(
            *_actor_rules(admin_only=True),
            (_either([F.col(name).isNull() for name in required]), "missing_field"),
            (_either([F.col(name) == "" for name in required]), "too_short"),
            (_either([F.char_length(F.col(name)) > limits[name] for name in texts]), "too_long"),
        ),
    )
    rows = judged.filter(F.col("reject_reason").isNull()).withColumns(
        {"id": stable_id(F.lit("place"), F.col("seq"), as_of), "created_at": as_of, "updated_at": as_of}
    )
    table = places.unionByName(model.conform(rows.select("id", *PLACE_FIELDS, "created_at", "updated_at"), model.PLACES))
    return Changed(_verdicts(judged), table)


def _create_pairs(judged: DataFrame, existing: DataFrame) -> DataFrame:
    """Reject pairs of user and place that exist or that an earlier good row of the batch creates."""
    pair = ["actor_id", "restaurant_id"]
    taken = existing.select(F.col("user_id").alias("actor_id"), "restaurant_id").distinct()
    good = judged.filter(F.col("reject_reason").isNull())
    winners = first_wins(good, pair, ["seq"]).join(taken, pair, "left_anti").select("seq")
    return flag(judged, winners, ["seq"], "_wins").withColumn(
        "reject_reason", F.coalesce("reject_reason", F.when(~F.col("_wins"), F.lit("duplicate")))
    )


def create_reviews(
    requests: DataFrame, users: DataFrame, places: DataFrame, reviews: DataFrame, as_of: Column
) -> Changed:
    """``requests``: seq, actor_id, restaurant_id, rating, comment. One review per user and place."""
    known = _exists(_with_actor(requests, users), places, "restaurant_id", "_place")
    rating = F.col("rating")
    judged = known.withColumn(
        "reject_reason",
        _first_reason(
            *_actor_rules(admin_only=False),
            (rating.isNull() | ~rating.between(model.MIN_RATING, model.MAX_RATING), "bad_rating"),
            (F.char_length("comment") > model.MAX_LENGTH["user_reviews"]["comment"], "too_long"),
            (~F.col("_place"), "no_place"),
        ),
    )
    final = _create_pairs(judged, reviews)
    rows = final.filter(F.col("reject_reason").isNull()).select(
        stable_id(F.lit("review"), F.col("seq"), as_of).alias("id"),
        F.col("actor_id").alias("user_id"),
        "restaurant_id",
        "rating",
        "comment",
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )
    table = reviews.unionByName(model.conform(rows, model.USER_REVIEWS))
    return Changed(_verdicts(final), table, feed_rows(rows, "id", no_image(), image("restaurant_id", "rating")))


def create_favorites(
    requests: DataFrame, users: DataFrame, places: DataFrame, favorites: DataFrame, as_of: Column
) -> Changed:
    """``requests``: seq, actor_id, restaurant_id."""
    known = _exists(_with_actor(requests, users), places, "restaurant_id", "_place")
    judged = known.withColumn(
        "reject_reason",
        _first_reason(*_actor_rules(admin_only=False), (~F.col("_place"), "no_place")),
    )
    final = _create_pairs(judged, favorites)
    rows = final.filter(F.col("reject_reason").isNull()).select(
        stable_id(F.lit("favorite"), F.col("seq"), as_of).alias("id"),
        F.col("actor_id").alias("user_id"),
        "restaurant_id",
        as_of.alias("created_at"),
    )
    return Changed(_verdicts(final), favorites.unionByName(model.conform(rows, model.FAVORITES)))


# --- partial updates -------------------------------------------------------------------------------------------


def _apply_updates(table: DataFrame, good: DataFrame, fields: list[str], as_of: Column) -> DataFrame:
    """Set every field to the last accepted value for it; a field that no row names keeps its value.

    One maximum per field over (seq, value) settles any number of updates of one row before the shuffle.
    """
    kinds = {f.name: f.dataType for f in table.schema.fields}

    def value(name: str) -> Column:
        return F.try_element_at("changes", F.lit(name)).try_cast(kinds[name])

    def named(name: str) -> Column:
        return F.map_contains_key("changes", F.lit(name))

    differs = _either([named(name) & ~value(name).eqNullSafe(F.col(f"_old_{name}")) for name in fields])
    last = good.groupBy("id").agg(
        *[
            F.max(F.when(named(name), F.struct("seq", value(name).alias("value")))).alias(f"_set_{name}")
            for name in fields
        ],
        F.bool_or(differs).alias("_changed"),
    )
    joined = table.join(last, "id", "left")

    def final(name: str) -> Column:
        if name in fields:
            setting = F.col(f"_set_{name}")
            return F.when(setting.isNotNull(), setting["value"]).otherwise(F.col(name)).alias(name)
        if name == "updated_at":
            return F.when(F.col("_changed"), as_of).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return joined.select(*[final(name) for name in table.columns])


def _change_rules(fields: list[str], limits: dict[str, int]) -> list[tuple[Column, str]]:
    def value(name: str) -> Column:
        return F.try_element_at("changes", F.lit(name))

    def cleared(name: str) -> Column:
        return F.map_contains_key("changes", F.lit(name)) & value(name).isNull()

    required = [name for name in fields if name in _REQUIRED]
    texts = [name for name in fields if name in limits]
    return [
        (_either([cleared(name) for name in required]), "null_field"),
        (_either([value(name) == "" for name in required]), "too_short"),
        (_either([F.char_length(value(name)) > limits[name] for name in texts]), "too_long"),
    ]


def update_places(requests: DataFrame, users: DataFrame, places: DataFrame, as_of: Column) -> Changed:
    """``requests``: seq, actor_id, id, changes (map of field to text, NULL clears). Administrators only."""
    old = places.select("id", *[F.col(name).alias(f"_old_{name}") for name in PLACE_FIELDS])
    known = _with_actor(requests, users).join(old.withColumn("_found", F.lit(True)), "id", "left")

    def unreadable(name: str) -> Column:
        text = F.try_element_at("changes", F.lit(name))
        return text.isNotNull() & text.try_cast("double").isNull()

    judged = known.withColumn(
        "reject_reason",
        _first_reason(
            *_actor_rules(admin_only=True),
            *_change_rules(PLACE_FIELDS, model.MAX_LENGTH["places"]),
            (unreadable("latitude") | unreadable("longitude"), "bad_value"),
            (F.col("_found").isNull(), "not_found"),
        ),
    )
    good = judged.filter(F.col("reject_reason").isNull())
    return Changed(_verdicts(judged), _apply_updates(places, good, PLACE_FIELDS, as_of))


def _may_touch() -> Column:
    return (F.col("_owner") == F.col("actor_id")) | F.col("_admin")


def update_reviews(requests: DataFrame, users: DataFrame, reviews: DataFrame, as_of: Column) -> Changed:
    """``requests``: seq, actor_id, id, changes. Owners and administrators; rating and comment only."""
    old = reviews.select(
        "id",
        F.col("user_id").alias("_owner"),
        F.col("restaurant_id").alias("_at"),
        *[F.col(name).alias(f"_old_{name}") for name in REVIEW_FIELDS],
    )
    known = _with_actor(requests, users).join(old, "id", "left")
    rating = F.try_element_at("changes", F.lit("rating"))
    out_of_range = ~F.coalesce(
        rating.try_cast("int").between(model.MIN_RATING, model.MAX_RATING), F.lit(False)
    )
    judged = known.withColumn(
        "reject_reason",
        _first_reason(
            *_actor_rules(admin_only=False),
            *_change_rules(REVIEW_FIELDS, model.MAX_LENGTH["user_reviews"]),
            (rating.isNotNull() & out_of_range, "bad_rating"),
            (F.col("_owner").isNull(), "not_found"),
            (~_may_touch(), "forbidden"),
        ),
    )
    good = judged.filter(F.col("reject_reason").isNull())
    named = F.map_contains_key("changes", F.lit("rating"))
    last = good.groupBy("id").agg(
        F.max(F.when(named, F.struct("seq", rating.try_cast("int").alias("value")))).alias("_set"),
        F.max("_at").alias("_at"),
        F.max("_old_rating").alias("_old"),
    )
    new = F.when(F.col("_set").isNotNull(), F.col("_set.value")).otherwise(F.col("_old"))
    feed = feed_rows(last, "id", image("_at", "_old"), image("_at", new))
    return Changed(_verdicts(judged), _apply_updates(reviews, good, REVIEW_FIELDS, as_of), feed)


# --- deletes ---------------------------------------------------------------------------------------------------


def _delete_once(judged: DataFrame) -> DataFrame:
    """The first good request for an id deletes it; later ones that would have been good find nothing.

    A request that is refused for its actor stays refused only while the row is there.
    """
    good = judged.filter(F.col("reject_reason").isNull())
    first = first_wins(good, ["id"], ["seq"]).select("id", F.col("seq").alias("_deleted_by"))
    gone = F.col("seq") > F.col("_deleted_by")
    looked_up = F.col("reject_reason").isNull() | F.col("_asks_row")
    return judged.join(first, "id", "left").withColumn(
        "reject_reason", F.when(gone & looked_up, F.lit("not_found")).otherwise(F.col("reject_reason"))
    )


def _delete_owned(requests: DataFrame, users: DataFrame, table: DataFrame) -> Changed:
    rating = F.col("rating") if "rating" in table.columns else F.lit(None)
    owners = table.select("id", F.col("user_id").alias("_owner"), image("restaurant_id", rating).alias("_image"))
    known = _with_actor(requests, users).join(owners, "id", "left")
    judged = known.withColumns(
        {
            "reject_reason": _first_reason(
                *_actor_rules(admin_only=False),
                (F.col("_owner").isNull(), "not_found"),
                (~_may_touch(), "forbidden"),
            ),
            # The owner rule is asked after the row was found, so an earlier delete answers first.
            "_asks_row": F.coalesce(F.col("_active"), F.lit(False)),
        }
    )
    final = _delete_once(judged)
    deleted = final.filter(F.col("reject_reason").isNull()).select("id", "_image")
    feed = feed_rows(deleted, "id", F.col("_image"), no_image()) if "rating" in table.columns else None
    return Changed(_verdicts(final), table.join(deleted.select("id"), "id", "left_anti").select(*table.columns), feed)


def delete_reviews(requests: DataFrame, users: DataFrame, reviews: DataFrame) -> Changed:
    """``requests``: seq, actor_id, id. Owners and administrators."""
    return _delete_owned(requests, users, reviews)


def delete_favorites(requests: DataFrame, users: DataFrame, favorites: DataFrame) -> Changed:
    return _delete_owned(requests, users, favorites)


@dataclass(frozen=True)
class Cascade:
    """``removed``: (table_name, removed) per table; ``tables``: the new states; ``gone``: (id) of the deleted places."""

    outcomes: DataFrame
    removed: DataFrame
    tables: dict[str, DataFrame]
    gone: DataFrame


def delete_places(requests: DataFrame, users: DataFrame, tables: dict[str, DataFrame]) -> Cascade:
    """``requests``: seq, actor_id, id. Administrators only; takes dishes, reviews and favorites along.

    The verdicts are cut from their lineage, since every table of the cascade reads them.
    """
    known = _exists(_with_actor(requests, users), tables["places"], "id", "_found")
    judged = known.withColumns(
        {
            "reject_reason": _first_reason(
                *_actor_rules(admin_only=True), (~F.col("_found"), "not_found")
            ),
            "_asks_row": F.lit(False),
        }
    )
    final = cut_lineage(_delete_once(judged))
    gone = final.filter(F.col("reject_reason").isNull()).select("id")
    after, counts = {}, []
    for name, table in tables.items():
        key = "id" if name == "places" else "restaurant_id"
        if name != "places" and name not in model.PLACE_CHILDREN:
            after[name] = table
            continue
        keys = gone.select(F.col("id").alias(key))
        per_place = table.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
        hit = per_place.join(keys, key, "left_semi")
        counts.append(
            hit.agg(F.coalesce(F.sum("_rows"), F.lit(0).cast("long")).alias("removed")).select(
                F.lit(name).alias("table_name"), "removed"
            )
        )
        after[name] = table.join(keys, key, "left_anti").select(*table.columns)
    return Cascade(_verdicts(final), reduce(DataFrame.unionByName, counts), after, gone)


def toggle_favorites(
    requests: DataFrame, users: DataFrame, places: DataFrame, favorites: DataFrame, as_of: Column
) -> Changed:
    """``requests``: seq, actor_id, restaurant_id. A toggle is a create or a delete and obeys the rules of both.

    Only the actor's own pairs are touched, so ownership holds by itself.
    """
    known = _exists(_with_actor(requests, users), places, "restaurant_id", "_place")
    judged = known.withColumn(
        "reject_reason",
        _first_reason(*_actor_rules(admin_only=False), (~F.col("_place"), "no_place")),
    )
    accepted = judged.filter(F.col("reject_reason").isNull())
    asked = accepted.select(F.col("actor_id").alias("user_id"), "restaurant_id")
    table = pairs.toggled(favorites, asked, as_of)
    return Changed(_verdicts(judged), model.conform(table, model.FAVORITES))


# --- registration ----------------------------------------------------------------------------------------------


def _first_two(rows: DataFrame, key: str) -> DataFrame:
    """The two earliest ``seq`` of every ``key``: columns ``first`` and ``second``, the latter NULL where there is one row."""
    first = rows.groupBy(key).agg(F.min("seq").alias("first"))
    later = rows.join(first, key).filter("seq > first").groupBy(key).agg(F.min("seq").alias("second"))
    return first.join(later, key, "left")


def _pointers(pending: DataFrame) -> DataFrame:
    """(seq, to): where exactly one earlier row has the name or the address, that row; the row itself where none has, NULL where several have."""
    by_name = _first_two(pending, "username").withColumnsRenamed({"first": "_n1", "second": "_n2"})
    by_mail = _first_two(pending, "email").withColumnsRenamed({"first": "_m1", "second": "_m2"})
    rows = pending.join(by_name, "username").join(by_mail, "email")
    seq = F.col("seq")
    leads_name, leads_mail = seq == F.col("_n1"), seq == F.col("_m1")
    after_name, after_mail = F.coalesce(seq == F.col("_n2"), F.lit(False)), F.coalesce(seq == F.col("_m2"), F.lit(False))
    to = (
        F.when(leads_name & leads_mail, seq)
        .when(leads_name & after_mail, F.col("_m1"))
        .when(leads_mail & after_name, F.col("_n1"))
        .when(after_name & after_mail & (F.col("_n1") == F.col("_m1")), F.col("_n1"))
    )
    return rows.select("seq", to.alias("to"))


def _alternating(pointers: DataFrame) -> DataFrame:
    """(seq, gets_in) of all rows whose pointers lead to a row that gets in: every second one along the way does.

    Pointers are doubled, so the number of steps is the logarithm of the longest way.
    """
    ways = cut_lineage(pointers.filter("to IS NOT NULL").select("seq", "to", (F.col("seq") != F.col("to")).cast("int").alias("steps")))
    while True:
        onward = ways.select(F.col("seq").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        longer = ways.join(onward, "to", "left").select(
            "seq",
            F.coalesce("_to", "to").alias("to"),
            ((F.col("steps") + F.coalesce("_steps", F.lit(0))) % 2).alias("steps"),
            (F.coalesce("_to", "to") != F.col("to")).alias("_moved"),
        )
        longer = cut_lineage(longer)
        ways = longer.drop("_moved")
        if longer.filter("_moved").isEmpty():
            break
    ends = pointers.filter("seq = to").select(F.col("seq").alias("to"))
    return ways.join(ends, "to", "left_semi").select("seq", (F.col("steps") == 0).alias("gets_in"))


def _accepted_accounts(pending: DataFrame) -> DataFrame:
    """Rows (seq, username, email) that get in when applied in order.

    A row gets in if no earlier row that got in has its name or its address. A row that comes first for both gets in. A row with one
    earlier rival gets in exactly if the rival does not, so chains of such rows are settled at once, by the parity of their way to a row that gets in.
    Rows with several earlier rivals wait for the next round, in which only rivals that may still get in are left.
    """
    accepted = None
    while True:
        pending = cut_lineage(pending)
        if pending.isEmpty():
            break
        settled = cut_lineage(_alternating(_pointers(pending)))
        winners = cut_lineage(pending.join(settled.filter("gets_in"), "seq", "left_semi").select("seq", "username", "email"))
        accepted = winners if accepted is None else accepted.unionByName(winners)
        pending = pending.join(settled, "seq", "left_anti").join(winners.select("username"), "username", "left_anti").join(
            winners.select("email"), "email", "left_anti"
        ).select("seq", "username", "email")
    return pending if accepted is None else accepted


def register_users(requests: DataFrame, users: DataFrame, as_of: Column) -> Changed:
    """``requests``: seq, username, email, hashed_password. The name is checked before the address."""
    shortest, longest = _USERNAME_LENGTH
    length = F.char_length("username")
    cleaned = requests.withColumn("email", clean_email(F.col("email")))
    judged = cleaned.withColumn(
        "reject_reason",
        _first_reason(
            (F.col("username").isNull() | ~length.between(shortest, longest), "bad_username"),
            (F.col("email").isNull() | ~F.col("email").rlike(_EMAIL), "bad_email"),
            (F.char_length("email") > model.MAX_LENGTH["users"]["email"], "too_long"),
        ),
    )
    stored = flag(judged, users.select("username").distinct(), ["username"], "_name_stored")
    stored = flag(stored, users.select("email").distinct(), ["email"], "_mail_stored")
    free = stored.filter(
        F.col("reject_reason").isNull() & ~F.col("_name_stored") & ~F.col("_mail_stored")
    )
    accepted = _accepted_accounts(free.select("seq", "username", "email"))
    holders = accepted.select("username", F.col("seq").alias("_holder"))
    named = stored.join(holders, "username", "left")
    final = flag(named, accepted.select("seq"), ["seq"], "_in").withColumn(
        "reject_reason",
        F.coalesce(
            "reject_reason",
            _first_reason(
                (F.col("_name_stored") | (F.col("_holder") < F.col("seq")), "username_taken"),
                (~F.col("_in"), "email_taken"),
            ),
        ),
    )
    rows = final.filter(F.col("reject_reason").isNull()).select(
        stable_id(F.lit("user"), F.col("seq"), as_of).alias("id"),
        "username",
        "email",
        "hashed_password",
        F.lit(True).alias("is_active"),
        F.lit(False).alias("is_admin"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )
    return Changed(_verdicts(final), users.unionByName(model.conform(rows, model.USERS)))
