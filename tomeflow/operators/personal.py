"""Personal libraries and accounts: favourites, read states, collections, removal, capabilities and denies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .primitives import insert_absent, next_ordinal, position, upsert_latest


def favorites_added(favorites: DataFrame, requests: DataFrame, visible: DataFrame) -> DataFrame:
    """Favourites (user_id, work_id, added_at) with the requests for works that the user may see; a second request changes nothing."""
    allowed = requests.join(visible.select("user_id", "work_id"), ["user_id", "work_id"], "left_semi")
    return favorites.unionByName(insert_absent(favorites, allowed, ["user_id", "work_id"], [F.col("added_at")]))


def favorites_removed(favorites: DataFrame, removals: DataFrame, key: str = "work_id") -> DataFrame:
    """favorites without those of the removals (user_id, key); one that isn't there changes nothing."""
    return favorites.join(removals.select("user_id", key).distinct(), ["user_id", key], "left_anti")


def visible_contributors(visible: DataFrame, links: DataFrame) -> DataFrame:
    """(user_id, contributor_id) of contributors of a work that the user sees (user_id, work_id)."""
    return links.select("work_id", "contributor_id").distinct().join(visible, "work_id").select("user_id", "contributor_id").distinct()


def favorite_contributors(favorites: DataFrame, contributors: DataFrame, visible: DataFrame, links: DataFrame) -> DataFrame:
    """(user_id, contributor_id, display_name, added_at, place) of the favourites (user_id, contributor_id, added_at) that are shown, by name.

    A favourite is shown while its user sees a work of the contributor; only the favourites' own works are looked at.
    """
    works = favorites.select("user_id", "contributor_id").distinct().join(links.select("work_id", "contributor_id").distinct(), "contributor_id")
    seen = works.join(visible, ["user_id", "work_id"], "left_semi").select("user_id", "contributor_id").distinct()
    return _by_name(favorites.join(seen, ["user_id", "contributor_id"], "left_semi"), contributors)


def favorite_contributors_by_class(favorites: DataFrame, contributors: DataFrame, visible: DataFrame, links: DataFrame) -> DataFrame:
    """favorite_contributors() where works are seen by class: visible (user_id, class), links (class, contributor_id). A favourite comes once.

    What is joined has a row for each favourite and class that its user sees, never one for each work of the contributor.
    """
    seen = favorites.join(visible.select("user_id", "class").distinct(), "user_id").join(links.select("class", "contributor_id").distinct(), ["class", "contributor_id"], "left_semi")
    return _by_name(seen.drop("class").dropDuplicates(["user_id", "contributor_id"]), contributors)


def _by_name(shown: DataFrame, contributors: DataFrame) -> DataFrame:
    return shown.join(contributors.select("contributor_id", "display_name"), "contributor_id").withColumn("place", position(["user_id"], [F.lower("display_name"), F.col("contributor_id")]))


def collections_updated(collections: DataFrame, members: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(collections, members, refused) after updates (collection_id, user_id, name, ordered, expected_version), one a collection.

    An update is refused with NOT_FOUND for a collection that isn't the user's, CONFLICT for another version, NAME_EXISTS where
    the user has a collection of that name, without case. A collection that becomes ordered gets places, one that no longer
    is loses them.
    """
    now = collections.select("collection_id", "user_id", F.col("version").alias("_version"), F.col("ordered").alias("_ordered"))
    known = updates.join(now, ["collection_id", "user_id"], "left")
    name = F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))
    others = collections.select("user_id", F.lower("name").alias("_name"), F.col("collection_id").alias("_other"))
    taken = known.withColumn("_name", name).join(others, ["user_id", "_name"]).where("_other <> collection_id").select("collection_id", F.lit(True).alias("_taken")).distinct()
    problem = F.when(F.col("_version").isNull(), "NOT_FOUND").when(F.col("_version") != F.col("expected_version"), "CONFLICT").when(F.col("_taken"), "NAME_EXISTS")
    judged = known.join(taken, "collection_id", "left").withColumn("problem", problem)
    fine = judged.where("problem is null")
    fresh = fine.select("collection_id", F.trim(F.regexp_replace("name", r"\s+", " ")).alias("_name"), F.col("ordered").alias("_to"))
    after = collections.join(fresh, "collection_id", "left").withColumns(
        {"name": F.coalesce("_name", "name"), "ordered": F.coalesce("_to", "ordered"), "version": F.col("version") + F.col("_to").isNotNull().cast("int")}
    )
    placed = made_ordered(members, fine.where("ordered and not _ordered"))
    placed = made_unordered(placed, fine.where("not ordered and _ordered"))
    return after.select(collections.columns), placed, judged.where("problem is not null").select("collection_id", "problem")


def read_states(states: DataFrame, changes: DataFrame, editions: DataFrame) -> DataFrame:
    """Read states (user_id, work_id, edition_id, state, version) after changes; an edition must be the work's."""
    fits = changes.join(editions.select("edition_id", F.col("work_id").alias("_work")), "edition_id", "left").where(F.col("edition_id").isNull() | (F.col("_work") == F.col("work_id"))).drop("_work")
    return upsert_latest(states, fits, ["user_id", "work_id"])


def members_added(members: DataFrame, requests: DataFrame) -> DataFrame:
    """Works appended to ordered collections, after the last place; works that are members stay where they are."""
    fresh = insert_absent(members, requests, ["collection_id", "work_id"], [F.col("added_at")])
    placed = next_ordinal(members, fresh, ["collection_id"], [F.col("added_at"), F.col("work_id")], "position")
    return members.unionByName(placed.select(members.columns))


def members_removed(members: DataFrame, removals: DataFrame) -> DataFrame:
    """The others close up: places from 0 by (position, added_at, work_id)."""
    left = members.join(removals.select("collection_id", "work_id"), ["collection_id", "work_id"], "left_anti")
    return left.withColumn("position", position(["collection_id"], [F.col("position").asc_nulls_last(), F.col("added_at"), F.col("work_id")]))


def made_ordered(members: DataFrame, collections: DataFrame) -> DataFrame:
    """Collections that become ordered get places by (added_at, work_id)."""
    return _toggled(members, collections, position(["collection_id"], [F.col("added_at"), F.col("work_id")]))


def made_unordered(members: DataFrame, collections: DataFrame) -> DataFrame:
    return _toggled(members, collections, F.lit(None).cast("int"))


def _toggled(members: DataFrame, collections: DataFrame, place: Column) -> DataFrame:
    hit = collections.select("collection_id", F.lit(True).alias("_hit"))
    return members.join(hit, "collection_id", "left").withColumn("position", F.when(F.col("_hit"), place).otherwise(F.col("position"))).drop("_hit")


def shown_members(members: DataFrame, visible: DataFrame, owners: DataFrame) -> DataFrame:
    """Members that the collection's owner may see now; hidden ones stay members. Unplaced ones come last."""
    owned = members.join(owners.select("collection_id", "user_id"), "collection_id")
    return owned.join(visible.select("user_id", "work_id"), ["user_id", "work_id"], "left_semi")


def accounts_removed(accounts: DataFrame, removals: DataFrame, personal: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Accounts (user_id, name, status, version) anonymised, and the personal tables without the removed users' rows."""
    gone = removals.select("user_id", F.lit(True).alias("_gone"))
    after = (
        accounts.join(gone, "user_id", "left")
        .withColumn("name", F.when(F.col("_gone"), F.concat(F.lit("removed-"), F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 12))).otherwise(F.col("name")))
        .withColumn("version", F.col("version") + F.coalesce(F.col("_gone"), F.lit(False)).cast("int"))
        .withColumn("status", F.when(F.col("_gone"), "REMOVED").otherwise(F.col("status")))
        .drop("_gone")
    )
    return after, {k: df.join(removals.select("user_id"), "user_id", "left_anti") for k, df in personal.items()}


def authorization_changed(accounts: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Accounts whose grants (user_id, grant) differ get a new authorization_version."""
    old, new = before.select("user_id", "grant").distinct(), after.select("user_id", "grant").distinct()
    differs = old.join(new, ["user_id", "grant"], "left_anti").unionByName(new.join(old, ["user_id", "grant"], "left_anti")).select("user_id").distinct().withColumn("_changed", F.lit(1))
    return accounts.join(differs, "user_id", "left").withColumn("authorization_version", F.col("authorization_version") + F.coalesce("_changed", F.lit(0))).drop("_changed")
