"""Observed evidence: from extracted records to observations, facts, resolved values, reviews and display values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import collapsed, contributor_role, with_facts
from .primitives import first_per_group, insert_absent, union_all

SUBJECT = ["subject_type", "subject_id", "field"]
MOST_OPEN_REVIEWS = 1000
#: What facts are made by. Facts of another name or version stay in their table and count no more.
NORMALIZER = ("metadata", "1")


def unpivot(extracted: DataFrame) -> DataFrame:
    """Observations of extracted records: (set_id, subject_type, subject_id, field, value, ordinal).

    extracted: set_id, subject_type, subject_id, title, contributors, language, identifiers, extra, format. Blank
    values are left out; the keys of maps are in order.
    """
    key = ["set_id", "subject_type", "subject_id"]

    def entries(prefix: str, column: str) -> Column:
        sorted_keys = F.array_sort(F.map_keys(column))
        return F.transform(sorted_keys, lambda k: F.struct(F.concat(F.lit(prefix), k).alias("field"), F.element_at(column, k).alias("value"), F.lit(0).alias("ordinal")))

    def single(field: str, column: str) -> Column:
        return F.array(F.struct(F.lit(field).alias("field"), F.col(column).alias("value"), F.lit(0).alias("ordinal")))

    people = F.transform("contributors", lambda x, i: F.struct(F.lit("contributor").alias("field"), x.alias("value"), i.alias("ordinal")))
    extra = F.flatten(F.transform(F.array_sort(F.map_keys("extra")), lambda k: F.transform(F.element_at("extra", k), lambda x, i: F.struct(k.alias("field"), x.alias("value"), i.alias("ordinal")))))
    parts = [single("title", "title"), people, single("language", "language"), entries("identifier:", "identifiers"), extra, single("format", "format")]
    rows = extracted.select(*key, F.inline(F.flatten(F.array_compact(F.array(*parts)))))
    return rows.where(F.length(F.trim("value")) > 0)


def facts(observations: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Every observation, or those of `fields`, with its normalised fact: valid, value, type, confidence, problem, and what it was made by."""
    wanted = observations if fields is None else observations.where(F.col("field").isin(fields))
    name, version = NORMALIZER
    return with_facts(wanted.withColumnRenamed("value", "observed"), fields=fields).withColumns({"normalizer": F.lit(name), "normalizer_version": F.lit(version)})


def facts_added(stored: DataFrame, observations: DataFrame) -> DataFrame:
    """stored facts with those of the observations that the current normaliser hasn't seen: new ones, and all once its version changes."""
    name, version = NORMALIZER
    seen = stored.where((F.col("normalizer") == name) & (F.col("normalizer_version") == version)).select("observation_id")
    return stored.unionByName(facts(observations.join(seen, "observation_id", "left_anti")).select(stored.columns))


def resolved(fact: DataFrame) -> DataFrame:
    """(subject_type, subject_id, field, outcome, value, alternatives, confidence): over the whole history of observations.

    Facts of the current normaliser count. No valid value: ABSENT; one: PRESENT, of HIGH confidence; several: CONFLICT
    without a value, alternatives the latest observation of each value, by value. Otherwise confidence is UNKNOWN.
    """
    name, version = NORMALIZER
    current = fact.where((F.col("normalizer") == name) & (F.col("normalizer_version") == version))
    resolvable = current.where("field in ('title', 'language') or startswith(field, 'identifier:')")
    latest = resolvable.groupBy(*SUBJECT, F.when(F.col("valid"), F.col("value")).alias("value")).agg(F.max(F.struct("observed_at", "observation_id"))["observation_id"].alias("latest"))
    merged = latest.groupBy(*SUBJECT).agg(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "latest")))).alias("found"))
    n = F.size("found")
    return merged.select(
        *SUBJECT,
        F.when(n == 0, "ABSENT").when(n == 1, "PRESENT").otherwise("CONFLICT").alias("outcome"),
        F.when(n == 1, F.col("found")[0]["value"]).alias("value"),
        F.when(n > 1, F.transform("found", lambda x: x["latest"])).alias("alternatives"),
        F.when(n == 1, "HIGH").otherwise("UNKNOWN").alias("confidence"),
    )


def superseded(previous: DataFrame, current: DataFrame, at: Column) -> DataFrame:
    """The resolved values after a run: a new version only where outcome or value changed.

    previous: version, active and resolved_at besides the columns of resolved(). Old versions stay, inactive.
    """
    old = previous.where("active").select(*SUBJECT, F.col("outcome").alias("_outcome"), F.col("value").alias("_value"), F.col("version").alias("_version"))
    both = current.join(old, SUBJECT, "left")
    changed = both.where(F.col("_version").isNull() | (F.col("outcome") != F.col("_outcome")) | ~F.col("value").eqNullSafe(F.col("_value")))
    fresh = changed.select(*SUBJECT, "outcome", "value", "alternatives", (F.coalesce("_version", F.lit(0)) + 1).cast("long").alias("version"), F.lit(True).alias("active"), at.alias("resolved_at"))
    kept = previous.join(fresh.select(*SUBJECT, F.lit(True).alias("_new")), SUBJECT, "left").withColumn("active", F.col("active") & F.col("_new").isNull()).drop("_new")
    return kept.unionByName(fresh)


def reviews(fact: DataFrame, resolution: DataFrame, open_reviews: DataFrame | None = None, most: int = MOST_OPEN_REVIEWS) -> DataFrame:
    """New review items (kind, subject_type, subject_id, field, observation_id, sequence), as many as `most` leaves room for.

    INVALID_VALUE for each observation that isn't valid, CONFLICT for each conflicting subject and field. Items
    are taken in order of subject, field and observation: each task keeps its first ones, and those meet.
    """
    invalid = fact.where("not valid").select(F.lit("INVALID_VALUE").alias("kind"), *SUBJECT, "observation_id")
    conflict = resolution.where("outcome = 'CONFLICT'").select(F.lit("CONFLICT").alias("kind"), *SUBJECT, F.lit("").alias("observation_id"))
    items = invalid.unionByName(conflict)
    keys = ["kind", *SUBJECT, "observation_id"]
    room = most
    if open_reviews is not None:
        items = insert_absent(open_reviews, items, keys, [F.col("observation_id")])
        room = max(0, most - open_reviews.count())
    return items.orderBy("subject_type", "subject_id", "field", "observation_id", "kind").limit(room)


def displayed(overrides: DataFrame, resolution: DataFrame, observations: DataFrame) -> DataFrame:
    """(subject_type, subject_id, field, value, source): active curated before active resolved before observed.

    Ties go to the newest, then to the greatest id. A curated ABSENT and a conflict have no value and still win.
    """
    ranked = union_all(
        overrides.where("active").select(*SUBJECT, F.when(F.col("state") == "PRESENT", F.col("value")).alias("value"), F.lit("CURATED").alias("source"), F.lit(1).alias("rank"), F.col("decided_at").alias("at"), F.col("version").cast("string").alias("id")),
        resolution.where("active").select(*SUBJECT, "value", F.lit("RESOLVED").alias("source"), F.lit(2).alias("rank"), F.col("resolved_at").alias("at"), F.col("version").cast("string").alias("id")),
        observations.where("state = 'PRESENT'").select(*SUBJECT, "value", F.lit("OBSERVED").alias("source"), F.lit(3).alias("rank"), F.col("observed_at").alias("at"), F.col("observation_id").alias("id")),
    )
    return first_per_group(ranked, SUBJECT, [F.col("rank"), F.col("at").desc_nulls_last(), F.col("id").desc_nulls_last()]).select(*SUBJECT, "value", "source")


def linked_contributors(observations: DataFrame, aliases: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, new contributors) after contributor observations (work_id, field, value, ordinal, observed_at, observation_id).

    A name is looked up among the aliases (work_id, normalized_name, contributor_id) of contributors on the same
    work only; other names become new contributors, one for each work and name. A place (work, role, observed ordinal)
    belongs to the observation that names it last; each one counts as a version, after those that `links`, the
    places there are, have already: (work_id, role, ordinal, contributor_id, observation_id, version).
    """
    place = ["work_id", "role", "ordinal"]
    named = observations.select("work_id", contributor_role(F.col("field")).alias("role"), collapsed(F.col("value")).alias("display_name"), "ordinal", "observed_at", "observation_id")
    named = named.where("display_name <> ''").withColumn("normalized_name", F.lower("display_name"))
    known = first_per_group(aliases, ["work_id", "normalized_name"], [F.col("contributor_id")]).select("work_id", "normalized_name", F.col("contributor_id").alias("known"))
    fresh_id = F.sha2(F.concat_ws("|", F.lit("contributor"), F.col("work_id").cast("string"), "normalized_name"), 256)
    found = named.join(known, ["work_id", "normalized_name"], "left").withColumn("contributor_id", F.coalesce("known", fresh_id))
    last = F.max(F.struct("observed_at", "observation_id", "contributor_id")).alias("last")
    placed = found.groupBy(*place).agg(last, F.count("*").alias("version")).select(*place, "last.contributor_id", "last.observation_id", "version")
    if links is not None:
        before = links.select(*place, F.col("version").alias("_before"))
        placed = placed.join(before, place, "left").withColumn("version", F.col("version") + F.coalesce("_before", F.lit(0))).drop("_before")
        placed = links.join(placed.select(*place), place, "left_anti").unionByName(placed)
    fresh = first_per_group(found.where("known is null"), ["contributor_id"], [F.col("observed_at"), F.col("observation_id")]).select("contributor_id", "display_name", "normalized_name")
    return placed, fresh


def seen_range(observations: DataFrame, keys: list[str], at: str) -> DataFrame:
    """observations with the first and last time their key was seen."""
    w = Window.partitionBy(*keys)
    return observations.withColumn("first_seen", F.min(at).over(w)).withColumn("last_seen", F.max(at).over(w))
