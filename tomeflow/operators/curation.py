"""Curation: title overrides with undo, tags, contributor names, and a work's curation document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import collapsed
from .primitives import first_per_group, insert_absent, ordered_collect, upsert_latest

MOST_TAGS = 50
MOST_ALIASES = 100


def folded_overrides(edits: DataFrame) -> DataFrame:
    """(subject_id, value, version, active) after all edits (subject_id, sequence, kind SET or UNDO, value).

    Every SET is a new version that remembers the one it replaced. UNDO brings back, as a new version, what the
    current one replaced; undoing the first leaves none, undoing an undo brings back what was undone. UNDO without a
    current version is a conflict: it changes nothing and is counted in `conflicts`.
    """
    ordered = F.array_sort(F.collect_list(F.struct("sequence", "kind", "value")))
    start = F.struct(F.expr("cast(array() as array<struct<value:string,prior:int>>)").alias("versions"), F.lit(-1).alias("current"), F.lit(0).alias("conflicts"))

    def step(s: Column, e: Column) -> Column:
        n = F.size(s["versions"])
        prior = F.when(s["current"] >= 0, F.get(s["versions"], s["current"])["prior"]).otherwise(F.lit(-1))
        undo = e["kind"] == "UNDO"
        back = undo & (prior >= 0)
        added = F.struct(F.when(undo, F.get(s["versions"], prior)["value"]).otherwise(e["value"]).alias("value"), s["current"].alias("prior"))
        grows = ~undo | back
        return F.struct(
            F.when(grows, F.concat(s["versions"], F.array(added))).otherwise(s["versions"]).alias("versions"),
            F.when(grows, n).otherwise(F.lit(-1)).cast("int").alias("current"),
            (s["conflicts"] + (undo & (s["current"] < 0)).cast("int")).alias("conflicts"),
        )

    state = edits.groupBy("subject_id").agg(F.aggregate(ordered, start, step).alias("s"))
    active = F.col("s.current") >= 0
    return state.select("subject_id", F.when(active, F.get(F.col("s.versions"), F.col("s.current"))["value"]).alias("value"), F.size("s.versions").cast("long").alias("version"), active.alias("active"), F.col("s.conflicts").alias("conflicts"))


def accepted_edits(edits: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """edits with `accepted`: whether the version they expect is the snapshot's (0 where it has none)."""
    now = snapshot.select(key, F.col("version").alias("_version"))
    return edits.join(now, key, "left").withColumn("accepted", F.coalesce("_version", F.lit(0)) == F.col("expected_version")).drop("_version")


def _required(texts: Column, what: str, letters: int, most: int) -> Column:
    """Texts collapsed, without repetition, in order. A text that is missing, blank or too long, or too many texts, are refused."""
    bad = F.exists(texts, lambda x: F.coalesce(F.length(collapsed(x)) == 0, F.lit(True)) | (F.length(x) > letters))
    clean = F.array_distinct(F.transform(texts, collapsed))
    refused = F.raise_error(F.lit(f"{what}: each has 1 to {letters} characters, and there are {most} at most")).cast("array<string>")
    return F.when(texts.isNull() | bad | (F.size(clean) > most), refused).otherwise(clean)


def normalized_tags(tags: Column) -> Column:
    """Collapsed, exact repetitions left out, in order; more than MOST_TAGS are refused."""
    return _required(tags, "tags", 100, MOST_TAGS)


def replaced_tags(tags: DataFrame, work_tags: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog tags, work tags) after commands (work_id, names). Tags are found by lower-case name, or made."""
    wanted = commands.select("work_id", F.posexplode(normalized_tags(F.col("names"))).alias("at", "name")).withColumn("normalized_name", F.lower("name"))
    made = insert_absent(tags, wanted.select("name", "normalized_name", "at", "work_id"), ["normalized_name"], [F.col("work_id"), F.col("at")])
    all_tags = tags.unionByName(made.select(F.sha2(F.concat(F.lit("tag|"), "normalized_name"), 256).alias("tag_id"), "name", "normalized_name"))
    now = wanted.join(all_tags.select("tag_id", "normalized_name"), "normalized_name").select("work_id", "tag_id").distinct()
    return all_tags, work_tags.join(commands.select("work_id"), "work_id", "left_anti").unionByName(now)


def renamed_contributors(contributors: DataFrame, aliases: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contributors, aliases) after commands (contributor_id, display_name, aliases).

    aliases: (contributor_id, name, normalized_name, origin, version). Curated aliases that a command leaves out
    go, observed ones stay; the others are inserted or get a new version. More than MOST_ALIASES are refused.
    """
    new_names = commands.select("contributor_id", collapsed(F.col("display_name")).alias("_name"))
    renamed = contributors.join(new_names, "contributor_id", "left").withColumn("display_name", F.coalesce("_name", "display_name")).withColumn("normalized_name", F.lower("display_name")).drop("_name")
    wanted = commands.select("contributor_id", F.posexplode(_required(F.col("aliases"), "aliases", 1000, MOST_ALIASES)).alias("at", "name")).withColumn("normalized_name", F.lower("name"))
    wanted = first_per_group(wanted, ["contributor_id", "normalized_name"], [F.col("at")]).select("contributor_id", "name", "normalized_name", F.lit("CURATED").alias("origin"))
    keys = ["contributor_id", "normalized_name"]
    dropped = aliases.where("origin = 'CURATED'").join(commands.select("contributor_id"), "contributor_id", "left_semi").join(wanted.select(*keys), keys, "left_anti").select(*keys)
    return renamed, upsert_latest(aliases.join(dropped, keys, "left_anti"), wanted, keys)


#: Audit events that a curator is shown of a work, the newest first.
MOST_AUDIT = 100


def curation_documents(works: DataFrame, titles: DataFrame, contributors: DataFrame, tags: DataFrame, reviews: DataFrame, history: DataFrame | None = None, audit: DataFrame | None = None) -> DataFrame:
    """A row for each work with everything a curator sees, nested: contributors, tags and open reviews in order.

    history: (work_id, version, value, active) of its titles, the newest first; audit: (work_id, at, event), of which the
    newest MOST_AUDIT are shown.
    """

    def nested(df: DataFrame, order: list[str], payload: list[str], name: str) -> DataFrame:
        return df.groupBy("work_id").agg(ordered_collect(order, payload).alias(name))

    documents = (
        works.join(titles, "work_id", "left")
        .join(nested(contributors, ["ordinal", "contributor_id"], ["contributor_id", "role"], "contributors"), "work_id", "left")
        .join(nested(tags, ["name"], ["name"], "tags"), "work_id", "left")
        .join(nested(reviews, ["field", "kind"], ["field", "kind"], "reviews"), "work_id", "left")
    )
    if history is not None:
        documents = documents.join(nested(history.withColumn("_newest", -F.col("version")), ["_newest"], ["version", "value", "active"], "history"), "work_id", "left")
    if audit is not None:
        newest = audit.withColumn("_nth", F.row_number().over(Window.partitionBy("work_id").orderBy(F.col("at").desc(), "event"))).where(F.col("_nth") <= MOST_AUDIT)
        documents = documents.join(nested(newest, ["_nth"], ["at", "event"], "audit"), "work_id", "left")
    return documents


def open_reviews(reviews: DataFrame, visible: DataFrame, most: int) -> DataFrame:
    """The oldest open reviews (review_id, state, subject_type, subject_id, created_at) of subjects that a user sees; most: 1 to 100."""
    if not 1 <= most <= 100:
        raise ValueError("a list of reviews has 1 to 100 entries")
    seen = visible.select("subject_type", "subject_id").distinct()
    return reviews.where("state = 'OPEN'").join(seen, ["subject_type", "subject_id"], "left_semi").orderBy("created_at", "review_id").limit(most)
