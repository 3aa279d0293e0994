"""Ingestion as snapshot functions: change detection, reconciliation, availability sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import title_from_path
from .primitives import first_per_group, union_all


def same_time(a: Column, b: Column) -> Column:
    """Within a microsecond."""
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) <= 1


def detected_changes(candidates: DataFrame, locations: DataFrame, version: str) -> DataFrame:
    """candidates (root_id, path, byte_size, modified_at) with action SKIP, PDF_QUEUE or EXTRACT."""
    known = locations.select("root_id", "path", F.col("byte_size").alias("_size"), F.col("modified_at").alias("_at"), F.col("extraction_version").alias("_version"), F.col("outcome").alias("_outcome"))
    unchanged = F.coalesce((F.col("byte_size") == F.col("_size")) & same_time(F.col("modified_at"), F.col("_at")) & (F.col("_version") == version) & (F.col("_outcome") != "FAILED_SAFE"), F.lit(False))
    action = F.when(unchanged, "SKIP").when(F.lower("path").endswith(".pdf"), "PDF_QUEUE").otherwise("EXTRACT")
    return candidates.join(known, ["root_id", "path"], "left").withColumn("action", action).drop("_size", "_at", "_version", "_outcome")


def natural_id(kind: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(kind), "root_id", "path", F.col("byte_size").cast("string"), F.unix_micros("modified_at").cast("string")), 256)


def reconciled(locations: DataFrame, batch: DataFrame, job: str) -> dict[str, DataFrame]:
    """The catalog rows after a batch of extracted files (root_id, path, byte_size, modified_at, extraction_version, format, title).

    A file with exactly the size and time of its location updates it in place; any other gets a new work, edition and
    asset, to which the location is pointed. Nothing is matched across files. locations: with asset_id, location_id.
    """
    batch = first_per_group(batch, ["root_id", "path"], [F.col("modified_at").desc(), F.col("byte_size").desc()])
    old = locations.select("root_id", "path", "location_id", "asset_id", F.col("byte_size").alias("_size"), F.col("modified_at").alias("_at"))
    both = batch.join(old, ["root_id", "path"], "left")
    same = F.coalesce((F.col("byte_size") == F.col("_size")) & (F.col("modified_at") == F.col("_at")), F.lit(False))
    both = both.withColumn("same", same).withColumn("asset_id", F.when(F.col("same"), F.col("asset_id")).otherwise(natural_id("asset"))).withColumn("location_id", F.coalesce("location_id", F.sha2(F.concat_ws("|", F.lit("location"), "root_id", "path"), 256)))
    fresh = both.where("not same")
    seen = both.select("location_id", "asset_id", "root_id", "path", "byte_size", "modified_at", "extraction_version", F.lit("PROCESSED").alias("outcome"), F.lit("AVAILABLE").alias("availability"), F.lit(job).alias("last_seen"))
    kept = locations.join(batch.select("root_id", "path"), ["root_id", "path"], "left_anti").select(seen.columns)
    return {
        "location": kept.unionByName(seen),
        "work": fresh.select(natural_id("work").alias("work_id"), F.coalesce("title", title_from_path(F.col("path"))).alias("provisional_title")),
        "edition": fresh.select(natural_id("edition").alias("edition_id"), natural_id("work").alias("work_id")),
        "asset": fresh.select("asset_id", natural_id("edition").alias("edition_id"), "format", "byte_size"),
        "observation_set": both.select(F.sha2(F.concat_ws("|", F.lit("set"), F.lit(job), "root_id", "path"), 256).alias("set_id"), "asset_id"),
    }


def swept(locations: DataFrame, job: str, complete: bool) -> DataFrame:
    """After a scan that covered everything, locations it hasn't seen are MISSING; a location never seen is, too."""
    if not complete:
        return locations
    return locations.withColumn("availability", F.when(F.col("last_seen").eqNullSafe(F.lit(job)), F.col("availability")).otherwise("MISSING"))


def final_outcomes(outcomes: DataFrame) -> DataFrame:
    """The last state of each job and path."""
    return first_per_group(outcomes, ["job_id", "path"], [F.col("at").desc(), F.col("sequence").desc()])


def job_counters(final: DataFrame) -> DataFrame:
    """(job_id, discovered, processed, skipped, failed). Found and deferred files count as discovered only."""
    return final.groupBy("job_id").agg(
        F.count("*").alias("discovered"),
        *[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("PROCESSED", "SKIPPED", "FAILED")],
    )


def inventory(locations: DataFrame, edges: DataFrame) -> DataFrame:
    """The exported list of what is where and what derives from what."""
    return union_all(
        locations.select(F.lit("LOCATION").alias("kind"), F.col("root_id").alias("a"), F.col("path").alias("b"), F.col("availability").alias("c")),
        edges.select(F.lit("LINEAGE").alias("kind"), F.col("child").cast("string").alias("a"), F.col("parent").cast("string").alias("b"), F.lit("").alias("c")),
    )
