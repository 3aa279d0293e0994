"""Schemas, value sets and integrity expectations of the catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("EPUB", "FB2", "MOBI", "PDF", "DOCX", "DJVU")
AVAILABILITY = ("AVAILABLE", "MISSING", "UNAVAILABLE")
TASK_STATES = ("QUEUED", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED")
OUTCOME_STATES = ("DISCOVERED", "PROCESSED", "SKIPPED", "FAILED", "DEFERRED")

TABLES = {
    "work": "work_id string, provisional_title string, merged_into_id string, version long",
    "edition": "edition_id string, work_id string, identifiers map<string,string>, version long",
    "asset": "asset_id string, edition_id string, format string, byte_size long, content_hash string, derivation string",
    "asset_location": "location_id string, asset_id string, root_id string, path string, byte_size long, modified_at timestamp, extraction_version string, outcome string, availability string, last_seen string",
    "asset_derivation_source": "derived_id string, source_id string",
    "contributor": "contributor_id string, display_name string, normalized_name string",
    "work_contributor": "work_id string, contributor_id string, role string, ordinal int, version long",
    "metadata_observation": "observation_id string, set_id string, subject_type string, subject_id string, field string, state string, value string, ordinal int, observed_at timestamp",
    "metadata_resolved_value": "subject_type string, subject_id string, field string, outcome string, value string, alternatives array<string>, version long, active boolean, resolved_at timestamp",
    "metadata_curated_override": "subject_type string, subject_id string, field string, state string, value string, version long, active boolean, decided_at timestamp",
    "file_outcome": "job_id string, path string, state string, code string, at timestamp",
    "ingestion_task": "task_id string, job_id string, root_id string, path string, state string, attempts int, lease_token string, lease_until timestamp, sequence long",
    "collection_member": "collection_id string, work_id string, position int, added_at timestamp",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


@dataclass(frozen=True)
class Expectation:
    name: str
    holds: Column


def path_is_clean(path: Column) -> Column:
    """Not empty, relative, no backslash, no empty, `.` or `..` segment."""
    return (F.length(path) > 0) & ~path.rlike(r"(^/|/$|//|\\)") & ~path.rlike(r"(^|/)\.{1,2}(/|$)")


def is_sha256(digest: Column) -> Column:
    return digest.rlike(r"^[0-9a-f]{64}$")


def alias_is_clean(alias: Column) -> Column:
    """A mount's alias: small letters, digits and hyphens, a letter first, 63 characters at most."""
    return alias.rlike(r"^[a-z][a-z0-9-]{0,62}$")


def staged_name_is_clean(name: Column, extension: str) -> Column:
    """A staged file's name: 36 digits and hyphens of an id, and the extension."""
    return name.rlike(rf"^[0-9a-f-]{{36}}\.{extension}$")


def cover_path_is_clean(path: Column) -> Column:
    """A content-addressed cover: its folder is named by the first two digits of its digest."""
    return path.rlike(r"^covers/([0-9a-f]{2})/\1[0-9a-f]{62}\.(jpg|png)$")


def counters_hold(discovered: Column, processed: Column, skipped: Column, failed: Column) -> Column:
    return (processed >= 0) & (skipped >= 0) & (failed >= 0) & (processed + skipped + failed <= discovered)


def lease_iff_running(state: Column, token: Column) -> Column:
    return (state == "RUNNING") == token.isNotNull()


def image_within_bounds(width: Column, height: Column) -> Column:
    return width.between(1, 1600) & height.between(1, 2400) & (width.cast("bigint") * height <= 8_000_000)


def violations(df: DataFrame, key: str, expectations: list[Expectation]) -> DataFrame:
    """(rule, key) for every row and rule that doesn't hold; a rule that is null doesn't hold. One pass over df."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(e.holds, F.lit(False)), F.lit(e.name)) for e in expectations]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).alias("key"))
