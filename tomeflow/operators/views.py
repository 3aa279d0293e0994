"""Resolved and displayed values as stored tables that are kept up with the evidence.

Evidence and overrides are appended in batches. refresh() looks at the batches since the last refresh, recomputes the subjects
and fields that they touch from their whole history, and publishes the next version of both tables together with the number of
the batch it has come to. Both are stored in buckets by subject; buckets without a touched subject keep their folders
and aren't read. The tables are those that a full computation gives, whatever the batches.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .evidence import SUBJECT, displayed, facts, resolved, superseded
from .primitives import written
from .snapshots import appended, folders, grown, published, versions

BUCKETS = 64
#: Columns of the appended tables. An override is named by its version; the last one of a subject and field counts.
OBSERVATION = "subject_type string, subject_id {id}, field string, value string, observation_id string, observed_at timestamp, state string"
OVERRIDE = "subject_type string, subject_id {id}, field string, state string, value string, version long, active boolean, decided_at timestamp"
RESOLVED = "subject_type string, subject_id {id}, field string, outcome string, value string, alternatives array<string>, version long, active boolean, resolved_at timestamp"
DISPLAY = "subject_type string, subject_id {id}, field string, value string, source string"


class Views(NamedTuple):
    """Stored tables below the folder `at`; subject ids are of the type `id`."""

    spark: SparkSession
    at: str
    id: str = "long"

    def _none(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema.format(id=self.id))

    def observe(self, rows: DataFrame) -> None:
        """Appends observations; those whose id is known change nothing."""
        none = self._none(OBSERVATION)
        appended(rows.select(none.columns).to(none.schema), f"{self.at}/observations", ["observation_id"], [F.col("observed_at")])

    def override(self, rows: DataFrame) -> None:
        """Appends curated values, each with a version of its own."""
        none = self._none(OVERRIDE)
        appended(rows.select(none.columns).to(none.schema), f"{self.at}/overrides", [*SUBJECT, "version"], [F.col("decided_at")])

    def _folders(self) -> tuple[int, dict[str, str]]:
        return folders(self.spark, f"{self.at}/views")

    def _stored(self, name: str, schema: str, names: dict[str, str], buckets: list[int] | None = None) -> DataFrame:
        known = [f"{self.at}/views/{folder}" for key, folder in names.items() if key.startswith(f"{name}-") and (buckets is None or int(key.split("-")[1]) in buckets)]
        none = self._none(schema)
        return self.spark.read.schema(none.schema).parquet(*sorted(known)) if known else none

    def resolved(self) -> DataFrame:
        """All versions of resolved values, the active ones among them."""
        return self._stored("resolved", RESOLVED, self._folders()[1])

    def display(self) -> DataFrame:
        return self._stored("display", DISPLAY, self._folders()[1])

    def refresh(self, now: Column) -> int:
        """Brings both tables up to the batches appended so far; returns how many subjects and fields were recomputed."""
        version, names = self._folders()
        until = {kind: versions(self.spark, f"{self.at}/{kind}").agg(F.max("version")).first()[0] or 0 for kind in ("observations", "overrides")}
        done = {kind: int(names.get(f"through_{kind}", 0)) for kind in until}
        if done == until:
            return 0

        def rows(kind: str, schema: str, after: int = 0) -> DataFrame:
            return grown(self.spark, f"{self.at}/{kind}", self._none(schema), after, until[kind])

        fresh = [rows("observations", OBSERVATION, done["observations"]), rows("overrides", OVERRIDE, done["overrides"])]
        bucket = F.pmod(F.xxhash64(*SUBJECT), F.lit(BUCKETS)).cast("int")
        touched = written(fresh[0].select(*SUBJECT).union(fresh[1].select(*SUBJECT)).distinct().withColumn("bucket", bucket), "touched")
        buckets = sorted(r.bucket for r in touched.select("bucket").distinct().collect())  # BUCKETS at most
        keys = touched.select(*SUBJECT)

        def only(df: DataFrame) -> DataFrame:
            return df.join(keys, SUBJECT, "left_semi")

        observed = only(rows("observations", OBSERVATION))
        before, shown = self._stored("resolved", RESOLVED, names, buckets), self._stored("display", DISPLAY, names, buckets)
        after = written(superseded(only(before), resolved(facts(observed)), now), "resolved")
        curated = only(rows("overrides", OVERRIDE)).groupBy(*SUBJECT).agg(F.max_by(F.struct("state", "value", "version", "active", "decided_at"), "version").alias("o")).select(*SUBJECT, "o.*")
        fresh_display = displayed(curated, after, observed)
        parts = {"resolved": before.join(keys, SUBJECT, "left_anti").unionByName(after), "display": shown.join(keys, SUBJECT, "left_anti").unionByName(fresh_display)}
        for name, df in parts.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            df.withColumn("bucket", bucket).repartition(len(buckets), "bucket").write.partitionBy("bucket").parquet(f"{self.at}/views/{folder}")
            names |= {f"{name}-{b}": f"{folder}/bucket={b}" for b in buckets}
            # a bucket that has no rows has no folder
            held = {r.bucket for r in self.spark.read.parquet(f"{self.at}/views/{folder}").select("bucket").distinct().collect()}
            names = {k: v for k, v in names.items() if not (k.startswith(f"{name}-") and int(k.split("-")[1]) in set(buckets) - held)}
        published(self.spark, f"{self.at}/views", version + 1, names | {f"through_{kind}": str(n) for kind, n in until.items()})
        return touched.count()
