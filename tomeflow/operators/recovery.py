"""What is known of merges before they are made (see merging.py), fingerprints, and decisions that two subjects differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .primitives import union_all


def independent(merges: DataFrame) -> DataFrame:
    """merges with `accepted`: false where a subject is merged with itself or occurs in another merge."""
    named = merges.withColumn("merge_id", F.sha2(F.concat_ws("|", F.col("survivor_id").cast("string"), F.col("source_id").cast("string")), 256))
    uses = union_all(*[named.select("merge_id", F.col(c).alias("subject_id")) for c in ("survivor_id", "source_id")]).distinct()
    shared = uses.groupBy("subject_id").agg(F.count("*").alias("n")).where("n > 1").select("subject_id")
    bad = uses.join(shared, "subject_id", "left_semi").select("merge_id").distinct().withColumn("_bad", F.lit(True))
    return named.join(bad, "merge_id", "left").withColumn("accepted", F.col("_bad").isNull() & (F.col("survivor_id") != F.col("source_id"))).drop("_bad")


def conflicting_editions(merges: DataFrame, editions: DataFrame) -> DataFrame:
    """Merges of editions that don't share a work."""
    a = editions.select(F.col("edition_id").alias("survivor_id"), F.col("work_id").alias("_a"))
    b = editions.select(F.col("edition_id").alias("source_id"), F.col("work_id").alias("_b"))
    return merges.join(a, "survivor_id").join(b, "source_id").where("_a <> _b").select(*merges.columns)


def fingerprints(df: DataFrame, owner: str, parts: list[Column], order: list[str]) -> DataFrame:
    """(owner, fingerprint): the rows as `a|b|...`, nulls left out, in order, a line each."""
    row = F.struct(*order, F.concat_ws("|", *parts).alias("_line"))
    return df.groupBy(owner).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["_line"]), "\n").alias("fingerprint"))


def not_same(decisions: DataFrame, requests: DataFrame) -> DataFrame:
    """Decisions after requests (first_id, second_id, rule, rule_version): pairs in order, each once per rule and version."""
    ordered = requests.select(F.least("first_id", "second_id").alias("first_id"), F.greatest("first_id", "second_id").alias("second_id"), "rule", "rule_version").where("first_id <> second_id").distinct()
    keys = ["first_id", "second_id", "rule", "rule_version"]
    return decisions.unionByName(ordered.join(decisions.select(*keys), keys, "left_anti"))
