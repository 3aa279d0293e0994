"""Relational building blocks of the catalog. All take and return DataFrames and collect nothing of the data's size."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which driver and executors share. Where it is unset, a local session gets a new one; a cluster can't do without it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tomeflow-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at}/tomeflow/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: With this Spark removes what a query shuffled when the query ends, instead of when the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def released(df: DataFrame, name: str = "table") -> DataFrame:
    """written(), after which nothing that df shuffled is left on disk: steps that follow one another need the disk of the largest, not of all."""
    conf = df.sparkSession.conf
    before = conf.get(RELEASE)
    conf.set(RELEASE, "true")
    try:
        return written(df, name)
    finally:
        conf.set(RELEASE, before)


#: So many rows of a relation that is dealt by keys come to a part, about.
ROWS_A_PART = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of about so many rows, dealt by keys into parts that don't grow with it: at least as many as the session's shuffles have."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_A_PART + 1), *keys)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; Spark prunes before the shuffle (WindowGroupLimit)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def position(keys: list[str], order: list[Column]) -> Column:
    """Places from 0 within each group."""
    return (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int")


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """incoming replaces rows of existing with its keys, at version old + 1, or adds them at version 1.

    incoming has the columns of existing but `version`, one row a key.
    """
    old = existing.select(*keys, F.col("version").alias("_old"))
    fresh = incoming.join(old, keys, "left").withColumn("version", F.coalesce(F.col("_old"), F.lit(0)) + 1).select(existing.columns)
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(fresh)


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of incoming whose keys existing lacks, the first of each key."""
    return first_per_group(incoming, keys, order).join(existing.select(*keys), keys, "left_anti")


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """target with `columns` taken from source where source has the row's key and a value."""
    new = source.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return target.join(new, keys, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns))


def next_ordinal(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column], column: str = "ordinal") -> DataFrame:
    """incoming with places after the last one existing has for the key."""
    last = existing.groupBy(*keys).agg((F.max(column) + 1).alias("_next"))
    return incoming.withColumn("_at", position(keys, order)).join(last, keys, "left").withColumn(column, (F.coalesce("_next", F.lit(0)) + F.col("_at")).cast("int")).drop("_at", "_next")


def ordered_collect(order: list[str], payload: list[str]) -> Column:
    """The group's payloads as an array of structs, sorted by `order`."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in payload if c not in order])))
    return F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in payload]))


def text_contains(column: Column, query: str) -> Column:
    """Substring search without case and without wildcards; a blank query matches all."""
    q = query.strip().lower()
    return F.lit(True) if not q else F.coalesce(F.contains(F.lower(column), F.lit(q)), F.lit(False))


def offset_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    if page < 0 or not 1 <= size <= 100:
        raise ValueError("page must be 0 or more and size 1 to 100")
    return df.orderBy(*order).offset(page * size).limit(size)


def global_places(df: DataFrame, order: list[Column], column: str = "place") -> DataFrame:
    """df with each row's place in the whole order, from 1: rows are sorted within ranges, and ranges begin after the rows before them."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = written(ranges.withColumns({"_range": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}), "places")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_nth").alias("_least"))  # a row a range
    before = sizes.select("_range", "_least", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranges.join(F.broadcast(before), "_range").withColumn(column, F.col("_before") + F.col("_nth") - F.col("_least") + 1).drop("_range", "_nth", "_least", "_before")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def closure(edges: DataFrame, child: str, parent: str, most_rounds: int = 64) -> DataFrame:
    """(start, ancestor) over a graph that may have cycles: every pair once, a node its own ancestor only by a cycle.

    Doubles path lengths each round, so the rounds grow with the logarithm of the longest path; a round's pairs
    are written, which cuts the lineage.
    """
    known = written(edges.select(F.col(child).alias("start"), F.col(parent).alias("ancestor")).where("start is not null and ancestor is not null").distinct(), "closure")
    n = known.count()
    for _ in range(most_rounds):
        step = known.select(F.col("start").alias("via"), F.col("ancestor").alias("above"))
        grown = written(known.unionByName(known.join(step, known.ancestor == step.via).select("start", F.col("above").alias("ancestor"))).distinct(), "closure")
        m = grown.count()
        known = grown
        if m == n:
            return known
        n = m
    raise RuntimeError("the graph has paths longer than 2^most_rounds")


def redirected(df: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """df with `column` replaced by what it was merged into; one hop, chains aren't followed. merges: (id, merged_into_id)."""
    m = merges.where("merged_into_id is not null").select(F.col("id").alias("_id"), F.col("merged_into_id").alias("_to"))
    return df.join(m, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("_to", column)).drop("_id", "_to")
