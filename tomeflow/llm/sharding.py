"""Sharding by fixed virtual slots, with DataFrame functions only.

Records are hashed into `slots` virtual slots. The bytes of each slot are summed. A map from slot to shard is stored as
a table with a version: version 1 deals the slots round robin, and rebalancing writes the next version, which is the
newest one edited to the sums, in which only the slots that must move change their shard; every other record stays where
it is. Records are placed by the newest version, as it is read back from where it is stored.

A slot is the hash of the text, so equal texts go together. Only a slot with more than half a shard's share of all bytes, or
of all records, can't stay whole in near equal shards: its records are dealt over all slots by a hash of the row, so even one
text on a third of all rows leaves shards near equal.

Defined results: a null text has no bytes and counts 1, and hashes like the text `null`; equal texts share a slot
unless it is crowded; rows that tie in id, size and checksum are numbered in any order; a text of any length is read
whole; an empty table gives an empty result; extra columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, only, shared_dir, written

SLOTS = 4096
#: A slot is crowded with more than 1 in so many of the bytes, or records, that a shard gets on average.
CROWD = 2
#: Rows that are numbered in one group, about.
GROUP = 4096


def virtual_slot(key: str = "text", slots: int = SLOTS) -> Column:
    return (F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("bigint") % slots).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, records) of the slots that hold records; `slots` rows at most, whatever the input."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def _dealt(moving: DataFrame, base: Column, shards: int) -> DataFrame:
    """Gives slots, heaviest first, each to the shard that is lightest so far.

    moving: one row with `slots`, a sorted array of (less = -bytes, virtual_slot), `slots` entries at most.
    base: the loads to start from, one for each shard.
    """

    def give(acc: Column, slot: Column) -> Column:
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(
            F.transform(acc["loads"], lambda x, i: F.when(i == to, x - slot["less"]).otherwise(x)).alias("loads"),
            F.concat(acc["given"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), to.alias("shard"), (-slot["less"]).alias("bytes")))).alias("given"),
        )

    start = F.struct(base.alias("loads"), F.expr("cast(array() as array<struct<virtual_slot:int,shard:int,bytes:bigint>>)").alias("given"))
    return moving.select(F.inline(F.aggregate("slots", start, give)["given"]))


def _heaviest_first() -> Column:
    return F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))).alias("slots")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map, made before any record is known: (version, virtual_slot, shard, bytes)."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(1).alias("version"), slot.alias("virtual_slot"), (slot % shards).alias("shard"), F.lit(0).cast("bigint").alias("bytes"))


def rebalanced(old: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, for new loads or another number of shards.

    A shard keeps its slots, heaviest first, up to the mean load; what lies above that, new slots and slots of
    shards that are no more are dealt to the lightest shards. All other entries are copied unchanged. Of equally heavy
    slots the one with the smaller number comes first, of equally light shards the first.
    """
    by_shard = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    have = (
        loads.select("virtual_slot", "bytes")
        .join(old.select("virtual_slot", F.when(F.col("shard") < shards, F.col("shard")).alias("shard")), "virtual_slot", "left")
        .crossJoin(F.broadcast(loads.agg((F.sum("bytes") / shards).alias("mean"))))  # one row
        .withColumn("stays", F.col("shard").isNotNull() & (F.sum("bytes").over(by_shard) <= F.greatest("mean", "bytes")))
    )
    kept = have.where("stays").select("virtual_slot", "shard", "bytes")
    filled = kept.groupBy("shard").agg(F.sum("bytes").alias("total")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "total"))).alias("base"))
    base = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.try_element_at(F.col("base"), s), F.lit(0).cast("bigint")))
    moved = _dealt(have.where("not stays").agg(_heaviest_first()).crossJoin(F.broadcast(filled)), base, shards)  # one row each
    version = old.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    return kept.unionByName(moved).crossJoin(F.broadcast(version)).select("version", "virtual_slot", "shard", "bytes")


def stored(slot_map: DataFrame, at: str) -> None:
    """Adds a version to the maps at `at`; those before stay."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(at)


def newest(spark: SparkSession, at: str) -> DataFrame:
    """The newest version of the map that is stored at `at`. Raises if two writers have added one, as records would be placed twice."""
    maps = spark.read.schema("virtual_slot int, shard int, bytes bigint, version int").parquet(at)
    found = maps.where(F.col("version") == maps.agg(F.max("version")).first()[0])
    rows = found.agg(F.count("*").alias("n"), F.countDistinct("virtual_slot").alias("slots")).first()
    if rows.n > rows.slots:
        raise ValueError(f"{at} has two maps of its newest version")
    return found


def _spread(records: DataFrame, slots: int, shards: int) -> DataFrame:
    """records with the virtual slot of those in crowded slots by a hash of the row."""
    loads = slot_bytes(records)
    most = loads.agg(*(F.greatest(F.lit(1), F.sum(c) / (CROWD * shards)).alias(f"most_{c}") for c in ("bytes", "records")))  # one row
    crowded = loads.crossJoin(F.broadcast(most)).where("(bytes > most_bytes or records > most_records) and records > 1").select(F.col("virtual_slot").alias("crowded"))
    at = F.when(F.col("crowded").isNotNull(), F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(slots)).cast("int")).otherwise(F.col("virtual_slot"))
    return records.join(F.broadcast(crowded), F.col("virtual_slot") == F.col("crowded"), "left").withColumn("virtual_slot", at).drop("crowded")  # `slots` rows at most


def sharded(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_at: str | None = None) -> DataFrame:
    """Every document with its shard and its place there.

    map_at: where the map is stored; its newest version is edited. Without one, a new map is begun.

    `slot` numbers the rows of a shard from 0 without a gap: the rows of its groups before, plus the rank in the
    group. Groups are parts of virtual slots, of about GROUP rows each, so no task sorts more than that at once.
    """
    spark = docs.sparkSession
    records = only(docs, "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("bigint").alias("text_crc32"),
        virtual_slot("text", slots).alias("virtual_slot"),
        F.monotonically_increasing_id().alias("row"),
    )
    hashed = written(records, "shard-records")
    records = written(_spread(hashed, slots, shards), "shard-spread")
    dropped(hashed)
    loads = slot_bytes(records)
    if map_at is None:
        map_at = f"{shared_dir(spark)}/tomeflow/shard-map-{uuid.uuid4().hex}"
        stored(first_map(spark, shards, slots), map_at)
    stored(rebalanced(newest(spark, map_at), loads, shards), map_at)
    placed = newest(spark, map_at).select("virtual_slot", "version", "shard")

    parts = loads.select(F.col("virtual_slot").alias("of"), F.ceil(F.col("records") / GROUP).alias("parts"))
    grouped = records.join(F.broadcast(parts), F.col("virtual_slot") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int")).drop("of", "parts")  # `slots` rows at most
    before = (
        grouped.groupBy("virtual_slot", "part")
        .agg(F.count("*").alias("records"))
        .join(F.broadcast(placed), "virtual_slot")  # `slots` rows at most
        .withColumn("first", F.coalesce(F.sum("records").over(Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("virtual_slot", "part", "version", "shard", "first")
    )
    ranked = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "size", "text_crc32", "row")))
    return ranked.join(before, ["virtual_slot", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("rank") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )
