"""Substring search by postings of three letters, equal to the scan of search.matching_works().

Every text is lower-cased and each run of three code points in it becomes a posting with its place. A query of three letters or
more reads the postings of its own runs only: the table is stored by bucket of the run and sorted by it. A text matches where all
runs of the query stand at consecutive places, which is what containing the query means, so no text is read. Shorter
queries can't be told by such runs; they scan.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .primitives import text_contains
from .search import MOST_QUERY

BUCKETS = 256
LENGTH = 3
#: Stored beside each posting, and what a text is given with: its work, the root it comes from or null, the text.
TEXTS = ("work_id", "root_id", "text")


def _bucket(gram):
    return F.pmod(F.crc32(gram), F.lit(BUCKETS)).cast("int")


def indexed(texts: DataFrame, at: str) -> None:
    """Writes the postings of texts (work_id, root_id, text) to `at`, and the texts themselves for short queries."""
    texts.select(*TEXTS).write.parquet(f"{at}/texts")
    stored = texts.sparkSession.read.parquet(f"{at}/texts")
    lower = stored.where("text is not null").select("work_id", "root_id", F.monotonically_increasing_id().alias("text_id"), F.lower("text").alias("_lower"))
    runs = lower.select("work_id", "root_id", "text_id", "_lower", F.explode(F.sequence(F.lit(1), F.length("_lower") - (LENGTH - 1))).alias("place")).where(F.length("_lower") >= LENGTH)
    postings = runs.select(F.substring("_lower", F.col("place"), F.lit(LENGTH)).alias("gram"), "text_id", "place", "work_id", "root_id").withColumn("bucket", _bucket(F.col("gram")))
    postings.repartition("bucket", F.pmod(F.xxhash64("text_id"), F.lit(8))).sortWithinPartitions("bucket", "gram", "text_id", "place").write.partitionBy("bucket").parquet(f"{at}/postings")


def matching(spark: SparkSession, at: str, query: str, denied_roots: DataFrame | None = None) -> DataFrame:
    """(work_id) of the works with a text that contains the query, in any case; blank queries match every text's work.

    denied_roots (root_id): texts that come from there don't count. A text without a root is seen by all.
    """
    if len(query) > MOST_QUERY:
        raise ValueError(f"a query has at most {MOST_QUERY} characters")
    wanted = query.strip().lower()
    grams = [wanted[i : i + LENGTH] for i in range(len(wanted) - LENGTH + 1)]
    if not grams:
        found = spark.read.parquet(f"{at}/texts").where(text_contains(F.col("text"), query))
    else:
        buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})
        read = spark.read.parquet(f"{at}/postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(sorted(set(grams))))
        asked = spark.createDataFrame(list(enumerate(grams)), "nth int, gram string")
        placed = read.join(F.broadcast(asked), "gram").select("text_id", "work_id", "root_id", (F.col("place") - F.col("nth")).alias("start"))  # MOST_QUERY rows
        found = placed.groupBy("text_id", "start", "work_id", "root_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    if denied_roots is not None:
        found = found.join(denied_roots.select("root_id"), "root_id", "left_anti")
    return found.select("work_id").distinct()
