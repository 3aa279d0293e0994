"""Deep pages of a sorted table: the table is sorted once, into ranges whose first places are known, and a page reads the ranges it lies in.

offset() sorts, or at least passes over, all rows before a page. Here page n costs what page 0 does, and pages of one version
fit together whatever is written meanwhile.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .snapshots import folders, published

_NTH = (1 << 33) - 1  # below it monotonically_increasing_id() counts the rows of a partition


def sorted_snapshot(df: DataFrame, order: list[Column], at: str, ranges: int | None = None) -> int:
    """Writes df in the given total order as the next version of the pages at `at`; returns the version."""
    spark = df.sparkSession
    version, _ = folders(spark, at)
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    rows = dealt.sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_nth": F.monotonically_increasing_id().bitwiseAND(F.lit(_NTH))})
    names = {name: f"{name}-{uuid.uuid4().hex}" for name in ("rows", "ranges")}
    rows.write.partitionBy("_range").parquet(f"{at}/{names['rows']}")
    sizes = spark.read.schema(rows.schema).parquet(f"{at}/{names['rows']}").groupBy("_range").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    sizes.withColumn("first", first).coalesce(1).write.parquet(f"{at}/{names['ranges']}")
    published(spark, at, version + 1, names)
    return version + 1


def page_of(spark: SparkSession, at: str, page: int, size: int, version: int | None = None) -> DataFrame:
    """The rows of one page, in order; page 0 or more, size 1 to 100."""
    if page < 0 or not 1 <= size <= 100:
        raise ValueError("page must be 0 or more and size 1 to 100")
    _, names = folders(spark, at, version)
    if not names:
        raise LookupError(f"no pages at {at}")
    begin, end = page * size, (page + 1) * size
    ranges = spark.read.parquet(f"{at}/{names['ranges']}").where((F.col("first") < end) & (F.col("first") + F.col("n") > begin)).collect()  # `size` at most
    rows = spark.read.parquet(f"{at}/{names['rows']}").where(F.col("_range").isin([r["_range"] for r in ranges]))
    first = F.element_at(F.create_map(*[F.lit(x) for r in ranges for x in (r["_range"], r["first"])]), F.col("_range")) if ranges else F.lit(0)
    placed = rows.withColumn("_place", first + F.col("_nth")).where((F.col("_place") >= begin) & (F.col("_place") < end))
    return placed.orderBy("_place").drop("_range", "_nth", "_place")
