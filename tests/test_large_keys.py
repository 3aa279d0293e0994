"""Queries against their SQL on made-up tables: keys beyond those of the smallest tables, names that many rows share."""

import os
import random
import time
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tomeflow.operators import merging, primitives

SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp",
    "part": "p_partkey long, p_brand string, p_type string",
    "supplier": "s_suppkey long, s_name string",
    "customer": "c_custkey long",
    "labels": "doc_id long, quality int, toxic int",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """120 orders with keys from 2^16 - 60, of 30 customers, for 40 parts by 25 suppliers."""
    at, r, first = str(tmp_path_factory.mktemp("tables")), random.Random(5), 2**16 - 60
    orders = [(first + i, r.randrange(30), datetime(2024, 1, 1 + i % 28)) for i in range(120)]
    rows = {
        "lineitem": [(r.choice(orders)[0], r.randrange(40), r.randrange(25), r.randrange(1, 8)) for _ in range(600)],
        "orders": orders,
        "part": [(i, f"b{i % 5}", f"t{i % 7}") for i in range(40)],
        "supplier": [(i, f"Name {i % 9}") for i in range(25)],
        "customer": [(i,) for i in range(30)],
        "labels": [(i, i % 2, i % 3) for i in range(40)],
    }
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows[name], schema).write.parquet(f"{at}/{name}.parquet")
    return at


def check(spark, tables, name):
    df = __spark_entry__.queries()[name](spark, tables)
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in SCHEMAS:
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    columns = sorted(df.columns)
    result = con.execute(f"select {', '.join(columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, result)) == sorted(repr(tuple(x)) for x in df.select(*columns).collect())
    return df


def test_uuids_of_orders_with_long_keys(spark, tables):
    assert check(spark, tables, "identifier_forms").where("l_orderkey >= 65536").count() > 100


def test_favourites_never_meet_all_works(spark, tables):
    """The plan has a row for each favourite and class that its user sees; users times works, or favourites times works, are in no join."""
    df = check(spark, tables, "favorite_contributors")
    assert not {"part", "customer"} & {f.split("/")[-2].removesuffix(".parquet") for f in df.inputFiles()}


@pytest.mark.parametrize("name", ["contributor_works"])
def test_parts_follow_the_rows(spark, tables, monkeypatch, name):
    """With few partitions a shuffle, what is dealt by keys still comes in parts of bounded size."""
    monkeypatch.setattr(primitives, "ROWS_A_PART", 50)
    df = check(spark, tables, name)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and df.select(F.spark_partition_id()).distinct().count() > 4


def test_lines_are_grouped_once(spark, tables):
    """What merges look at is read from what was written, not made of the order lines again for each table."""
    df = check(spark, tables, "merged_contributors")
    assert not any("/lineitem.parquet/" in f for f in df.inputFiles())


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_many_merges_are_not_sent_to_all(spark):
    """Of 70,000 merges nothing is gathered in the driver, of a few their subjects are."""
    many = spark.range(70_000).select(F.col("id").alias("operation_id"), (F.col("id") * 2).alias("survivor_id"), (F.col("id") * 2 + 1).alias("source_id"))
    schemas = {
        "edition": "edition_id long, work_id long, version long, merged_into_id long",
        "asset": "edition_id long, asset_id long, version long",
        "edition_contributor": "edition_id long, contributor_id long, role string, ordinal int",
        "edition_identifier": "edition_id long, identifier_id long, scheme string, observed_value string",
        "user_work_read_state": "user_id long, work_id long, completed_edition_id long, completed_at date, version long",
    }
    catalog = {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}
    for merges, sent in ((many, False), (many.where("operation_id < 9"), True)):
        tables = [spark.range(140_000).withColumnRenamed("id", "edition_id").join(catalog[n], "edition_id", "left").select(catalog[n].columns) for n in ("edition", "asset")]
        after = merging.merged(catalog | dict(zip(("edition", "asset"), tables, strict=True)), "EDITION", merges)
        assert {"strategy=broadcast" in planned(after[name]) for name in ("edition", "asset")} == {sent}


def test_undos_are_previewed_one_type_at_a_time(spark, tables):
    """The result is read from what each type's own job wrote; one plan doesn't hold the joins of all three."""
    assert "Join" not in planned(check(spark, tables, "undo_allowed"))


def test_merged_tables_are_written_one_by_one(spark, tables):
    assert "Join" not in planned(check(spark, tables, "merged_editions"))


def test_released_leaves_no_shuffle_files(spark):
    def files():
        local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in local for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before = files()
    df = primitives.released(spark.range(100_000).groupBy((F.col("id") % 5000).alias("k")).count(), "sums")
    assert df.count() == 5000 and spark.conf.get(primitives.RELEASE) == "false"
    df = primitives.released(df.repartition(7, "k"), "dealt")
    end = time.time() + 20
    while (left := {f.split("_")[1] for f in files() - before}) and len(left) > 1 and time.time() < end:
        time.sleep(0.2)
    assert len(left) <= 1 and df.count() == 5000  # that of count()
