"""Deep pages, substring search by postings, and one changed set for several tables."""

import random

import pytest
from pyspark.sql import functions as F

from tomeflow.operators import pages, postings, primitives, queue, search, snapshots


@pytest.mark.parametrize("ranges", [None, 7])
def test_every_page_equals_offset(spark, tmp_path, ranges):
    r = random.Random(3)
    rows = [(i, None if i % 17 == 0 else r.choice("abcde") * r.randrange(1, 4)) for i in range(430)]
    df = spark.createDataFrame(rows, "id long, title string").repartition(3)
    order = [F.col("title").asc_nulls_last(), F.col("id")]
    assert pages.sorted_snapshot(df, order, str(tmp_path), ranges) == 1
    whole = df.orderBy(*order).collect()
    for page in (*range(7), 12, 13, 14, 15, 400):
        assert pages.page_of(spark, str(tmp_path), page, 33).collect() == whole[33 * page : 33 * page + 33]
    assert [tuple(x) for x in pages.page_of(spark, str(tmp_path), 4, 50).collect()] == [tuple(x) for x in primitives.offset_page(df, order, 4, 50).collect()]


def test_a_page_reads_its_range_only(spark, tmp_path):
    pages.sorted_snapshot(spark.range(1000), [F.col("id")], str(tmp_path), 20)
    found = pages.page_of(spark, str(tmp_path), 50, 10)
    assert len(found.inputFiles()) == 20 and [r.id for r in found.collect()] == list(range(500, 510))
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "_range" in filters and "PushedFilters" in plan
    read = found.select(F.input_file_name()).distinct().count()
    assert read <= 2
    # a later version doesn't disturb who pages through an older one
    pages.sorted_snapshot(spark.range(5), [F.col("id")], str(tmp_path))
    assert pages.page_of(spark, str(tmp_path), 50, 10, version=1).count() == 10 and pages.page_of(spark, str(tmp_path), 50, 10).count() == 0
    for bad in ((-1, 10), (0, 0), (0, 101)):
        with pytest.raises(ValueError):
            pages.page_of(spark, str(tmp_path), *bad)


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(8)
    rows = [(i % 90, r.choice([None, "r1", "r2"]), "".join(r.choice("abAB é漢_%") for _ in range(r.randrange(0, 60)))) for i in range(400)]
    rows += [(200, "r1", None), (201, "r1", ""), (202, None, "ab" * 150), (203, "r2", "aaaa"), (204, "r1", "Ünïcode ÉTÉ")]
    return spark.createDataFrame(rows, "work_id long, root_id string, text string").repartition(3)


def test_postings_equal_the_scan(spark, texts, tmp_path):
    at, r = str(tmp_path / "index"), random.Random(2)
    postings.indexed(texts, at)
    long = [x.text for x in texts.where("length(text) > 20").collect()]
    queries = ["", " ", "a", "AB", "aba", "aaa", "aaaa", "aaaaa", "été", "ünï", "%", "a_b", "漢", "b é", "ab" * 100, "ab" * 99 + "x", "  Ab  ", "zzz"]
    queries += [t[i : i + n] for t in r.sample(long, 4) for n in (3, 9) for i in (r.randrange(10),)]
    denied = spark.createDataFrame([("r1",)], "root_id string")
    for q in queries:
        scanned = texts.where(primitives.text_contains(F.col("text"), q))
        assert {x.work_id for x in postings.matching(spark, at, q).collect()} == {x.work_id for x in scanned.select("work_id").collect()}, q
    for q in ("aba", "b", ""):
        seen = texts.where(primitives.text_contains(F.col("text"), q)).join(denied, "root_id", "left_anti")
        assert {x.work_id for x in postings.matching(spark, at, q, denied).collect()} == {x.work_id for x in seen.collect()}
    with pytest.raises(ValueError):
        postings.matching(spark, at, "x" * (search.MOST_QUERY + 1))


def test_three_letters_read_no_texts(spark, texts, tmp_path):
    at = str(tmp_path / "index")
    postings.indexed(texts, at)
    found = postings.matching(spark, at, "abab")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("/postings/" in f for f in found.inputFiles()) and "IN (aba,bab)" in plan
    assert "bucket" in plan[plan.index("PartitionFilters: [") :].split("]")[0]


def test_one_changed_set_feeds_both_tables(spark, tmp_path):
    """What changes is drawn at random each time it is computed; jobs and assets agree all the same, and change together."""
    at = str(tmp_path)
    jobs = spark.range(200).select(F.col("id").alias("job_id"), F.lit("RUNNING").alias("state"), F.lit(3).alias("attempts"), F.lit("2024-01-01").cast("timestamp").alias("lease_until"), F.lit("r").alias("root_id"), F.col("id").cast("string").alias("path"), F.lit(None).cast("string").alias("code"))
    assets = spark.range(200).select(F.col("id").alias("asset_id"), F.lit("PENDING").alias("metadata_state"))
    locations = spark.range(200).select(F.col("id").alias("asset_id"), F.lit("r").alias("root_id"), F.col("id").cast("string").alias("path"))
    snapshots.replaced_all({"jobs": jobs, "assets": assets, "locations": locations}, at)

    def some(tables):
        return queue.exhausted(tables["jobs"], F.lit("2024-02-01").cast("timestamp"), 3).where(F.rand() < 0.5)

    results = {"jobs": lambda t, c: queue.jobs_failed(t, c, "PARSE_LIMIT_EXCEEDED"), "assets": lambda t, c: queue.assets_failed(t, locations, c)}
    changed = {r.job_id for r in snapshots.changed_once(spark, at, some, results).collect()}
    version, tables = snapshots.current_all(spark, at)
    failed = {r.job_id for r in tables["jobs"].where("state = 'FAILED_SAFE' and code = 'PARSE_LIMIT_EXCEEDED' and lease_until is null").collect()}
    assert version == 2 and failed == changed == {r.asset_id for r in tables["assets"].where("metadata_state = 'FAILED_SAFE'").collect()}
    assert 50 < len(changed) < 150 and tables["jobs"].count() == 200
