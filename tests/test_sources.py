"""Discovery, the parsers and the streams, on files made here."""

import os
import struct
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tomeflow.operators import snapshots
from tomeflow.sources import files
from tomeflow.streaming import queues

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o.opf"/></rootfiles></container>'
OPF = '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> A  title</dc:title><dc:creator>Ann</dc:creator><dc:creator>Bob</dc:creator><dc:language>en</dc:language><dc:identifier>i1</dc:identifier></metadata></package>'
FB2 = '<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><author><first-name>Ann</first-name><last-name>Lee</last-name></author><book-title>Story</book-title><lang>en</lang></title-info></description><body/></FictionBook>'


def epub(path, opf=OPF):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("o.opf", opf)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("root")
    (at / "sub").mkdir()
    epub(at / "sub" / "a.EPUB")
    epub(at / "entity.epub", '<!DOCTYPE x [<!ENTITY e "x">]>' + OPF)
    (at / "b.fb2").write_text(FB2)
    (at / "cut.fb2").write_text(FB2[:60])
    (at / "notes.txt").write_text("x")
    (at / "bad.djvu").write_bytes(b"AT&TFORM" + struct.pack(">I", 100))
    os.symlink(at / "b.fb2", at / "link.fb2")
    return at


def test_discovery(spark, root):
    found = {r.path: r for r in files.discovered(spark, str(root), 3).collect()}
    assert set(found) == {"sub/a.EPUB", "entity.epub", "b.fb2", "cut.fb2", "bad.djvu", "link.fb2"}
    assert found["link.fb2"].problem == "PATH_ESCAPE" and found["sub/a.EPUB"].format == "EPUB" and found["b.fb2"].byte_size == len(FB2)
    assert files.discovered(spark, str(root)).agg(files.coverage_complete(None).alias("c")).first().c


def test_extraction(spark, root):
    found = {r.path: r for r in files.extracted(files.discovered(spark, str(root)), str(root)).collect()}
    a, b = found["sub/a.EPUB"], found["b.fb2"]
    assert (a.state, a.title, a.contributors, a.language) == ("EXTRACTED", "A title", ["Ann", "Bob"], "en") and "i1" in a.identifiers.values()
    assert (b.title, b.contributors, b.language) == ("Story", ["Ann Lee"], "en")
    assert all(found[p].state == "FAILED" and found[p].error_code for p in ("entity.epub", "cut.fb2", "bad.djvu"))


def test_lease_stream(spark, tmp_path):
    rows = [(1, 1, "CLAIM", "a"), (1, 2, "FAIL", "stale"), (1, 3, "COMPLETE", "a"), (2, 1, "CANCEL", None), (2, 2, "CLAIM", "b"), (3, 1, "CLAIM", "c")]
    schema = "task_id long, sequence int, kind string, token string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = queues.folded_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("folded").collect()) == [(1, "SUCCEEDED", 1), (2, "CANCELLED", 0), (3, "RUNNING", 1)]


def files_in_order(spark, tmp_path, batches, schema):
    """A stream that reads one file a micro-batch, in order."""
    at = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(at))
        for f in at.glob("part-*"):
            if f.stat().st_mtime > 1e9 + 1e8:
                os.utime(f, (1e9 + 1000 * k, 1e9 + 1000 * k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at))


def test_leases_expire_by_timer(spark, tmp_path):
    def t(seconds):
        return datetime(2024, 1, 1) + timedelta(seconds=seconds)

    batches = [
        [(1, 1, "CLAIM", "a", t(0)), (2, 1, "CLAIM", "b", t(0)), (3, 1, "CLAIM", "c", t(0))],
        [(2, 2, "HEARTBEAT", "b", t(40)), (9, 1, "CLAIM", "z", t(50))],
        [(9, 2, "HEARTBEAT", "z", t(80))],  # the watermark passes 60, and timers go off in the batch after: tasks 1 and 3 expire
        [(9, 2, "HEARTBEAT", "z", t(85))],
        [(1, 2, "CLAIM", "a2", t(90)), (3, 2, "COMPLETE", "c", t(90))],
        [(9, 3, "HEARTBEAT", "z", t(130))],  # passes 100: task 2 expires
        [(9, 4, "HEARTBEAT", "z", t(200))],  # passes 150: task 1 has used up its attempts
        [(9, 5, "HEARTBEAT", "z", t(230))],
    ]
    stream = queues.leased_stream(files_in_order(spark, tmp_path, batches, "task_id long, sequence int, kind string, token string, at timestamp"), "0 seconds", 60_000, 2)
    stream.writeStream.format("memory").queryName("leases").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)
    seen = [tuple(r) for r in spark.table("leases").collect() if r.task_id != 9]
    assert [r[1:] for r in seen if r[0] == 1] == [("RUNNING", 1, None), ("QUEUED", 1, None), ("RUNNING", 2, None), ("FAILED", 2, "LEASE_EXPIRED")]
    assert [r[1:] for r in seen if r[0] == 2] == [("RUNNING", 1, None), ("RUNNING", 1, None), ("QUEUED", 1, None)]
    assert [r[1:3] for r in seen if r[0] == 3] == [("RUNNING", 1), ("QUEUED", 1), ("QUEUED", 1)]  # a stale token completes nothing


def test_outcomes_and_batches_of_a_stream(spark, tmp_path):
    def t(minutes):
        return datetime(2024, 1, 1) + timedelta(minutes=minutes)

    batches = [[("PROCESSED", t(1)), ("FAILED", t(2)), ("PROCESSED", t(3))], [("PROCESSED", t(40))], [("PROCESSED", t(42))], [("PROCESSED", t(1)), ("PROCESSED", t(41))], [("FAILED", t(90))]]
    given = files_in_order(spark, tmp_path, batches, "state string, at timestamp")
    counts = queues.outcomes_per_window(given, "5 minutes", "10 minutes")
    counts.writeStream.format("memory").queryName("outcomes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)
    found = {(r.start, r.state): r.n for r in spark.table("outcomes").collect()}
    assert found == {(t(0), "PROCESSED"): 2, (t(0), "FAILED"): 1, (t(40), "PROCESSED"): 3}  # the row that came late is left out

    def step(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}"))

    queues.ingested(given, step, str(tmp_path / "d")).awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "out")).count() == sum(map(len, batches))


def test_evidence_grows_and_versions_replace(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    at = str(tmp_path / "evidence")
    snapshots.appended(rows, at, ["k"], [F.col("v")])
    after = snapshots.appended(spark.createDataFrame([(2, "other"), (3, "c"), (3, "d")], rows.schema), at, ["k"], [F.col("v")])
    assert sorted(map(tuple, after.collect())) == [(1, "a"), (2, "b"), (3, "c")]
    at = str(tmp_path / "derived")
    assert snapshots.replaced(rows, at) == 1 and snapshots.replaced(rows.where("k = 2"), at) == 2
    rows.write.parquet(f"{at}/data-left-by-a-failed-writer")
    assert [tuple(r) for r in snapshots.current(spark, at).collect()] == [(2, "b")] and snapshots.current(spark, at, 1).count() == 2
    with pytest.raises(LookupError):
        snapshots.current(spark, str(tmp_path / "none"))
