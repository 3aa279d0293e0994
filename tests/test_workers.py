"""Worker queues: the rules in plain loops over one table of jobs, and the batch fold against the stream."""

import random
import time
from datetime import datetime, timedelta

import pytest

from tomeflow.operators import workers
from tomeflow.streaming.workers import PROVIDER, worker_stream

from .test_sources import files_in_order

LOG = "queue string, sequence long, at timestamp, kind string, job_id long, key string, token string, code string"
START = datetime(2024, 1, 1)
LEASE = timedelta(minutes=5)


def random_log(seed, queues=("PDF/1", "COVER/1", "CONVERSION/1"), n=120):
    """Commands whose jobs and tokens are mostly those that are about."""
    r, rows = random.Random(seed), []
    for queue in queues:
        now, jobs, tokens = START, [], []
        for k in range(n):
            now += timedelta(seconds=r.randrange(200))
            kind = r.choice(["ENQUEUE"] * 3 + ["CLAIM"] * 4 + ["HEARTBEAT", "COMPLETE", "COMPLETE", "CANCEL"])
            job, key, token, code = None, None, None, None
            if kind == "ENQUEUE":
                key, job = f"file {r.randrange(12)}", k
                jobs.append(job)
            elif kind == "CLAIM":
                token = f"t{k}"
                tokens.append(token)
            else:
                job, token = r.choice(jobs or [0]), r.choice((tokens or ["x"])[-2:])
                code = r.choice([None, "CORRUPT_ASSET"]) if kind == "COMPLETE" else None
            rows.append((queue, k, now, kind, job, key, token, code))
    return rows


def in_loops(log):
    """One list of jobs a queue, looked through for every command."""
    out = []
    for queue in sorted({r[0] for r in log}):
        kind_of, jobs = queue.split("/")[0], []
        fails = {"CONVERSION": "CONVERSION_CRASHED"}.get(kind_of, "PARSE_LIMIT_EXCEEDED")
        for _, sequence, now, kind, job_id, key, token, code in (r for r in log if r[0] == queue):

            def say(outcome, job=None, said=None, i=None):
                out.append((queue, sequence, outcome, job["id"] if job else i, job and job["state"], job and job["attempts"], job and job["token"], said))

            mine = next((j for j in jobs if j["id"] == job_id), None)
            live = mine and mine["state"] in ("QUEUED", "RUNNING")
            held = mine and mine["state"] == "RUNNING" and mine["token"] == token and mine["until"] > now
            if kind == "ENQUEUE":
                same = next((j for j in jobs if j["key"] == key), None)
                if same is None:
                    jobs.append({"id": job_id, "key": key, "state": "QUEUED", "attempts": 0, "token": None, "until": None, "created": now, "cancel": False})
                    say("QUEUED", jobs[-1])
                elif kind_of == "PDF" and same["state"] == "FAILED_SAFE":
                    same |= {"state": "QUEUED", "attempts": 0, "created": now}
                    say("REQUEUED", same)
                else:
                    say("KNOWN", same)
            elif kind == "CLAIM":
                for j in sorted(jobs, key=lambda j: j["id"]):
                    if j["state"] == "RUNNING" and j["until"] <= now and j["attempts"] >= 3:
                        j |= {"state": "CANCELLED" if j["cancel"] else "FAILED_SAFE", "token": None}
                        say("EXHAUSTED", j, None if j["cancel"] else fails)
                free = [j for j in jobs if j["attempts"] < 3 and not j["cancel"] and (j["state"] == "QUEUED" or j["state"] == "RUNNING" and j["until"] <= now)]
                if free:
                    j = min(free, key=lambda j: (j["created"], j["id"]))
                    j |= {"state": "RUNNING", "attempts": j["attempts"] + 1, "token": token, "until": now + LEASE}
                    say("CLAIMED", j)
                else:
                    say("EMPTY")
            elif kind == "CANCEL" and kind_of == "CONVERSION" and live:
                if mine["state"] == "QUEUED":
                    mine["state"] = "CANCELLED"
                    say("CANCELLED", mine)
                else:
                    mine["cancel"] = True
                    say("CANCELLING", mine)
            elif kind == "HEARTBEAT" and held:
                mine["until"] = now + LEASE
                say("HELD", mine)
            elif kind == "COMPLETE" and held:
                mine |= {"state": "CANCELLED" if mine["cancel"] else "FAILED_SAFE" if code else "SUCCEEDED", "token": None}
                say("COMPLETED", mine, code)
            else:
                say("REFUSED", mine if live else None, i=job_id)
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_loops(spark, seed):
    log = random_log(seed)
    found = rows_of(workers.folded_workers(spark.createDataFrame(log, LOG).repartition(5)))
    assert found == in_loops(log)
    assert {f[2] for f in found} >= {"QUEUED", "REQUEUED", "KNOWN", "CLAIMED", "EXHAUSTED", "COMPLETED", "REFUSED", "HELD", "CANCELLING"}


@pytest.fixture
def rocks(spark):
    was = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    yield spark
    spark.conf.set(PROVIDER[0], was)


def test_stream_equals_batch(rocks, tmp_path):
    log = random_log(11, n=60)
    batches = [[r for r in log if r[1] // 15 == k] for k in range(4)]
    stream = worker_stream(files_in_order(rocks, tmp_path, batches, LOG), clock="log")
    stream.writeStream.format("memory").queryName("workers").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)
    assert rows_of(rocks.table("workers")) == rows_of(workers.folded_workers(rocks.createDataFrame(log, LOG))) == in_loops(log)


def test_timers_end_jobs_that_nobody_claims(rocks, tmp_path):
    rules = {"PDF": workers.Rules("PARSE_LIMIT_EXCEEDED", resets=True, attempts=1, lease=1_000_000)}
    batches = [[("PDF/1", 1, None, "ENQUEUE", 7, "file", None, None), ("PDF/1", 2, None, "CLAIM", None, None, "t", None)]]
    given = files_in_order(rocks, tmp_path, batches, LOG)
    query = worker_stream(given, rules=rules).writeStream.format("memory").queryName("timed").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            seen = [tuple(r)[1:6] for r in rocks.table("timed").collect()]
            if len(seen) > 2:
                break
        assert seen == [(1, "QUEUED", 7, "QUEUED", 0), (2, "CLAIMED", 7, "RUNNING", 1), (0, "EXHAUSTED", 7, "FAILED_SAFE", 1)]
    finally:
        query.stop()
