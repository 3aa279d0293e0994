"""Queues that isolated workers are served from: one log of commands a queue, folded into states of jobs.

A queue is served strictly in order, so its commands meet in one group; work is spread by having many queues (a format and a
root each, say). The rules stand in step(), once: folded_workers() applies them to a log in batch, and
streaming.workers to a stream. They see jobs through mappings, so that the stream's may be Spark's own state.

Commands (queue, sequence, at, kind, job_id, key, token, code):

* ENQUEUE: a job for the file that `key` names. A file that has a job already gets none: it is KNOWN. Where the queue
  resets, a job that failed is put back with no attempts, as if it were new: REQUEUED.
* CLAIM: first, leases that have run out and whose job has used up its attempts are ended (EXHAUSTED). Then the oldest job
  that is queued, or whose lease has run out, by time of its enqueuing and id, is leased under the token: CLAIMED, or EMPTY.
* HEARTBEAT, COMPLETE (with a code: it failed): REFUSED unless the job runs under this token and the lease hasn't run out.
* CANCEL, where the queue may be cancelled: a queued job ends, a running one does when its worker or its lease does.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rules(NamedTuple):
    """code: of a job whose attempts are used up; lease: in microseconds."""

    code: str
    resets: bool = False
    cancels: bool = False
    attempts: int = 3
    lease: int = 300_000_000


RULES = {"PDF": Rules("PARSE_LIMIT_EXCEEDED", resets=True), "COVER": Rules("PARSE_LIMIT_EXCEEDED"), "CONVERSION": Rules("CONVERSION_CRASHED", cancels=True)}


class Job(NamedTuple):
    """created, lease: microseconds; lease 0 without one."""

    key: str | None
    state: str
    attempts: int
    token: str | None
    lease: int
    created: int
    cancelled: bool


class Command(NamedTuple):
    sequence: int
    at: int
    kind: str
    job_id: int | None
    key: str | None
    token: str | None
    code: str | None


#: What a command did to a job; the job is None where the command found none.
Outcome = tuple[int, str, int | None, Job | None, str | None]  # sequence, outcome, job_id, job, code
OUTCOME = "queue string, sequence long, outcome string, job_id long, state string, attempts int, token string, code string"


class Jobs(NamedTuple):
    """active: job_id -> Job of those queued or running; ended: of the others; keys: key -> job_id."""

    active: MutableMapping[int, Job]
    ended: MutableMapping[int, Job]
    keys: MutableMapping[str, int]


def end(jobs: Jobs, job_id: int, job: Job, state: str) -> Job:
    job = job._replace(state=state, token=None, lease=0)
    del jobs.active[job_id]
    jobs.ended[job_id] = job
    return job


def exhausted(jobs: Jobs, rules: Rules, sequence: int, now: int) -> Iterator[Outcome]:
    """Ends the jobs whose lease has run out with their attempts used up, in order of their ids."""
    over = sorted(i for i, j in list(jobs.active.items()) if j.state == "RUNNING" and j.lease <= now and j.attempts >= rules.attempts)
    for i in over:
        cancelled = rules.cancels and jobs.active[i].cancelled
        yield sequence, "EXHAUSTED", i, end(jobs, i, jobs.active[i], "CANCELLED" if cancelled else "FAILED_SAFE"), None if cancelled else rules.code


def step(jobs: Jobs, rules: Rules, command: Command) -> Iterator[Outcome]:
    """Carries out a command; says what became of it and of the jobs it touched."""
    sequence, now, kind, job_id, key, token, code = command
    if kind == "ENQUEUE":
        known = jobs.keys.get(key)
        if known is None:
            job = Job(key, "QUEUED", 0, None, 0, now, False)
            jobs.active[job_id], jobs.keys[key] = job, job_id
            yield sequence, "QUEUED", job_id, job, None
            return
        job = jobs.ended.get(known)
        if job is not None and job.state == "FAILED_SAFE" and rules.resets:
            job = Job(key, "QUEUED", 0, None, 0, now, False)
            del jobs.ended[known]
            jobs.active[known] = job
            yield sequence, "REQUEUED", known, job, None
        else:
            yield sequence, "KNOWN", known, job or jobs.active[known], None
        return
    if kind == "CLAIM":
        yield from exhausted(jobs, rules, sequence, now)
        free = [(j.created, i) for i, j in list(jobs.active.items()) if j.attempts < rules.attempts and (j.state == "QUEUED" or j.lease <= now) and not (rules.cancels and j.cancelled)]
        if not free:
            yield sequence, "EMPTY", None, None, None
            return
        _, i = min(free)
        job = jobs.active[i]._replace(state="RUNNING", token=token, lease=now + rules.lease)
        jobs.active[i] = job = job._replace(attempts=job.attempts + 1)
        yield sequence, "CLAIMED", i, job, None
        return
    job = jobs.active.get(job_id)
    if kind == "CANCEL" and rules.cancels and job is not None:
        if job.state == "QUEUED":
            yield sequence, "CANCELLED", job_id, end(jobs, job_id, job, "CANCELLED"), None
        else:
            jobs.active[job_id] = job = job._replace(cancelled=True)
            yield sequence, "CANCELLING", job_id, job, None
    elif kind in ("HEARTBEAT", "COMPLETE") and job is not None and job.state == "RUNNING" and job.token == token and job.lease > now:
        if kind == "HEARTBEAT":
            jobs.active[job_id] = job = job._replace(lease=now + rules.lease)
            yield sequence, "HELD", job_id, job, None
        elif rules.cancels and job.cancelled:
            yield sequence, "COMPLETED", job_id, end(jobs, job_id, job, "CANCELLED"), code
        else:
            yield sequence, "COMPLETED", job_id, end(jobs, job_id, job, "FAILED_SAFE" if code else "SUCCEEDED"), code
    else:
        yield sequence, "REFUSED", job_id, job, None


def rules_of(queue: str, rules: dict[str, Rules]) -> Rules:
    """A queue's rules by the part of its name before a slash."""
    return rules[queue.split("/")[0]]


def commands(rows, now: int | None = None) -> Iterator[Command]:
    """Commands from a pandas frame, in order of their sequence; now: the time of those that have none."""
    rows = rows.sort_values("sequence", kind="stable")
    for sequence, at, kind, job_id, key, token, code in zip(rows.sequence, rows["at"], rows.kind, rows.job_id, rows.key, rows.token, rows.code, strict=True):
        yield Command(int(sequence), now if at != at or at is None else int(at.value // 1000), kind, None if job_id is None or job_id != job_id else int(job_id), key, token, code)


def as_frame(queue: str, outcomes: list[Outcome]):
    import pandas as pd

    rows = [(queue, sequence, outcome, i, job and job.state, job and job.attempts, job and job.token, code) for sequence, outcome, i, job, code in outcomes]
    frame = pd.DataFrame(rows, columns=[f.split()[0] for f in OUTCOME.split(", ")])
    return frame.astype({"sequence": "int64", "job_id": "Int64", "attempts": "Int32"})


def folded_workers(log: DataFrame, rules: dict[str, Rules] = RULES) -> DataFrame:
    """What became of every command of the log, and of the jobs that claims swept: OUTCOME's columns."""

    def fold(key, rows):
        jobs, own = Jobs({}, {}, {}), rules_of(key[0], rules)
        return as_frame(key[0], [o for c in commands(rows) for o in step(jobs, own, c)])

    return log.select("queue", "sequence", F.col("at").cast("timestamp_ntz").alias("at"), "kind", "job_id", "key", "token", "code").groupBy("queue").applyInPandas(fold, OUTCOME)
