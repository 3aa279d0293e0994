"""Work queues as deterministic functions of state, commands and a given time. tomeflow.streaming folds events with the same rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .primitives import first_per_group, insert_absent

ACTIVE = ("QUEUED", "RUNNING")
CAPACITY = 256


def scans_enqueued(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests (root_id, requested_at, job_id) that become jobs: the first for each root without an active job."""
    return insert_absent(jobs.where(F.col("state").isin(*ACTIVE)), requests, ["root_id"], [F.col("requested_at"), F.col("job_id")])


def scan_claimed(jobs: DataFrame, now: Column, stale: Column) -> DataFrame:
    """The job to work on next: the oldest that is queued, or runs without having discovered all and has no recent heartbeat."""
    eligible = (F.col("state") == "QUEUED") | (F.col("state") == "RUNNING") & ~F.col("discovery_complete") & (F.col("heartbeat_at") < now - stale)
    return jobs.where(eligible).orderBy("requested_at", "job_id").limit(1)


def enqueued(tasks: DataFrame, incoming: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """incoming (job_id, key, sequence, ...) with its decision: ENQUEUED, DUPLICATE or FULL.

    What is in the queue already is refused before room is counted; with no room left even duplicates are refused
    as FULL. Room is taken in order of sequence. Only as many rows as there is room for are ranked.
    """
    active = tasks.where(F.col("state").isin(*ACTIVE)).count()
    room = max(0, capacity - active)
    if not room:
        return incoming.withColumn("decision", F.lit("FULL"))
    fresh = insert_absent(tasks, incoming, ["job_id", "key"], [F.col("sequence")])
    taken = fresh.orderBy("sequence", "job_id", "key").limit(room).select("job_id", "key", "sequence", F.lit("ENQUEUED").alias("_taken"))
    last = taken.agg(F.max("sequence").alias("last"), F.count("*").alias("n"))
    first = fresh.select("job_id", "key", "sequence", F.lit(True).alias("_first"))
    return (
        incoming.join(taken, ["job_id", "key", "sequence"], "left")
        .join(first, ["job_id", "key", "sequence"], "left")
        .crossJoin(F.broadcast(last))  # one row
        .withColumn("decision", F.when(F.col("_taken").isNotNull(), F.col("_taken")).when((F.col("n") >= room) & (F.col("sequence") > F.col("last")), "FULL").otherwise(F.when(F.col("_first"), "FULL").otherwise("DUPLICATE")))
        .drop("_taken", "_first", "last", "n")
    )


def expired(tasks: DataFrame, now: Column, most_attempts: int) -> DataFrame:
    """Tasks after leases that ran out: back to the queue, or failed after the last attempt."""
    over = (F.col("state") == "RUNNING") & (F.col("lease_until") < now)
    last = F.col("attempts") >= most_attempts
    return (
        tasks.withColumn("_over", F.coalesce(over, F.lit(False)))
        .withColumn("code", F.when(F.col("_over") & last, "LEASE_EXPIRED"))
        .withColumn("state", F.when(F.col("_over"), F.when(last, "FAILED").otherwise("QUEUED")).otherwise(F.col("state")))
        .withColumn("lease_until", F.when(~F.col("_over"), F.col("lease_until")))
        .drop("_over")
    )


def claimable(tasks: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Tasks that may be claimed: queued or with a lease that ran out, of jobs (job_id, state, cancel_requested) that run and aren't cancelled."""
    live = jobs.where("state = 'RUNNING' and not cancel_requested").select("job_id")
    return tasks.where((F.col("state") == "QUEUED") | (F.col("state") == "RUNNING") & (F.col("lease_until") < now)).join(live, "job_id", "left_semi")


def fair_claims(tasks: DataFrame, jobs: DataFrame, schedule: DataFrame, now: Column, share: int, n: int, most_attempts: int) -> DataFrame:
    """What the next n single claims at `now` take, in order: (task_id, root_id, turn, outcome CLAIMED or EXHAUSTED).

    A claim serves the root that was served longest ago (never: first), then the one with the least claim_sequence, then
    the least id, and takes its oldest task by (sequence, task_id). While more than one root has something to claim, a
    root that runs `share` tasks under a valid lease is passed over. A task whose attempts are used up fails instead of
    running, which counts as a claim.

    schedule: (root_id, last_claimed_at, claim_sequence). Each claim sets the first to `now` and adds one to the second,
    so a root's claims have rising keys, and the single claims' order is that of all roots' keys. Roots whose share
    holds them back stay so while another has something to claim; a root that is alone in this goes on after
    all others. Of each root only the first n tasks are ranked.
    """
    open_tasks = claimable(tasks, jobs, now)
    running = tasks.where((F.col("state") == "RUNNING") & (F.col("lease_until") >= now)).groupBy("root_id").agg(F.count("*").alias("running"))
    by_root = Window.partitionBy("root_id").orderBy("sequence", "task_id")
    spent = (F.col("attempts") >= most_attempts).cast("int")
    ranked = open_tasks.withColumn("nth", F.row_number().over(by_root)).where(F.col("nth") <= n)
    before = F.coalesce(F.sum(1 - spent).over(by_root.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.select("root_id", "task_id", "sequence", "nth", spent.alias("spent"), before.alias("started"))
    # a root is held back if its share ends before its tasks do: those beyond n aren't looked at, but count
    roots = open_tasks.groupBy("root_id").agg(F.sum(1 - spent).alias("open")).join(running, "root_id", "left").withColumn("room", share - F.coalesce("running", F.lit(0)))
    scheduled = schedule.select("root_id", F.lit(True).alias("scheduled"))
    last = open_tasks.groupBy("root_id").agg(F.max_by(spent, F.struct("sequence", "task_id")).alias("last_spent"))
    # one that isn't scheduled waits for ever
    roots = roots.join(last, "root_id").join(scheduled, "root_id", "left").withColumn("held", F.col("scheduled").isNull() | (F.col("room") <= 0) | (F.col("open") > F.col("room")) | (F.col("open") == F.col("room")) & (F.col("last_spent") == 1))
    held = roots.agg(F.count_if("held").alias("held_roots"))
    fair = ranked.join(schedule, "root_id").join(roots.select("root_id", "room"), "root_id").crossJoin(F.broadcast(held))  # one row
    within = F.col("started") < F.col("room")
    fair = fair.where(within | (F.col("held_roots") == 1)).withColumn("late", (~within).cast("int"))
    first = F.when(F.col("nth") == 1, F.col("last_claimed_at")).otherwise(now)
    order = [F.col("late"), F.when(F.col("nth") == 1, F.col("last_claimed_at").isNotNull()).otherwise(F.lit(True)), first, F.col("claim_sequence") + F.col("nth") - 1, F.col("root_id")]
    keyed = fair.select("task_id", "root_id", "nth", F.when(F.col("spent") == 1, "EXHAUSTED").otherwise("CLAIMED").alias("outcome"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)]).alias("key"))
    chosen = keyed.orderBy("key", "nth").limit(n)
    return chosen.select("task_id", "root_id", (F.row_number().over(Window.orderBy("key", "nth")) - 1).alias("turn"), "outcome")  # n rows


def claimed(tasks: DataFrame, claims: DataFrame, now: Column, until: Column) -> DataFrame:
    """tasks after claims: running under a lease with one more attempt, or failed."""
    both = tasks.join(claims.select("task_id", F.col("outcome").alias("_outcome")), "task_id", "left")
    ran, spent = F.col("_outcome") == "CLAIMED", F.col("_outcome") == "EXHAUSTED"
    return both.withColumns(
        {
            "state": F.when(ran, "RUNNING").when(spent, "FAILED").otherwise(F.col("state")),
            "attempts": F.col("attempts") + F.coalesce(ran, F.lit(False)).cast("int"),
            "lease_until": F.when(ran, until).when(spent, F.lit(None)).otherwise(F.col("lease_until")),
        }
    ).drop("_outcome")


def rescheduled(schedule: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """The schedule after claims."""
    served = claims.groupBy("root_id").agg(F.count("*").alias("_n"))
    both = schedule.join(served, "root_id", "left")
    return both.select("root_id", F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last_claimed_at")).alias("last_claimed_at"), (F.col("claim_sequence") + F.coalesce("_n", F.lit(0))).alias("claim_sequence"))


def folded(events: DataFrame) -> DataFrame:
    """The state of each task after its events (task_id, sequence, kind, token, at), in order.

    CLAIM sets the token; HEARTBEAT, COMPLETE and FAIL count only with the token that holds; CANCEL ends a queued
    task at once and lets a running one drain. A fold over one task's events, which are few.
    """
    ordered = F.array_sort(F.collect_list(F.struct("sequence", "kind", "token", "at")))
    start = F.struct(F.lit("QUEUED").alias("state"), F.lit(None).cast("string").alias("token"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("heartbeat"), F.lit(False).alias("cancelled"))

    def step(s: Column, e: Column) -> Column:
        holds = (s["state"] == "RUNNING") & s["token"].eqNullSafe(e["token"])
        claim = (e["kind"] == "CLAIM") & (s["state"] == "QUEUED")
        done, failed = holds & (e["kind"] == "COMPLETE"), holds & (e["kind"] == "FAIL")
        cancel = e["kind"] == "CANCEL"
        state = (
            F.when(claim, "RUNNING")
            .when(done, F.when(s["cancelled"], "CANCELLED").otherwise("SUCCEEDED"))
            .when(failed, "FAILED")
            .when(cancel & (s["state"] == "QUEUED"), "CANCELLED")
            .otherwise(s["state"])
        )
        return F.struct(
            state.alias("state"),
            F.when(claim, e["token"]).when(done | failed, F.lit(None).cast("string")).otherwise(s["token"]).alias("token"),
            (s["attempts"] + claim.cast("int")).alias("attempts"),
            F.when(claim | holds & (e["kind"] == "HEARTBEAT"), e["at"]).otherwise(s["heartbeat"]).alias("heartbeat"),
            (s["cancelled"] | cancel & (s["state"] == "RUNNING")).alias("cancelled"),
        )

    return events.groupBy("task_id").agg(F.aggregate(ordered, start, step).alias("s")).select("task_id", "s.*")


def job_states(jobs: DataFrame, tasks: DataFrame, counters: DataFrame) -> DataFrame:
    """(job_id, state): finished once all is discovered and no task is active."""
    active = tasks.groupBy("job_id").agg(F.bool_or(F.col("state").isin(*ACTIVE)).alias("active"))
    done = F.col("discovery_complete") & ~F.coalesce("active", F.lit(False))
    finished = F.when(F.col("cancel_requested"), "CANCELLED").when((F.coalesce("failed", F.lit(0)) == 0) & F.col("coverage_complete"), "SUCCEEDED").otherwise("COMPLETED_WITH_FAILURES")
    return jobs.join(active, "job_id", "left").join(counters, "job_id", "left").select("job_id", F.when(done, finished).otherwise("RUNNING").alias("state"))


def cancelled(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queued tasks of the jobs (job_id) end at once; running ones drain."""
    hit = jobs.select("job_id", F.lit(True).alias("_hit"))
    return tasks.join(hit, "job_id", "left").withColumn("state", F.when(F.col("_hit") & (F.col("state") == "QUEUED"), "CANCELLED").otherwise(F.col("state"))).drop("_hit")


def metrics(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("state", F.coalesce("code", F.lit("NONE")).alias("code")).agg(F.count("*").alias("n"))


def oldest_first(tasks: DataFrame, key: str) -> DataFrame:
    return first_per_group(tasks.where("state = 'QUEUED'"), [key], [F.col("sequence"), F.col("task_id")])


def exhausted(jobs: DataFrame, now: Column, most_attempts: int) -> DataFrame:
    """(job_id, root_id, path) of running jobs whose lease has run out with their attempts used up."""
    return jobs.where((F.col("state") == "RUNNING") & (F.col("lease_until") <= now) & (F.col("attempts") >= most_attempts)).select("job_id", "root_id", "path")


def jobs_failed(jobs: DataFrame, changed: DataFrame, code: str) -> DataFrame:
    """jobs after those in `changed` (job_id) failed: without a lease, with the code."""
    hit = changed.select("job_id", F.lit(True).alias("_hit"))
    both = jobs.join(hit, "job_id", "left")
    return both.withColumns({"state": F.when(F.col("_hit"), "FAILED_SAFE").otherwise(F.col("state")), "lease_until": F.when(F.col("_hit").isNull(), F.col("lease_until")), "code": F.when(F.col("_hit"), code).otherwise(F.col("code"))}).drop("_hit").select(jobs.columns)


def assets_failed(assets: DataFrame, locations: DataFrame, changed: DataFrame) -> DataFrame:
    """assets whose metadata_state is FAILED_SAFE where a location (asset_id, root_id, path) is that of a job in `changed`."""
    hit = locations.join(changed.select("root_id", "path").distinct(), ["root_id", "path"], "left_semi").select("asset_id").distinct().withColumn("_hit", F.lit(True))
    both = assets.join(hit, "asset_id", "left")
    return both.withColumn("metadata_state", F.when(F.col("_hit"), "FAILED_SAFE").otherwise(F.col("metadata_state"))).select(assets.columns)
