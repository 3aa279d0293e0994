"""Queues as streams: the batch rules of tomeflow.operators.queue over unbounded events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "state string, token string, attempts int, cancelled boolean"
OUTPUT = "task_id long, state string, attempts int"


def _stepped(state: tuple, kind: str, token: str | None) -> tuple:
    now, held, attempts, cancelled = state
    holds = now == "RUNNING" and held == token
    if kind == "CLAIM" and now == "QUEUED":
        return "RUNNING", token, attempts + 1, cancelled
    if kind == "COMPLETE" and holds:
        return ("CANCELLED" if cancelled else "SUCCEEDED"), None, attempts, cancelled
    if kind == "FAIL" and holds:
        return "FAILED", None, attempts, cancelled
    if kind == "CANCEL" and now == "QUEUED":
        return "CANCELLED", held, attempts, cancelled
    if kind == "CANCEL" and now == "RUNNING":
        return now, held, attempts, True
    return state


def folded_stream(events: DataFrame) -> DataFrame:
    """The state of each task after each micro-batch's events (task_id, sequence, kind, token), in order within a batch.

    Events of one task must arrive in order of batches; stale tokens change nothing, as in the batch fold.
    """

    def fold(key, parts: Iterator, state):
        import pandas as pd

        now = state.get if state.exists else ("QUEUED", None, 0, False)
        rows = pd.concat(list(parts)).sort_values("sequence", kind="stable")
        for kind, token in zip(rows.kind, rows.token, strict=True):
            now = _stepped(tuple(now), kind, token)
        state.update(now)
        yield pd.DataFrame({"task_id": [key[0]], "state": [now[0]], "attempts": [now[2]]})

    return events.groupBy("task_id").applyInPandasWithState(fold, OUTPUT, STATE, "update", "NoTimeout")


LEASED_STATE = f"{STATE}, lease_until long"
LEASED_OUTPUT = "task_id long, state string, attempts int, code string"


def leased_stream(events: DataFrame, late: str, lease_ms: int, most_attempts: int) -> DataFrame:
    """As folded_stream() over events that have a time `at`, with leases: (task_id, state, attempts, code).

    CLAIM and HEARTBEAT hold a lease of `lease_ms` from their own time. When the watermark (`late` behind the newest
    event) passes its end, a timer puts the task back into the queue, or fails it with LEASE_EXPIRED once its attempts
    are used up; a CLAIM that comes before the timer finds the lease as it is. The same rules in batch: queue.expired().
    """

    def after_expiry(now: tuple) -> tuple[tuple, str | None]:
        if now[2] >= most_attempts:
            return ("FAILED", None, now[2], now[3], 0), "LEASE_EXPIRED"
        return ("QUEUED", None, now[2], now[3], 0), None

    def fold(key, parts: Iterator, state):
        import pandas as pd

        now, code = tuple(state.get) if state.exists else ("QUEUED", None, 0, False, 0), None
        if state.hasTimedOut:
            now, code = after_expiry(now)
        else:
            rows = pd.concat(list(parts)).sort_values("sequence", kind="stable")
            for kind, token, at in zip(rows.kind, rows.token, rows["at"], strict=True):
                ms = int(at.timestamp() * 1000)
                if now[0] == "RUNNING" and now[4] < ms:  # it ran out before this event
                    now, code = after_expiry(now)
                held = now[0] == "RUNNING" and now[1] == token
                stepped = _stepped(now[:4], kind, token)
                renewed = stepped[0] == "RUNNING" and (now[0] != "RUNNING" or held and kind == "HEARTBEAT")
                code = None if stepped[0] != "FAILED" else code
                now = (*stepped, ms + lease_ms if renewed else now[4] if stepped[0] == "RUNNING" else 0)
        state.update(now)
        if now[0] == "RUNNING":
            state.setTimeoutTimestamp(max(now[4], state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"task_id": [key[0]], "state": [now[0]], "attempts": [now[2]], "code": [code]})

    return events.withWatermark("at", late).groupBy("task_id").applyInPandasWithState(fold, LEASED_OUTPUT, LEASED_STATE, "update", "EventTimeTimeout")


def outcomes_per_window(outcomes: DataFrame, late: str, every: str) -> DataFrame:
    """Counts by state in windows of event time; rows later than `late` are left out."""
    return outcomes.withWatermark("at", late).groupBy(F.window("at", every), "state").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "state", "n")


def ingested(candidates: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a batch step on each micro-batch of a stream of candidates. The step must be idempotent by its batch number, as a batch may come again after a failure."""
    return candidates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
