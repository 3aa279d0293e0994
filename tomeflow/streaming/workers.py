"""Worker queues as a stateful stream: the rules of tomeflow.operators.workers over commands as they arrive.

Each queue's jobs are three states of Spark's store: those active, those ended, and the jobs by the files they are for; a fourth
holds the time a timer is set for. With the log's own times (`clock="log"`) the stream says what a batch fold of the same
log says. With `clock="processing"` a command happens when it is processed, and a timer at the end of the earliest lease
ends jobs whose attempts are used up even if nobody claims any more.

The session needs spark.sql.streaming.stateStore.providerClass set to RocksDBStateStoreProvider (see PROVIDER).
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.workers import OUTCOME, RULES, Job, Jobs, Rules, as_frame, commands, exhausted, rules_of, step

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_JOB = "key string, state string, attempts int, token string, lease long, created long, cancelled boolean"


class _Stored(MutableMapping):
    """A map state as a mapping of single values, read through and written through."""

    def __init__(self, state, load, store):
        self.state, self.load, self.store = state, load, store

    def __getitem__(self, key):
        if not self.state.containsKey((key,)):
            raise KeyError(key)
        return self.load(self.state.getValue((key,)))

    def __setitem__(self, key, value):
        self.state.updateValue((key,), self.store(value))

    def __delitem__(self, key):
        self.state.removeKey((key,))

    def __iter__(self):
        return (k[0] for k in self.state.keys())

    def __len__(self):
        return sum(1 for _ in self.state.keys())

    def items(self):
        return [(k[0], self.load(v)) for k, v in self.state.iterator()]


def _job(row) -> Job:
    key, state, attempts, token, lease, created, cancelled = row
    return Job(key, state, int(attempts), token, int(lease), int(created), bool(cancelled))


class WorkerQueue(StatefulProcessor):
    def __init__(self, timed: bool, rules: dict[str, Rules]):
        self.timed, self.rules = timed, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        active, ended = (handle.getMapState(name, "job_id long", _JOB) for name in ("active", "ended"))
        keys = handle.getMapState("keys", "key string", "job_id long")
        self.jobs = Jobs(*(_Stored(s, _job, tuple) for s in (active, ended)), _Stored(keys, lambda v: int(v[0]), lambda v: (v,)))
        self.timer = handle.getValueState("timer", "at long")

    def _set_timer(self, key, now: int) -> None:
        """A timer at the end of the earliest lease of a job that has no attempt left, if it isn't set already."""
        last = [j.lease for _, j in self.jobs.active.items() if j.state == "RUNNING" and j.attempts >= rules_of(key[0], self.rules).attempts]
        at = max(min(last) // 1000 + 1, now // 1000 + 1) if last else 0
        was = int(self.timer.get()[0]) if self.timer.exists() else 0
        if at != was:
            if was:
                self.handle.deleteTimer(was)
            if at:
                self.handle.registerTimer(at)
                self.timer.update((at,))
            else:
                self.timer.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentProcessingTimeInMs() * 1000 if self.timed else None
        parts = pd.concat(list(rows))
        if self.timed:
            parts = parts.assign(at=None)
        rules = rules_of(key[0], self.rules)
        found = [o for c in commands(parts, now) for o in step(self.jobs, rules, c)]
        if self.timed:
            self._set_timer(key, now)
        yield as_frame(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        self.timer.clear()
        found = list(exhausted(self.jobs, rules_of(key[0], self.rules), 0, now))  # no command: sequence 0
        self._set_timer(key, now)
        yield as_frame(key[0], found)

    def close(self) -> None:
        pass


def worker_stream(log: DataFrame, clock: str = "processing", rules: dict[str, Rules] = RULES) -> DataFrame:
    """What becomes of every command of the stream, as operators.workers.folded_workers() says of a log.

    A queue's commands must arrive in order of batches. clock: `log`, the commands' own times, or `processing`.
    """
    if clock not in ("log", "processing"):
        raise ValueError("the clock is `log` or `processing`")
    timed = clock == "processing"
    rows = log.select("queue", "sequence", F.col("at").cast("timestamp_ntz").alias("at"), "kind", "job_id", "key", "token", "code")
    return rows.groupBy("queue").transformWithStateInPandas(WorkerQueue(timed, rules), OUTCOME, "Update", "processingTime" if timed else "none")
