"""The feed of a job for subscribers: its state when they come, how it ends, and a sign of life while neither happens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What keeps a silent connection open, and after how long.
KEEP_ALIVE, KEEP_ALIVE_SECONDS = ": keepalive", 60.0
FINAL = ("done", "failed")
OUTPUT = "job string, subscriber long, what string, status string"


class Feed(StatefulProcessor):
    """State of a job: its last status and its open subscribers, by number. Rows of a batch go by (t, kind, n); kind 0 is a status row,
    1 a subscriber, so that a row at the same moment counts as before.

    A subscriber is told the snapshot at once, a sign of life whenever ``quiet`` seconds pass without a word, and the ending, which
    closes it. One that comes after a final status waits for the next. A job's last status goes when it has not been heard of for
    ``expiry`` seconds. Without ``quiet`` there are no timers and nothing expires, so that a stream over what is there can end.
    """

    def __init__(self, final: tuple[str, ...] = FINAL, quiet: float | None = KEEP_ALIVE_SECONDS, expiry: float = 7 * 86400.0):
        self.final, self.quiet, self.expiry = final, quiet, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the last status lives on only as long as the job is heard of
        self.last = handle.getValueState("last", "status string", None if self.quiet is None else int(self.expiry * 1000))
        self.open = handle.getMapState("open", "n long", "since double")

    def _set_timer(self, timers) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(timers.getCurrentProcessingTimeInMs() + self.quiet * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told: list[tuple[str, int, str, str | None]] = []
        last = self.last.get()[0] if self.last.exists() else None
        waiting = [k[0] for k in self.open.keys()] if self.open.exists() else []
        was_open = set(waiting)
        frame = pd.concat(list(rows)).sort_values(["t", "kind", "n"])
        for kind, n, status in zip(frame["kind"], frame["n"], frame["status"], strict=True):
            if kind == 1:
                told.append((key[0], n, "snapshot", last))
                waiting.append(n)
            else:
                last = status
                if status in self.final:
                    told += [(key[0], x, "ending", status) for x in waiting]
                    waiting = []
        if last is not None:
            self.last.update((last,))
        for n in was_open - set(waiting):
            self.open.removeKey((n,))
        for n in set(waiting) - was_open:
            self.open.updateValue((n,), (0.0,))
        if waiting and self.quiet is not None:
            self._set_timer(timerValues)
        yield pd.DataFrame(told, columns=["job", "subscriber", "what", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = [k[0] for k in self.open.keys()] if self.open.exists() else []
        if waiting:
            self._set_timer(timerValues)
        yield pd.DataFrame([(key[0], n, "alive", KEEP_ALIVE) for n in waiting], columns=["job", "subscriber", "what", "status"])

    def close(self) -> None:
        pass


def feed(log: DataFrame, subscribers: DataFrame, job: str, ts: str, n: str, status: str, subscriber: str = "subscriber", **options) -> DataFrame:
    """What subscribers are told, from two streams: status rows (job, ts, n, status) and subscriptions (job, ts, subscriber).

    Both are one stream of two kinds, keyed by job, so they meet in one state. Timers go by processing time; a stream with timers never
    ends by itself, so one that is to drain what is there takes ``quiet=None``.
    """
    mode = "none" if options.get("quiet", KEEP_ALIVE_SECONDS) is None else "processingTime"
    t = F.col(ts).cast("timestamp").cast("double").alias("t")
    rows = log.select(F.col(job).cast("string").alias("job"), t, F.lit(0).alias("kind"), F.col(n).cast("long").alias("n"), F.col(status).alias("status"))
    asks = subscribers.select(F.col(job).cast("string").alias("job"), t, F.lit(1).alias("kind"), F.col(subscriber).cast("long").alias("n"), F.lit(None).cast("string").alias("status"))
    both = rows.unionByName(asks)
    return both.groupBy("job").transformWithStateInPandas(Feed(**options), OUTPUT, "append", mode)


def endings(told: DataFrame) -> DataFrame:
    """(subscriber, job, snapshot, ending) of what has been told so far; one whose job has not ended has no ending."""
    of = lambda what: F.max(F.when(F.col("what") == what, F.col("status"))).alias(what)
    return told.groupBy("subscriber", "job").agg(of("snapshot"), of("ending"))
