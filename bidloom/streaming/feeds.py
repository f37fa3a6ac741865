"""Streams: file intake, the status change feed and admission control."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import admit


def status_changes(log: DataFrame, job: str, order: list[str], status: str) -> DataFrame:
    """Batch form: rows whose status differs from the job's row before."""
    before = F.lag(status).over(Window.partitionBy(job).orderBy(*order))
    return log.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(status))).drop("_before")


def subscriptions(log: DataFrame, subscribers: DataFrame, job: str, order: list[str], status: str, final: tuple[str, ...] = ("done", "failed")) -> DataFrame:
    """What each subscriber (subscriber, job, the order columns) is told: the job's state at that moment and how it ends.

    Adds ``snapshot``, the status of the job's last row up to then (null: the job was not there), and ``ending``, the first
    final status after it (null: none yet). Log and subscribers are merged by one shuffle; a row at the same moment counts as before.
    """
    rows = log.select(job, *order, F.lit(0).alias("_kind"), F.col(status).alias("_status"), F.lit(None).cast("long").alias("subscriber"))
    asks = subscribers.select(job, *order, F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_status"), "subscriber")
    by = [*order[:1], "_kind", *order[1:]]
    before = Window.partitionBy(job).orderBy(*by)
    after = Window.partitionBy(job).orderBy(*[F.desc(c) for c in by])
    told = rows.unionByName(asks).withColumn("snapshot", F.last("_status", True).over(before))
    told = told.withColumn("ending", F.last(F.when(F.col("_status").isin(*final), F.col("_status")), True).over(after))
    return told.where("_kind = 1").select("subscriber", job, "snapshot", "ending")


class ChangeFeed(StatefulProcessor):
    """Emits a job's row when its status differs from the last one seen; rows of a batch go in order of event_id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for s in frame["event_type"]:
            keep.append(s != last)
            last = s
        self.last.update((last,))
        yield frame[keep][["event_id", "user_id", "event_type"]]

    def close(self) -> None:
        pass


class Admission(StatefulProcessor):
    """Sliding-window limiter: at most ``most`` accepted requests of a client within ``seconds``; rejected ones don't count.

    State is the at most ``most`` accepted times. A batch's rows of a client are held and sorted, so a batch should be bounded at its
    source (files or bytes a trigger); batches are taken to come in order of time.
    """

    def __init__(self, most: int = 30, seconds: float = 60.0):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = deque(r[0] for r in self.held.get())
        out = []
        for t, event_id in sorted((t, i) for f in rows for t, i in zip(f["t"], f["event_id"], strict=True)):
            out.append((event_id, key[0], admit(held, t, self.most, self.seconds)))
        self.held.put([(x,) for x in held])
        yield pd.DataFrame(out, columns=["event_id", "user_id", "accepted"])

    def close(self) -> None:
        pass


def change_feed(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").transformWithStateInPandas(ChangeFeed(), "event_id long, user_id long, event_type string", "append", "none")


def admissions(events: DataFrame, most: int = 30, seconds: float = 60.0) -> DataFrame:
    timed = events.select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return timed.groupBy("user_id").transformWithStateInPandas(Admission(most, seconds), "event_id long, user_id long, accepted boolean", "append", "none")


def ingest(spark: SparkSession, folder: str, per_trigger: int = 3, pattern: str = "*") -> DataFrame:
    """New files of a landing folder, at most ``per_trigger`` a batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there and stops."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
