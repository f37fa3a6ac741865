"""How a job's status goes on, as data, and the fold of status events over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import state_machine

#: The statuses of a job, and how far it is when it enters one.
PERCENT = {"pending": 0, "detecting": 10, "preprocessing": 25, "ocr": 50, "extracting": 70, "done": 100, "failed": 0}
FINAL = ("done", "failed")
_ONWARD = {"pending": ["detecting"], "detecting": ["preprocessing", "ocr"], "preprocessing": ["preprocessing", "ocr"], "ocr": ["ocr", "extracting", "done"], "extracting": ["done"]}
#: (status, wanted status) -> status. A job may fail from wherever it is, and nothing follows a final status.
MOVES = {(a, b): b for a, onward in _ONWARD.items() for b in [*onward, "failed"]}


def percent(status: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in PERCENT.values()]), F.array_position(F.array(*map(F.lit, PERCENT)), status).cast("int") - 1)


def progression(events: DataFrame, job: str, order: list[str], status: str, start: str = "pending") -> DataFrame:
    """The events with before, after, progress_pct (of the status after) and rejected: a status that does not follow is passed over."""
    return state_machine(events, job, order, status, MOVES, start).withColumn("progress_pct", percent(F.col("after")))
