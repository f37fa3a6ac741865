"""The jobs table on disk: an append-only log of changes, snapshots that fold it, and reads that lay the log's tail over a snapshot.

    <root>/log/append=<n>[,token]/...  changes: op (insert, patch or delete), at, job columns
    <root>/snapshot/upto=<n>/...       live jobs after all appends up to n

Appends are numbered as they come. One that is given a token counts once, however often it is repeated, so a batch may be run again
after a failure. Only folders whose write has ended are seen. Changes take effect by (append, at). A job begins with its first insert since its last delete: later
inserts leave it as it is, patches set each column to its latest non-null value, patches of absent jobs change nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage
from .jobs import COLUMNS, new_jobs

KEY = "job_id"
CHANGE = {"op": "string", "at": "long"} | COLUMNS


def _changes(rows: DataFrame, op: str) -> DataFrame:
    given = {c.lower() for c in rows.columns}
    fixed = {"op": F.lit(op)} | ({} if "at" in given else {"at": F.lit(0)})
    return rows.select(*[fixed.get(c, F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in CHANGE.items()])


def inserts(receipts: DataFrame) -> DataFrame:
    """Changes that start jobs of uploads (job_id, filename, file_path, created_at); an ``at`` orders them within their append."""
    return _changes(new_jobs(receipts), "insert")


def patches(rows: DataFrame) -> DataFrame:
    """Changes that set the non-null ones of the given job columns."""
    return _changes(rows, "patch")


def deletes(ids: DataFrame) -> DataFrame:
    return _changes(ids, "delete")


def merged(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Live jobs after the changes (op, append, at, job columns). Jobs that no change names pass as they are, without a shuffle if
    the names are few; of the others all aggregates are partial, so one job may have any number of changes."""
    named = changes.select(KEY).distinct()
    pos = lambda *more: F.struct("append", "at", *more)
    old = base.join(named, KEY, "left_semi").select(F.lit("insert").alias("op"), F.lit(-1).cast("long").alias("append"), F.lit(0).cast("long").alias("at"), *COLUMNS)
    rows = old.unionByName(changes.select("op", "append", "at", *COLUMNS))
    gone = rows.where("op = 'delete'").groupBy(KEY).agg(F.max(pos()).alias("gone"))
    rows = rows.where("op <> 'delete'").join(gone, KEY, "left").where(F.col("gone").isNull() | (pos() > F.col("gone"))).drop("gone")
    born = rows.where("op = 'insert'").groupBy(KEY).agg(F.min(pos()).alias("born"))
    rows = rows.join(born, KEY).where((pos() == F.col("born")) | ((F.col("op") == "patch") & (pos() > F.col("born"))))
    latest = [F.max(F.when(F.col(c).isNotNull(), pos(c)))[c].alias(c) for c in COLUMNS if c != KEY]
    return base.join(named, KEY, "left_anti").select(*COLUMNS).unionByName(rows.groupBy(KEY).agg(*latest).select(*COLUMNS))


class JobLog:
    """One jobs table in a folder; a single writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self, n: int, token: str) -> str:
        return f"{self.root}/log/append={n},{token}" if token else f"{self.root}/log/append={n}"

    def _snapshot(self, n: int) -> str:
        return f"{self.root}/snapshot/upto={n}"

    def snapshots(self) -> list[int]:
        return [n for n, _, ended in storage.folders(self.spark, f"{self.root}/snapshot", "upto") if ended]

    def _appends(self) -> list[tuple[int, str, bool]]:
        return storage.folders(self.spark, f"{self.root}/log", "append")

    def tail(self) -> list[tuple[int, str]]:
        """(number, token) of the appends that no snapshot holds yet."""
        upto = max(self.snapshots(), default=-1)
        return [(n, token) for n, token, ended in self._appends() if ended and n > upto]

    def append(self, changes: DataFrame, token: str = "") -> int:
        """Adds changes and returns their number; where the token is there already, nothing is written and its number returned."""
        there = self._appends()
        again = [n for n, t, ended in there if token and t == token and ended]
        if again:
            return again[0]
        number = 1 + max([-1, *self.snapshots(), *(n for n, _, _ in there)])
        changes.select(*CHANGE).write.mode("overwrite").parquet(self._log(number, token))
        return number

    def read(self) -> DataFrame:
        """The live jobs as they are now."""
        upto, tail = max(self.snapshots(), default=None), self.tail()
        schema = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
        base = self.spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()]) if upto is None else self.spark.read.schema(schema).parquet(self._snapshot(upto))
        if not tail:
            return base
        change = ", ".join(f"{c} {t}" for c, t in CHANGE.items())
        each = [self.spark.read.schema(change).parquet(self._log(n, t)).withColumn("append", F.lit(n).cast("long")) for n, t in tail]
        return merged(base, reduce(DataFrame.unionByName, each))

    def compact(self) -> int | None:
        """Folds the tail into a new snapshot and returns its number; None where there is no tail. Readers see old or new, never half."""
        tail = self.tail()
        if not tail:
            return None
        upto = tail[-1][0]
        self.read().write.mode("overwrite").parquet(self._snapshot(upto))
        return upto

    def vacuum(self, keep: int = 1) -> int:
        """Removes snapshots but the newest ``keep`` and the appends that the oldest of those holds; may be repeated."""
        kept = self.snapshots()[-keep:]
        if not kept:
            return 0
        old = [self._snapshot(n) for n in self.snapshots() if n < kept[0]]
        old += [self._log(n, token) for n, token, _ in self._appends() if n <= kept[0]]
        return storage.remove(self.spark, old)
