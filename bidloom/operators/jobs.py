"""The jobs table as a DataFrame: inserts, patches, deletes, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_timestamp
from .ordered import limiter


#: Fixed value: what a new job says of its progress.
FIRST_STEP = "Đang chờ..."
#: Columns of the jobs table.
COLUMNS = {
    "job_id": "string", "filename": "string", "status": "string", "document_type": "string", "extraction_method": "string", "overall_confidence": "double", "progress_pct": "int",
    "current_step": "string", "error_message": "string", "created_at": "timestamp", "completed_at": "timestamp", "file_path": "string",
}


def new_jobs(receipts: DataFrame) -> DataFrame:
    """Job rows of uploads (job_id, filename, file_path, created_at); of receipts with one id the earliest counts."""
    first = receipts.groupBy("job_id").agg(F.min(F.struct("created_at", "filename", "file_path")).alias("r")).select("job_id", "r.*")
    start = {"status": F.lit("pending"), "overall_confidence": F.lit(0.0), "progress_pct": F.lit(0), "current_step": F.lit(FIRST_STEP)}
    given = {c: F.col(c) for c in first.columns}
    return first.select(*[(given | start).get(c, F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def insert(jobs: DataFrame, receipts: DataFrame) -> DataFrame:
    """The jobs with new rows for the receipts; a job that is there stays as it is."""
    return jobs.unionByName(new_jobs(receipts).join(jobs.select("job_id"), "job_id", "left_anti").select(*COLUMNS))


def result(jobs: DataFrame, results: DataFrame, key: str = "job_id") -> DataFrame:
    """The envelope of each finished job that has a result: its columns and the result row, nested."""
    nested = results.select(key, F.struct(*[c for c in results.columns if c != key]).alias("result"))
    done = jobs.where(F.col("status") == "done").select(key, "filename", "document_type", "extraction_method", "overall_confidence")
    return done.join(nested, key)


def history_view(jobs: DataFrame, n: int = 20) -> DataFrame:
    """The latest n jobs in the ten columns that a history shows."""
    times = [iso_timestamp(F.col(c)).alias(c) for c in ("created_at", "completed_at")]
    kept = history(jobs, n)
    return kept.select("job_id", "filename", "status", "document_type", "extraction_method", "overall_confidence", "progress_pct", "current_step", *times)


def history(jobs: DataFrame, n: int = 20, when: str = "created_at", tie: str = "job_id") -> DataFrame:
    """The latest n jobs; a negative n means all."""
    ordered = jobs.orderBy(F.desc(when), F.desc(tie))
    return ordered.limit(n) if n >= 0 else ordered


def patch(jobs: DataFrame, patches: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Each column's latest non-null patch over its old value; patches of absent jobs change nothing."""
    latest = patches.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in columns])
    joined = jobs.join(latest, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in jobs.columns])


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids, key, "left_anti")


def outcome(status: Column, has_result: Column) -> Column:
    """HTTP code of a result request."""
    return F.when(status.isNull(), 404).when(status == "failed", 500).when(status != "done", 202).when(~has_result, 500).otherwise(200)


def status_view(jobs: DataFrame) -> DataFrame:
    times = [iso_timestamp(F.col(c)).alias(c) for c in ("created_at", "completed_at")]
    return jobs.select("job_id", "filename", "status", "document_type", "progress_pct", "current_step", F.col("error_message").alias("error"), *times)


def key_check(given: Column, expected: Column) -> Column:
    """200 where no key is set or the given one, or its SHA-256, equals it; 401 without one, 403 for another."""
    return F.when(expected.isNull() | (expected == ""), 200).when(given.isNull() | (given == ""), 401).when((given == expected) | (F.sha2(given, 256) == expected), 200).otherwise(403)


def rate_limit(requests: DataFrame, client: str, ts: str, most: int = 30, seconds: float = 60.0) -> DataFrame:
    """(client, n_requests, n_rejected): a request is rejected when ``most`` accepted ones lie within the window before it.

    Decided by ``ordered.limiter``, so a client's history may be of any length.
    """
    decided = limiter(requests.withColumn("_row", F.lit(0)), client, ts, "_row", most, seconds)
    return decided.groupBy(client).agg(F.count("*").alias("n_requests"), F.count_if(~F.col("accepted")).alias("n_rejected"))
