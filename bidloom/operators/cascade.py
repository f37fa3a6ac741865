"""Files of deleted jobs: mark what belongs to no live job, and sweep it; a sweep that broke off may be run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage


_OWNED = r"/(?:uploads|results)/(?:job_id=)?([^/]+?)(?:\.json)?(?:/|$)"


def owner(path: Column) -> Column:
    """The job a file belongs to: ``uploads/<job>/...`` or ``results/<job>.json``, or either with a folder ``job_id=<job>`` as Spark
    writes them; null for exports and all else, which belong to none."""
    return F.nullif(F.regexp_extract(path, _OWNED, 1), F.lit(""))


def orphans(listing: DataFrame, live: DataFrame) -> DataFrame:
    """The listed files whose job is not among the live ones. Only names are compared; no content is read."""
    owned = listing.withColumn("job_id", owner(F.col("path"))).where("job_id IS NOT NULL")
    return owned.join(live.select("job_id").distinct(), "job_id", "left_anti")


def sweep(spark: SparkSession, orphaned: DataFrame) -> int:
    """Deletes the orphans, a job's folder as a whole; how many deletions took effect. Tasks delete in mounted folders; in other stores
    the driver does, where only paths reach it."""
    folder = F.regexp_extract("path", r"^(.*/(?:uploads|results)/[^/]+)/", 1)
    at = F.when(folder == "", F.col("path")).otherwise(folder)
    return storage.remove_all(orphaned.select(at.alias("at")))
