"""From arriving uploads to finished jobs: admission, landing, and a stream that takes a few files at a time.

Folders of a deployment, below one root:

    landing/    bundles of admitted uploads (filename, content, uploaded_at, job_id), what the stream reads
    jobs/       the jobs table (``JobLog``)
    results/    batch=<n>: a document a finished job
    dead/       batch=<n>: chunks that gave no reply

A batch writes under its own number and replaces what is there, so a batch that broke off and is repeated counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import documents, joblog, jobs, recognition
from ..options import Options
from ..sources import files, storage

UPLOAD = "filename string, content binary, uploaded_at timestamp, job_id string"
#: Confidence of a text layer, and how a job's last step reads.
TEXT_CONFIDENCE, DONE_STEP, FAILED_STEP = 0.85, ("✅ Hoàn thành — ", " sản phẩm"), "❌ Lỗi: "

Ask = Callable[[DataFrame], DataFrame]


def admission(filename: Column, size: Column, options: Options) -> Column:
    """200, or 400 for a suffix that isn't taken, or 413 for too large a file."""
    return F.when(~F.coalesce(T.allowed(filename), F.lit(False)), 400).when(~T.small_enough(size, options.max_file_mb), 413).otherwise(200)


def upload_id(filename: Column, uploaded_at: Column) -> Column:
    """Names a job wherever jobs meet, so it must not be shared by two uploads."""
    return T.job_key(F.concat_ws("|", filename, uploaded_at.cast("timestamp").cast("double").cast("string")))


def receipts(uploads: DataFrame, options: Options, most: int = 30, seconds: float = 60.0) -> DataFrame:
    """What each upload (filename, content, uploaded_at) is told: code, and where that is 200 its job_id, size and stored name.

    Uploads with an ``api_key`` are held against that of the options (401, 403), and those with a ``client`` and a good key against
    its limit (429, ``most`` in ``seconds``), before their names and sizes are looked at.
    """
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    given = F.col("api_key") if "api_key" in uploads.columns else F.lit(options.api_key)
    code = jobs.key_check(given, F.lit(options.api_key))
    kept = ["filename", "content", "uploaded_at"]
    coded = uploads.select(*kept, *[c for c in ("client",) if c in uploads.columns], size.alias("_size"), code.alias("code"))
    if "client" in uploads.columns:
        # rows are numbered once and for all, as the limiter tells them apart
        path = storage.scratch(uploads.sparkSession, "received")
        coded.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
        coded = uploads.sparkSession.read.parquet(path)
        decided = jobs.limiter(coded.where("code = 200"), "client", "uploaded_at", "_row", most, seconds).select("_row", "accepted")
        coded = coded.join(decided, "_row", "left").withColumn("code", F.when(~F.col("accepted"), 429).otherwise(F.col("code")))
    coded = coded.withColumn("code", F.when(F.col("code") != 200, F.col("code")).otherwise(admission(F.col("filename"), F.col("_size"), options)))
    ok = lambda c: F.when(F.col("code") == 200, c)
    key = ok(upload_id(F.col("filename"), F.col("uploaded_at")))
    size_mb = ok(F.round(F.col("_size") / 1048576.0, 2))
    return coded.select(*kept, "code", key.alias("job_id"), size_mb.alias("size_mb"), ok(T.safe_name(F.col("filename"))).alias("stored_name"))


def save(uploads: DataFrame, root: str, options: Options | None = None, bundles: int | None = None) -> DataFrame:
    """Lands admitted uploads in bundles, puts each job in the jobs table as pending, and returns all receipts, without content."""
    told = receipts(uploads, options or Options.from_env())
    taken = told.where("code = 200").select("filename", "content", "uploaded_at", "job_id")
    taken = taken if bundles is None else taken.repartition(bundles, "job_id")
    taken.write.mode("append").parquet(f"{root}/landing")
    log = joblog.JobLog(uploads.sparkSession, f"{root}/jobs")
    at = F.concat_ws("/", F.lit(f"{root}/landing"), "job_id", "stored_name")
    log.append(joblog.inserts(told.where("code = 200").select("job_id", "filename", at.alias("file_path"), F.col("uploaded_at").alias("created_at"))))
    return told.drop("content")


def landed(spark: SparkSession, root: str, options: Options | None = None) -> DataFrame:
    """The landing folder as a stream, as many bundles a batch as jobs may run at once."""
    limit = (options or Options.from_env()).concurrent_jobs
    return spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", limit).parquet(f"{root}/landing")


def dropped(spark: SparkSession, folder: str, options: Options | None = None, pattern: str = "*") -> DataFrame:
    """The same from a folder into which others drop files one by one."""
    from . import feeds

    found = feeds.ingest(spark, folder, (options or Options.from_env()).concurrent_jobs, pattern)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return found.select(name.alias("filename"), "content", F.col("modificationTime").alias("uploaded_at"), upload_id(name, F.col("modificationTime")).alias("job_id"))


def text_layer(uploads: DataFrame) -> DataFrame:
    """Adds ``text`` and ``pages``: pages of a PDF joined by empty lines, the content of any other file as UTF-8."""
    body = uploads.withColumn("_pdf", F.col("content").startswith(F.lit(b"%PDF")))
    pages = files.pdf_pages(body.where("_pdf"), "job_id", "content").withColumnRenamed("path", "job_id")
    read = files.document_text(pages, "job_id").join(pages.groupBy("job_id").agg(F.count("*").alias("pages")), "job_id")
    plain = body.where("NOT coalesce(_pdf, false)").withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).withColumn("pages", F.lit(1).cast("long"))
    return plain.drop("_pdf").unionByName(body.where("_pdf").drop("_pdf").join(read, "job_id", "left").select(*uploads.columns, "text", "pages"))


def process(batch: DataFrame, number: int, root: str, ask: Ask, recognise: Callable[[DataFrame], DataFrame] = text_layer, options: Options | None = None, now: Column | None = None) -> None:
    """One batch of uploads from admission to finished jobs; of uploads with one job id the first by name counts.

    A job whose chunk gave no reply has failed, with that chunk's error; the others are done. All writes carry the batch's number.
    """
    options, now = options or Options.from_env(), F.current_timestamp() if now is None else now
    log = joblog.JobLog(batch.sparkSession, f"{root}/jobs")
    admitted = batch.where(admission(F.col("filename"), F.octet_length("content"), options) == 200)
    one = admitted.groupBy("job_id").agg(F.min(F.struct("filename", "uploaded_at", "content")).alias("u")).select("job_id", "u.*")
    # the batch is written once, so that later steps don't read and sort out the uploads again
    staged = f"{root}/staged/batch={number}"
    one.write.mode("overwrite").parquet(staged)
    one = batch.sparkSession.read.schema(UPLOAD).parquet(staged)
    began = one.select("job_id", "filename", F.concat_ws("/", F.lit(f"{root}/landing"), "job_id", T.safe_name(F.col("filename"))).alias("file_path"), F.col("uploaded_at").alias("created_at"))
    log.append(joblog.inserts(began), f"began-{number}")

    read = recognise(one)
    mean = F.char_length("text") / F.col("pages")
    none = F.lit(None).cast("double")
    kind = recognition.document_type(F.col("filename"), T.mime_type(F.col("filename"), F.col("content")), mean, none, none, none)
    key = F.struct("job_id", kind["doc_type"].alias("document_type"))
    docs = documents.extract_documents(read.select(key.alias("key"), "text", "filename"), ask, "key", filename=F.col("filename"))
    docs = documents.with_overall_confidence(docs, F.lit(TEXT_CONFIDENCE)).select("key.*", "*").drop("key")
    docs.write.mode("overwrite").parquet(f"{root}/results/batch={number}")
    docs = batch.sparkSession.read.schema(docs.schema).parquet(f"{root}/results/batch={number}")

    docs.select("job_id", F.inline("failures")).write.mode("overwrite").parquet(f"{root}/dead/batch={number}")
    error = F.get("failures", F.lit(0))["error"]
    good = error.isNull()
    step = F.concat(F.lit(DONE_STEP[0]), F.size("items").cast("string"), F.lit(DONE_STEP[1]))
    ended = {
        "status": F.when(good, "done").otherwise("failed"),
        "document_type": F.col("document_type"),
        "extraction_method": F.when(good, "pdfplumber"),
        "overall_confidence": F.when(good, F.col("overall_confidence")),
        "progress_pct": F.when(good, 100).otherwise(0),
        "current_step": F.when(good, step).otherwise(F.concat(F.lit(FAILED_STEP), F.substring(error, 1, 200))),
        "error_message": error,
        "completed_at": F.when(good, now),
    }
    log.append(joblog.patches(docs.select("job_id", *[c.alias(k) for k, c in ended.items()])), f"ended-{number}")


def results(spark: SparkSession, root: str) -> DataFrame:
    """Documents of the jobs that are done now, without those of deleted jobs."""
    done = joblog.JobLog(spark, f"{root}/jobs").read().where("status = 'done'").select("job_id")
    return spark.read.option("mergeSchema", False).parquet(f"{root}/results").drop("batch").join(done, "job_id", "left_semi")


def run(uploads: DataFrame, root: str, ask: Ask, **more) -> StreamingQuery:
    """Processes a stream of uploads till there are none left; started again, it goes on behind the last batch that ended."""
    stream = uploads.writeStream.foreachBatch(lambda batch, number: process(batch, number, root, ask, **more))
    return stream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
