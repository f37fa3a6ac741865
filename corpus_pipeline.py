"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next one.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows and ids, and columns of any name besides
those it reads (text, doc_id, source, lang, n_chars); an empty table stays empty. Ties: the row of smallest id, null ids last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import jaccard, language, mixing, packing, pii
from bidloom.llm.common import free_name, stage_table, vocabulary

#: Bytes of encoded words a Python worker keeps while it packs; less than in a job of its own, as the stages share the workers.
CACHE_BYTES = 64 << 20


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.select(*like.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (no text or no letter) go; the others keep their row as it is, whatever its columns are called."""
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = language.predict(docs, language.fit(docs), pred_col=pred, score_col=score)
    return _columns(found.where(F.col(pred) != "und"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of smallest id stays, null ids last; rows tell apart, so ids may be null or repeat.

    Rows with no word link with nothing and stay. Rows of one id with unrelated texts both stay; of equal rows one stays.
    """
    row = free_name(docs, "row")
    rows = stage_table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = jaccard.jaccard_components(rows, row, "text").select(F.col("doc_id").alias("r"), "component_id")
    ids = rows.select(F.col(row).alias("r"), F.col("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "r"))
    heads = found.join(ids, "r").groupBy("component_id").agg(first.alias("head")).select(F.col("head.r").alias(row))
    return _columns(rows.join(heads, row, "left_semi"), docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; n_chars follows the text; null texts and all other columns stay."""
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return _columns(clean, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the balanced sample takes it; at most two documents a source are taken in part; rows may repeat."""
    return _columns(mixing.mixed_documents(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every taken document lies in which sequence; each row, repeated or not, is packed for itself."""
    return packing.pack(docs, vocabulary(), cache_bytes=CACHE_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned, drawn and packed rows can't be given by SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
