"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target number of words; the ratio of target to size is a whole number of repeats and a fraction, the same for
all its documents. The fractions are inclusion probabilities: within blocks of a source the flight phase moves them along the
null space of two constraints, the totals of words and of documents, until at most two of a block are still fractional. What is
left of many blocks meets in one block of the next round, until a source has one block. The landing problem of at most two
documents a source is settled by taking those in part, so that the words taken meet the target to a word.

A null text has no words; null is a source of its own, last in order. Rows are taken one by one, so repeated rows are separate
units, and ids, which may be null, name no unit; in an empty table nothing is drawn. Draws depend on what the rows hold only, and
rows that tie in all of it are equal: reruns agree. A row that repeats very often is spread over many blocks. A text of any length is one unit. The table's columns travel in one struct, so they
may have any names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import stage_counted, stage_table, table

#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A document is taken at most so many times.
REPEATS = 3
#: Units in a block of the flight phase.
BLOCK = 4096
#: Blocks whose rest meets in one block of the next round.
FAN_IN = 1024

SPACE = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("long")


def _running(rows: DataFrame, order: list[Column], values: list[str], label: str) -> DataFrame:
    """``rows`` with ``<value>_before``, the sum of each value over all rows that come before in the order (no two rows tie in it).

    Rows lie in range partitions; a window runs within one, and the sums of whole partitions, one row each, are added.
    """
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = stage_table(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), label)
    parts = placed.groupBy("part").agg(*(F.sum(v).alias(v) for v in values))
    offsets = parts.select("part", *(F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"{v}_ahead") for v in values))
    before = {f"{v}_before": F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"{v}_ahead") for v in values}
    return placed.join(offsets, "part").withColumns(before).drop("part", *(f"{v}_ahead" for v in values))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_no, source_size, n, target) from rows (source, size): the sizes shared by weight under caps.

    Water-filling: with sources ascending by size over weight, those before the first one that its fair share does not exceed
    are capped, the others share the rest by weight. Sources may be many: no window holds them all.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.lit(1).alias("one"))
    number = _running(totals, [F.col("source").isNull(), F.col("source")], ["one"], "sources").withColumn("source_no", F.col("one_before") + 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("source_no") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double")
    ranked = number.withColumn("w", weight).withColumn("cap", (REPEATS * F.col("source_size")).cast("double")).withColumn("full_at", F.col("cap") / F.col("w"))
    rising = _running(ranked, [F.col("full_at"), F.col("source_no")], ["cap", "w"], "levels")
    rising = stage_table(rising, "rising")
    whole = rising.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    level = (F.lit(whole["size"]) - F.col("cap_before")) / (F.lit(whole["w"]) - F.col("w_before"))
    share = rising.where(level <= F.col("full_at")).agg(F.max(level)).first()[0]
    fair = F.col("cap") if share is None else F.lit(share) * F.col("w")
    return rising.select("source", "source_no", "source_size", "n", F.least("cap", fair).alias("target"))


def flight(x: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities to 0 or 1 with the sums of x and of size * x kept, until at most two units are fractional."""
    x = x.astype(float).tolist()
    s = size.astype(float).tolist()
    waiting = [i for i in range(len(x)) if 1e-9 < x[i] < 1 - 1e-9]
    draws = rng.random(len(waiting) + 1).tolist()
    held, at, step = [], 0, 0
    while True:
        while len(held) < 3 and at < len(waiting):
            held.append(waiting[at])
            at += 1
        if len(held) < 3:
            break
        i, j, k = held
        # the null space of the rows (1, 1, 1) and (s_i, s_j, s_k)
        u = (s[k] - s[j], s[i] - s[k], s[j] - s[i])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - x[m]) / d if d > 0 else -x[m] / d for m, d in zip(held, u, strict=True) if d)
        down = min(x[m] / d if d > 0 else (x[m] - 1) / d for m, d in zip(held, u, strict=True) if d)
        move = up if draws[step] * (up + down) < down else -down
        step += 1
        for m, d in zip(held, u, strict=True):
            x[m] += move * d
            x[m] = 0.0 if x[m] < 1e-9 else 1.0 if x[m] > 1 - 1e-9 else x[m]
        held = [m for m in held if 0.0 < x[m] < 1.0]
    return np.array(x)


def _round(units: DataFrame, level: int) -> DataFrame:
    """One flight phase in every (source_no, block)."""

    def fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "size", "unit"], kind="stable").reset_index(drop=True)
        rows["x"] = flight(rows["x"].to_numpy(), rows["size"].to_numpy(), np.random.default_rng([level, int(key[0]), int(key[1])]))
        return rows

    return units.groupBy("source_no", "block").applyInPandas(fly, units.schema)


def _units(documents: DataFrame, id_col: str, source_col: str, text_col: str, *more: Column) -> DataFrame:
    """One row a document, written once so that its number ``unit`` holds from here on: id, source, size, and what its draw depends on."""
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    rows = documents.select(F.monotonically_increasing_id().alias("unit"), F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), n_words(text).alias("size"), F.xxhash64(F.col(id_col).cast("long"), source, text).alias("draw"), *more)
    return stage_table(rows, "units")


def _pieces(units: DataFrame) -> DataFrame:
    """The units with ``piece``: rows of one draw, which are equal, are numbered, and each ``BLOCK`` of them is a piece.

    So a row that repeats very often fills many blocks. Only draws of over ``BLOCK`` rows are numbered: within the table's parts
    (the upper bits of a unit) and on from part to part. Equal rows may trade numbers, so the parts do not show in the result.
    """
    often, found = stage_counted(units.groupBy("draw").count().where(F.col("count") > BLOCK).select("draw", F.lit(True).alias("often")), "often")
    if not found:
        return units.withColumn("piece", F.lit(0).cast("long"))
    told = units.join(often, "draw", "left").withColumn("part", F.shiftright("unit", 33))
    many = told.where("often").drop("often")
    ahead = Window.partitionBy("draw").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = many.groupBy("draw", "part").agg(F.count("*").alias("m")).withColumn("ahead", F.coalesce(F.sum("m").over(ahead), F.lit(0))).drop("m")
    number = F.row_number().over(Window.partitionBy("draw", "part").orderBy("unit")) - 1 + F.col("ahead")
    many = many.join(parts, ["draw", "part"]).withColumn("piece", F.floor(number / BLOCK).cast("long"))
    few = told.where("often IS NULL").withColumn("piece", F.lit(0).cast("long"))
    return few.select(*units.columns, "piece").unionByName(many.select(*units.columns, "piece"))


def _draw(units: DataFrame) -> DataFrame:
    """(unit, x) with every x settled but for at most two of a source; units carry unit, draw, source_no, size, n, x."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))
    now = _pieces(units).withColumn("block", F.pmod(F.xxhash64("draw", "piece"), blocks)).withColumn("blocks", blocks).drop("n", "piece")
    most = units.agg(F.max("n")).first()[0] or 0
    most = -(-most // BLOCK)
    settled, level = None, 0
    while True:
        now = stage_table(_round(now, level), f"flight-{level}")
        open_ = (F.col("x") > 0) & (F.col("x") < 1)
        if most <= 1:
            return now if settled is None else settled.unionByName(now)
        done = now.where(~open_)
        settled = done if settled is None else settled.unionByName(done)
        now = now.where(open_).withColumn("block", F.floor(F.col("block") / FAN_IN))
        most, level = -(-most // FAN_IN), level + 1


def _taken(units: DataFrame) -> DataFrame:
    """The units with source_size, target, ``copies`` (whole ones), ``part`` (words of one more, cut) and ``taken`` words."""
    targets = stage_table(source_targets(units.select("source", "size")), "targets").withColumnRenamed("source", "of")
    base = units.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-12)
    base = base.withColumn("whole", whole).withColumn("x", F.greatest(F.lit(0.0), ratio - whole))
    drawn = _draw(base.where("x > 0 AND size > 0").select("unit", "draw", "source_no", "size", "n", "x")).select("unit", F.col("x").alias("got"))
    out = base.join(drawn, "unit", "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
    copies = (F.col("whole") + F.when(F.col("got") >= 1, 1).otherwise(0)).cast("long")
    part = F.when((F.col("got") > 0) & (F.col("got") < 1), F.round(F.col("got") * F.col("size"))).otherwise(0).cast("long")
    return out.withColumn("copies", copies).withColumn("part", part).withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))


def taken(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row a document: its id, source, size, source_size, target, whole copies, ``part`` words of a further copy, and words taken."""
    found = _taken(_units(documents, id_col, source_col, text_col))
    return found.select("doc_id", "source", "source_no", "size", "source_size", "target", "copies", "part", "taken")


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself, with the columns of ``documents``: each row as often as it is taken whole, and the parts cut at a word.

    ``n_chars``, where there is one, follows the text.
    """
    names = documents.columns
    units = _units(documents, id_col, source_col, text_col, F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    picked = _taken(units.drop("row")).where("copies > 0 OR part > 0").select("unit", "copies", "part")
    joined = units.select("unit", "row").join(picked, "unit")
    text = F.col("row")[text_col]
    words = F.filter(F.split(text.cast("string"), "[ \\t-\\r]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, 1, F.col("part").cast("int")), " ").cast(documents.schema[text_col].dataType)
    texts = F.concat(F.array_repeat(text, F.col("copies").cast("int")), F.when(F.col("part") > 0, F.array(cut)).otherwise(F.array().cast(ArrayType(documents.schema[text_col].dataType))))
    out = joined.select("row", F.explode(texts).alias("text"))
    new = {text_col: F.col("text")}
    if "n_chars" in names:
        new["n_chars"] = F.char_length(F.col("text").cast("string")).cast(documents.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "part")
