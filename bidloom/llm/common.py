"""What several of the training-data operators share: table access, staged tables, Arrow helpers and a word-cached tokenizer."""

from __future__ import annotations

import re
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []

#: Bytes of encoded words that a Python worker keeps.
CACHE_BYTES = 192 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set and Spark runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-bidloom-"))
    return _own_dir[0]


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/bidloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def stage_table(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = stage_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, label: str, where: str = "true") -> tuple[DataFrame, int]:
    """``stage_table`` and the number of its rows for which ``where`` holds, observed while it is written."""
    seen = Observation()
    out = stage_table(df.observe(seen, F.count_if(F.expr(where)).alias("n")), label)
    return out, seen.get["n"]


def map_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over a generator of plain dicts of columns, lists or Arrow arrays (one dict per output batch)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            arrays = ((columns[f.name], f.type) for f in arrow)
            yield pa.RecordBatch.from_arrays([x.cast(t) if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in arrays], schema=arrow)

    return df.mapInArrow(run, schema)


def scalars(column: pa.Array) -> Iterator:
    """Python values of an Arrow column one at a time, so that a batch of long texts is never held twice."""
    for x in column:
        yield x.as_py()


_kept: dict = {}


def kept_in_worker(key: object, build: Callable[[], object] = object):
    """What a Python worker keeps from task to task: one object at a time, so nothing of an earlier operator stays in its memory."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` needs."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# ------------------------------------------------------------------ prefix sums


def prefix_sums(df: DataFrame, key: str, value: str, out: str, bits: int = 16) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows with a smaller ``key``; keys are unique non-null longs.

    A radix tree over the key: each level sums what shares a key prefix, so no window ever holds more than ``2**bits`` rows
    for dense or sparse keys alike, and the top level has at most that many rows in all.
    """
    from pyspark.sql import Window

    level = df.select(F.col(key).alias("k0"), F.col(value).cast("long").alias("v"))
    levels = [level]
    for _ in range(3):
        level = level.groupBy(F.shiftright("k0", bits).alias("k0")).agg(F.sum("v").alias("v"))
        levels.append(level)
    before = None
    for i in (3, 2, 1, 0):
        parent = F.shiftright("k0", bits) if i < 3 else F.lit(0).cast("long")
        w = Window.partitionBy("up").orderBy("k0")
        here = levels[i].withColumn("up", parent).withColumn("s", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
        if before is not None:
            here = here.join(before, "up").withColumn("s", F.col("s") + F.col("base"))
        before = here.select(F.col("k0").alias("up"), F.col("s").alias("base"))
    return df.join(before.select(F.col("up").alias(key), F.col("base").alias(out)), key)


# ------------------------------------------------------------------ tokenizer


class _Words(dict):
    """Word -> its ids as little-endian 32-bit bytes; an unknown word is encoded when first asked for.

    The cache is bounded by bytes: words of over ``LONGEST`` characters are never kept, and at ``limit`` bytes it starts anew.
    """

    LONGEST, ENTRY = 64, 190

    def __init__(self, tokenizer, limit: int):
        super().__init__()
        self.tokenizer, self.model, self.limit, self.held = tokenizer, tokenizer.model, limit, 0
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        # the byte-level alphabet: visible bytes stand for themselves, the others for code points from 256 on
        self.bytes_as_text = dict(zip((b for b in range(256) if b not in visible), range(256, 512), strict=False))

    def __missing__(self, word: str) -> bytes:
        letters = word[:-1] if len(word) > 1 and word[-1] in ".," else word
        if letters.isalpha() and max(letters) <= "\xff" and letters == letters.lower():
            if letters is not word:
                # a stop or comma behind letters is a piece of its own
                out = self[letters] + self[word[-1]]
            else:
                # a run of lower-case letters is one piece for the pre-tokenizer, so the model alone is needed
                ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.bytes_as_text))]
                out = struct.pack(f"<{len(ids)}I", *ids)
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= self.LONGEST:
            self.held += self.ENTRY + len(word) + len(out)
            if self.held > self.limit:
                self.clear()
                self.held = 0
            self[word] = out
        return out


_NO_SPACE = re.compile("[\x1c-\x1f]")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordTokenizer:
    """Whole-text encoding through a cache of white-space words.

    The pre-tokenizer of ``word_bpe_49k.json`` never joins text across white space, so a text's ids are those of its words in a
    row, and a word is encoded once and later only looked up. Texts of Latin-1 characters are lowered first, as the tokenizer's
    normalizer does, so that runs of letters need the model alone; other texts, and those that may hold added tokens, go word by
    word and unlowered through the whole tokenizer, and texts with separators that only Python takes for space go as they are. ``encode`` returns little-endian unsigned 32-bit ids.
    """

    def __init__(self, path: str, cache_bytes: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer, cache_bytes)

    def encode(self, text: str) -> bytes:
        if _NO_SPACE.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        # added tokens are matched before the normalizer, so only the text as it stands tells them from upper-case look-alikes
        if "<|" not in text and _latin(text):
            text = text.lower()
        return b"".join(map(self.words.__getitem__, text.split()))


def word_tokenizer(path: str, cache_bytes: int = CACHE_BYTES) -> WordTokenizer:
    """One tokenizer for each Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept_in_worker(("tokenizer", path, cache_bytes), lambda: WordTokenizer(path, cache_bytes))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
