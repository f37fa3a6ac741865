"""Token ids in a content-addressed store.

A rolling hash over the ids cuts each document's stream into chunks; a chunk is stored once under the hash of its content; a
recipe lists a document's chunks, and Merkle roots over documents and over shards of the stream verify reconstruction.

File format (Parquet, in one folder):
  blobs/kind=chunk   key = BLAKE2b-128 of the ids as little-endian 32-bit integers, body = the ids, 16 bits each where the vocabulary allows
  recipes            doc_id, start, n_tokens, keys and lens of the chunks in order, root; in ascending order of doc_id
  manifest           shard, root over the roots of its documents in order of start

Reading back never moves ids: CRC-32 is linear, so a document's checksum is the XOR of its chunks' checksums, each shifted by
the bytes that follow it. Chunks are deduplicated inside each task before the one shuffle, so a passage that a third of the
documents share is one row a task. Null texts count as empty, null ids sort first; of repeated ids each row keeps its place.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, prefix_sums, scalars, stage_path, table, vocabulary, word_tokenizer

#: Chunk sizes in ids: where the rolling hash may cut, on average, and where it must.
LEAST, MEAN_BITS, MOST = 128, 9, 4096
#: Ids the rolling hash looks back on.
WINDOW = 16
#: Ids a manifest shard covers, as a power of two.
SHARD_BITS = 22

_GEAR = np.random.default_rng(7).integers(0, 2**32, 65536, dtype=np.uint32)


def marks(ids: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash of the last WINDOW ids allows a cut.

    The sum of gear values, each shifted by its distance, is built by doubling the window. Several documents may lie in one array:
    the first LEAST ids of a document never end a chunk, so no window that decides reaches into another document.
    """
    h, reach = _GEAR[ids & 0xFFFF], 1
    while reach < WINDOW:
        longer = h.copy()
        longer[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = longer, 2 * reach
    return np.flatnonzero((h >> np.uint32(20)) & np.uint32(2**MEAN_BITS - 1) == 0) + 1


def cut_points(allowed: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of n ids, from the places where a cut is allowed, within the least and the most size."""
    ends, last = [], 0
    for m in allowed:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST:
            ends.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def content_key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over the leaves; an odd node moves up as it is."""
    level = [content_key(b"\0" + x) for x in leaves] or [content_key(b"")]
    while len(level) > 1:
        level = [content_key(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the CRC-32 polynomial, in its reflected form."""
    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ np.uint64(0xEDB88320), b >> np.uint64(1))
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 values as if ``n_bytes`` further bytes followed, without those bytes' own part: crc(AB) = shift(crc(A), |B|) ^ crc(B)."""
    out, left = crc.astype(np.uint64), n_bytes.astype(np.uint64)
    power = np.array([1 << 23], np.uint64)  # x to the 8th: one byte
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            out[odd] = _times(out[odd], np.broadcast_to(power, int(odd.sum())))
        left >>= np.uint64(1)
        power = _times(power, power)
    return out


def write_store(documents: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, cut, deduplicate and write the store under ``path``."""

    def rows(batches):
        encode, seen = word_tokenizer(tokenizer).encode, set()
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        width = 2 if word_tokenizer(tokenizer).tokenizer.get_vocab_size() <= 65536 else 4
        out = {k: [] for k in ("key", "kind", "doc_id", "n", "body", "keys", "lens", "root")}

        def put(**row):
            for k, v in out.items():
                v.append(row.get(k))

        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                streams = [encode(text or "") + tail for text in scalars(part.column(1))]
                flat = np.frombuffer(b"".join(streams), "<u4")
                slim, allowed = flat.astype(f"<u{width}").tobytes(), marks(flat)
                lengths = [len(raw) // 4 for raw in streams]
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                bounds = np.searchsorted(allowed, offsets, "right").tolist()
                for i, (doc_id, raw) in enumerate(zip(part.column(0).to_pylist(), streams, strict=True)):
                    offset, at, keys, lens = int(offsets[i]), 0, [], []
                    for end in cut_points((allowed[bounds[i] : bounds[i + 1]] - offset).tolist(), lengths[i]):
                        key = content_key(raw[4 * at : 4 * end])
                        if key not in seen:
                            seen.add(key)
                            put(key=key, kind="chunk", n=end - at, body=slim[width * (offset + at) : width * (offset + end)])
                        keys.append(key)
                        lens.append(end - at)
                        at = end
                    put(key=content_key(b"%r %d" % (doc_id, len(keys))), kind="doc", doc_id=doc_id, n=lengths[i], keys=keys, lens=lens, root=merkle_root(keys))
                if len(out["key"]) >= 2000:
                    yield out
                    out = {k: [] for k in out}
        if out["key"]:
            yield out

    spark = documents.sparkSession
    picked = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    mapped = map_arrow(picked, rows, _BLOB)
    rank = F.row_number().over(Window.partitionBy("kind", "key").orderBy("n"))
    mapped.withColumn("rank", rank).where("kind = 'doc' OR rank = 1").drop("rank").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/blobs")

    # a kind without rows has no folder, so kinds are told apart by the partition column
    blobs = _blobs(spark, path)
    docs = blobs.where("kind = 'doc'").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("place"), "doc_id", F.col("n").alias("n_tokens"), "keys", "lens", "root")
    starts = prefix_sums(docs.groupBy("place").agg(F.sum("n_tokens").alias("n")), "place", "n", "base").select("place", "base")
    inside = Window.partitionBy("place").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(starts, "place")
    placed = placed.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "keys", "lens", "root")
    placed.repartitionByRange("start").sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _shard_roots(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def _shard_roots(recipes: DataFrame) -> DataFrame:
    def rows(batches):
        for batch in batches:
            yield {"shard": batch.column(0), "root": [merkle_root([x["root"] for x in docs]) for docs in scalars(batch.column(1))]}

    shards = recipes.groupBy(F.shiftright("start", SHARD_BITS).alias("shard")).agg(F.array_sort(F.collect_list(F.struct("start", "root"))).alias("docs"))
    return map_arrow(shards, rows, "shard long, root binary")


_BLOB = "key binary, kind string, doc_id long, n long, body binary, keys array<binary>, lens array<int>, root binary"


def _blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOB).parquet(f"{path}/blobs")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return _blobs(spark, path).where("kind = 'chunk'").select("key", "n", "body")


def _wide(body: bytes, n: int) -> bytes:
    return np.frombuffer(body, f"<u{len(body) // max(n, 1)}").astype("<u4").tobytes() if n else b""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ``ids`` (little-endian 32-bit) of every document, put together again from its chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("doc_id", "start", F.posexplode("keys").alias("pos", "key"))
    parts = refs.join(_chunks(spark, path), "key").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "body"))).alias("parts"))

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield {"doc_id": batch.column(0).slice(i, 1), "start": batch.column(1).slice(i, 1), "ids": [b"".join(_wide(x["body"], x["n"]) for x in batch.column(2)[i].as_py())]}

    return map_arrow(parts, rows, "doc_id long, start long, ids binary")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Per document: place, number and CRC-32 of its ids as the files give them, and whether all hashes agree."""

    def index(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys, ns, crcs, good = [], [], [], []
                for key, n, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), scalars(part.column(2)), strict=True):
                    raw = _wide(body, n)
                    keys.append(key)
                    ns.append(len(raw) // 4)
                    crcs.append(zlib.crc32(raw))
                    good.append(content_key(raw) == key)
                yield {"key": keys, "n": ns, "crc": crcs, "good": good}

    def roots(batches):
        for batch in batches:
            doc = {f: batch.column(i) for i, f in enumerate(("doc_id", "start", "n_tokens", "keys", "lens"))}
            keys, lens = doc["keys"].to_pylist(), doc["lens"].to_pylist()
            after = [[4 * (sum(ns) - x) for x in np.cumsum(ns).tolist()] for ns in lens]
            yield doc | {"after": after, "n_chunks": [len(k) for k in keys], "whole": [merkle_root(k) == r for k, r in zip(keys, batch.column(5).to_pylist(), strict=True)]}

    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", "keys", "lens", "root")
    checked = map_arrow(recipes, roots, "doc_id long, start long, n_tokens long, keys array<binary>, lens array<int>, after array<long>, n_chunks long, whole boolean")
    refs = checked.select("doc_id", "start", "n_tokens", "n_chunks", "whole", F.explode_outer(F.arrays_zip("keys", "after")).alias("c"))
    refs = refs.select("doc_id", "start", "n_tokens", "n_chunks", "whole", F.col("c.keys").alias("key"), F.col("c.after").alias("after"))
    stored = map_arrow(_chunks(spark, path), index, "key binary, n long, crc long, good boolean")
    shifted = F.pandas_udf(lambda crc, after: _shift_series(crc, after), "long")
    joined = refs.join(stored, "key", "left").withColumn("part", shifted(F.coalesce("crc", F.lit(0)), F.coalesce("after", F.lit(0))))
    docs = joined.groupBy("start").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("want"), F.first("n_chunks").alias("n_chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.bit_xor("part").alias("ids_crc32"),
        (F.first("whole") & (F.count("good") == F.first("n_chunks")) & F.coalesce(F.bool_and("good"), F.lit(True))).alias("good"),
    )
    manifest = spark.read.parquet(f"{path}/manifest").join(_shard_roots(recipes).withColumnRenamed("root", "again"), "shard", "left").select("shard", (F.col("root") == F.col("again")).alias("same"))
    docs = docs.withColumn("shard", F.shiftright("start", SHARD_BITS)).join(manifest, "shard", "left")
    return docs.select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", (F.col("good") & (F.col("want") == F.col("n_tokens")) & F.coalesce("same", F.lit(False))).alias("verified"))


def _shift_series(crc, after):
    import pandas as pd

    return pd.Series(shift_crc(crc.to_numpy(), after.to_numpy()).astype(np.int64))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, vocabulary())
    return verify(spark, path)
