"""Approximate nearest neighbours by collision-counting hashing.

Each vector is projected on ``PROJECTIONS`` random lines; a block of the table keeps every line's values as a sorted array. A
query opens a window around its own projection on every line; virtual rehashing widens all windows together by ``GROWTH`` a
level, and only what a level adds is counted. A vector that has collided on at least ``THRESHOLD`` lines is verified by its exact
distance. A block stops for a query when it has verified k vectors plus the share ``BETA`` of its vectors, or when its k-th best
lies within the level's radius; with ``share`` 1 it goes on until every vector is verified, and the result is exact.

Rows go to blocks of at most some ``BLOCK`` vectors, once each; queries are a stated set and meet every block. A task reads its
blocks one after the other, rows before queries: it projects and sorts a block once and then streams the queries past it, so it
holds one block and one batch of queries. The best k of each block are merged. Rows are dealt by a hash of id and vector, so that
neither copies of one vector nor rows of one id fill a block; rows equal in both share one. The lines come from a fixed seed; the
first radius is set from each block.

Vectors that are null, zero, hold null or non-finite components or have another length than most take no part, nor do rows without
an id. Of candidates with the same id each counts; equal query rows are one query, those of one id with other vectors are queries
of their own, and no row with a query's id is a candidate of it. Ties go to the smaller id. Very long vectors make blocks larger,
nothing else. An empty table gives an empty result; only the id and vector columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import table

PROJECTIONS, THRESHOLD = 128, 92  # counts of collisions fit a byte
#: Width of a window at radius 1, growth of the radius a level, share of a block and number of vectors verified at least.
WIDTH, GROWTH, BETA, LEAST_CHECKED = 2.6, 1.2, 0.06, 150
BLOCK = 65536
#: Rows a block has at least before another one is opened, and blocks that small tables are spread over.
LEAST_BLOCK, SPREAD = 4096, 12
#: Queries of a block whose windows widen together.
QUERIES_AT_ONCE = 128


def usable(v: Column) -> Column:
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(v, lambda x: x != 0), F.lit(False))


def lines(dim: int) -> np.ndarray:
    return np.random.default_rng(5).standard_normal((dim, PROJECTIONS))


class Block:
    """Vectors of a block with the sorted arrays of all lines."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.lines = ids, x, lines(x.shape[1])
        projected = x @ self.lines
        self.order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order.T, axis=0).T.copy()
        # the spread of a line is the typical distance over the square root of two
        self.radius = 0.35 * float(np.sqrt(2) * np.median(projected.std(0))) or 1.0

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, share: float = BETA) -> tuple[list[int], list[int], list[float]]:
        """The k nearest found for each query: numbers of queries, vector ids and distances.

        All queries that are still open widen their windows together, so that each level looks up each line once.
        """
        ids, x, n, order, sorted_ = self.ids, self.x, len(self.ids), self.order, self.sorted
        wanted, enough = (q @ self.lines).T.copy(), k + LEAST_CHECKED + share * n
        out: tuple[list, list, list] = ([], [], [])
        for first in range(0, len(q), QUERIES_AT_ONCE):
            part = np.arange(first, min(first + QUERIES_AT_ONCE, len(q)))
            low = np.stack([s.searchsorted(w) for s, w in zip(sorted_, wanted[:, part], strict=True)], 1)
            high, now, r = low.copy(), np.arange(len(part)), self.radius
            counts = np.zeros((len(part), n), np.uint8)
            checked = np.zeros((len(part), n), bool)
            found = [(np.empty(0, np.int64), np.empty(0)) for _ in part]
            while len(now):
                at, half = wanted[:, part[now]], WIDTH * r / 2
                left = np.stack([s.searchsorted(w - half) for s, w in zip(sorted_, at, strict=True)], 1)
                right = np.stack([s.searchsorted(w + half, "right") for s, w in zip(sorted_, at, strict=True)], 1)
                left, right = np.minimum(left, low[now]), np.maximum(right, high[now])
                done = np.zeros(len(now), bool)
                for m, i in enumerate(now.tolist()):
                    spans = zip(order, left[m].tolist(), low[i].tolist(), high[i].tolist(), right[m].tolist(), strict=True)
                    new = np.concatenate([piece for o, a0, a1, b0, b1 in spans for piece in (o[a0:a1], o[b0:b1])])
                    counts[i] += np.bincount(new, minlength=n).astype(np.uint8)
                    new = np.flatnonzero((counts[i] >= THRESHOLD) & ~checked[i])
                    if len(new):
                        checked[i, new] = True
                        own = new[ids[new] != query_ids[part[i]]]
                        near = np.concatenate([found[i][0], ids[own]]), np.concatenate([found[i][1], np.sqrt(((x[own] - q[part[i]]) ** 2).sum(1))])
                        best = np.lexsort(near)[:k]
                        found[i] = near[0][best], near[1][best]
                    settled = share < 1 and len(found[i][1]) >= k and found[i][1][-1] <= r
                    done[m] = settled or checked[i].sum() >= min(enough, n)
                low[now], high[now] = left, right
                done |= (left == 0).all(1) & (right == n).all(1)
                now, r = now[~done], r * GROWTH
            for i, (vec_ids, scores) in enumerate(found):
                out[0].extend([int(part[i])] * len(vec_ids))
                out[1].extend(vec_ids.tolist())
                out[2].extend(scores.tolist())
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _past_blocks(batches: Iterator[pa.RecordBatch], k: int, share: float, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches (block, asks, id, v) in the order of block and asks: a block's rows are gathered and sorted once, then its queries pass."""
    at, held, block = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            part, (number, asks) = batch.slice(a, b - a), keys[:, a].tolist()
            if number != at:
                at, held, block = number, [], None
            ids, v = part.column(2).to_numpy(), part.column(3)
            if not asks:
                held.append((ids.copy(), _matrix(v)))
                continue
            if block is None and held:
                block, held = Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])), []
            if block is not None:
                of, vec_ids, scores = block.search(ids, _matrix(v), k, share)
                rows = pa.array(of, pa.int64())
                arrays = [part.column(2).take(rows), v.take(rows), pa.array(vec_ids, pa.int64()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, out, strict=True)], schema=out)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", share: float = BETA) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every query, its own id left out; exact with ``share`` 1."""
    from pyspark.sql.pandas.types import to_arrow_schema

    slim = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    data = slim(vectors)
    asked = slim(queries).dropDuplicates(["id", "v"])
    dims = data.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, n = (dims["d"], dims["count"]) if dims else (0, 0)
    blocks = max(1, -(-n // BLOCK), min(SPREAD, n // LEAST_BLOCK))
    rows = data.where(F.size("v") == dim).select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    asks = asked.where(F.size("v") == dim).select(every, F.lit(1).alias("asks"), "id", "v")
    dealt = rows.unionByName(asks).repartitionById(blocks, "block").sortWithinPartitions("block", "asks")
    schema = StructType([StructField("query_id", LongType()), StructField("query", data.schema["v"].dataType), StructField("vec_id", LongType()), StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _past_blocks(batches, k, share, arrow)

    pairs = dealt.mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
