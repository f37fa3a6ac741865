"""SimHash near-duplicates: pairs of fingerprints at two or fewer differing bits through vantage-point trees, and their components.

Words are runs of non-space characters with A-Z lowered, shingles three words joined by a space, repeats included (the whole
sequence where there are fewer words). A shingle's hash is XXH64 of its UTF-8 bytes with seed 42; a bit of the fingerprint is 1
where it is set in over half of the hashes. A text without words has the fingerprint zero and links like any other.

1. One pass over the texts; equal fingerprints are one class, counted by partial aggregates, so copies never meet in one task.
2. A vantage-point tree over a bounded sample of the distinct fingerprints (``SAMPLE``) deals them into shards. A node sends a
   fingerprint inward when its distance d to the node's vantage point is at most the radius r, else outward. By the triangle
   bound two fingerprints of either side can only link if both lie within ``BITS`` of the boundary; so those just outside
   (r < d <= r + BITS) also go inward as guests, and guests go wherever the bound leaves room for a resident. Each linked pair
   thus meets as two residents, or as a resident and a guest, of some shard. The sample decides how even the shards are, never
   which pairs are found.
3. A shard goes on splitting by the same rule in its task until few residents are left, and these are compared with all that
   reached them. A fingerprint has at most 2,080 others within two bits, so pairs are linear in the distinct fingerprints; of
   those found a task keeps a spanning forest. A set that vantage points cannot split has a small diameter; if it is large all the
   same, the 2,080 neighbours of each resident are looked up instead.
4. Components of the forests' edges by forests of theirs, then minimum labels with pointer jumping; a component's name is its least document id.

Null and empty texts have the fingerprint zero. Ids may be null or repeat: each row gives a row, a component whose rows have no id
but null has a null component_id. Equal rows and equal texts are one class. Ties do not arise: the least id names a component.
Very long texts are hashed in blocks, whole. An empty table gives an empty result. Only the id and text columns are read, so other
columns may have any names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_in_worker, map_arrow, scalars, stage_counted, stage_table, table
from .jaccard import components, forest

WORDS, SEED, BITS = 3, 42, 2
#: Fingerprints a shard holds on average; the sample has ``PER_SHARD`` a shard and at most ``SAMPLE`` (8 bytes each) in all.
SHARD, PER_SHARD, SAMPLE = 50_000, 64, 4_000_000
#: Residents that are compared one by one; vantage points tried at a node; share of residents near a boundary that makes a split vain.
LEAF, TRIED, VAIN = 128, 6, 0.8
#: Rows of named classes that are broadcast at most (16 bytes each).
BROADCAST_ROWS = 2_000_000

_ONES = np.uint64(0x0101010101010101)
#: Shingles hashed at a time.
_BLOCK = 255 * 256


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; bytes of a word are added side by side, 255 hashes at a time."""
    rows = np.zeros((-(-len(h) // 255), 255), np.uint64)
    rows.reshape(-1)[: len(h)] = h
    counts = np.empty((8, 8), np.int64)
    for j in range(8):
        sums = ((rows >> np.uint64(j)) & _ONES).sum(axis=1)
        counts[:, j] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0)
    return counts.reshape(64)


def fingerprint(text: str | None) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if n < WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if n else 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - WORDS] + 1]).tolist()
    ends = ends[WORDS - 1 :].tolist()
    m = n - WORDS + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, m, _BLOCK):
        pieces = map(joined.__getitem__, map(slice, starts[at : at + _BLOCK], ends[at : at + _BLOCK]))
        counts += bit_counts(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, min(_BLOCK, m - at)))
    return int(np.packbits(2 * counts > m, bitorder="little").view(np.uint64)[0])


# ------------------------------------------------------------------ vantage-point trees


def _split(f: np.ndarray) -> tuple[np.uint64, int] | None:
    """The vantage point and radius with the fewest fingerprints just outside, of those that leave a quarter on either side."""
    best = None
    for v in f[np.linspace(0, len(f) - 1, TRIED).astype(np.int64)]:
        up_to = np.cumsum(np.bincount(np.bitwise_count(f ^ v), minlength=65 + BITS))
        for r in np.flatnonzero((4 * up_to >= len(f)) & (4 * up_to <= 3 * len(f))):
            if r <= 64 - BITS:
                near = (up_to[r + BITS] - up_to[max(r - BITS, 0)]) / len(f)
                if best is None or near < best[0]:
                    best = (near, v, int(r))
    return None if best is None or best[0] > VAIN else best[1:]


def fit(sample: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """Nodes of a tree as arrays: vantage point, radius and children; a child below zero is the shard of number -1 - child."""
    nodes, shards = [], 0
    todo = [(np.sort(sample), None)]
    while todo:
        f, of = todo.pop()
        cut = _split(f) if len(f) >= 2 * least else None
        if cut is None:
            me, shards = -1 - shards, shards + 1
        else:
            me = len(nodes)
            nodes.append([*cut, 0, 0])
            inner = np.bitwise_count(f ^ cut[0]) <= cut[1]
            todo += [(f[~inner], (me, 3)), (f[inner], (me, 2))]
        if of is not None:
            nodes[of[0]][of[1]] = me
    columns = list(zip(*nodes, strict=True)) if nodes else [[]] * 4
    return {"vantage": np.array(columns[0], np.uint64), "radius": np.array(columns[1], np.int64), "inner": np.array(columns[2], np.int64), "outer": np.array(columns[3], np.int64)}


def _sides(f: np.ndarray, resident: np.ndarray, v: np.uint64, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which go inward as residents, which as guests, and which go outward (each as what it is)."""
    d = np.bitwise_count(f ^ v).astype(np.int64)
    inside = d <= r
    return inside & resident, (~inside | ~resident) & (d <= r + BITS), np.where(resident, ~inside, d > r - BITS)


def _divided(f: np.ndarray, resident: np.ndarray, v: np.uint64, r: int):
    inner, guests, outer = _sides(f, resident, v, r)
    both = inner | guests
    return (f[both], inner[both]), (f[outer], resident[outer])


def route(tree: dict[str, np.ndarray], f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, resident, shard): every fingerprint once as a resident and where else a partner of it may reside."""
    out, todo = [], [(0 if len(tree["vantage"]) else -1, f, np.ones(len(f), bool))]
    while todo:
        node, part, resident = todo.pop()
        if not len(part):
            continue
        if node < 0:
            out.append((part, resident, np.full(len(part), -1 - node, np.int64)))
            continue
        inner, outer = _divided(part, resident, tree["vantage"][node], tree["radius"][node])
        todo += [(tree["inner"][node], *inner), (tree["outer"][node], *outer)]
    if not out:
        return np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _masks() -> np.ndarray:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    a, b = np.triu_indices(64, 1)
    return np.concatenate([one, one[a] | one[b]])


def _compared(f: np.ndarray, resident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs of a resident and another that reached it."""
    own, found = f[resident], []
    if len(own) <= 40 * len(_MASKS):
        step = max(1, 4_000_000 // max(1, len(f)))
        for at in range(0, len(own), step):
            i, j = np.nonzero(np.bitwise_count(own[at : at + step, None] ^ f[None, :]) <= BITS)
            found.append((own[at + i], f[j]))
    else:
        there = np.sort(f)
        for mask in _MASKS:
            other = own ^ mask
            at = np.minimum(np.searchsorted(there, other), len(there) - 1)
            hit = there[at] == other
            found.append((own[hit], other[hit]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64),) * 2
    return a[a != b], b[a != b]


_MASKS = _masks()


def linked(f: np.ndarray, resident: np.ndarray, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the residents of a shard and all that reached it."""
    a, b, waiting = [], [], 0
    todo = [(f, resident)]
    while todo:
        part, own = todo.pop()
        if not own.any() or len(part) < 2:
            continue
        cut = _split(part[own]) if own.sum() > LEAF else None
        if cut is not None:
            todo += _divided(part, own, *cut)
            continue
        x, y = _compared(part, own)
        a.append(x)
        b.append(y)
        waiting += len(x)
        if waiting > most:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, waiting = [x], [y], 0
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return forest(np.concatenate(a), np.concatenate(b))


# ------------------------------------------------------------------ Spark


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def rows(batches):
        kept_in_worker("simhash")
        for batch in batches:
            yield {"doc_id": batch.column(0), "fp": np.array([fingerprint(t) for t in scalars(batch.column(1))], np.uint64).view(np.int64)}

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(docs, rows, "doc_id long, fp long")


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(a, b), edges with the components of all pairs of the n distinct ``fp`` at two or fewer differing bits."""
    shards = max(1, min(-(-n // SHARD), SAMPLE // PER_SHARD))
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(PER_SHARD * shards).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = distinct.sparkSession.sparkContext.broadcast(fit(sample, PER_SHARD))

    def deal(batches):
        for batch in batches:
            f, resident, shard = route(tree.value, batch.column(0).to_numpy().view(np.uint64))
            yield {"fp": f.view(np.int64), "resident": resident, "shard": shard}

    def solve(key, rows):
        import pyarrow as pa

        f = rows.column("fp").to_numpy().view(np.uint64)
        a, b = linked(f, rows.column("resident").to_numpy(zero_copy_only=False))
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return map_arrow(distinct, deal, "fp long, resident boolean, shard long").groupBy("shard").applyInArrow(solve, "a long, b long")


def simhash_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hexadecimal digits) and component_id."""
    docs = stage_table(fingerprints(documents, id_col, text_col), "fingerprints")
    classes, n = stage_counted(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    edges, n_edges = stage_counted(links(classes.select("fp"), n), "links")
    if n_edges:
        labels, _ = components(edges, n_edges, 6 + n // 200_000)
        classes = classes.join(labels.withColumnRenamed("cid", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    else:
        classes = classes.withColumn("comp", F.col("fp"))
    heads = classes.groupBy("comp").agg(F.min("least").alias("component_id"), F.sum("copies").alias("rows"))
    # a document alone in its component needs no row here
    named, n_named = stage_counted(classes.join(heads.where("rows > 1"), "comp").select("fp", "component_id"), "components")
    named = F.broadcast(named) if n_named <= BROADCAST_ROWS else named
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    found = docs.join(named.withColumn("shared", F.lit(True)), "fp", "left")
    return found.select("doc_id", digits.alias("fingerprint"), F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
