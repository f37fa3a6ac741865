"""Merkle manifest of a dataset: every document's leaf, the roots above it, and its proof.

A leaf is the SHA-256 of doc_id, source, lang, n_chars and text, each as ``-`` where null, else as its UTF-8 byte count, a colon and
the value. The leaves of a language, by ascending doc_id, are paired level by level (the last of an odd level goes alone) up to the
language's subroot; the subroots, null first, then by UTF-8 bytes, are paired likewise up to the root.

Bottom-up build: places come from one range shuffle and sums over its partitions, so a language may hold all rows. ``STRIDE`` levels
at a time, each aligned block of ``2 ** STRIDE`` nodes becomes one node of the next persisted level. Top-down proof push: from the
root's level on, each persisted level joins its children to their parents' paths; a child puts its own siblings before the path it
inherits. Only paths of blocks are ever moved; a leaf's path is made and used in the task of its block.

Null ids come first in their language. Rows of equal language and id go by their leaf; rows equal in all five columns have equal
leaves, so their order changes nothing (their proofs may differ by place). Null or empty languages and texts are values like others
(``-`` and ``0:``). Texts of any length are hashed whole, in the scan. An empty table gives an empty result. Other columns may have
any names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage_counted, stage_table, table

#: Levels that a block climbs at once, if not told otherwise; a block holds two to their power nodes.
STRIDE = 10
#: Rows (of a range partition and language, or of a language) that are broadcast at most.
BROADCAST_ROWS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Every how many ids, by their crc32, the check tampers with one.
TAMPERED = 7


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: dict[str, Column]) -> Column:
    """The leaf of a row from its fields as strings."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(fields[f]) for f in FIELDS]), 256)


def leaves(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, forged): forged is the leaf with one more in n_chars, of every ``TAMPERED``-th id by crc32 (else null)."""
    number = {"doc_id": "long", "n_chars": "long"}
    fields = {f: F.col(f).cast(number.get(f, "string")).cast("string") for f in FIELDS}
    more = fields | {"n_chars": (F.col("n_chars").cast("decimal(19,0)") + 1).cast("string")}
    picked = F.crc32(fields["doc_id"]) % TAMPERED == 0
    forged = F.when(picked, F.unhex(leaf_digest(more)))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), fields["lang"].alias("lang"), F.unhex(leaf_digest(fields)).alias("leaf"), forged.alias("forged"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def placed(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """The rows with ``pos``, their place within the group from 0 on, and ``total``, the group's rows; null is a group like others.

    One range shuffle orders all rows; a row's place follows from its number in its partition and the counts of the partitions before.
    """
    by = [group, *order]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ordered = stage_table(ordered.withColumn("_part", F.shiftright("_at", 33)), label)
    runs = ordered.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs, n = stage_counted(runs.withColumn("_before", before).withColumn("total", F.sum("_n").over(of)).drop("_n"), f"{label}-runs")
    runs = _small(runs.withColumnRenamed(group, "_group").withColumnRenamed("_part", "_run"), n)
    found = ordered.join(runs, (F.col("_part") == F.col("_run")) & F.col(group).eqNullSafe(F.col("_group")))
    return found.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_run", "_group", "_first", "_before")


# ------------------------------------------------------------------ one block


def height(total: int) -> int:
    """Levels from so many nodes up to the one that remains."""
    return (total - 1).bit_length() if total else 0


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The block's nodes and those of the levels above."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([_h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """A node's sibling in each level but the last, empty where it goes alone."""
    out = []
    for nodes in levels[:-1]:
        other = at ^ 1
        out.append(nodes[other] if other < len(nodes) else "")
        at >>= 1
    return out


def fold(digest: str, path: list[str], places: list[int]) -> str:
    """The root that a leaf and its siblings give; odd places have their sibling on the left."""
    for sibling, odd in zip(path, places, strict=True):
        digest = _h(sibling, digest) if odd else _h(digest, sibling)
    return digest


def _trees(rows, below: int, stride: int) -> list[list[str]]:
    """The levels that a block's sorted rows climb, with so many below; fewer than ``stride`` only where the group's top is near."""
    total = rows.column("total")[0].as_py()
    return climb([x.hex() for x in rows.column("node").to_pylist()], max(0, min(stride, height(total) - below)))


# ------------------------------------------------------------------ levels


def build(nodes: DataFrame, most: int, stride: int, label: str) -> list[DataFrame]:
    """The persisted levels above (g, pos, total, node), ``stride`` apart; the last has one node for each group."""
    import pyarrow as pa

    def of(level):
        def up(key, rows):
            top = _trees(rows.sort_by("pos"), level * stride, stride)[-1][0]
            return pa.table({"g": [key[0].as_py()], "pos": [key[1].as_py()], "total": [rows.column("total")[0].as_py()], "node": [bytes.fromhex(top)]})

        return up

    out = [nodes]
    for level in range(-(-height(most) // stride)):
        below = out[-1].select("g", "pos", "total", "node", F.shiftright("pos", stride).alias("block"))
        out.append(stage_table(below.groupBy("g", "block").applyInArrow(of(level), "g long, pos long, total long, node binary"), f"{label}-{level + 1}"))
    return out


def push(levels: list[DataFrame], paths: DataFrame, lowest: int, stride: int, label: str) -> DataFrame:
    """(g, pos, path) of the nodes of persisted level ``lowest``, from the paths above the last one; a join a level."""
    import pyarrow as pa

    def of(level):
        def down(key, rows, above):
            rows = rows.sort_by("pos")
            trees, inherited = _trees(rows, level * stride, stride), above.column("path")[0].as_py()
            own = [siblings(trees, i) + inherited for i in range(rows.num_rows)]
            return pa.table({"g": rows.column("g"), "pos": rows.column("pos"), "path": pa.array(own, pa.list_(pa.string()))})

        return down

    for level in range(len(levels) - 2, lowest - 1, -1):
        below = levels[level].select("g", "pos", "total", "node", F.shiftright("pos", stride).alias("block")).groupBy("g", "block")
        paths = stage_table(below.cogroup(paths.groupBy("g", "pos")).applyInArrow(of(level), "g long, pos long, path array<string>"), f"{label}-{level}")
    return paths


def proofs(documents: DataFrame, digest: bool = False, stride: int = STRIDE) -> DataFrame:
    """One row a document: doc_id, lang, pos, leaf, forged, subroot, root (hex), path (siblings from its leaf to the root, empty where
    a node goes alone) and places (whether each node on the way is odd).

    With ``digest``, proof_sha256 and folded_root (from ``forged`` where there is one, else from the leaf) stand for path and places.
    """
    import pyarrow as pa

    # a number for every row makes the order total; a heap of equal rows is thus split like any other
    rows = stage_table(leaves(documents).withColumn("_row", F.monotonically_increasing_id()), "leaves")
    base = placed(rows, "lang", ["doc_id", "leaf", "_row"], "ordered").drop("_row")
    langs, n_langs = stage_counted(base.groupBy("lang").agg(F.first("total").alias("rows")), "langs")
    most = langs.agg(F.max("rows")).first()[0] or 0
    ranked = placed(langs.withColumn("_all", F.lit(0)), "_all", ["lang"], "ranked").select("lang", F.col("pos").alias("g"))
    ranked = _small(stage_table(ranked, "ranks").withColumnRenamed("lang", "_lang"), n_langs)
    base = base.join(ranked, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang").withColumnRenamed("leaf", "node")
    base = stage_table(base.withColumn("block", F.shiftright("pos", stride)), "placed")

    levels = build(base, most, stride, "level")
    subroots = levels[-1].select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(n_langs).cast("long").alias("total"), "node")
    upper = build(subroots, n_langs, stride, "upper")
    top = upper[-1].select("g", "pos", F.array(F.lower(F.hex("node"))).alias("path"))
    # below the last level a path ends with the root, and from the subroots on with subroot and root
    paths = push(upper, top, 0, stride, "upper-path")
    paths = stage_table(paths.select(F.col("pos").alias("g"), "path").join(levels[-1].select("g", F.lower(F.hex("node")).alias("subroot")), "g"), "subroots")
    paths = paths.select("g", F.lit(0).cast("long").alias("pos"), F.concat("path", F.array("subroot")).alias("path"))
    paths = push(levels, paths, 1, stride, "path")
    schema = "doc_id long, lang string, pos long, leaf string, forged string, subroot string, root string, "
    schema += "proof_sha256 string, folded_root string" if digest else "path array<string>, places array<int>"

    def finish(key, rows, above):
        rows = rows.sort_by("pos")
        g, total = rows.column("g")[0].as_py(), rows.column("total")[0].as_py()
        *rest, root, subroot = above.column("path")[0].as_py()
        trees = _trees(rows, 0, stride)
        nodes = trees[0]
        in_lang = height(total)
        g_places = [g >> i & 1 for i in range(height(n_langs))]
        out = {name.split()[0]: [] for name in schema.split(", ")}
        for i, (doc_id, lang, pos, forged) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "lang", "pos", "forged")), strict=True)):
            path, places = siblings(trees, i) + rest, [pos >> j & 1 for j in range(in_lang)] + g_places
            forged = forged.hex() if forged is not None else None
            if digest:
                last = {"proof_sha256": _h(*path), "folded_root": fold(forged or nodes[i], path, places)}
            else:
                last = {"path": path, "places": places}
            row = {"doc_id": doc_id, "lang": lang, "pos": pos, "leaf": nodes[i], "forged": forged, "subroot": subroot, "root": root} | last
            for name, x in row.items():
                out[name].append(x)
        types = {"doc_id": pa.int64(), "pos": pa.int64(), "path": pa.list_(pa.string()), "places": pa.list_(pa.int32())}
        return pa.table({name: pa.array(x, types.get(name, pa.string())) for name, x in out.items()})

    return base.groupBy("g", "block").cogroup(paths.groupBy("g", "pos")).applyInArrow(finish, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proofs(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_PART = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_PART.format(f) for f in FIELDS)
_FORGED = " || ".join(_PART.format("(n_chars + 1)" if f == "n_chars" else f) for f in FIELDS)
_CRC = (
    "xor(list_reduce(list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: "
    "list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295)"
)

ORACLE_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf,
         CASE WHEN {_CRC.format("doc_id::VARCHAR")} % {TAMPERED} = 0 THEN sha256({_FORGED}) ELSE sha256({_LEAF}) END AS claim,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total
  FROM documents),
up(lang, lvl, pos, total, node) AS (
  SELECT lang, 0, pos, total, leaf FROM leaf
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, (max(total) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE total > 1 GROUP BY lang, lvl, pos // 2),
sub AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g, count(*) OVER () AS total FROM up WHERE total = 1),
top(lvl, pos, total, node) AS (
  SELECT 0, g, total, subroot FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 2, (max(total) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE total > 1 GROUP BY lvl, pos // 2),
base AS (
  SELECT l.doc_id, l.lang, l.leaf, l.claim, l.pos, s.g, s.subroot, (SELECT node FROM top WHERE total = 1) AS root,
         (SELECT max(lvl) FROM up u WHERE u.lang IS NOT DISTINCT FROM l.lang) AS below, (SELECT max(lvl) FROM top) AS above
  FROM leaf l JOIN sub s ON l.lang IS NOT DISTINCT FROM s.lang),
step AS (
  SELECT b.doc_id, b.claim, k.i, CASE WHEN k.i < below THEN (b.pos >> k.i) & 1 ELSE (b.g >> (k.i - below)) & 1 END AS odd, coalesce(u.node, t.node, '') AS sibling
  FROM base b CROSS JOIN range(0, 80) k(i)
  LEFT JOIN up u ON k.i < below AND u.lang IS NOT DISTINCT FROM b.lang AND u.lvl = k.i AND u.pos = xor(b.pos >> k.i, 1)
  LEFT JOIN top t ON k.i >= below AND t.lvl = k.i - below AND t.pos = xor(b.g >> (k.i - below), 1)
  WHERE k.i < below + above),
proof AS (SELECT doc_id, sha256(string_agg(sibling, '' ORDER BY i)) AS proof_sha256 FROM step GROUP BY doc_id),
folded(doc_id, i, digest) AS (
  SELECT doc_id, 0, claim FROM base
  UNION ALL
  SELECT f.doc_id, f.i + 1, sha256(CASE WHEN odd = 1 THEN sibling || digest ELSE digest || sibling END) FROM folded f JOIN step s ON s.doc_id = f.doc_id AND s.i = f.i)
SELECT b.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM base b JOIN folded f ON f.doc_id = b.doc_id AND f.i = below + above LEFT JOIN proof p ON p.doc_id = b.doc_id
"""
