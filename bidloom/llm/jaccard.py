"""N-gram Jaccard self-join as a grouped prefix join, and the components of its links.

Words are runs of non-space characters with A-Z lowered; a document's set holds its distinct 5-word shingles (the whole
sequence where there are fewer words). Documents link when 100 * |intersection| >= 75 * |union|.

1. Shingles that many documents hold are counted over all texts; they come last in the global order of shingles. The order
   decides how much work is done, never the result, so the list of such shingles may be bounded (``HEAVY_MOST``), and a task's
   buffer of ``BUFFER`` shingles may leave out what it holds but once.
2. Two linking sets share a shingle among the first n - ceil(0.75 n) + 1 of each. Documents of equal size and equal prefix form
   one group; a task emits a group's prefix once. One shuffle by shingle finds the light shingles that more than one group
   holds; heavy ones, whose runs may hold a third of all rows, are summed by partial aggregates instead and never meet in a task.
   If the first shingle that two sets share stands at place i of n, they share n - i at most; so a place tells the largest set
   that may link there (``reach``), and two groups of a run pair up only where each lies within the reach of the other.
3. Runs (the groups that share a shingle) with the same groups are taken once, by their earliest shingle; the classes of equal
   sets in a group are a run of their own. First every group meets one leader, the least of those its runs have. A run is dealt
   into cells of about ``CELL`` groups. In each later round a group outside a run's largest component asks some further cells,
   ``GROWTH`` times as many as in the round before; what it meets there within both reaches are the group pairs.
   They are expanded to pairs of classes, each asked once: parity sketches, whose differing bits bound the sets' difference from
   below, then whole sets. Links merge into components, each task's links to stars first. A group waits no more when it lies in the largest component of its run or
   has asked all cells; when none waits, no link between different components can be missed. So a group of thousands of near
   copies costs a star and a few questions for each member that the star leaves out, not all its pairs.

Null or empty texts have an empty set and link with nothing. Equal texts are one class; copies are never expanded into pairs.
Repeated rows each give a row. Ids may be null or repeat; a class with no id but null takes no part in links with other texts, and
its rows have a null component_id. Ties do not arise: the least id names a component. Very long texts are taken whole, one at a
time. An empty table gives an empty result. Only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_in_worker, map_arrow, scalars, stage_counted, stage_table, table

WORDS, SHARE = 5, 75
#: A shingle is heavy from this many counted occurrences on; at most so many are kept for the order. Shingles in a task's buffer.
HEAVY_LEAST, HEAVY_MOST, BUFFER = 6, 200_000, 3_000_000
#: Groups in a cell of a run on average; cells a group asks in the first round after the leaders, and how that grows.
CELL, FIRST_CELLS, GROWTH = 8, 1, 8
#: Candidate ids that are broadcast at most (8 bytes each); beyond this they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Links that a task merges, on average (16 bytes each).
LINKS = 200_000


def shingles(text: str) -> np.ndarray:
    """The set of a text as sorted distinct 64-bit hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64) if n else np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    acc = h[: n - WORDS + 1].copy()
    for j in range(1, WORDS):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += h[j : n - WORDS + 1 + j]
    acc ^= acc >> np.uint64(32)
    acc *= np.uint64(0xD6E8FEB86659FD93)
    acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def prefix_length(n: int) -> int:
    return n - -(-SHARE * n // 100) + 1 if n else 0


def reach(n, place):
    """The largest set that may link with one of size n (columns or numbers) whose first shared shingle stands at this place."""
    return ((100 * n - (100 + SHARE) * place) / SHARE).cast("long")


def in_order(s: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """The set in global order, light shingles by hash, then heavy ones from the rarest to the most frequent; and how many are light."""
    if not len(heavy):
        return s, len(s)
    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
    place = np.where(heavy[at] == s, rank[at] + 1, 0)
    return s[np.lexsort((s, place))], int((place == 0).sum())


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set, as two longs."""
    wide = xxhash.xxh3_128_intdigest(s.tobytes(), seed=len(s))
    return (wide >> 64) - 2**63, (wide & (2**64 - 1)) - 2**63


def parity_sketch(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of about n buckets."""
    buckets = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the size of two sets' symmetric difference: a bucket of differing parity holds at least one of it."""
    if len(x) < len(y):
        x, y = y, x
    a, b, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x)
    while bits > 8 * len(y):
        bits //= 2
        a = (a >> bits) ^ (a & ((1 << bits) - 1))
    return (a ^ b).bit_count()


def heavy_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles (ascending hashes) and their ranks; counted in every task's buffers, summed over all."""

    def rows(batches):
        kept_in_worker("jaccard")
        held, size = [], 0

        def counted():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= 2
            return {"token": tokens[often].view(np.int64), "n": n[often]}

        for batch in batches:
            for text in scalars(batch.column(1)):
                if text:
                    s = shingles(text)
                    held.append(s)
                    size += len(s)
                    if size > BUFFER:
                        yield counted()
                        held, size = [], 0
        if held:
            yield counted()

    counts = map_arrow(docs, rows, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_LEAST)
    top = counts.orderBy(F.desc("n"), "token").limit(HEAVY_MOST).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    rank = np.empty(len(top), np.int64)
    rank[np.lexsort((tokens, top["n"].to_numpy(np.int64)))] = np.arange(len(top))
    order = np.argsort(tokens)
    return tokens[order], rank[order]


def _postings(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows of three kinds: documents (0), light prefix shingles that more than one group holds (1), heavy prefix shingles (2)."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def rows(batches):
        seen: set[int] = set()
        count = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = {k: [] for k in ("at", "n", "v1", "v2", "gkey", "sketch", "prefix", "light")}
                for text in scalars(part.column(1)):
                    s = shingles(text or "")
                    ordered, light = in_order(s, *shared.value)
                    prefix = ordered[: prefix_length(len(s))]
                    gkey = xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=len(s)) - 2**63
                    for k, v in zip(("v1", "v2"), signature(s), strict=True):
                        out[k].append(v)
                    out["at"].append(count)
                    out["n"].append(len(s))
                    out["sketch"].append(parity_sketch(s))
                    out["gkey"].append(gkey)
                    out["prefix"].append([] if gkey in seen else prefix.view(np.int64))
                    out["light"].append(light)
                    seen.add(gkey)
                    count += 1
                yield out | {"doc_id": part.column(0)}

    mapped = map_arrow(docs, rows, "doc_id long, at long, n long, v1 long, v2 long, gkey long, sketch binary, prefix array<long>, light int")
    token = F.posexplode(F.concat(F.array(F.lit(None).cast("long")), "prefix")).alias("place", "token")
    rows_ = mapped.select(token, "gkey", "n", "doc_id", "at", "v1", "v2", "sketch", "light")
    kind = F.when(F.col("token").isNull(), 0).when(F.col("place") <= F.col("light"), 1).otherwise(2).cast("byte")
    of_doc = [F.when(F.col("token").isNull(), F.col(c)).alias(c) for c in ("doc_id", "v1", "v2", "sketch")]
    # only light shingles meet; all other rows are spread by a key of their own
    meet = F.when(kind == 1, F.col("token")).otherwise(F.xxhash64("at", "place", "v1"))
    rows_ = rows_.select(kind.alias("kind"), "token", "gkey", "n", reach(F.col("n"), F.col("place") - 1).alias("reach"), *of_doc, meet.alias("meet"))
    w = Window.partitionBy("meet", "kind")
    # a group stays if some size in its run is within its reach and some reach covers its size
    kept = rows_.withColumn("least", F.min("n").over(w)).withColumn("most", F.max("reach").over(w)).where("kind <> 1 OR (reach >= least AND n <= most)").drop("least", "most")
    kept = kept.withColumn("members", F.count("*").over(w)).where("kind <> 1 OR members > 1").withColumn("reaches", F.sum("reach").over(w))
    for run, seed in (("run1", 1), ("run2", 2)):
        kept = kept.withColumn(run, F.when(F.col("kind") == 1, F.try_sum(_half(seed)).over(w)))
    return kept.drop("meet")


def _half(seed: int):
    """A share of the bits that name a run's groups, small enough that sums do not overflow."""
    return F.shiftright(F.xxhash64("gkey", F.lit(seed)), 22)


def _heavy_runs(postings: DataFrame) -> DataFrame:
    """The heavy postings that may pair up, with the sums that the light ones have; at most ``HEAVY_MOST`` shingles are broadcast."""
    rows = postings.where("kind = 2").select("token", "gkey", "n", "reach")
    span = rows.groupBy("token").agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    rows = rows.join(F.broadcast(span), "token").where("reach >= least AND n <= most").drop("least", "most")
    sums = rows.groupBy("token").agg(F.count("*").alias("members"), F.sum("reach").alias("reaches"), F.try_sum(_half(1)).alias("run1"), F.try_sum(_half(2)).alias("run2"))
    return rows.join(F.broadcast(sums.where("members > 1")), "token")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sketches leave room for a link."""

    def rows(batches):
        for batch in batches:
            out = {"a": [], "b": []}
            for a, b, n, x, y in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if (100 + SHARE) * least_difference(x, y) <= (100 - SHARE) * n:
                    out["a"].append(a)
                    out["b"].append(b)
            yield out

    end = lambda name: classes.select(F.col("cid").alias(name), F.col("sketch").alias(f"x_{name}"), F.col("n").alias(f"n_{name}"))
    both = pairs.join(end("b"), "b").join(end("a"), "a").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "x_a", "x_b")
    return map_arrow(both, rows, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link."""

    def rows(batches):
        for batch in batches:
            out = {"a": [], "b": []}
            for a, b, x, y in zip(*(scalars(batch.column(i)) for i in range(4)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                if 100 * both >= SHARE * (len(x) + len(y) - both):
                    out["a"].append(a)
                    out["b"].append(b)
            yield out

    right = pairs.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b")
    return map_arrow(right.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("x")), "a").select("a", "b", "x", "y"), rows, "a long, b long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` where its counted rows are few enough; beyond that it is shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer pairs with the same components: each end with the least of its component."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(ends))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        # a label's own label falls too, so that whole trees move at once
        for x in (i, j, label[i], label[j]):
            np.minimum.at(new, x, low)
        while (label := new[new]).tolist() != new.tolist():
            new = label
        if (label[i] == label[j]).all():
            break
    kept = label != np.arange(len(ends))
    return ends[label[kept]], ends[kept]


def _stars(links: DataFrame, tasks: int) -> DataFrame:
    """(cid, comp): each end of a task's links with the least of its component there."""

    def rows(batches):
        a = b = np.empty(0, np.int64)
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in (0, 1)])
            size += batch.num_rows
            if size > LINKS:
                a, b = forest(*map(np.concatenate, zip((a, b), *held, strict=True)))
                held, size = [], 0
        a, b = forest(*map(np.concatenate, zip((a, b), *held, strict=True)))
        roots = np.unique(a)
        yield {"cid": np.concatenate([roots, b]), "comp": np.concatenate([roots, a])}

    return map_arrow(links.select("a", "b").coalesce(tasks), rows, "cid long, comp long")


def as_links(labels: DataFrame) -> DataFrame:
    """Links with the components that the labels tell."""
    return labels.where("cid <> comp").select(F.col("comp").alias("a"), F.col("cid").alias("b"))


def components(links: DataFrame, n_links: int, files: int) -> tuple[DataFrame, int]:
    """(cid, comp), the least id reachable by links, for every id that has a link, and their number.

    Each task merges its links, ``LINKS`` on average, to stars. Where one task holds them all, these are the components; where there
    are more, the stars are merged by minimum labels with pointer jumping.
    """
    tasks = n_links // LINKS + 1
    labels, rows = stage_counted(_stars(links, tasks), "labels")
    if tasks == 1:
        return labels, rows
    links = as_links(labels)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, rows = stage_counted(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cid"), F.least("a", "m").alias("comp")).coalesce(files), "labels")
    while True:
        near = both.join(_small(labels.withColumnRenamed("cid", "b"), rows), "b").groupBy("a").agg(F.min("comp").alias("m")).withColumnRenamed("a", "cid")
        lower = near.join(_small(labels, rows), "cid").select("cid", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        # what a label points to may itself have a lower label by now
        jump = labels.select(F.col("cid").alias("comp"), F.col("comp").alias("next"))
        lower = lower.join(_small(jump, rows), "comp", "left").select("cid", "was", F.least("comp", F.coalesce("next", "comp")).alias("comp"))
        labels, moved = stage_counted(lower.coalesce(files), "labels", "was <> comp")
        labels = labels.select("cid", "comp")
        if not moved:
            return labels, rows


def _files(rows: int) -> int:
    """Files of a staged table of so many narrow rows; grows with the rows."""
    return 6 + rows // 200_000


def _runs(postings: DataFrame, classes: DataFrame, groups: DataFrame) -> tuple[DataFrame, int]:
    """(run, unit, n, reach, cells, cell), the units of each run: groups by their shingles and classes within their group; and their number."""
    columns = ("token", "gkey", "n", "reach", "reaches", "members", "run1", "run2")
    shared = postings.where("kind = 1").select(*columns).unionByName(stage_table(_heavy_runs(postings).select(*columns), "heavy"))
    # of runs with the same groups the earliest shingle has the widest reach of each of them
    one = shared.groupBy("members", "run1", "run2").agg(F.max(F.struct("reaches", "token")).alias("top")).where("run1 IS NOT NULL AND run2 IS NOT NULL").select("top.token")
    one = one.unionByName(shared.where("run1 IS NULL OR run2 IS NULL").select("token").distinct())
    runs = shared.join(one, "token", "left_semi").select("token", "gkey", "n", "reach").distinct()
    across = runs.join(groups, ["gkey", "n"]).select(F.col("token").alias("run"), F.col("gid").alias("unit"), "n", "reach")
    within = classes.join(groups.where("classes > 1"), ["gkey", "n"]).select(F.col("gid").alias("run"), F.col("cid").alias("unit"), "n", reach(F.col("n"), F.lit(0)).alias("reach"))
    rows = stage_table(across.unionByName(within), "run-units")
    sizes = rows.groupBy("run").count().where("count > 1").select("run", F.ceil(F.col("count") / CELL).cast("int").alias("cells"))
    return stage_counted(rows.join(sizes, "run").withColumn("cell", F.pmod(F.xxhash64("unit", "run"), F.col("cells")).cast("int")), "runs")


def _waiting(state: DataFrame, units: DataFrame, labels: DataFrame | None, cells: int) -> DataFrame:
    """The open runs with each unit's component (null where its classes lie in several) and the number of cells it asks now."""
    of = units if labels is None else units.join(labels, "cid", "left").select("unit", F.coalesce("comp", "cid").alias("cid"))
    comps = of.groupBy("unit").agg(F.min("cid").alias("comp"), F.max("cid").alias("last"))
    now = state.join(comps.select("unit", F.when(F.col("comp") == F.col("last"), F.col("comp")).alias("comp")), "unit")
    # a run is open while a unit outside its largest component has cells left to ask
    counted = now.groupBy("run", "comp").agg(F.count("*").alias("c"), F.max((F.col("done") < F.col("cells")).cast("int")).alias("more"))
    top = F.max(F.when(F.col("comp").isNotNull(), F.struct("c", F.negative("comp").alias("m"), "more")))
    main = counted.groupBy("run").agg(F.sum("more").alias("more"), top.alias("top")).where("more > coalesce(top.more, 0)").select("run", F.negative("top.m").alias("main"))
    waits = (F.col("done") < F.col("cells")) & F.coalesce(F.col("comp") != F.col("main"), F.lit(True))
    now = now.join(main, "run").withColumn("left", F.when(waits, F.col("cells") - F.col("done")).otherwise(0))
    # a unit asks its smallest runs first, where few copies meet, and as much in its largest, where the large groups are; it has at
    # most as many runs as its prefix has shingles
    before = lambda *order: F.coalesce(F.sum("left").over(Window.partitionBy("unit").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(cells) - F.least(before("cells", "run"), before(F.desc("cells"), F.desc("run")))
    asks = F.greatest(F.lit(0), F.least(F.col("left"), room)).cast("int")
    return now.withColumn("asks", asks).select("run", "unit", "n", "reach", "cells", "cell", "done", "comp", "asks")


def _asked(now: DataFrame) -> DataFrame:
    """The unit pairs (a, b) that the questions of this round meet within both reaches and outside one component."""
    to = F.explode(F.transform(F.sequence(F.lit(0), F.col("asks") - 1), lambda i: F.pmod(F.col("cell") + F.col("done") + i, F.col("cells")))).alias("cell")
    askers = now.where("asks > 0").select("run", F.col("unit").alias("a"), F.col("n").alias("na"), F.col("reach").alias("ra"), F.col("comp").alias("ca"), to)
    others = now.select("run", "cell", F.col("unit").alias("b"), F.col("n").alias("nb"), F.col("reach").alias("rb"), F.col("comp").alias("cb"))
    apart = F.coalesce(F.col("ca") != F.col("cb"), F.lit(True))
    met = askers.join(others, ["run", "cell"]).where((F.col("a") != F.col("b")) & apart & (F.col("na") <= F.col("rb")) & (F.col("nb") <= F.col("ra")))
    return met.select("a", "b")


def _led(runs: DataFrame) -> DataFrame:
    """One unit pair for each unit: with the least leader of its runs."""
    leaders = runs.groupBy("run").agg(F.min(F.struct("unit", "n", "reach")).alias("l"))
    met = runs.join(leaders, "run").where("l.unit <> unit AND l.n <= reach AND n <= l.reach")
    return met.groupBy(F.col("unit").alias("b")).agg(F.min("l.unit").alias("a"))


def _expanded(met: DataFrame, units: DataFrame) -> DataFrame:
    """The class pairs (a, b), a < b, of unit pairs."""
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    end = lambda name: units.select(F.col("unit").alias(name), F.col("cid").alias(f"c{name}"))
    both = met.join(end("a"), "a").join(end("b"), "b").where("ca <> cb")
    return both.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, n_shingles, its class of equal sets, and component_id, the smallest id reachable by links."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    postings = stage_table(_postings(docs, heavy_shingles(docs)), "postings")
    members = postings.where("kind = 0").select("doc_id", "n", "v1", "v2")
    classes = postings.where("kind = 0 AND n > 0").groupBy("v1", "v2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("gkey").alias("gkey"), F.first("sketch").alias("sketch")).where("rep IS NOT NULL")
    # odd numbers name classes, even ones groups; they hold from here on, as the table is written
    classes = stage_table(classes.withColumn("cid", 2 * F.monotonically_increasing_id() + 1), "classes")
    groups = stage_table(classes.groupBy("gkey", "n").agg(F.count("*").alias("classes"), (F.min("cid") - 1).alias("gid")), "groups")
    runs, n_runs = _runs(postings, classes, groups)
    files = _files(n_runs)
    grouped = classes.select("gkey", "n", "cid").join(groups, ["gkey", "n"])
    units = grouped.select(F.col("gid").alias("unit"), "cid").unionByName(grouped.where("classes > 1").select(F.col("cid").alias("unit"), "cid"))
    units = stage_table(units.join(runs.select("unit").distinct(), "unit", "left_semi"), "units")

    labels, sets, asked, labelled, n_sets = None, None, None, 0, 0
    state, cells, met = runs.withColumn("done", F.lit(0)), FIRST_CELLS, _led(runs)
    while True:
        pairs = _expanded(met, units)
        pairs, n_pairs = stage_counted((pairs if asked is None else pairs.join(asked, ["a", "b"], "left_anti")).coalesce(files), "pairs")
        asked = pairs if asked is None else asked.unionByName(pairs)
        near, n_near = stage_counted(_near(pairs, classes).coalesce(files), "near") if n_pairs else (pairs, 0)
        if n_near:
            ends = near.select(F.explode(F.array("a", "b")).alias("cid"))
            wanted = classes.join(_small(ends, 2 * n_near), "cid", "left_semi")
            wanted = wanted if sets is None else wanted.join(_small(sets.select("cid"), n_sets), "cid", "left_anti")
            wanted, n_wanted = stage_counted(wanted.select(F.col("rep").alias("doc_id"), "v1", "v2", "cid").coalesce(files), "wanted")
            if n_wanted:
                more = _sets(docs, wanted, n_wanted)
                sets, n_sets = more if sets is None else sets.unionByName(more), n_sets + n_wanted
            found, n_found = stage_counted(_verified(near, sets).coalesce(files), "found")
            if n_found:
                # the labels so far stand for all links before
                links = found if labels is None else found.unionByName(as_links(labels))
                labels, labelled = components(links, n_found + labelled, files)
        now, n_now = stage_counted(_waiting(state, units, None if labels is None else _small(labels, labelled), min(cells, 1 << 30)).coalesce(files), "round")
        if not n_now:
            break
        state, cells, met = now.withColumn("done", F.col("done") + F.col("asks")).drop("comp", "asks"), cells * GROWTH, _asked(now)
    of_class = classes.select("v1", "v2", "cid", "rep")
    if labels is not None:
        named = of_class.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        of_class = named.join(named.groupBy("comp").agg(F.min("rep").alias("least")), "comp").select("v1", "v2", F.col("least").alias("rep"))
    joined = members.join(of_class.select("v1", "v2", "rep"), ["v1", "v2"], "left")
    named_set = F.concat_ws("-", F.hex("v1"), F.hex("v2"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), named_set.alias("class_id"), F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _sets(docs: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """(cid, set) of the classes asked for, from the text of their first documents."""
    ids = _small(wanted.select("doc_id"), n_wanted)

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingles(t or "") for t in scalars(batch.slice(at, 256).column(1))]
                named = [signature(s) for s in sets]
                yield {"v1": [v[0] for v in named], "v2": [v[1] for v in named], "set": [s.tobytes() for s in sets]}

    sets = map_arrow(docs.join(ids, "doc_id", "left_semi"), rows, "v1 long, v2 long, set binary")
    # an id that repeats with other texts brings other sets along; equal ones are needed once
    return stage_table(sets.join(wanted.select("v1", "v2", "cid"), ["v1", "v2"]).select("cid", "set").dropDuplicates(["cid"]), "sets")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
