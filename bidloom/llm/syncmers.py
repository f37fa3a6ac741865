"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text's units are hashed; a k-mer of ``K`` units is an anchor when, of its inner ``S``-unit substrings, the one with the least
hash lies at either edge. Whether a k-mer is an anchor depends on its own units alone, so an edit moves no anchor outside it.
Units are the words; of a word longer than ``LONG`` characters each character is a unit. Texts of fewer than ``2 * K`` units also
have the anchors of their characters (words joined by one space), so that short texts compare with each other and with those of
``K`` words and more. Where nothing is an anchor, as in texts of fewer than K characters, the hash of the whole text is the one.

A fingerprint holds every anchor with the place of its first unit, as ``hash@place`` in hex, joined by dots, by hash and then
place; places among characters of short texts have bit 26 set. Likeness goes by place: anchors of equal hash are matched one to one
in order of their places, so a passage that stands once in one text and three times in the other is shared once; and of the matched
ones those count that have moved by about as much as most (``DRIFT``). So a text with its parts in another order shares little with
the first one, while a passage that stands elsewhere as a whole is found. Likeness is the count over all anchors of both.

Null counts as empty. Equal texts have equal fingerprints. Ties: repeated ids are put in order of their texts, null ids come first,
and of two middle shifts the lower one is the median. Texts of any length are taken whole, in one row. An empty table gives an empty
result. Only the id and text columns are read, so other columns may have any names. One shuffle moves the texts: documents meet in buckets of neighbouring ids, and each bucket also gets a copy of the first document of
the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, S = 5, 2
#: A longer word is taken by characters.
LONG = 32
#: The share of the longer text by which a matched anchor may stray from the median shift, as one over this.
DRIFT = 8
#: Ids that share a bucket, as a power of two.
BUCKET_BITS = 10
#: Bits of an anchor kept for its place, the highest of them for places among characters; no row can hold 2**26 units.
PLACE_BITS = 27
_PLACE = (1 << PLACE_BITS) - 1


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _units(words: Column) -> Column:
    cut = F.transform(words, lambda w: F.when(F.char_length(w) > LONG, F.split(w, "")).otherwise(F.array(w)))
    return F.when(F.exists(words, lambda w: F.char_length(w) > LONG), F.flatten(cut)).otherwise(words)


def _syncmers(units: Column, kind: int = 0) -> Column:
    """The anchors among hashed units, in order of place."""

    def pick(h: Column) -> Column:
        # inner[i] covers units i and i+1; a k-mer at i has inner hashes i to i+K-S
        inner = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
        return _let(inner, lambda m: select(h, m))

    def select(h: Column, m: Column) -> Column:
        def edge(x, i):
            last = F.get(m, i + (K - S))
            middle = F.least(*[F.get(m, i + j) for j in range(1, K - S)])
            return F.when((i <= F.size(h) - K) & ((x <= F.least(middle, last)) | (last <= F.least(middle, x))), F.shiftleft(F.xxhash64(*[F.get(h, i + j) for j in range(K)]), PLACE_BITS).bitwiseOR(i.cast("long").bitwiseOR(F.lit(kind << (PLACE_BITS - 1)))))

        return F.filter(F.transform(m, edge), lambda x: x.isNotNull())

    return _let(F.transform(units, lambda u: F.xxhash64(u)), pick)


def anchors(text: Column) -> Column:
    """All anchors of a text as longs, ascending: 37 bits of hash above the place of the first unit."""
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")

    def found(ws: Column) -> Column:
        short = lambda us: F.when(F.size(us) < 2 * K, _syncmers(F.split(F.array_join(ws, " "), ""), 1)).otherwise(F.array().cast("array<bigint>"))
        return _let(_units(ws), lambda us: F.concat(_syncmers(us), short(us)))

    whole = F.array(F.shiftleft(F.xxhash64(text), PLACE_BITS))
    return F.sort_array(_let(_let(words, found), lambda a: F.when(F.size(a) > 0, a).otherwise(whole)))


def as_text(a: Column) -> Column:
    return F.lower(F.array_join(F.transform(a, lambda x: F.concat(F.hex(F.shiftrightunsigned(x, PLACE_BITS)), F.lit("@"), F.hex(x.bitwiseAND(F.lit(_PLACE))))), "."))


def numbered(a: Column) -> Column:
    """Ascending anchors with their number among those of equal hash, in order of place, instead of the place."""
    bare = F.transform(a, lambda x: x.bitwiseAND(F.lit(~_PLACE)))
    starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.shiftright(F.get(a, i), PLACE_BITS) != F.shiftright(F.get(a, i - 1), PLACE_BITS)))
    run = lambda i, end: F.transform(F.sequence(i, end - 1), lambda j: F.get(a, i).bitwiseAND(F.lit(~_PLACE)).bitwiseOR((j - i).cast("long")))
    counted = _let(starts, lambda s: F.flatten(F.transform(s, lambda i, k: run(i, F.coalesce(F.get(s, k + 1), F.size(a))))))
    return F.when(F.size(F.array_distinct(bare)) == F.size(a), bare).otherwise(counted)


def shifts(a: Column, b: Column) -> Column:
    """How far each anchor that two lists share has moved, ascending; those of equal hash are matched one to one in order of place."""
    entries = lambda xs, side: _let(numbered(xs), lambda keys: F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.lit(side).alias("side"), place(F.get(xs, i)).alias("p"))))

    def moved(m: Column) -> Column:
        # a key stands at most once in either list, so equal neighbours are a match
        return F.transform(m, lambda x, i: F.when(x["k"] == F.get(m, i + 1)["k"], F.get(m, i + 1)["p"] - x["p"]))

    both = F.sort_array(F.concat(entries(a, 0), entries(b, 1)))
    return F.sort_array(F.filter(_let(both, moved), lambda x: x.isNotNull()))


def place(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << (PLACE_BITS - 1)) - 1))


def likeness(a: Column, b: Column) -> Column:
    """Of all anchors of two texts the share that stands in both at like places: matched anchors count whose shift differs from the
    median shift of all matched ones by at most an eighth of the longer text."""
    longest = F.greatest(*[F.array_max(F.transform(x, place)) for x in (a, b)]) + 1

    def share(s: Column, longer: Column) -> Column:
        median = F.get(s, ((F.size(s) - 1) / 2).cast("int"))
        near = _let(median, lambda m: F.size(F.filter(s, lambda x: F.abs(x - m) * DRIFT <= longer)))
        return F.when(F.size(s) > 0, _let(near, lambda n: n / (F.size(a) + F.size(b) - n))).otherwise(0.0)

    # what a lambda names is worked out for each element, so the length is bound before
    return _let(longest, lambda longer: _let(shifts(a, b), lambda s: share(s, longer)))


def next_bucket(buckets: DataFrame) -> DataFrame:
    """(bucket, next): the next larger bucket of the table, after the last one the first; by a radix tree, 2**16 rows a window."""
    levels = [buckets.select(F.col("bucket").alias("k"), F.col("bucket").alias("first")).distinct()]
    for _ in range(3):
        levels.append(levels[-1].groupBy(F.shiftright("k", 16).alias("k")).agg(F.min("first").alias("first")))
    after = None
    for i in (3, 2, 1, 0):
        w = Window.partitionBy("up").orderBy("k")
        here = levels[i].withColumn("up", F.shiftright("k", 16) if i < 3 else F.lit(0).cast("long"))
        here = here.withColumn("lead", F.lead("first").over(w)).withColumn("least", F.min("first").over(Window.partitionBy("up")))
        if after is not None:
            here = here.join(after, "up").withColumn("lead", F.coalesce("lead", "after"))
        after = here.select(F.col("k").alias("up"), F.coalesce("lead", "least").alias("after"))
    return after.select(F.col("up").alias("bucket"), F.col("after").alias("next"))


def with_next(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the next document's text; rows come sorted within buckets of neighbouring ids."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.shiftright(key, BUCKET_BITS).alias("bucket"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    firsts = docs.groupBy("bucket").agg(F.min("key").alias("key"))
    nexts = next_bucket(firsts)
    # the first document of each bucket also goes, as the last one, to the bucket before
    lent = firsts.join(nexts.select(F.col("bucket").alias("to"), F.col("next").alias("bucket")), "bucket").select("key", "to")
    # of rows with that id the one of least text
    guests = docs.join(lent, "key").groupBy("to").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), F.lit(2**63 - 1).alias("key"), F.col("to").alias("bucket"), "text", F.lit(1).alias("guest"))
    rows = docs.withColumn("guest", F.lit(0)).unionByName(guests)
    w = Window.partitionBy("bucket").orderBy("guest", "key", "text")
    return rows.select("bucket", "doc_id", "key", "guest", "text", F.lead("text").over(w).alias("next_text"))


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ``anchors``: all anchors of every document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(id_col, text_col, anchors(text).alias("anchors"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("bucket").orderBy("guest", "key", "text")
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) AS INT))"), F.expr("substring(next_text, 1, cast(floor(char_length(text) / 4) AS INT))"))
    rows = with_next(table(spark, sf_dir, "documents")).select("bucket", "doc_id", "key", "guest", "text", n.cast("long").alias("n_chars"), quarter.alias("q"), F.coalesce(edited, F.lit("")).alias("edited"))
    rows = rows.withColumn("fp", anchors(F.col("text"))).withColumn("next_fp", F.lead("fp").over(w)).where("guest = 0").withColumn("edited_fp", anchors(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
