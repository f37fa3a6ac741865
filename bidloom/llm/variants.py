"""Spelling variants: words at exactly one inserted, deleted or replaced code point, the form each word leads to, and its root.

A run of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lowered is counted for its document; by the stated rule a few runs first lose
one code point. Words have ``LEAST_CHARS`` code points and ``LEAST_COUNT`` occurrences over all documents at least.

1. One pass over the texts counts distinct words in tasks; counts are summed by partial aggregates, so a frequent word is no hot key.
2. Rolling-hash deletions: for a word c_0 .. c_(L-1), with P_i the polynomial hash of its first i letters, the hash without letter i
   is P_i + (H - P_(i+1)) / B modulo 2^64, so all deletion keys of a batch come from one running sum in NumPy and no string is cut.
   A word gives its own key, a key for each distinct deletion, and a key for each deletion with its place.
3. Keys are dealt by their high bits (radix) and sorted; in a run of equal keys, a word meets those whose deletion it is, and words
   of one length that lost a letter at one place meet each other. A run holds at most one letter of the alphabet a word and place
   (90 letters), so runs are short whatever the data, and a pair is met just once.
4. Pairs are verified on the strings. Counts of near words and the form (the most frequent near word, ties to the smallest in
   code-point order, if at least ``RATIO`` times as frequent) are aggregates; roots follow the forms by pointer doubling, and as
   counts grow ``RATIO``-fold a step, a chain has log many.

Null and empty texts have no words; a null doc_id hashes as an empty one. Repeated rows count anew. Words of any length give integer
keys in proportion to their length. An empty table, or no word often enough, gives an empty result. Only doc_id and text are read,
so other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_in_worker, map_arrow, scalars, stage_counted, stage_table, table

LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: Every how many runs, by their hash, one loses a code point.
CUT = 199
#: Distinct words, and their bytes, that a task counts before it hands them on.
HELD_WORDS, HELD_BYTES = 200_000, 16 << 20
#: Letters whose keys are made at a time; rows of words that are broadcast at most.
LETTERS, BROADCAST_ROWS = 1 << 20, 200_000

_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]
#: One byte a code point up to U+00FF: letters stay, A-Z are lowered, all else is a space.
_TO_WORDS = bytes((b + 32 if b < 0x5B else b) if b in _LETTERS else 0x20 for b in range(256))
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_VALUES = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[bytes]:
    """The runs of letters, A-Z lowered, a byte a code point (Latin-1); code points beyond U+00FF are no letters."""
    return text.encode("latin-1", "replace").translate(_TO_WORDS).split()


def mutated(counts: dict[bytes, int], doc_id: int | None) -> dict[bytes, int]:
    """A document's words by the stated rule: a word whose hash with the id is divisible by ``CUT`` loses the code point it names."""
    out: dict[bytes, int] = {}
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in counts.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % CUT == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= LEAST_CHARS:
            out[word] = out.get(word, 0) + n
    return out


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over all documents."""

    def rows(batches):
        kept_in_worker("variants")
        held: Counter = Counter()
        size = 0

        def counted():
            return {"word": [w.decode("latin-1") for w in held], "n": list(held.values())}

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), scalars(batch.column(1)), strict=True):
                if text:
                    for word, n in mutated(Counter(words_of(text)), doc_id).items():
                        if word not in held:
                            size += len(word)
                        held[word] += n
                    if len(held) > HELD_WORDS or size > HELD_BYTES:
                        yield counted()
                        held, size = Counter(), 0
        if held:
            yield counted()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(docs, rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ------------------------------------------------------------------ deletion keys

WHOLE, SHORTER, PLACED = 0, 1, 2


def _mixed(h: np.ndarray, *more: np.ndarray) -> np.ndarray:
    for x in more:
        h = (h ^ x.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return h


def deletion_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, word's number, role) of all words: whole, each distinct deletion, each deletion with its place."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(letters)) - starts[of]
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, int(lengths.max(initial=1)) - 1), _B)]).astype(np.uint64))
    running = np.concatenate([[np.uint64(0)], np.cumsum(_VALUES[letters] * powers[at])])
    base = running[starts]
    whole = running[starts + lengths] - base
    before, through = running[:-1] - base[of], running[1:] - base[of]
    without = before + (whole[of] - through) * _B_INVERSE
    # next to an equal letter, the deletion is the same string
    first = np.ones(len(letters), bool)
    first[1:] = (letters[1:] != letters[:-1]) | (at[1:] == 0)
    zero = np.zeros(1, np.int64)
    key = np.concatenate([_mixed(whole, lengths, zero), _mixed(without[first], lengths[of[first]] - 1, zero), _mixed(without, lengths[of], at + 1)])
    role = np.repeat(np.array([WHOLE, SHORTER, PLACED], np.int8), [len(words), int(first.sum()), len(letters)])
    return key, np.concatenate([np.arange(len(words)), of[first], of]), role


def met(key: np.ndarray, word: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words that meet in the runs of equal keys (sorted): a shorter word with its longer ones, words of one length and place."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    a, b = [], []
    ends = np.repeat(starts + sizes, sizes)
    # each row with those behind it, step by step, as far as the longest run goes
    rows = np.arange(len(key))
    step = 1
    while len(rows := rows[rows + step < ends[rows]]):
        x, y = rows, rows + step
        fits = ((role[x] == PLACED) & (role[y] == PLACED)) | (role[x] + role[y] == WHOLE + SHORTER)
        fits &= word[x] != word[y]
        a.append(word[x[fits]])
        b.append(word[y[fits]])
        step += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), each two of the ``words`` (wid, word) at exactly one edit once, by their numbers."""

    def keyed(batches):
        for batch in batches:
            wids, spelled = batch.column(0).to_numpy(), [w.encode("latin-1") for w in scalars(batch.column(1))]
            ends = np.cumsum([len(w) for w in spelled])
            for cut in np.split(np.arange(len(spelled)), np.flatnonzero(np.diff(ends // LETTERS)) + 1):
                if len(cut):
                    key, of, role = deletion_keys([spelled[i] for i in cut])
                    yield {"key": key.view(np.int64), "wid": wids[cut][of], "role": role}

    def runs(batches):
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            # the last run may go on in the next batch
            cut = int(np.searchsorted(now[0], now[0][-1]))
            held = [x[cut:] for x in now]
            if cut:
                a, b = met(*[x[:cut] for x in now])
                yield {"a": a, "b": b}
        if held is not None:
            a, b = met(*held)
            yield {"a": a, "b": b}

    keys = map_arrow(words.select("wid", "word"), keyed, "key long, wid long, role byte")
    dealt = keys.repartition(F.shiftrightunsigned("key", 40)).sortWithinPartitions("key")
    pairs = map_arrow(dealt, runs, "a long, b long")
    end = lambda name: words.select(F.col("wid").alias(name), F.col("word").alias(f"w_{name}"))
    spelled = pairs.join(end("a"), "a").join(end("b"), "b")
    return spelled.where(F.levenshtein("w_a", "w_b", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """(wid, root): where following the forms (wid, form_id) ends."""
    seen, _ = stage_counted(forms.select("wid", F.col("form_id").alias("root")), "roots")
    while True:
        onward = seen.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        step = seen.join(onward, "root", "left").select("wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step, moved = stage_counted(step, "roots", "moved")
        seen = step.drop("moved")
        if not moved:
            return seen


def spelling_variants(documents: DataFrame) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n."""
    words = stage_table(word_counts(documents).withColumn("wid", F.monotonically_increasing_id()), "words")
    pairs = stage_table(near_pairs(words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("wid").alias("b"), F.struct(F.negative("n").alias("n"), "word", "wid").alias("other"))
    near = both.join(other, "b").groupBy(F.col("a").alias("wid")).agg(F.count("*").alias("n_near"), F.min("other").alias("top"))
    found = words.join(near, "wid", "left").withColumn("leads", F.negative("top.n") >= RATIO * F.col("n"))
    form = {"form": F.col("top.word"), "form_n": F.negative("top.n"), "form_id": F.col("top.wid")}
    found = found.select("wid", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(F.col("leads"), c).alias(k) for k, c in form.items()])
    found = stage_table(found, "forms")
    ends = roots(found.where("form_id IS NOT NULL")).join(words.select(F.col("wid").alias("root"), F.col("word").alias("root_word")), "root").drop("root")
    out = found.join(ends, "wid", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


_BYTES = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)]::BIGINT[] END))"
_CRC = (
    f"xor(list_reduce({_BYTES}, lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295)"
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS c FROM runs GROUP BY id, run),
hashed AS (SELECT run, c, {_CRC.format("id || ':' || run")} AS h FROM counted),
cut AS (SELECT CASE WHEN h % {CUT} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
gone AS (SELECT word, length(word) AS l, i, substr(word, 1, i::BIGINT) || substr(word, i::BIGINT + 2) AS rest FROM words, range(0, 100000) r(i) WHERE i < length(word)),
near AS (
  SELECT DISTINCT x.word AS a, y.word AS b FROM gone x JOIN gone y ON x.rest = y.rest AND x.i = y.i AND x.l = y.l AND x.word <> y.word
  UNION SELECT x.word, w.word FROM gone x JOIN words w ON x.rest = w.word
  UNION SELECT w.word, x.word FROM gone x JOIN words w ON x.rest = w.word),
ranked AS (
  SELECT w.word, w.n, v.word AS other, v.n AS other_n, count(v.word) OVER (PARTITION BY w.word) AS n_near,
         row_number() OVER (PARTITION BY w.word ORDER BY v.n DESC NULLS LAST, encode(v.word)) AS k
  FROM words w LEFT JOIN near x ON x.a = w.word LEFT JOIN words v ON v.word = x.b),
forms AS (SELECT word, n, n_near, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n FROM ranked WHERE k = 1),
walk(word, ends, k) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL SELECT w.word, f.form, w.k + 1 FROM walk w JOIN forms f ON f.word = w.ends WHERE f.form IS NOT NULL)
SELECT f.word, f.form, arg_max(w.ends, w.k) AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word GROUP BY f.word, f.form, f.n, f.n_near, f.form_n
"""
