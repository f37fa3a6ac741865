"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a labelled sample recognises exactly the sample's substrings. A text is parsed greedily
into longest matches; the language in whose automaton it needs the fewest phrases a symbol wins, ties going to the language that
comes first by name. A phrase is a pointer into the sample and counts 1; the last one, which the text's end cuts short, counts
log(N / k) / log(N) where its string stands k times in the N symbols of the sample: so short texts are told apart by how common
they are. Symbols are the UTF-8 bytes of all lower-cased letters, of any script, and 0 for everything else; every label is learned.

Fitting: at most ``TRAIN_DOCS`` documents a language, those of least id hash, ``TRAIN_CHARS`` symbols of each language after parts
that another language explains better are dropped (labelled documents hold foreign passages). The sample, not the automata,
travels to the tasks, where a worker builds them once. Predicting is one pass without a shuffle. The texts of a batch are cut into
lanes of ``LANE`` symbols, which step through the automata together; then each lane is parsed again from the state in which the
lane before it ended, until no state changes: the result is that of one parse of each whole text.

Null texts and texts without a letter are ``und``, and so is everything where nothing is learned. Ids may be null or repeat: each
row is predicted for itself, in training a null id takes no part and an id counts with at most ``TRAIN_DOCS`` rows. An empty table
gives an empty result. Texts of any length are parsed whole. Other columns pass through, but for such as bear the two result names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_in_worker, scalars, table

#: Bounds of the labelled sample: documents a language, symbols taken of each, symbols kept for the automaton.
TRAIN_DOCS, DOC_CHARS, TRAIN_CHARS = 120, 1500, 20_000
#: PAD fills lanes; no UTF-8 text holds that byte.
LANE, PAD = 256, 255

_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def symbols_of(text: str) -> np.ndarray:
    """UTF-8 bytes of the lower-cased letters; 0 separates (each character that is no letter)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.frombuffer(np.where(_LETTER[codes], codes, 0).astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)


class Automaton(NamedTuple):
    """Step table: entry [state * width + column] is the next state, plus 2**30 where a phrase ends; ``columns`` has each byte's column,
    ``cost`` what the phrase that ends in a state counts."""

    table: np.ndarray
    columns: np.ndarray
    width: int
    cost: np.ndarray


def automaton(symbols: list[int]) -> Automaton:
    """Suffix automaton of a sample; a column for each byte in it, one for all bytes it lacks and one for PAD."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    # how often the strings of a state occur: once for each prefix that ends there, and what longer states hand down
    times = np.zeros(len(step))
    state = 0
    for c in symbols:
        state = step[state][c]
        times[state] += 1
    for s in sorted(range(1, len(step)), key=length.__getitem__, reverse=True):
        times[link[s]] += times[s]
    cost = np.log(max(len(symbols), 2) / np.maximum(times, 1)) / np.log(max(len(symbols), 2))
    cost[0] = 0
    own = sorted(step[0])
    columns = np.full(256, len(own), np.int32)
    columns[own] = range(len(own))
    columns[PAD] = len(own) + 1
    at = dict(zip(own, range(len(own)), strict=True))
    out = np.empty((len(step), len(own) + 2), np.int32)
    out[:] = [*(step[0][c] + (1 << 30) for c in own), 1 << 30, 0]
    for s, moves in enumerate(step):
        for c, t in moves.items():
            out[s, at[c]] = t
        out[s, -1] = s
    return Automaton(out.ravel(), columns, len(own) + 2, cost)


def count_phrases(lanes: np.ndarray, step: Automaton, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Whole phrases that each lane (a column of symbols) ends, and the states at its end, from the root or the given states."""
    state, found = np.zeros(lanes.shape[1], np.int32) if state is None else state, np.zeros(lanes.shape[1], np.int32)
    for row in lanes:
        v = step.table.take(state * step.width + step.columns.take(row))
        found += v >> 30
        state = v & ((1 << 30) - 1)
    return found, state


def phrase_rates(texts: list[np.ndarray], steps: list[Automaton]) -> np.ndarray:
    """Phrases a symbol of each text (rows) in each automaton (columns)."""
    n = np.array([len(t) for t in texts])
    lanes_of = np.maximum(-(-n // LANE), 1)
    first = np.concatenate([[0], np.cumsum(lanes_of)])
    flat = np.full(int(first[-1]) * LANE, PAD, np.uint8)
    for i, t in enumerate(texts):
        flat[first[i] * LANE : first[i] * LANE + len(t)] = t
    flat = flat.reshape(-1, LANE)
    follows = np.ones(len(flat), bool)
    follows[first[:-1]] = False
    out = np.zeros((len(texts), len(steps)))
    for k, step in enumerate(steps):
        found, ends, began = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int32), np.zeros(len(flat), np.int32)
        todo = np.arange(len(flat))
        while len(todo):
            for at in range(0, len(todo), 8192):
                some = todo[at : at + 8192]
                found[some], ends[some] = count_phrases(np.ascontiguousarray(flat[some].T).astype(np.int32), step, began[some])
            enter = np.where(follows, np.concatenate([[0], ends[:-1]]), 0).astype(np.int32)
            todo = np.flatnonzero(enter != began)
            began = enter
        out[:, k] = np.add.reduceat(found, first[:-1]) + step.cost[ends[first[1:] - 1]]
    return out / np.maximum(n, 1)[:, None]


class Model:
    """Sample texts by language; the automata are built where they are used."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        joined = {k: [symbols_of(t) for t in samples[k]] for k in self.languages}
        self.kept = [np.concatenate([*joined[k], np.zeros(1, np.uint8)])[:TRAIN_CHARS] for k in self.languages]
        if len(self.languages) > 1:
            # parts that another language's automaton explains better leave the sample
            steps = [automaton(s.tolist()) for s in self.kept]
            for k, lang in enumerate(self.languages):
                parts = [p for t in joined[lang] for p in (t[i : i + 200] for i in range(0, len(t), 200)) if len(p) > 40]
                if parts:
                    # its own automaton knows the first parts by heart, so only the others' rates are compared with fresh parts
                    rates = phrase_rates(parts, steps)
                    good = [p for p, r in zip(parts, rates, strict=True) if r.argmin() == k]
                    self.kept[k] = np.concatenate([*good[::-1], np.zeros(1, np.uint8)])[:TRAIN_CHARS] if good else self.kept[k]
        self._steps: list[Automaton] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_steps": None}

    def steps(self) -> list[Automaton]:
        if self._steps is None:
            self._steps = [automaton(s.tolist()) for s in self.kept]
        return self._steps

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        symbols = [symbols_of(t or "") for t in texts]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        told = [i for i, s in enumerate(symbols) if s.any()] if self.languages else []
        if told:
            rates = phrase_rates([symbols[i] for i in told], self.steps())
            best = rates.argmin(1)
            for row, (i, k) in enumerate(zip(told, best.tolist(), strict=True)):
                others = np.delete(rates[row], k)
                langs[i] = self.languages[k]
                scores[i] = float(1 - rates[row, k] / others.min()) if len(others) and others.min() > 0 else float(not len(others))
        return langs, scores


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on a bounded sample of the labelled rows that are not held out: first ids by hash, then only those rows' texts."""
    usable = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = usable.select("id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= TRAIN_DOCS)
    texts = usable.join(F.broadcast(picked.select("id").distinct()), "id", "left_semi").select("id", "lang", F.substring("text", 1, DOC_CHARS).alias("text"))
    # ids may repeat, so the rows of each language are bounded once more
    bounded = texts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text"))).where(F.col("r") <= TRAIN_DOCS)
    rows = sorted(bounded.collect(), key=lambda r: (r["lang"], r["r"]))
    samples: dict[str, list[str]] = {}
    for r in rows:
        samples.setdefault(r["lang"], []).append(r["text"])
    return Model(samples)


def _cached(model: Model) -> Model:
    """The worker's own copy, so that automata are built once a worker and not once a task."""
    import hashlib

    key = hashlib.blake2b(repr(model.languages).encode() + b"".join(s.tobytes() for s in model.kept)).digest()
    return kept_in_worker(("language", key), lambda: model)


def predict(documents: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of the table and the two of the prediction, which stand for columns of the same names."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    names = [n for n in documents.columns if n not in (pred_col, score_col)]
    documents = documents.select(*(f"`{n}`" for n in names))
    at = names.index(text_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*documents.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = _cached(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                langs, scores = mine.predict(list(scalars(part.column(at))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, pred_col, score_col])

    return documents.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


