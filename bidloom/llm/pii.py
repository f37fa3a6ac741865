"""Personal data by candidate gradient boosting.

High-recall generators propose spans that may overlap; boosted trees read format and context features of each; a threshold
per kind, calibrated on held-out labelled rows, selects what is redacted. Spans of the four base rules always stay.

One pass over the texts, no shuffle. A null text counts as empty; an empty table gives an empty result; repeated rows each
give a row; ids may be null and are passed through; columns other than id and text are not read, so clashing names do no harm.
Of overlapping candidates the one of highest score stays, ties going to the kind and place that come first. All scans are linear in
the text, however long. The labelled rows are generated here (``LABELLED_ROWS`` of them, fixed seed), half of
them held out for the thresholds, so the model is the same for every input and every rerun.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import map_arrow, scalars, table

#: Order of the kinds in digests: the base kinds, then those that only the method finds.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
#: Bound on the rows the classifier is fitted on.
LABELLED_ROWS = 6000
#: Precision that a threshold must reach on the held-out half.
PRECISION = 0.995

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NUMERIC = re.compile(r"[0-9]{2}")

#: Generators beyond the base rules; each is bounded to the left, so a scan stays linear.
_PROPOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\((?:at|AT|@)\)|\[(?:at|AT|@)\]|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}(?: ?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\]|(?<= )dot(?= )|\.) ?[A-Za-z0-9-]{2,63}){1,4}"),
    "card": re.compile(r"(?<![0-9.,-])[0-9]{4}(?:[ ./-]?[0-9]{2,6}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.,-])\(?[0-9]{2,5}\)?(?:[ ./-]\(?[0-9]{2,5}\)?){1,4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
#: What every match of the e-mail generator holds, so texts without it are not scanned.
_AT = re.compile(r"\((?:at|AT|@)\)|\[(?:at|AT|@)\]| at ")
#: Words that announce a kind, in English, German, French and Spanish.
CUES = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel", "write to"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "handy", "anruf", "appel", "llama"),
    "ssn": ("ssn", "social", "security number", "tax id"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
}
#: Words that announce a number of another sort.
PLAIN = ("order", "version", "invoice", "page", "isbn", "date", "total", "price", "item", "serial", "rechnung", "facture", "pedido", "ref")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail rule, found from each @ so that long runs cost linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            end = max(end, start)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four base rules, by kind and then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _NUMERIC.search(text) and not _DIGITS.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """High-recall candidates of the other generators; they may overlap each other and the base spans."""
    out = []
    if _NUMERIC.search(text):
        out = [(kind, m.start(), m.end()) for kind in ("card", "phone", "ssn", "iban") for m in _PROPOSE[kind].finditer(text)]
    if _AT.search(text):
        out += [("email", m.start(), m.end()) for m in _PROPOSE["email"].finditer(text)]
    return out


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and its context on both sides."""
    span, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 16].lower()
    groups = _DIGITS.findall(span)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    own = sum(c in before for c in CUES[kind])
    other = sum(c in before for k, cues in CUES.items() if k != kind for c in cues)
    return [
        *(float(kind == k) for k in ("email", "card", "phone", "ssn", "iban")),
        float(end - start), float(len(digits)), len(digits) / (end - start), float(len(groups)), float(max(sizes)), float(min(sizes)), float(sizes[-1]), float(sizes[0]),
        float(len(set(digits))), float(span.count("-")), float(span.count(".")), float(span.count(" ")), float("(" in span), float("/" in span),
        float(len(digits) >= 12 and luhn(digits)), float(kind == "iban" and _mod97(span)),
        float(any(a in span.lower() for a in ("(at)", "[at]", "(@)", "[@]"))), float("dot" in span.lower()),
        float(own), float(other), float(sum(c in before for c in PLAIN)), float(any(c in before[-3:] + after[:3] for c in "$€£%")), float(before[-2:].strip().endswith(":")),
        float(bool(_DIGITS.search(before[-12:]))), float(bool(_DIGITS.search(after[:8]))), float(1 <= int(groups[0] if sizes[0] <= 4 and groups else 0) <= 31), float(any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)),
    ]


def labelled(rows: int, seed: int = 11) -> Iterator[tuple[str, str, int, int, int]]:
    """Generated labelled candidates (text, kind, start, end, label): true forms in varied contexts, and look-alikes."""
    r, forms = np.random.default_rng(seed), np.random.default_rng(seed + 1)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    form = lambda *xs: xs[int(forms.integers(len(xs)))]
    at = lambda: form("(at)", "(AT)", "(@)", "[at]", "[AT]", "[@]")
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    filler = ["the", "und", "que", "on", "is", "para", "les", "of", "von", "see", "with", "a", "to", "der", "est", "por"]

    def word() -> str:
        return "".join(pick("abcdefghilmnoprstuv") for _ in range(int(r.integers(3, 9))))

    def check(body: str) -> str:
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def iban(good: bool) -> str:
        country, body = pick(["DE", "FR", "ES", "GB"]), num(18)
        value = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
        return f"{country}{value if good else (value + 7) % 97:02d}{body}"

    true = {
        "email": lambda: f"{word()}{pick(['.', '_', ''])}{word()} {at()} {word()}{form(' (dot) ', ' (DOT) ', ' [dot] ', ' [DOT] ', '.')}{pick(['com', 'org', 'net', 'de'])}" if r.random() < 0.7 else f"{word()}{at()}{word()}.{pick(['com', 'org'])}",
        "card": lambda: check(pick("3456") + num(pick([12, 13]))) if r.random() < 0.4 else "{}.{}.{}.{}".format(*re.findall("....", check(pick("456") + num(14)))),
        "phone": lambda: pick(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(str(r.integers(200, 999)), num(3), num(4)),
        "ssn": lambda: f"{int(r.integers(1, 665)):03d}-{int(r.integers(1, 99)):02d}-{int(r.integers(1, 9999)):04d}",
        "iban": lambda: iban(True),
    }
    false = {
        "email": lambda: f"{word()} at {word()}{form(' dot ', '.')}{word()}",
        "card": lambda: pick([lambda: num(16), lambda: f"2024{num(2)}{num(2)}{num(6)}", lambda: f"{num(4)} {num(4)} {num(3)}", lambda: f"{num(4)}-{num(3)}-{num(4)}-{num(2)}"])(),
        "phone": lambda: pick([lambda: f"{int(r.integers(1, 31)):02d}.{int(r.integers(1, 12)):02d}.20{num(2)}", lambda: f"20{num(2)}-{int(r.integers(1, 12)):02d}-{int(r.integers(1, 31)):02d}", lambda: f"{num(3)} {num(3)}", lambda: f"{num(2)}.{num(2)}.{num(2)}", lambda: f"{num(4)}-{num(4)}-{num(4)}", lambda: f"{num(5)}/{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(3)}.{num(2)}"])(),
        "ssn": lambda: f"9{num(2)}-{num(2)}-{num(4)}",
        "iban": lambda: iban(False),
    }
    kinds = list(true)
    for i in range(rows):
        kind, good = kinds[i % len(kinds)], bool(r.random() < 0.5)
        cue = pick(CUES[kind]) if r.random() < (0.75 if good else 0.1) else pick(PLAIN) if r.random() < (0.05 if good else 0.6) else ""
        lead = " ".join(pick(filler) if r.random() < 0.5 else word() for _ in range(int(r.integers(2, 9)))) + f" {cue}{pick([': ', ' ', ' no. '])}"
        span = (true if good else false)[kind]()
        # true forms without any cue look just like plain numbers; for the weaker kinds they count as plain
        strong = kind in ("email", "iban") or kind == "card"
        yield f"{lead}{span} {word()} {pick(filler)}", kind, len(lead), len(lead) + len(span), int(good and (strong or cue in CUES[kind]))


@lru_cache(maxsize=1)
def model() -> tuple[BoostedTrees, dict[str, float]]:
    """Trees fitted on one half of the labelled rows; for each kind the least threshold of the wanted precision on the other."""
    rows = list(labelled(LABELLED_ROWS))
    x, y = np.array([features(*row[:4]) for row in rows]), np.array([row[4] for row in rows], float)
    kinds, half = np.array([row[1] for row in rows]), np.arange(len(rows)) // len(CUES) % 2 == 0
    trees = BoostedTrees().fit(x[half], y[half])
    p, thresholds = trees.probability(x[~half]), {}
    for kind in CUES:
        mine = kinds[~half] == kind
        score, right = p[mine], y[~half][mine]
        # rows of equal score are taken or left together
        reached = [t for t in (0.5, *np.unique(score[score > 0.5]).tolist()) if (score >= t).any() and right[score >= t].mean() >= PRECISION]
        thresholds[kind] = reached[0] if reached else 1.1
    return trees, thresholds


class _Taken:
    """The union of spans as disjoint sorted intervals, so that a text's candidates are held against its spans in n log n."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, s, e in sorted(spans, key=lambda x: x[1]):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        i = bisect_left(self.starts, e) - 1
        return i >= 0 and self.ends[i] > s

    def add(self, s: int, e: int) -> None:
        """A span that meets none."""
        i = bisect_left(self.starts, s)
        self.starts.insert(i, s)
        self.ends.insert(i, e)


def pii_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id and ``found``, an array of (kind, start, end, score, base); code points, end exclusive."""
    trees, thresholds = model()

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, asked, x, taken = [], [], [], []
                for i, text in enumerate(scalars(part.column(1))):
                    text = text or ""
                    mine = base_spans(text)
                    found.append([(k, s, e, 1.0, True) for k, s, e in mine])
                    taken.append(_Taken(mine))
                    for k, s, e in proposals(text):
                        if not taken[i].meets(s, e):
                            asked.append((i, k, s, e))
                            x.append(features(text, k, s, e))
                if asked:
                    p = trees.probability(np.array(x))
                    for (i, k, s, e), score in sorted(zip(asked, p.tolist(), strict=True), key=lambda c: (c[0][0], -c[1], c[0])):
                        if score >= thresholds[k] and not taken[i].meets(s, e):
                            found[i].append((k, s, e, score, False))
                            taken[i].add(s, e)
                yield {"id": part.column(0), "found": [[dict(zip(("kind", "start", "end", "score", "base"), f, strict=True)) for f in fs] for fs in found]}

    picked = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_arrow(picked, rows, "id long, found array<struct<kind:string,start:int,end:int,score:double,base:boolean>>")
    return out.withColumnRenamed("id", id_col)


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with each selected span replaced by its kind in brackets; all other columns stay. Null texts stay null."""
    trees, thresholds = model()
    names = documents.columns
    at = names.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out, x, asked = [], [], []
            texts = [t for t in scalars(batch.column(at))]
            spans = [base_spans(t or "") for t in texts]
            taken = [_Taken(found) for found in spans]
            for i, t in enumerate(texts):
                for k, s, e in proposals(t or ""):
                    if not taken[i].meets(s, e):
                        asked.append((i, k, s, e))
                        x.append(features(t, k, s, e))
            if asked:
                for (i, k, s, e), score in sorted(zip(asked, trees.probability(np.array(x)).tolist(), strict=True), key=lambda c: (c[0][0], -c[1], c[0])):
                    if score >= thresholds[k] and not taken[i].meets(s, e):
                        spans[i].append((k, s, e))
                        taken[i].add(s, e)
            for t, found in zip(texts, spans, strict=True):
                last, parts = 0, []
                for k, s, e in sorted(found, key=lambda f: (f[1], -f[2])):
                    if e > last:
                        parts += [t[last : max(s, last)], f"[{k.upper()}]"] if s >= last else []
                        last = e
                out.append(t if not found else "".join([*parts, t[last:]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(at).type) if j == at else batch.column(j) for j in range(len(names))], schema=batch.schema)

    return documents.mapInArrow(run, documents.schema)


def digest(spans: DataFrame, kinds: tuple[str, ...] = KINDS, base: tuple[str, ...] = KINDS[:4], by_start: bool = False) -> DataFrame:
    """Digest columns from ``found``: counts and SHA-256 of the base spans, and all spans as text."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])

    def order(s):
        keys = (s["start"], rank[s["kind"]]) if by_start else (rank[s["kind"]], s["start"])
        return F.struct(keys[0].alias("a"), keys[1].alias("b"), s["end"].alias("c"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("s"), s["base"].alias("base"), s["kind"].alias("kind"))

    sorted_ = F.array_sort(F.transform("found", order))
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: s["s"]), ",")
    of_kind = lambda k: lambda s: s["base"] & (s["kind"] == k)
    counts = [F.size(F.filter("_s", of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return spans.withColumn("_s", sorted_).select("doc_id", *counts, F.sha2(joined(F.filter("_s", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("_s")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pii_spans(table(spark, sf_dir, "documents")))
