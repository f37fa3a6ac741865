"""Fingerprint near-duplicates, the Merkle manifest and spelling variants against plain Python; awkward tables for every operator."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from bidloom.llm import jaccard, language, merkle, mixing, packing, pii, secrets, simhash, syncmers, token_store, variants
from bidloom.llm.common import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, unit string, score double, found string, _n map<string,int>"
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s", 35, 1, "u", 0.5, "f", {"a": 1}),
    (2, "Alpha beta gamma delta epsilon zeta", "en", "s", 35, 1, "u", 0.5, "f", None),
    (2, "Alpha beta gamma delta epsilon zeta", "en", "s", 35, 1, "u", 0.5, "f", None),
    (2, "another text of the same id altogether", "de", "s", 38, None, None, None, None, None),
    (3, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None),
    (4, "", "en", "", 0, 1, "u", 0.5, "f", None), (5, " \t\n", None, "t", 3, None, None, None, None, None),
    (6, "lengthy wording " * 60000, "en", "t", 960000, 1, "u", 0.5, "f", None),
    (None, "no id here", "en", "s", 10, 1, "u", 0.5, "f", None), (None, "no id here either", "", "s", 2**63 - 1, 1, "u", 0.5, "f", None),
    (7, "Ünï 😀 \x1c ﬁ Ärger ärger", "de", None, 9, 1, "u", 0.5, "f", None), (-8, "minus", "fr", "s", -1, 1, "u", 0.5, "f", None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


OPERATORS = {
    "pii": lambda d, tmp: pii.digest(pii.pii_spans(d)),
    "redact": lambda d, tmp: pii.redact(d),
    "token_store": lambda d, tmp: (token_store.write_store(d, tmp, vocabulary()), token_store.verify(d.sparkSession, tmp))[1],
    "language": lambda d, tmp: language.predict(d, language.fit(d)),
    "mixing": lambda d, tmp: mixing.mixed_documents(d),
    "syncmers": lambda d, tmp: syncmers.fingerprints(d),
    "secrets": lambda d, tmp: secrets.digest(secrets.scan(d), secrets.KINDS, secrets.KINDS[:3], by_start=True),
    "packing": lambda d, tmp: packing.pack(d, vocabulary()),
    "jaccard": lambda d, tmp: jaccard.jaccard_components(d),
    "simhash": lambda d, tmp: simhash.simhash_components(d),
    "merkle": lambda d, tmp: merkle.proofs(d),
    "variants": lambda d, tmp: variants.spelling_variants(d),
}
#: Operators with one row out for one row in.
ROW_FOR_ROW = {"pii", "redact", "token_store", "language", "syncmers", "secrets", "jaccard", "simhash", "merkle"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty_tables(spark, awkward, empty, name, tmp_path):
    found = OPERATORS[name](awkward, f"{tmp_path}/a").collect()
    if name in ROW_FOR_ROW:
        assert len(found) == len(ROWS)
    if name == "token_store":
        assert all(r["verified"] for r in found)
    assert OPERATORS[name](empty, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_awkward_and_empty_stages(spark, awkward, empty, stage):
    out = stage(spark, awkward, "")
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == awkward.columns
    assert out.count() > 0
    assert stage(spark, empty, "").count() == 0


def test_near_copies_stage_keeps_rows_of_one_id_apart(spark, awkward):
    kept = corpus_pipeline.drop_near_copies(spark, awkward, "").collect()
    assert Counter(r["doc_id"] for r in kept)[2] == 1 and "another text of the same id altogether" in [r["text"] for r in kept]


# ------------------------------------------------------------------ SimHash


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    pieces = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints):
    label = list(range(len(ids)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                label[top(i)] = top(j)
    least = defaultdict(list)
    for i, x in enumerate(ids):
        least[top(i)].append(x)
    return [min((x for x in least[top(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash_equals_brute_force(spark, awkward):
    r = random.Random(5)
    base = [" ".join(r.choice(["stone", "river", "cloud", "Tree", "mountain", "sky", "leaf", "road"]) + str(r.randrange(40)) for _ in range(160)) for _ in range(30)]
    texts = [t for t in base for _ in range(6)]
    for i in range(len(texts)):
        words = texts[i].split()
        for _ in range(i % 6):
            words[r.randrange(len(words))] = f"new{r.randrange(9)}"
        texts[i] = " ".join(words)
    rows = [(x[0], x[1]) for x in ROWS] + list(enumerate(texts, 100))
    prints = [plain_fingerprint(t) for _, t in rows]
    want = Counter((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, plain_components([i for i, _ in rows], prints), strict=True))
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == want
    assert len(set(c for _, _, c in want)) < len(rows) - 20


@pytest.mark.parametrize("kind", ["spread", "clusters", "ball", "dense"])
def test_vantage_points_lose_no_link(kind):
    r = np.random.default_rng(3)
    one = np.uint64(1)
    if kind == "spread":
        f = r.integers(0, 2**63, 3000).astype(np.uint64)
    elif kind == "clusters":
        f = (r.integers(0, 2**63, 60).astype(np.uint64)[:, None] ^ (one << r.integers(0, 64, (60, 40)).astype(np.uint64))).reshape(-1)
    elif kind == "ball":
        f = np.bitwise_or.reduce(one << r.integers(0, 64, (2500, 3)).astype(np.uint64), axis=1)
    else:
        f = r.integers(0, 2**12, 3000).astype(np.uint64)
    f = np.unique(f)
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2)
    want = simhash.forest(f[i[i < j]], f[j[i < j]])
    pairs = lambda ab: sorted(zip(ab[0].tolist(), ab[1].tolist(), strict=True))
    assert pairs(simhash.linked(f, np.ones(len(f), bool))) == pairs(want)
    tree = simhash.fit(f[::2], 16)
    g, resident, shard = simhash.route(tree, f)
    assert resident.sum() == len(f) and sorted(g[resident].tolist()) == f.tolist()
    found = [simhash.linked(g[shard == s], resident[shard == s]) for s in np.unique(shard)]
    assert pairs(simhash.forest(*map(np.concatenate, zip(*found, strict=True)))) == pairs(want)
    own = np.ones(len(f), bool)
    compared = pairs(simhash._compared(f, own))
    there = np.sort(f)
    looked = sorted((int(x), int(x ^ m)) for m in simhash._MASKS for x in f[np.isin(f ^ m, there)])
    assert compared == looked


# ------------------------------------------------------------------ Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_siblings(levels, i):
    return [x for k, level in enumerate(levels[:-1]) for x in level[(i >> k) ^ 1 : ((i >> k) ^ 1) + 1]]


def plain_manifest(rows):
    by_lang = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        by_lang[lang].append((doc_id is not None, doc_id or 0, plain_leaf(doc_id, source, lang, n_chars, text), (doc_id, source, lang, n_chars, text)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([leaf for _, _, leaf, _ in sorted(by_lang[x], key=lambda r: r[:3])]) for x in langs}
    top = plain_tree([trees[x][-1][0] for x in langs])
    out = []
    for g, x in enumerate(langs):
        for i, (_, _, leaf, fields) in enumerate(sorted(by_lang[x], key=lambda r: r[:3])):
            doc_id, source, lang, n_chars, text = fields
            path = plain_siblings(trees[x], i) + plain_siblings(top, g)
            bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
            out.append((doc_id, leaf, trees[x][-1][0], top[-1][0], H(*path), not bad))
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1500])
def test_manifest_equals_plain_trees(spark, n):
    r = random.Random(n)
    rows = [(x[0], x[1], x[2], x[3], x[4]) for x in ROWS if n == 5] + [(i, f"text {i}", r.choice(["en", "de", None, "é"]), "s", i % 9 or None) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = merkle.proofs(docs, digest=True, stride=3).collect()
    # rows that are equal in all columns may trade places, and with them their proofs
    got = Counter((f["doc_id"], f["leaf"], f["subroot"], f["root"], f["folded_root"] == f["root"]) for f in found)
    want = plain_manifest(rows)
    assert got == Counter((a, b, c, d, e) for a, b, c, d, _, e in want)
    assert Counter(f["proof_sha256"] for f in found) == Counter(x[4] for x in want)


def test_paths_prove_their_leaves(spark, awkward):
    for f in merkle.proofs(awkward).collect():
        assert merkle.fold(f["leaf"], f["path"], f["places"]) == f["root"]


# ------------------------------------------------------------------ spelling variants


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in words if x != w and one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_variants_equal_brute_force(spark):
    r = random.Random(2)
    pool = ["stationary", "stationery", "colours", "colour", "colouring", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Ärgerlich", "ärgerlich", "naïveté", "naivete", "zzzzzz", "abcdef", "abcdeg", "abcdefg"]
    weights = [400, 12, 60, 300, 2, 9, 60, 400, 7, 90, 8, 80, 5, 6, 40, 300]
    rows = [(i if i % 11 else None, " ".join(r.choices(pool, weights, k=90)) + ("" if i % 5 else "é1x" + "q" * 3000)) for i in range(120)]
    rows += [(i, "q" * 3001 + " " + "q" * 2999 + "z") for i in range(6)] + [(x[0], x[1]) for x in ROWS if x[0] != 6]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["word"], x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in variants.spelling_variants(docs).collect()}
    assert got == plain_variants(rows)
    assert any(f for _, f, *_ in got)


def test_deletion_keys_are_those_of_the_strings():
    words = [b"abcabc", b"aabbaa", b"zzzzzz", b"bcabc"]
    key, of, role = variants.deletion_keys(words)
    whole = {words[w]: k for k, w, x in zip(key.tolist(), of.tolist(), role.tolist(), strict=True) if x == variants.WHOLE}
    shorter = defaultdict(set)
    for k, w, x in zip(key.tolist(), of.tolist(), role.tolist(), strict=True):
        if x == variants.SHORTER:
            shorter[words[w]].add(k)
    assert whole[b"bcabc"] in shorter[b"abcabc"] and {w: len(s) for w, s in shorter.items()} == {b"abcabc": 6, b"aabbaa": 3, b"zzzzzz": 1, b"bcabc": 5}


# ------------------------------------------------------------------ hostile texts


def test_deep_nesting_is_no_token():
    import base64

    body = base64.urlsafe_b64encode(b"[" * 200_000).decode().rstrip("=")
    assert not secrets.is_signed_token(f"eyJhbGciOiJIUzI1NiJ9.{body}.x")
    assert isinstance(secrets.secret_spans(f"x eyJhbGciOiJIUzI1NiJ9.{body}.x"), list)


def test_taken_spans_meet_as_plain_intervals_do():
    r = random.Random(1)
    for _ in range(200):
        spans = [("k", s, s + r.randrange(1, 9)) for s in (r.randrange(60) for _ in range(r.randrange(8)))]
        taken, held = pii._Taken(spans), [(s, e) for _, s, e in spans]
        for _ in range(20):
            s = r.randrange(60)
            e = s + r.randrange(1, 9)
            plain = any(s < b and a < e for a, b in held)
            assert taken.meets(s, e) == plain
            if not plain:
                taken.add(s, e)
                held.append((s, e))
