"""The pipeline's stages, one after the other, on a small table."""

import corpus_pipeline as pipeline

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stage_table(stage(spark, docs, DIR), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "near_copies":
            assert docs.select("doc_id").distinct().count() == sizes[-1]
        if name == "personal_data":
            assert docs.where("text RLIKE '@mail[0-9]+[.]example[.]com'").count() == 0
    assert sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2]
    packed = pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_run_equals_plain_stages(spark):
    """Each stage's decisions by plain Python on what the stage before kept: language, near copies, personal data, targets, packing."""
    import re
    import zlib
    from collections import Counter, defaultdict

    from tokenizers import Tokenizer

    from bidloom.llm.common import vocabulary
    from test_operators import brute_components, plain_base

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    stage = dict(pipeline.STAGES)
    kept = {r["doc_id"]: r for r in stage["language"](spark, docs, DIR).collect()}
    assert kept == {i: r for i, r in rows.items() if r["text"] and any(c.isalpha() for c in r["text"])}

    found = {r["doc_id"]: r for r in stage["near_copies"](spark, docs, DIR).collect()}
    order = sorted(rows)
    _, heads = brute_components([(i, rows[i]["text"]) for i in order])
    assert found == {i: rows[i] for i, h in zip(order, heads, strict=True) if i == h}

    clean = {r["doc_id"]: r["text"] for r in stage["personal_data"](spark, docs, DIR).collect()}
    for i, text in clean.items():
        assert not plain_base(text) and (text == rows[i]["text"]) <= (not plain_base(rows[i]["text"]))

    taken = stage["mixing"](spark, docs, DIR).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, got = defaultdict(int), defaultdict(int)
    for r in rows.values():
        size[r["source"]] += words(r["text"])
    for r in taken:
        got[r["source"]] += words(r["text"])
    weight = {x: i % 3 + 1 for i, x in enumerate(sorted(size))}
    target, full = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[x] for x in full)
        open_ = sum(w for x, w in weight.items() if x not in full)
        target = {x: 3 * size[x] if x in full else rest * w / open_ for x, w in weight.items()}
        over = {x for x in weight if x not in full and target[x] > 3 * size[x]}
        if not over:
            break
        full |= over
    assert all(abs(got[x] - t) <= 2 for x, t in target.items())
    assert max(Counter(r["doc_id"] for r in taken).values()) <= 3

    tokenizer = Tokenizer.from_file(vocabulary())
    ids = {i: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for i, r in rows.items()}
    packed = stage["packing"](spark, docs, DIR).collect()
    for p in packed:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == p["ids_crc32"]
    assert sum(p["length"] for p in packed) == sum(map(len, ids.values()))
    ends = defaultdict(int)
    for p in sorted(packed, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends[p["sequence_id"]]
        ends[p["sequence_id"]] += p["length"]
    assert max(ends.values()) <= 2048
