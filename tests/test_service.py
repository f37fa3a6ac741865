"""The stored jobs table, arrivals, limits, progress, subscribers, dead letters, deletes and layout against plain Python."""

import os
import random
import re
from collections import Counter, deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bidloom.operators import cascade, documents, joblog, jobs, ordered, polygons, progress, raster, tables
from bidloom.functions import text as T
from bidloom.options import Options
from bidloom.plans.service import Flaky
from bidloom.sources import providers, storage
from bidloom.streaming import arrivals, subscribers

# ------------------------------------------------------------------ jobs table


def receipt(spark, *rows):
    return joblog.inserts(spark.createDataFrame([(i, f, f"/in/{i}", t) for i, f, t in rows], "job_id string, filename string, file_path string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp")))


def patch(spark, *rows):
    return joblog.patches(spark.createDataFrame(rows, "job_id string, at long, status string, progress_pct int"))


def gone(spark, *ids):
    return joblog.deletes(spark.createDataFrame([(i,) for i in ids], "job_id string"))


def state(log):
    return {r["job_id"]: (r["filename"], r["status"], r["progress_pct"]) for r in log.read().collect()}


def test_job_log_before_and_after_compaction(spark, tmp_path):
    log = joblog.JobLog(spark, str(tmp_path / "jobs"))
    assert state(log) == {} and log.compact() is None
    log.append(receipt(spark, ("a", "fa", "2024-01-01"), ("b", "fb", "2024-01-02"), ("c", "fc", "2024-01-03")))
    log.append(patch(spark, ("a", 2, None, 50), ("a", 1, "ocr", 30), ("x", 1, "ocr", 30), ("b", 1, "done", None)))
    want = {"a": ("fa", "ocr", 50), "b": ("fb", "done", 0), "c": ("fc", "pending", 0)}
    assert state(log) == want
    assert log.compact() == 1 and state(log) == want
    log.append(gone(spark, "b", "c", "never"))
    log.append(patch(spark, ("b", 1, "late", 99)))
    log.append(receipt(spark, ("c", "again", "2024-02-01"), ("a", "ignored", "2024-02-01")))
    log.append(patch(spark, ("c", 1, "extracting", 70)))
    want = {"a": ("fa", "ocr", 50), "c": ("again", "extracting", 70)}
    assert state(log) == want
    assert log.compact() == 5 and log.vacuum() > 0 and state(log) == want and log.tail() == []
    assert sorted(os.listdir(tmp_path / "jobs" / "snapshot")) == ["upto=5"] and os.listdir(tmp_path / "jobs" / "log") == []
    assert log.append(gone(spark, "a")) == 6 and state(log) == {"c": ("again", "extracting", 70)}


def test_job_log_counts_a_token_once_and_sees_no_half_writes(spark, tmp_path):
    log = joblog.JobLog(spark, str(tmp_path / "jobs"))
    log.append(receipt(spark, ("a", "fa", "2024-01-01")))
    assert log.append(patch(spark, ("a", 1, "ocr", 1)), "batch-1") == log.append(patch(spark, ("a", 1, "failed", 9)), "batch-1")
    assert state(log) == {"a": ("fa", "ocr", 1)}
    half = log.append(patch(spark, ("a", 1, "failed", 9)), "batch-2")
    os.remove(tmp_path / "jobs" / "log" / f"append={half},batch-2" / "_SUCCESS")
    assert state(log) == {"a": ("fa", "ocr", 1)}
    assert log.append(patch(spark, ("a", 1, "done", 5)), "batch-2") == half + 1 and state(log) == {"a": ("fa", "done", 5)}


def test_job_log_with_one_job_changed_very_often(spark, tmp_path):
    log = joblog.JobLog(spark, str(tmp_path / "jobs"))
    log.append(receipt(spark, ("a", "fa", "2024-01-01"), ("b", "fb", "2024-01-01")))
    many = spark.range(20000).select(F.lit("a").alias("job_id"), F.col("id").alias("at"), (F.col("id") % 101).cast("int").alias("progress_pct"))
    log.append(joblog.patches(many))
    assert state(log)["a"][2] == 19999 % 101


# ------------------------------------------------------------------ arrivals


def upload_rows(n):
    return [(f"quote {i}.pdf" if i % 4 else f"tool {i}.exe", f"item {i} | {i}\nother | 5".encode(), i) for i in range(1, n + 1)]


def uploads(spark, n):
    return spark.createDataFrame(upload_rows(n), "filename string, content binary, at long").select("filename", "content", F.timestamp_seconds("at").alias("uploaded_at"))


def ask(chunks):
    bad = F.col("chunk").startswith("item 6 ")
    return chunks.withColumn("reply", F.when(~bad, providers.lines_reply(F.col("chunk")))).withColumn("attempts", F.lit(3)).withColumn("error", F.when(bad, "refused"))


def test_arrivals_end_once_each_after_a_restart(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "service")
    told = arrivals.save(uploads(spark, 14), root, bundles=7).collect()
    assert Counter(r["code"] for r in told) == {200: 11, 400: 3} and all((r["job_id"] is None) == (r["code"] != 200) for r in told)
    log = joblog.JobLog(spark, f"{root}/jobs")
    assert {r["status"] for r in log.read().collect()} == {"pending"}

    real, calls = documents.with_overall_confidence, []

    def breaks(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("executor lost")
        return real(*args)

    monkeypatch.setattr(documents, "with_overall_confidence", breaks)
    with pytest.raises(Exception, match="executor lost"):
        arrivals.run(arrivals.landed(spark, root), root, ask).awaitTermination()
    some = {r["filename"]: r["status"] for r in log.read().collect()}
    assert "pending" in some.values() and "done" in some.values()
    arrivals.run(arrivals.landed(spark, root), root, ask).awaitTermination()
    done = {r["filename"]: r for r in log.read().collect()}
    assert len(done) == log.read().count() == 11
    assert {f: r["status"] for f, r in done.items()} == {f: "failed" if f == "quote 6.pdf" else "done" for f, *_ in upload_rows(14) if f.endswith("pdf")}
    assert done["quote 6.pdf"]["error_message"] == "refused" and done["quote 6.pdf"]["progress_pct"] == 0 and done["quote 6.pdf"]["current_step"] == "❌ Lỗi: refused"
    assert done["quote 5.pdf"]["current_step"] == "✅ Hoàn thành — 2 sản phẩm" and round(done["quote 5.pdf"]["overall_confidence"], 6) == 0.825
    results = arrivals.results(spark, root)
    assert results.count() == 10 and results.select("job_id").distinct().count() == 10
    dead = spark.read.parquet(f"{root}/dead").collect()
    assert [(r["no"], r["attempts"], r["error"]) for r in dead] == [(0, 3, "refused")]
    # nothing is left to do
    arrivals.run(arrivals.landed(spark, root), root, ask).awaitTermination()
    assert log.read().count() == 11


def test_two_uploads_whose_short_ids_are_equal(spark, tmp_path):
    """The first eleven digits of these two are the same (found among 7.6 million); each must end as a job of its own."""
    root, keys = str(tmp_path / "service"), (2265304, 3469960)
    pair = spark.createDataFrame([(f"quote {k}.pdf", f"item {k} | 5".encode(), k) for k in keys], "filename string, content binary, at long").select("filename", "content", F.timestamp_seconds("at").alias("uploaded_at"))
    short = T.job_id(F.concat_ws("|", "filename", F.col("uploaded_at").cast("double").cast("string")))
    assert pair.select(short).distinct().count() == 1
    arrivals.save(pair, root, bundles=2)
    arrivals.run(arrivals.landed(spark, root), root, ask).awaitTermination()
    found = joblog.JobLog(spark, f"{root}/jobs").read().collect()
    assert sorted((r["filename"], r["status"]) for r in found) == [(f"quote {k}.pdf", "done") for k in keys]


def test_files_dropped_into_a_folder(spark, tmp_path):
    drop, root = tmp_path / "in", str(tmp_path / "service")
    drop.mkdir()
    pdf = b"%PDF-1.4\n1 0 obj\nstream\nBT (item 1 | 7) Tj ET\nendstream\nstream\nBT (item 2 | 8) Tj ET\nendstream"
    for name, content in (("a.pdf", pdf), ("b c.png", b"x | 3\ny | 4"), ("d.exe", b"z | 1"), ("e.jpg", b"\xff\xd8\xff\x00")):
        (drop / name).write_bytes(content)
    arrivals.run(arrivals.dropped(spark, str(drop), Options(concurrent_jobs=2)), root, ask).awaitTermination()
    found = {r["filename"]: (r["status"], r["document_type"], r["current_step"]) for r in joblog.JobLog(spark, f"{root}/jobs").read().collect()}
    assert found["a.pdf"] == ("done", "scanned_pdf", "✅ Hoàn thành — 2 sản phẩm")
    assert found["b c.png"][2] == "✅ Hoàn thành — 2 sản phẩm" and found["e.jpg"][2] == "✅ Hoàn thành — 0 sản phẩm" and "d.exe" not in found


def test_upload_gates_in_their_order(spark):
    rows = [("a.pdf", "k", "c", 0), ("b.pdf", "k", "c", 1), ("b.exe", "k", "c", 2), ("c.pdf", None, "c", 3), ("d.pdf", "x", "c", 4), ("e.pdf", "k", "c", 61), ("f.exe", "k", "d", 5)]
    sent = spark.createDataFrame(rows, "filename string, api_key string, client string, at long").select("*", F.timestamp_seconds("at").alias("uploaded_at"), F.lit(b"x").alias("content"))
    told = arrivals.receipts(sent, Options(api_key="k"), most=1).collect()
    assert {r["filename"]: r["code"] for r in told} == {"a.pdf": 200, "b.pdf": 429, "b.exe": 429, "c.pdf": 401, "d.pdf": 403, "e.pdf": 200, "f.exe": 400}
    assert {r["code"] for r in arrivals.receipts(sent.drop("client", "api_key"), Options(api_key="k")).collect()} == {200, 400}


def test_admission_by_options(spark):
    rows = spark.createDataFrame([("a.pdf", 2 << 20), ("a.pdf", 1 << 20), ("a.PDF", 0), ("a", 0), (None, 0)], "f string, n long")
    assert [r[0] for r in rows.select(arrivals.admission(F.col("f"), F.col("n"), Options(max_file_mb=1))).collect()] == [413, 200, 200, 400, 400]


# ------------------------------------------------------------------ limiter and progress


def plain_limiter(rows, most, seconds):
    held, out = {}, {}
    for client, t, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        mine = held.setdefault(client, deque())
        while mine and t - mine[0] >= seconds:
            mine.popleft()
        out[i] = len(mine) < most
        if out[i]:
            mine.append(t)
    return out


@pytest.mark.parametrize(("gap", "most"), [(1, 4), (8, 4), (200, 1)])
def test_limiter_equals_plain_fold_with_a_hot_client(spark, gap, most):
    r = random.Random(gap)
    rows = [(r.choice([1, 1, 1, *range(2, 6), None]), float(r.randrange(3000 * gap) // 3 * 3), i) for i in range(6000)]
    requests = spark.createDataFrame(rows, "c long, t double, i long").select("c", F.timestamp_seconds("t").alias("ts"), "i")
    found = {x["i"]: x["accepted"] for x in ordered.limiter(requests.repartition(5), "c", "ts", "i", most, 60.0).collect()}
    assert found == plain_limiter(rows, most, 60.0) and 0 < sum(found.values()) < len(rows)
    counts = {x["c"]: (x["n_requests"], x["n_rejected"]) for x in jobs.rate_limit(requests, "c", "ts", most, 60.0).collect()}
    assert counts == {c: (sum(x[0] == c for x in rows), sum(x[0] == c and not found[x[2]] for x in rows)) for c in {x[0] for x in rows}}


def test_limiter_edges(spark):
    at = lambda *t: spark.createDataFrame([("c", x, i) for i, x in enumerate(t)], "c string, t double, i long").select("c", F.timestamp_seconds("t").alias("ts"), "i")
    accepted = lambda rows, most: [x["accepted"] for x in ordered.limiter(rows, "c", "ts", "i", most, 60.0).orderBy("i").collect()]
    # an age of just the window is over, and what is rejected does not extend it
    assert accepted(at(0.0, 59.0, 60.0, 61.0), 1) == [True, False, True, False]
    assert accepted(at(5.0, 5.0, 5.0, None), 2) == [True, True, False, False]
    assert accepted(at(), 2) == []


def test_progression_equals_plain_fold_with_a_hot_job(spark):
    r = random.Random(4)
    states = [*progress.PERCENT, None, "unheard"]
    rows = [(r.choice([1, 1, 1, *range(2, 400)]), i, r.choice(states)) for i in range(5000)]
    events = spark.createDataFrame(rows, "job long, n long, status string")
    found = {x["n"]: (x["before"], x["after"], x["rejected"], x["progress_pct"]) for x in progress.progression(events.repartition(7), "job", ["n"], "status").collect()}
    now, want = {}, {}
    for job, n, status in sorted(rows, key=lambda x: x[:2]):
        was = now.get(job, "pending")
        now[job] = progress.MOVES.get((was, status), was)
        want[n] = (was, now[job], (was, status) not in progress.MOVES, progress.PERCENT[now[job]])
    assert found == want


# ------------------------------------------------------------------ subscribers


class Handle:
    """What a processor is given, with plain values."""

    def __init__(self):
        self.timers, self.values, self.maps = [], {}, {}

    def getValueState(self, name, schema, ttl=None):
        values = self.values

        class Value:
            exists = staticmethod(lambda: name in values)
            get = staticmethod(lambda: values[name])
            update = staticmethod(lambda x: values.__setitem__(name, x))

        return Value

    def getMapState(self, name, key, value):
        held = self.maps.setdefault(name, {})

        class Map:
            exists = staticmethod(lambda: bool(held))
            keys = staticmethod(lambda: iter(list(held)))
            updateValue = staticmethod(held.__setitem__)
            removeKey = staticmethod(held.pop)

        return Map

    def registerTimer(self, t):
        self.timers.append(t)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def listTimers(self):
        return iter(self.timers)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def test_a_silent_minute_gives_a_sign_of_life():
    handle, feed = Handle(), subscribers.Feed()
    feed.init(handle)
    rows = lambda *r: iter([pd.DataFrame(r, columns=["t", "kind", "n", "status"])])
    told = lambda frames: [tuple(x) for f in frames for x in f[["subscriber", "what", "status"]].itertuples(index=False)]
    assert told(feed.handleInputRows(("j",), rows((2.0, 1, 7, None), (1.0, 0, 1, "ocr")), Clock(1000))) == [(7, "snapshot", "ocr")]
    assert handle.timers == [61_000]
    assert told(feed.handleInputRows(("j",), rows((3.0, 0, 2, "extracting")), Clock(31_000))) == [] and handle.timers == [91_000]
    handle.timers.clear()
    assert told(feed.handleExpiredTimer(("j",), Clock(91_000), None)) == [(7, "alive", subscribers.KEEP_ALIVE)] and handle.timers == [151_000]
    assert told(feed.handleInputRows(("j",), rows((4.0, 0, 3, "done"), (4.0, 1, 8, None)), Clock(92_000))) == [(7, "ending", "done"), (8, "snapshot", "done")]
    assert list(handle.maps["open"]) == [(8,)]
    handle.maps["open"].clear()
    handle.timers.clear()
    assert told(feed.handleExpiredTimer(("j",), Clock(200_000), None)) == [] and handle.timers == []


# ------------------------------------------------------------------ extraction


def test_chunks_that_fail_are_listed_and_the_others_go_on(spark):
    texts = [(i, "x" * i) for i in range(5, 25)]
    waits = []
    found = providers.extract(spark.createDataFrame(texts, "i long, chunk string"), Flaky(), sleep=waits.append).collect()
    for r in found:
        fails = r["i"] % 5
        assert r["attempts"] == min(fails + 1, 3) and (r["reply"] is None) == (fails >= 3)
        assert r["error"] == (f"attempt 3 of a text of {r['i']}" if fails >= 3 else None)


def test_a_chunk_row_holds_no_other_chunk(spark):
    texts = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(3000))), (2, None), (3, "")], "doc_id long, text string")
    seen = []

    def ask(chunks):
        seen.append(providers.extract(chunks, lambda text: '{"items": []}'))
        return seen[0]

    docs = documents.extract_documents(texts, ask, budget=50)
    plan = docs._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    carried = re.findall(r"\(\d+\) ArrowEvalPython\nInput \[\d+\]: \[(.*?)\]", plan)
    assert len(carried) == 1 and "chunks#" not in carried[0]
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 2, 3]
    rows = seen[0].groupBy("doc.id").agg(F.count("*").alias("n"), F.min("total").alias("least"), F.max("total").alias("most"), F.max("no").alias("last")).collect()
    assert all(r["n"] == r["least"] == r["most"] == r["last"] + 1 for r in rows)
    assert {r["id"]: r["n"] > 1 for r in rows} == {1: True, 2: False, 3: False}


def test_extract_documents_with_repeated_and_null_ids(spark):
    rows = [(1, "a | 1"), (1, "b | 2\nc | 3"), (1, "a | 1"), (None, "d | 4"), (2, None), (2, ""), (3, "a | 1\n" * 30 + "A  | 2\n | 3")]
    reply = lambda chunks: chunks.withColumn("reply", providers.lines_reply(F.col("chunk")))
    docs = documents.extract_documents(spark.createDataFrame(rows, "doc_id long, text string"), reply, budget=60).collect()
    items = Counter((r["doc_id"], tuple(i["ten_sp"] for i in r["items"])) for r in docs)
    assert items == Counter([(1, ("a",)), (1, ("a",)), (1, ("b", "c")), (None, ("d",)), (2, ()), (2, ()), (3, ("a",))])


def test_prompts_reach_the_provider(spark):
    seen = []
    rows = spark.createDataFrame([(1, "l" * 30 + "\n" + "m" * 30, "q.pdf")], "doc_id long, text string, name string")

    def ask(chunks):
        seen.extend(sorted(r["prompt"] for r in chunks.collect()))
        return chunks.withColumn("reply", F.lit("{}"))

    documents.extract_documents(rows, ask, budget=40, filename=F.col("name")).collect()
    assert [p.split("\n")[0] for p in seen] == ["File: q.pdf (trang 1/2)", "File: q.pdf (trang 2/2)"]


@pytest.mark.parametrize("text", ["", "a | 1", "a|1\n b |2 \nno\nx|y|z\n |5", "a | 1\r\nb | 2", "q\"uo | te\n"])
def test_lines_reply_equals_the_python_reader(spark, text):
    import json

    got = spark.createDataFrame([(text,)], "t string").select(providers.lines_reply(F.col("t"))).first()[0]
    assert json.loads(got) == json.loads(providers.extract_lines(text))


def test_health_names_the_engines_that_answer(spark):
    def broken(content):
        raise OSError("no model")

    row = providers.health(spark, {"tesseract": lambda c: ("", 0.0), "easyocr": broken}).first()
    assert (row["status"], row["ocr_engines"]) == ("ok", ["tesseract"])


# ------------------------------------------------------------------ deletes


def test_sweep_takes_files_of_deleted_jobs_alone(spark, tmp_path):
    for f in ("uploads/a/one two.pdf", "uploads/b/x.pdf", "uploads/b/pages/p1.png", "results/a.json", "results/b.json", "exports/b.xlsx", "uploads/job_id=c/part"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"1")
    live = spark.createDataFrame([("a",)], "job_id string")
    orphans = cascade.orphans(storage.listing(spark, str(tmp_path)), live)
    assert Counter(r["job_id"] for r in orphans.collect()) == {"b": 3, "c": 1}
    assert cascade.sweep(spark, orphans) == 3
    left = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith("."))
    assert left == ["exports/b.xlsx", "results/a.json", "uploads/a/one two.pdf"]
    assert cascade.sweep(spark, cascade.orphans(storage.listing(spark, str(tmp_path)), live)) == 0


def test_files_are_written_listed_and_swept_by_tasks(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "a b")
    rows = [(f"{kind}/{i}{rest}", str(i).encode()) for i in range(20) for kind, rest in (("uploads", "/x/quote 1.txt"), ("results", ".json"), ("exports", ".csv"))]
    assert storage.write_files(spark.createDataFrame(rows, "name string, content binary"), root) == 60
    assert (tmp_path / "a b/uploads/7/x/quote 1.txt").read_bytes() == b"7"
    (tmp_path / "a b/uploads/.hidden").write_bytes(b"1")
    (tmp_path / "a b/_SUCCESS").write_bytes(b"1")
    (tmp_path / "a b/uploads/linked").symlink_to(tmp_path / "a b/exports")
    found = storage.below(spark, root).where("path NOT LIKE '%/linked'")
    paths = sorted(r["path"] for r in found.collect())
    assert paths == sorted(f"file:{root}/{name}" for name, _ in rows)
    assert found.exceptAll(storage.listing(spark, root).where("path NOT LIKE '%/linked%'")).count() == 0
    asked = []
    monkeypatch.setattr(storage, "remove", lambda _, paths: asked.extend(p for p in paths if "/uploads/" in p or "/results/" in p) or 0)
    live = spark.range(1, 20).selectExpr("string(id) AS job_id").unionByName(spark.createDataFrame([("linked",)], "job_id string"))
    assert cascade.sweep(spark, cascade.orphans(storage.below(spark, root), live)) == 2
    assert asked == []  # the driver deletes none of them itself
    assert storage.below(spark, root).where("path NOT LIKE '%/linked'").count() == 58
    assert cascade.sweep(spark, cascade.orphans(storage.below(spark, root), live)) == 0
    assert not (tmp_path / "a b/uploads/0").exists() and (tmp_path / "a b/exports/0.csv").exists()


def test_files_in_a_store_that_is_not_mounted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "_mounted", lambda *_: None)
    rows = [(f"uploads/{i}/q.txt", b"1") for i in range(5)]
    assert storage.write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path)) == 5
    assert storage.below(spark, str(tmp_path)).count() == 5
    # a path without a scheme belongs to the default store, so the driver deletes it
    gone = spark.createDataFrame([(f"{tmp_path}/uploads/{i}",) for i in (1, 2, 2, 9)], "at string")
    assert storage.remove_all(gone) == 2
    assert sorted(p.name for p in (tmp_path / "uploads").iterdir()) == ["0", "3", "4"]


@pytest.mark.parametrize("name", ["/etc/x", "a/../../x", ""])
def test_names_of_files_keep_below_their_folder(spark, tmp_path, name):
    with pytest.raises(Exception, match="no name below"):
        storage.write_files(spark.createDataFrame([(name, b"1")], "name string, content binary"), str(tmp_path))


# ------------------------------------------------------------------ layout


def test_tables_come_back_from_scattered_boxes(spark):
    r = random.Random(8)
    boxes = []

    def put(doc, x, y, text):
        for w in text.split():
            boxes.append((doc, float(x), float(x + 5 * len(w)), y + r.random(), y + 9 + r.random(), w))
            x += 5 * len(w) + 3

    put(1, 0, 0, "A long heading over everything there is on this page")
    for i, row in enumerate([("Name", "Qty", "Price"), ("big bolt", "", "12"), ("", "7", "1 000"), ("nut", "8", "")]):
        for x, c in zip((0, 90, 140), row, strict=True):
            put(1, x, 20 + 12 * i, c)
    put(1, 0, 70, "and this")
    for i, row in enumerate([("A", "B"), ("1", "2")]):
        for x, c in zip((30, 80), row, strict=True):
            put(1, x, 84 + 12 * i, c)
    put(2, 0, 0, "alone")
    put(2, 90, 0, "row")
    r.shuffle(boxes)
    found = tables.from_boxes(spark.createDataFrame(boxes, "doc long, x0 double, x1 double, y0 double, y1 double, text string"), ["doc"]).collect()
    got = sorted((x["doc"], x["table_no"], x["row_no"], tuple(x["header"]), tuple(x["cells"])) for x in found)
    head = ("Name", "Qty", "Price")
    assert got == [(1, 1, 1, head, ("big bolt", "", "12")), (1, 1, 2, head, ("", "7", "1 000")), (1, 1, 3, head, ("nut", "8", "")), (1, 2, 1, ("A", "B"), ("1", "2"))]


def plain_islands(rows, start, end, gap):
    """The rows, dealt into islands along one axis."""
    out, reached = [], None
    for w in sorted(rows, key=lambda w: (w[start], w[end])):
        if reached is None or w[start] - reached >= gap:
            out.append([])
        out[-1].append(w)
        reached = w[end] if reached is None else max(reached, w[end])
    return out


def plain_tables(words, cell_gap=8.0):
    lines = [plain_islands(line, 0, 1, cell_gap) for line in plain_islands(words, 2, 3, 0.0)]
    runs = [[]]
    for line in lines:
        runs[-1].append([w for piece in line for w in piece]) if len(line) > 1 else runs.append([])
    found = []
    for run in runs:
        columns = plain_islands([w for line in run for w in line], 0, 1, cell_gap)
        if len(run) > 1 and len(columns) > 1:
            found.append([[" ".join(w[4] for w in sorted((w for w in line if w in c), key=lambda w: (w[0], w[4]))) for c in columns] for line in run])
    return [(t, r, rows[0], row) for t, rows in enumerate(found, 1) for r, row in enumerate(rows[1:], 1)]


def test_tables_of_random_pages_equal_plain_python(spark):
    """Pages lie in a row each: their plan has no window, and no exchange beside that of the words."""
    r = random.Random(9)
    pages = {}
    for doc in range(60):
        word = lambda: (float(x := r.randrange(0, 300, 6)), x + r.choice((5.0, 20.0)), float(y := r.randrange(0, 200, 11)), y + r.choice((9.0, 9.0, 9.0, 13.0)), f"w{r.randrange(1000)}")  # noqa: B023, E731
        pages[doc] = [word() for _ in range(r.randrange(0, 60))]
    schema = "doc int, words array<struct<x0:double,x1:double,y0:double,y1:double,text:string>>"
    whole = spark.createDataFrame([*pages.items(), (None, None)], schema)
    want = sorted((d, *t) for d, ws in pages.items() for t in plain_tables(ws))
    boxes = tables.from_boxes(whole.select("doc", F.inline("words")), ["doc"])
    for found in (tables.from_pages(whole, ["doc"]), boxes):
        assert sorted((x["doc"], x["table_no"], x["row_no"], x["header"], x["cells"]) for x in found.collect()) == want
    plan = boxes.select("*")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    assert len(want) > 50


@pytest.mark.parametrize("rows", [[["a", "bb"], ["ccc", ""], ["", "d"]], [["x"], ["yy"]], [["Tên", "Giá"], ["Ống thép", "12.000"]]])
def test_aligned_text_equals_a_frames_text(spark, rows):
    got = spark.createDataFrame([(rows,)], "r array<array<string>>").select(tables.aligned(F.col("r"))).first()[0]
    assert got == pd.DataFrame(rows[1:], columns=rows[0]).to_string(index=False)


def plain_simplified(p, tolerance):
    n = len(p)
    dist = lambda a, b: float(np.hypot(*(np.array(p[a % n]) - np.array(p[b % n]))))
    far = lambda a: max(range(n), key=lambda i: (dist(i, a), -i))
    first = far(0)
    a, b = sorted((first, far(first)))

    def off(j, a, b):
        (x, y), (x0, y0), (x1, y1) = p[j % n], p[a % n], p[b % n]
        length = dist(a, b)
        return abs((x1 - x0) * (y0 - y) - (x0 - x) * (y1 - y0)) / length if length else dist(j, a)

    def between(a, b):
        top = max(range(a + 1, b), key=lambda j: (off(j, a, b), -j), default=None)
        return between(a, top) + [top % n] + between(top, b) if top is not None and off(top, a, b) > tolerance else []

    return sorted({a, b, *between(a, b), *between(b, a + n)})


def test_outlines_equal_plain_recursion(spark):
    r = np.random.default_rng(6)
    shapes = [[(float(np.cos(t) * (9 + x)), float(np.sin(t) * (5 + x))) for t, x in zip(np.linspace(0, 6.2, n), r.random(n) * s, strict=True)] for n, s in ((4, 0), (12, 0.1), (40, 2.0), (60, 6.0))]
    shapes.append([(0.0, 0.0), (10.0, 0.0), (10.0, 0.1), (10.0, 8.0), (0.0, 8.0)])
    rows = spark.createDataFrame([(i, [{"x": a, "y": b} for a, b in s]) for i, s in enumerate(shapes)], "i int, p array<struct<x:double,y:double>>")
    out = rows.select("i", polygons.simplified(F.col("p"), polygons.perimeter(F.col("p")) * 0.02).alias("k"), polygons.area(F.col("p")).alias("a"), polygons.quadrilateral(F.col("p"), F.lit(100.0)).alias("q")).collect()
    for row in out:
        p = shapes[row["i"]]
        around = sum(float(np.hypot(p[k][0] - p[k - 1][0], p[k][1] - p[k - 1][1])) for k in range(len(p)))
        assert row["k"] == plain_simplified(p, around * 0.02)
        assert row["a"] == pytest.approx(abs(sum(p[k - 1][0] * p[k][1] - p[k][0] * p[k - 1][1] for k in range(len(p)))) / 2)
    assert [r["q"] for r in out][-1] is True


@pytest.mark.parametrize(("h", "w"), [(8, 8), (3, 5), (2, 2)])
def test_blur_equals_the_kernel(spark, h, w):
    g = np.random.default_rng(h).uniform(0, 255, (h, w))
    row = spark.createDataFrame([(g.ravel().tolist(),)], "g array<double>").select(raster.blur_variance(F.col("g"), w), raster.any_glare(F.col("g"))).first()
    assert row[0] == pytest.approx(raster.laplacian_variance(g)) and row[1] == bool((g > 240).any())


# ------------------------------------------------------------------ PDF text


def test_pdf_text_by_unicode_tables():
    from bidloom.sources import files, samples

    pages = [["Báo giá số 12", "Ống thép | 12.000 đ", "😀 (a) \\ <b>"], [""], ["Tổng cộng"]]
    for deflate in (True, False):
        assert files.pdf_text(samples.pdf_of(pages, deflate)) == ["\n".join(p) for p in pages]
    table = b"begincmap 1 beginbfchar <01> <1ED1> endbfchar 2 beginbfrange <02> <04> <0061> <05> <06> [<0058> <00590059>] endbfrange endcmap"
    font = b"3 0 obj << /Type /Font /Subtype /Type1 /ToUnicode 4 0 R >> endobj\n4 0 obj << /Length %d >> stream\n%s\nendstream endobj\n" % (len(table), table)
    page = b"5 0 obj << /Font << /F7 3 0 R >> >> endobj 6 0 obj << >> stream\nBT /F7 9 Tf (\\001\\002) Tj <0304> Tj 0 -9 Td [(\\005) -20 <06>] TJ T* /F0 9 Tf (caf\\351\\)) Tj ET\nendstream endobj"
    assert files.pdf_text(b"%PDF-1.5\n" + font + page) == ["ốabc\nXYY\ncafé)"]


def test_pdf_text_of_objects_in_streams():
    import zlib

    from bidloom.sources import files

    held = [b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>", b"<< /Font << /F1 7 0 R >> >>"]
    index = b"7 0 8 %d " % len(held[0])
    packed = zlib.compress(index + b"".join(held))
    objects = b"1 0 obj << /Type /ObjStm /N 2 /First %d /Length %d >> stream\n%s\nendstream endobj\n" % (len(index), len(packed), packed)
    table = b"begincmap 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap"
    rest = b"9 0 obj << >> stream\n%s\nendstream endobj 2 0 obj << >> stream\nBT /F1 1 Tf <1ED10041> Tj ET\nendstream endobj" % table
    assert files.pdf_text(b"%PDF-1.5\n" + objects + rest) == ["ốA"]


@pytest.mark.parametrize("content", [b"", b"%PDF", b"%PDF-1.4 1 0 obj stream\n\xff\xfe\nendstream endobj", b"BT ( Tj", b"stream\nBT <zz> Tj ET\nendstream"])
def test_pdf_text_of_broken_files(content):
    from bidloom.sources import files

    assert all(isinstance(x, str) for x in files.pdf_text(content))


def test_image_files_hold_their_pixels(spark):
    import struct
    import zlib

    g = np.arange(6.0).reshape(2, 3) * 50
    row = raster.image_files(spark.createDataFrame([(None, g.ravel().tolist())], "i long, g array<double>"), "i", "g", 3).first()
    content = bytes(row["content"])
    assert content[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", content[16:24]) == (3, 2)
    at = content.index(b"IDAT")
    raw = zlib.decompress(content[at + 4 : at + 4 + struct.unpack(">I", content[at - 4 : at])[0]])
    assert [list(raw[1:4]), list(raw[5:8])] == g.tolist()
