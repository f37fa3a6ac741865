"""WARC archives with segmented records.

Writing: one WARC/1.1 record a page, an HTTP response with chunked transfer framing around the page's UTF-8 bytes. Of pages with
equal payloads of at least ``REVISIT_LEAST`` bytes the one with the largest id is a response, the others revisit it. A block
longer than ``SEGMENT_BYTES`` becomes a first segment and continuation records, so no record is large and files stay small
enough to be read as a whole. Spark's text writer writes the archives, with the record terminator of WARC as line separator.

Reading: files are parsed by Content-Length alone; records in one piece are decoded where they are read, only continuation
records are grouped by their origin, put in order of segment number, checked against the total length and decoded.

Every row has a record of its own, named by page id and row number, so ids may repeat or be null; repeated rows each give a row. A
null html counts as an empty payload; empty tables give empty archives; columns other than the three are not read. Of copies with
the largest id all are responses if that id repeats, and so are all copies if none has an id. A payload of any length is cut into
segments, which meet again in the task of their origin. Copies meet their response in joins whose large side Spark can split, so a
payload that a third of the pages share does not land in one task.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, scalars, stage_path, stage_table, table

#: Payloads of fewer bytes are never revisits.
REVISIT_LEAST = 1000
#: Longest block of a record.
SEGMENT_BYTES = 32768
#: Longest chunk of the transfer framing.
CHUNK_BYTES = 8192
#: Records in a file at most: with short segments this bounds a file.
FILE_RECORDS = 1000

_EOL = b"\r\n"
_END = "\r\n\r\n"


def _uri(page_id: int | None, row: int, segment: int = 1) -> str:
    return f"<urn:bidloom:page:{'' if page_id is None else page_id}:{row}:{segment}>"


def _record(fields: list[tuple[str, str | int]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + _EOL + block


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Payload of a chunked body; raises ValueError where the framing is broken. Chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.index(_EOL, at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != _EOL:
            raise ValueError("a chunk is cut short")
        parts.append(body[at : at + n])
        at += n + 2


def records_of(page_id: int | None, row: int, url: str, payload: bytes, refers_to: tuple[int, int] | None) -> Iterator[bytes]:
    """The records of one page: a revisit, a whole response, or a first segment and its continuations."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    url = "".join(c for c in url if c > " ") or f"urn:bidloom:page:{row}"
    common = [("WARC-Target-URI", url), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", digest)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    mime = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", _uri(page_id, row)), *common, ("WARC-Profile", profile), ("WARC-Refers-To", _uri(*refers_to)), mime], http)
        return
    block = http + chunked(payload)
    parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", _uri(page_id, row)), *common, mime]
    if len(parts) == 1:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", _uri(page_id, row, k)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", _uri(page_id, row)), ("WARC-Segment-Number", k), *last], part)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record in an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(_EOL)
        if not lines[0].startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"), text(url_col).alias("url"), F.encode(text(payload_col), "UTF-8").alias("payload"))
    keyed = keyed.withColumn("digest", F.when(F.length("payload") >= REVISIT_LEAST, F.sha1("payload")))
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))
    largest = keyed.where("digest IS NOT NULL").groupBy("digest").agg(F.max(known).alias("latest"), F.count("*").alias("n")).where("n > 1").select("digest", "latest")
    # pages without a copy have no row in ``largest``; short pages get keys of their own, so that they don't meet in one task
    paired = keyed.withColumn("digest", F.coalesce("digest", F.concat(F.lit("short "), F.col("row")))).join(largest, "digest", "left")

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out = []
                for page_id, row, url, payload, latest, latest_row in zip(*(scalars(part.column(i)) for i in range(6)), strict=True):
                    out += records_of(page_id, row, url, payload, (latest, latest_row) if latest is not None and latest != page_id else None)
                yield {"record": out}

    records = map_arrow(paired.select("page_id", "row", "url", "payload", F.col("latest.page_id").alias("latest_page"), F.col("latest.row").alias("latest_row")), rows, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a page: payload_bytes, payload_digest, record_type and refers_to; a revisit's length is that of what it refers to."""
    def number(uri: str) -> int | None:
        page_id = uri.rsplit(":", 3)[1]
        return int(page_id) if page_id else None

    def measured(block: bytes) -> dict:
        head, _, body = block.partition(b"\r\n\r\n")
        payload = unchunked(body) if b"chunked" in head.lower() else body
        return {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}

    fields = ("origin", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "segment", "total", "block")

    def rows(batches):
        for batch in batches:
            for data in scalars(batch.column(0)):
                out = []
                for h, block in parse(zlib.decompress(data, 47) if data[:2] == b"\x1f\x8b" else data):
                    origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                    row = {"origin": origin, "page_id": number(origin), "record_type": h["warc-type"]}
                    digest = base64.b32decode(h["warc-payload-digest"].partition(":")[2]).hex() if "warc-payload-digest" in h else None
                    if h["warc-type"] == "revisit":
                        row |= {"payload_digest": digest, "refers_to": number(h["warc-refers-to"])}
                    elif "warc-segment-number" in h:
                        row |= {"segment": int(h["warc-segment-number"]), "total": int(h.get("warc-segment-total-length", 0)), "block": block, "payload_digest": digest}
                    else:
                        row |= measured(block)
                        if row["payload_digest"] != digest:
                            raise ValueError(f"record of page {row['page_id']}: the payload digest differs")
                    out.append(row)
                    if len(out) >= 500:
                        yield {f: [r.get(f) for r in out] for f in fields}
                        out = []
                yield {f: [r.get(f) for r in out] for f in fields}

    def joined(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, parts = number(batch.column(0)[i].as_py()), batch.column(1)[i].as_py()
                block = b"".join(p["block"] for p in parts)
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != parts[-1]["total"]:
                    raise ValueError(f"record of page {page_id}: segments are missing or the total length differs")
                found = measured(block)
                if found["payload_digest"] != parts[0]["payload_digest"]:
                    raise ValueError(f"record of page {page_id}: the payload digest differs")
                yield {"page_id": [page_id], **{k: [v] for k, v in found.items()}}

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parsed = map_arrow(files, rows, "origin string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, segment int, total long, block binary")
    parsed = stage_table(parsed, "warc-parsed")  # small but for the segments; read three times below
    whole = parsed.where("segment IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    pieces = parsed.where("segment IS NOT NULL").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("segment", "total", "payload_digest", "block"))).alias("parts"))
    put = map_arrow(pieces, joined, "page_id long, payload_bytes long, payload_digest string").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return _resolved(whole.unionByName(put))


def _resolved(rows: DataFrame) -> DataFrame:
    """Revisits get the length of the response that they name and whose digest agrees."""
    responses = rows.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload_bytes").alias("n"))
    revisits = rows.where("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left")
    agreed = revisits.select("page_id", F.col("n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return rows.where("record_type = 'response'").unionByName(agreed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS latest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN m.latest IS NOT NULL AND m.latest <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.latest <> p.page_id THEN m.latest END AS refers_to
FROM p LEFT JOIN m ON p.payload_bytes >= 1000 AND p.payload_digest = m.payload_digest
"""
