"""The catalogue: each query over the driver tables, with oracle SQL wherever SQL can express it.

Stand-ins: orders are jobs, line items are price items (full rows give their order), parts are product names, documents are
recognised texts, events are status rows and requests, embeddings are small rasters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import money as M
from ..functions import text as T
from ..operators import chunking, documents, jobs, raster, recognition, tables
from ..sources import exports, files, providers
from ..sources.storage import scratch
from ..streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_LINE_ORDER_SQL = ", ".join(LINE_ORDER)


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from . import images, layout, service  # noqa: F401  register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------------ documents and roll-ups


def _status():
    return F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "extracting").otherwise("pending")


@register("""
SELECT o.o_orderkey AS job_id, count(l.l_orderkey) AS n_items,
  round(coalesce(sum(CAST(CASE WHEN l.l_linenumber % 3 = 0 THEN l.l_quantity * l.l_extendedprice ELSE l.l_extendedprice END AS DECIMAL(18,2))), 0)::DOUBLE, 2) AS calculated_total,
  round(CASE WHEN count(l.l_orderkey) > 0 THEN (avg(1 - l.l_discount) + 0.85) / 2 ELSE 0.85 END, 6) AS overall_confidence
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""")
def doc_summary(s: SparkSession, d: str) -> DataFrame:
    items = read(s, d, "lineitem").select("l_orderkey", M.repaired_total(F.col("l_quantity"), F.col("l_extendedprice"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice"))).alias("total"), (1 - F.col("l_discount")).alias("conf"))
    rolled = items.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("total").cast("decimal(18,2)")).cast("double").alias("t"), F.avg("conf").alias("c"))
    joined = read(s, d, "orders").select("o_orderkey").join(rolled, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select(F.col("o_orderkey").alias("job_id"), n.alias("n_items"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("calculated_total"), F.round(M.overall_confidence(F.col("c"), n, F.lit(0.85)), 6).alias("overall_confidence"))


@register("""
SELECT o.o_orderkey AS job_id, round(CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_totalprice WHEN o.o_orderkey % 3 = 1 THEN o.o_totalprice * 2 ELSE coalesce(t.s, 0) END, 2) AS displayed_total
FROM orders o LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS s FROM lineitem GROUP BY 1) t ON o.o_orderkey = t.l_orderkey""")
def displayed_total(s, d):
    sums = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("s"))
    k = F.col("o_orderkey") % 3
    after, before = F.when(k == 0, F.col("o_totalprice")).otherwise(0.0), F.when(k == 1, F.col("o_totalprice") * 2)
    first = F.coalesce(F.nullif(after, F.lit(0.0)), F.nullif(before, F.lit(0.0)), F.col("s"), F.lit(0.0))
    return read(s, d, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("job_id"), F.round(first, 2).alias("displayed_total"))


@register("SELECT l_orderkey AS job_id, round(avg(1 - l_discount), 6) AS item_avg, round((avg(1 - l_discount) + 0.3) / 2, 6) AS overall FROM lineitem GROUP BY 1")
def overall_confidence(s, d):
    a = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.avg(1 - F.col("l_discount")).alias("a"), F.count("*").alias("n"))
    return a.select("job_id", F.round("a", 6).alias("item_avg"), F.round(M.overall_confidence(F.col("a"), F.col("n"), F.lit(0.3)), 6).alias("overall"))


@register("SELECT l_orderkey AS job_id, count(*) AS n_items FROM lineitem GROUP BY 1")
def item_pill(s, d):
    return read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("n_items"))


# ------------------------------------------------------------------ scalar rules

_MONEY_IN = "CASE l_linenumber % 7 WHEN 0 THEN format('{:,}', v) WHEN 1 THEN format('{:,}', v) || ' đ' WHEN 2 THEN replace(format('{:,}', v), ',', ' ') || ' VND' WHEN 3 THEN '$' || v WHEN 4 THEN v || ' vnd' WHEN 5 THEN v || 'K' ELSE v || '.5' END"


@register(f"""
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice) AS BIGINT) AS v FROM lineitem), b AS (SELECT *, {_MONEY_IN} AS raw FROM a),
c AS (SELECT *, trim(replace(replace(replace(replace(replace(replace(replace(replace(raw, ' ', ''), ',', ''), '.', ''), 'VND', ''), 'đ', ''), '$', ''), 'USD', ''), 'EUR', '')) AS t FROM b)
SELECT l_orderkey, l_partkey, raw, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+([eE][+-]?[0-9]+)?') THEN try_cast(t AS DOUBLE) END AS amount FROM c""")
def safe_money(s, d):
    v = F.floor("l_extendedprice").cast("bigint")
    k = F.col("l_linenumber") % 7
    grouped = F.format_number(v, 0)
    text = v.cast("string")
    raw = F.when(k == 0, grouped).when(k == 1, F.concat(grouped, F.lit(" đ"))).when(k == 2, F.concat(F.translate(grouped, ",", " "), F.lit(" VND"))).when(k == 3, F.concat(F.lit("$"), text)).when(k == 4, F.concat(text, F.lit(" vnd"))).when(k == 5, F.concat(text, F.lit("K"))).otherwise(F.concat(text, F.lit(".5")))
    return read(s, d, "lineitem").select("l_orderkey", "l_partkey", raw.alias("raw"), M.safe_money(raw).alias("amount"))


@register("""SELECT l_orderkey, l_partkey, CASE WHEN coalesce(CASE WHEN l_linenumber % 2 = 0 THEN 0 WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_extendedprice END, 0) = 0 AND l_quantity <> 0 AND nullif(l_extendedprice, 0) <> 0
THEN round(l_quantity * l_extendedprice, 2) ELSE round(l_extendedprice, 2) END AS total FROM lineitem""")
def line_total_repair(s, d):
    total = F.when(F.col("l_linenumber") % 2 == 0, 0.0).when(F.col("l_linenumber") % 3 == 0, F.lit(None)).otherwise(F.col("l_extendedprice"))
    return read(s, d, "lineitem").select("l_orderkey", "l_partkey", F.round(M.repaired_total(F.col("l_quantity"), F.col("l_extendedprice"), total), 2).alias("total"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN format('{:,.0f}', o_totalprice) || ' đ' ELSE format('{:,.2f}', o_totalprice) || ' USD' END AS money FROM orders")
def money_format(s, d):
    return read(s, d, "orders").select("o_orderkey", M.format_money(F.col("o_totalprice"), F.when(F.col("o_orderkey") % 2 == 0, "VND").otherwise("USD")).alias("money"))


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN translate(regexp_replace(format('{:,.3f}', o_totalprice), '\\.?0+$', ''), ',.', '.,') || ' đ' ELSE regexp_replace(format('{:,.3f}', o_totalprice), '0$', '') || ' USD' END AS money FROM orders""")
def ui_money(s, d):
    return read(s, d, "orders").select("o_orderkey", M.ui_money(F.col("o_totalprice"), F.when(F.col("o_orderkey") % 2 == 0, "VND").otherwise("USD")).alias("money"))


@register("""SELECT l_orderkey, l_partkey, CASE WHEN c >= 0.85 THEN 'conf-high' WHEN c >= 0.6 THEN 'conf-medium' ELSE 'conf-low' END AS band, CAST(floor(c * 100 + 0.5) AS BIGINT) || '%' AS label FROM (SELECT *, 1 - l_discount * 5 AS c FROM lineitem)""")
def confidence_band(s, d):
    c = 1 - F.col("l_discount") * 5
    return read(s, d, "lineitem").select("l_orderkey", "l_partkey", M.confidence_band(c).alias("band"), M.percent_label(c).alias("label"))


@register("SELECT l_orderkey, l_partkey, format('{:,.0f}', (1 - l_discount) * 100) || '%' AS percent FROM lineitem")
def percent_label(s, d):
    return read(s, d, "lineitem").select("l_orderkey", "l_partkey", M.format_percent(1 - F.col("l_discount")).alias("percent"))


@register("SELECT p_partkey, lower(p_name) AS name_key FROM part")
def name_key(s, d):
    return read(s, d, "part").select("p_partkey", T.name_key(F.concat(F.lit(" \t"), "p_name", F.lit("  "))).alias("name_key"))


@register("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def html_escape(s, d):
    return read(s, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


_NAME = "'scan ' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.heic' WHEN 3 THEN '.exe' WHEN 4 THEN '.tiff' ELSE '' END"


def _names(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 6
    end = F.when(k == 0, ".PDF").when(k == 1, ".jpg").when(k == 2, ".heic").when(k == 3, ".exe").when(k == 4, ".tiff").otherwise("")
    return read(s, d, "documents").select("doc_id", "n_chars", F.concat(F.lit("scan "), F.col("doc_id").cast("string"), end).alias("name"))


@register(f"SELECT doc_id, lower(regexp_extract(name, '(\\.[^./]+)$', 1)) IN ('.pdf', '.jpg', '.jpeg', '.png', '.webp', '.tiff', '.bmp', '.heic') AS ok, n_chars * 4096 / 1048576.0 <= 50 AS fits FROM (SELECT *, {_NAME} AS name FROM documents)")
def intake_gates(s, d):
    return _names(s, d).select("doc_id", T.allowed(F.col("name")).alias("ok"), T.small_enough(F.col("n_chars") * 4096).alias("fits"))


@register(f"""SELECT doc_id, replace(name, ' ', '_') AS safe, CASE lower(regexp_extract(name, '(\\.[^./]+)$', 1)) WHEN '.pdf' THEN 'application/pdf' WHEN '.jpg' THEN 'image/jpeg' WHEN '.tiff' THEN 'image/tiff' ELSE 'application/octet-stream' END AS mime FROM (SELECT *, {_NAME} AS name FROM documents)""")
def name_and_mime(s, d):
    return _names(s, d).select("doc_id", T.safe_name(F.concat(F.lit("/in box/"), F.col("name"))).alias("safe"), T.mime_type(F.col("name")).alias("mime"))


@register(f"SELECT substr(sha256(name), 1, 11) AS job_id, replace(name, ' ', '_') AS filename, round(n_chars / 1048576.0 * 1024, 2) AS size_kb, 'pending' AS status, '/api/ws/' || substr(sha256(name), 1, 11) AS ws_url FROM (SELECT *, {_NAME} AS name FROM documents)")
def upload_receipt(s, d):
    key = T.job_id(F.col("name"))
    return _names(s, d).select(key.alias("job_id"), T.safe_name(F.col("name")).alias("filename"), F.round(F.col("n_chars") / 1048576.0 * 1024, 2).alias("size_kb"), F.lit("pending").alias("status"), F.concat(F.lit("/api/ws/"), key).alias("ws_url"))


@register("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 401 WHEN 1 THEN 200 WHEN 2 THEN 200 ELSE 403 END AS code, sha256(c_name) AS digest FROM customer")
def api_key_check(s, d):
    k = F.col("c_custkey") % 4
    expected = F.when(k == 2, F.sha2("c_name", 256)).otherwise(F.col("c_name"))
    given = F.when(k == 1, F.col("c_name")).when(k == 2, F.col("c_name")).when(k == 3, "other")
    return read(s, d, "customer").select("c_custkey", jobs.key_check(given, expected).alias("code"), F.sha2("c_name", 256).alias("digest"))


@register("SELECT doc_id, substr(text, 1, 200) AS error_message, substr(text, 1, 500) AS logged FROM documents")
def error_prefix(s, d):
    return read(s, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("error_message"), F.substring("text", 1, 500).alias("logged"))


@register("SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso, strftime(ts, '%H:%M %d/%m/%Y') AS shown FROM events")
def iso_timestamps(s, d):
    return read(s, d, "events").select("event_id", T.iso_timestamp(F.col("ts")).alias("iso"), F.date_format("ts", "HH:mm dd/MM/yyyy").alias("shown"))


@register("SELECT doc_id, base64(encode(text)) AS b64, CASE WHEN length(text) > 20 THEN 0.85 ELSE 0.3 END AS vision_confidence FROM documents")
def image_b64(s, d):
    whole = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\r\n", "")
    return read(s, d, "documents").select("doc_id", whole.alias("b64"), recognition.vision_confidence(F.col("text")).alias("vision_confidence"))


# ------------------------------------------------------------------ chunking and prompts

_LINES = "SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents"
_FOLD = """
f AS (SELECT doc_id, text, list_reduce(list_transform(ls, lambda x: {'done': []::VARCHAR[], 'lines': [x], 'size': length(x)}),
  lambda s, n: CASE WHEN s.size + n.size > 500 THEN
      {'done': list_append(s.done, array_to_string(s.lines, chr(10))), 'lines': list_concat(s.lines[-3:], n.lines), 'size': CAST(list_sum(list_transform(s.lines[-3:], lambda y: length(y))) + n.size AS BIGINT)}
    ELSE {'done': s.done, 'lines': list_concat(s.lines, n.lines), 'size': s.size + n.size} END) AS r FROM l),
c AS (SELECT doc_id, CASE WHEN length(text) > 500 THEN list_append(r.done, array_to_string(r.lines, chr(10))) ELSE [text] END AS chunks FROM f)"""


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", chunking.chunk_lines(F.col("text"), 500).alias("chunks"))


CHUNKS_SQL = f"WITH l AS ({_LINES}), {_FOLD} SELECT doc_id, unnest(range(1, len(chunks) + 1)) AS chunk_no, unnest(chunks) AS chunk FROM c"


@register(CHUNKS_SQL)
def chunk_text(s, d):
    return _chunks(s, d).select("doc_id", F.posexplode("chunks").alias("p", "chunk")).select("doc_id", (F.col("p") + 1).cast("long").alias("chunk_no"), "chunk")


@register(f"WITH l AS ({_LINES}), {_FOLD} SELECT doc_id, len(chunks) AS n_chunks, list_max(list_transform(chunks, lambda x: length(x))) AS longest FROM c")
def chunk_stats(s, d):
    return _chunks(s, d).select("doc_id", F.size("chunks").cast("long").alias("n_chunks"), F.array_max(F.transform("chunks", F.char_length)).cast("long").alias("longest"))


@register("""SELECT doc_id, 'File: ' || source || CASE WHEN doc_id % 2 = 0 THEN ' (trang 1/2)' ELSE '' END || chr(10) || chr(10) || '=== NỘI DUNG OCR ===' || chr(10) || text || chr(10) || '=== HẾT NỘI DUNG ===' AS prompt FROM documents""")
def prompt_text(s, d):
    return read(s, d, "documents").select("doc_id", T.prompt(F.col("text"), F.col("source"), F.lit(1), F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1)).alias("prompt"))


@register("""SELECT doc_id, '{"a": {"n": ' || n_chars || '}}' AS region FROM documents""")
def json_region(s, d):
    body = F.concat(F.lit('{"a": {"n": '), F.col("n_chars").cast("string"), F.lit("}}"))
    k = F.col("doc_id") % 4
    reply = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```\nbye"))).when(k == 2, F.concat(F.lit("  Here: "), body, F.lit(" done"))).otherwise(F.concat(F.lit("\n"), body, F.lit("\n ")))
    return read(s, d, "documents").select("doc_id", T.json_region(reply).alias("region"))


# ------------------------------------------------------------------ items

_KEYS = "l_orderkey, l_linenumber"


@register("""
SELECT l_orderkey AS doc_id, count(*) AS n_items, round(sum(CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE l_quantity * l_extendedprice END AS DECIMAL(18,2)))::DOUBLE, 2) AS total, round(avg(CASE WHEN l_linenumber % 3 = 0 THEN 0.8 ELSE 1 - l_discount END), 6) AS confidence
FROM lineitem WHERE l_linenumber <> 4 GROUP BY 1""")
def json_roundtrip_items(s, d):
    """Items written as JSON replies, some in fences, with bad and nameless ones among them, and read back."""
    k = F.col("l_linenumber")
    num = lambda c: F.regexp_replace(F.col(c).cast("decimal(18,2)").cast("string"), r"\.?0+$", "")
    fields = [
        F.concat(F.lit('"ten_sp":"'), F.when(k == 4, "").otherwise("x"), F.lit('"')), F.concat(F.lit('"so_luong":'), F.col("l_quantity").cast("decimal(18,2)").cast("string")), F.concat(F.lit('"don_gia":'), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")),
        F.concat(F.lit('"thanh_tien":'), F.when(k % 2 == 0, F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).otherwise("null")), F.when(k % 3 != 0, F.concat(F.lit('"confidence":'), num("conf"))),
    ]
    item = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    lines = read(s, d, "lineitem").withColumn("conf", 1 - F.col("l_discount"))
    replies = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit('```json\n{"items":['), F.array_join(F.sort_array(F.collect_list(item)), ","), F.lit(',5,{"ten_sp":"bad","confidence":1.5}]}\n```')).alias("reply"))
    docs = documents.parse_replies(replies).where(F.size("items") > 0)
    i = docs.select("doc_id", F.explode("items").alias("i"))
    return i.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.round(F.sum(F.col("i.thanh_tien").cast("decimal(18,2)")).cast("double"), 2).alias("total"), F.round(F.avg("i.confidence"), 6).alias("confidence"))


@register("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_linenumber % 5 <> 0 AND 1 - l_discount * 12 BETWEEN 0 AND 1")
def drop_bad_items(s, d):
    name = F.when(F.col("l_linenumber") % 5 != 0, "part").otherwise("")
    good = documents.item_valid(name, 1 - F.col("l_discount") * 12)
    return read(s, d, "lineitem").where(good).select("l_orderkey", "l_partkey", "l_linenumber")


@register(f"""
SELECT l_orderkey, name, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, name ORDER BY {_LINE_ORDER_SQL}) AS n FROM (SELECT *, 'item ' || l_partkey % 5 AS name FROM lineitem)) WHERE n = 1""")
def dedupe_first_wins(s, d):
    named = read(s, d, "lineitem").withColumn("name", F.concat(F.lit("item "), (F.col("l_partkey") % 5).cast("string")))
    return documents.first_wins(named, "l_orderkey", "name", *LINE_ORDER).select("l_orderkey", "name", "l_linenumber", "l_suppkey")


@register("""
SELECT l_orderkey AS doc_id, arg_min(l_suppkey, k) AS first_supplier, arg_max(l_suppkey, k) AS last_supplier, count(*) AS n FROM (SELECT *, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS k FROM lineitem) GROUP BY 1""")
def merge_chunks(s, d):
    k = F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey")
    chunks = read(s, d, "lineitem").withColumn("k", k).withColumn("first_supplier", F.col("l_suppkey"))
    merged = documents.merge_chunks(chunks, "l_orderkey", "k", ["first_supplier"], F.max_by("l_suppkey", "k").alias("last_supplier"), F.count("*").alias("n"))
    return merged.select(F.col("l_orderkey").alias("doc_id"), "first_supplier", "last_supplier", "n")


@register(f"""
SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 4 = 0 THEN n ELSE l_linenumber END AS stt, n % 2 AS stripe, coalesce(nullif(l_returnflag, 'N'), '—') AS code, format('{{:,.0f}}', (1 - l_discount) * 100) || '%' AS conf
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER_SQL}) AS INT) AS n FROM lineitem)""")
def item_grid(s, d):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    stt = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_linenumber"))
    rows = read(s, d, "lineitem").withColumn("n", n)
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.coalesce(F.when(stt != 0, stt), F.col("n")).alias("stt"), (F.col("n") % 2).alias("stripe"), F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("N")), F.lit("—")).alias("code"), M.format_percent(1 - F.col("l_discount")).alias("conf"))


@register(f"""
SELECT l_orderkey AS doc_id, CAST(CASE WHEN l_linenumber % 4 = 0 THEN n ELSE l_linenumber END AS VARCHAR) AS stt, '' AS ma_sp, l_returnflag AS ten_sp, round(l_quantity, 2) AS qty, round(l_extendedprice, 2) AS price
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER_SQL}) AS n FROM lineitem)""")
def item_export_rows(s, d):
    """Export rows written as CSV and read back."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    items = read(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("pos"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_linenumber")).alias("stt"), F.lit(None).cast("string").alias("ma_sp"), F.col("l_returnflag").alias("ten_sp"), F.lit("kg").alias("dvt"), F.col("l_quantity").alias("so_luong"), F.col("l_extendedprice").alias("don_gia"), F.lit(None).cast("double").alias("chiet_khau_pct"), F.lit(None).cast("double").alias("thanh_tien"), F.lit('a "b", c').alias("ghi_chu"), (1 - F.col("l_discount")).alias("confidence"))
    path = scratch(s, "csv")
    exports.write_csv(exports.csv_rows(items), path, files=64)
    back = s.read.option("header", True).option("quote", '"').option("escape", '"').csv(path, schema="doc_id long, stt string, ma_sp string, ten_sp string, dvt string, so_luong double, don_gia double, chiet_khau_pct string, thanh_tien string, ghi_chu string, confidence double")
    return back.select("doc_id", "stt", F.coalesce("ma_sp", F.lit("")).alias("ma_sp"), "ten_sp", F.round("so_luong", 2).alias("qty"), F.round("don_gia", 2).alias("price"))


@register("SELECT 'p_name' AS col, least(max(length(p_name)) + 4, 50) AS width FROM part UNION ALL SELECT 'p_type', least(max(length(p_type)) + 4, 50) FROM part UNION ALL SELECT 'p_size', least(max(length(CAST(p_size AS VARCHAR))) + 4, 50) FROM part")
def column_widths(s, d):
    longest = read(s, d, "part").agg(*[F.max(F.char_length(F.col(c).cast("string"))).alias(c) for c in ("p_name", "p_type", "p_size")])
    return longest.unpivot([], ["p_name", "p_type", "p_size"], "col", "n").select("col", F.least(F.col("n") + 4, F.lit(50)).cast("long").alias("width"))


@register("""
SELECT o_orderkey, label, value FROM (SELECT o_orderkey, c_name AS "Khách hàng", CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS "Số báo giá", 'VND' AS "Đơn vị tiền", format('{:,.0f}', o_totalprice) || ' đ' AS "Tổng sau VAT" FROM orders JOIN customer ON o_custkey = c_custkey)
UNPIVOT (value FOR label IN ("Khách hàng", "Số báo giá", "Đơn vị tiền", "Tổng sau VAT")) WHERE value <> ''""")
def doc_kv_summary(s, d):
    labels = ["Khách hàng", "Số báo giá", "Đơn vị tiền", "Tổng sau VAT"]
    wide = read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_name").alias(labels[0]), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderpriority")).alias(labels[1]), F.lit("VND").alias(labels[2]), M.format_money(F.col("o_totalprice"), F.lit("VND")).alias(labels[3]))
    return wide.unpivot(["o_orderkey"], labels, "label", "value").where(F.col("value").isNotNull() & (F.col("value") != ""))


def _order_docs(s: SparkSession, d: str) -> DataFrame:
    """Orders as documents, with as many items as the key modulo 5."""
    none, k = F.lit(None).cast("string"), F.col("o_orderkey")
    rate = F.when(k % 3 == 1, 0.0).when(k % 3 == 2, 8.0)
    return read(s, d, "orders").select(
        k.alias("doc_id"), F.col("o_orderpriority").alias("nha_cung_cap"), none.alias("so_bao_gia"), F.col("o_orderpriority").alias("ngay_bao_gia"), F.lit("").alias("khach_hang"), F.when(k % 2 == 0, "VND").otherwise("USD").alias("don_vi_tien"),
        F.col("o_totalprice").alias("tong_chua_vat"), F.lit(None).cast("double").alias("thue_vat_tien"), F.col("o_totalprice").alias("tong_sau_vat"), rate.alias("thue_vat_pct"), none.alias("dieu_kien_thanh_toan"), F.lit("x").alias("thoi_gian_giao_hang"), none.alias("bao_hanh"),
        F.array_repeat(F.lit("x"), (k % 5).cast("int")).alias("items"),
    )


_MONEY = "CASE WHEN o_orderkey % 2 = 0 THEN format('{:,.0f}', o_totalprice) || ' đ' ELSE format('{:,.2f}', o_totalprice) || ' USD' END"


@register(f"""
SELECT doc_id, unnest(range(1, 13))::INT AS pos, unnest(labels) AS label, unnest(vals) AS value FROM (SELECT o_orderkey AS doc_id,
 ['Nhà cung cấp', 'Số báo giá', 'Ngày báo giá', 'Khách hàng', 'Đơn vị tiền', 'Số sản phẩm', 'Tổng chưa VAT', CASE WHEN o_orderkey % 3 = 2 THEN 'Thuế VAT (8.0%)' ELSE 'Thuế VAT (10%)' END, 'Tổng sau VAT', 'Điều kiện thanh toán', 'Thời gian giao hàng', 'Bảo hành'] AS labels,
 [o_orderpriority, '', o_orderpriority, '', CASE WHEN o_orderkey % 2 = 0 THEN 'VND' ELSE 'USD' END, CAST(o_orderkey % 5 AS VARCHAR), {_MONEY}, '', {_MONEY}, '', 'x', ''] AS vals FROM orders)""")
def summary_sheet(s, d):
    return exports.summary_rows(_order_docs(s, d))


@register("""
SELECT o_orderkey AS doc_id, fmt, CASE WHEN fmt = 'pdf' THEN 400 WHEN o_orderstatus <> 'F' THEN 404 WHEN fmt <> 'json' AND o_orderkey % 5 = 0 THEN 404 ELSE 200 END AS code
FROM (SELECT *, unnest(['excel', 'csv', 'json', 'pdf']) AS fmt FROM orders)""")
def export_gate(s, d):
    asked = read(s, d, "orders").select("o_orderkey", "o_orderstatus", F.explode(F.array(*map(F.lit, ("excel", "csv", "json", "pdf")))).alias("fmt"))
    return asked.select(F.col("o_orderkey").alias("doc_id"), "fmt", exports.export_outcome(F.col("fmt"), F.col("o_orderstatus") == "F", F.col("o_orderkey") % 5).alias("code"))


_NAMED_LINES = "SELECT l_orderkey AS doc_id, 'item ' || l_partkey % 4 || ' | ' || CAST(floor(l_extendedprice) AS BIGINT) AS line FROM lineitem"


@register(f"""
WITH l AS ({_NAMED_LINES}), p AS (SELECT doc_id, line, split_part(line, ' | ', 1) AS name, CAST(split_part(line, ' | ', 2) AS BIGINT) AS price, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos FROM l),
t AS (SELECT doc_id, sum(length(line) + 1) - 1 > 80 AS long FROM l GROUP BY 1), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY pos) AS nth FROM p)
SELECT doc_id, count(*) AS n_items, sum(price)::DOUBLE AS total FROM f JOIN t USING (doc_id) WHERE NOT long OR nth = 1 GROUP BY 1""")
def extract_chunked(s, d):
    """Texts of one line an item through chunks of 80 characters, a line reader as extractor, parsing and merging."""
    line = F.concat(F.lit("item "), (F.col("l_partkey") % 4).cast("string"), F.lit(" | "), F.floor("l_extendedprice").cast("string"))
    texts = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    docs = documents.extract_documents(texts, lambda chunks: providers.extract(chunks, providers.extract_lines), budget=80)
    return docs.select("doc_id", F.size("items").cast("long").alias("n_items"), F.aggregate("items", F.lit(0.0), lambda a, i: a + i["don_gia"]).alias("total"))


# ------------------------------------------------------------------ jobs


@register("SELECT o_orderkey AS job_id, o_orderstatus AS status, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def history_topk(s, d):
    return jobs.history(read(s, d, "orders"), 20, "o_orderdate", "o_orderkey").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), "o_totalprice")


@register("SELECT count(*) AS n_done FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100) WHERE o_orderstatus = 'F'")
def done_in_latest_100(s, d):
    return jobs.history(read(s, d, "orders"), 100, "o_orderdate", "o_orderkey").where("o_orderstatus = 'F'").agg(F.count("*").alias("n_done"))


@register("SELECT o_orderkey AS job_id, o_totalprice FROM orders WHERE o_orderkey = 7")
def job_lookup(s, d):
    return read(s, d, "orders").where(F.col("o_orderkey") == 7).select(F.col("o_orderkey").alias("job_id"), "o_totalprice")


@register("""
SELECT o.o_orderkey AS job_id, CASE WHEN o_orderstatus <> 'F' THEN 202 WHEN l.k IS NULL THEN 500 ELSE 200 END AS code, coalesce(l.n, 0) AS n_items
FROM orders o LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.k""")
def result_outcome(s, d):
    results = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    joined = read(s, d, "orders").join(results, F.col("o_orderkey") == F.col("k"), "left")
    return joined.select(F.col("o_orderkey").alias("job_id"), jobs.outcome(_status(), F.col("k").isNotNull()).alias("code"), F.coalesce("n", F.lit(0)).alias("n_items"))


@register("""
SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'extracting' ELSE 'pending' END AS status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS completed_at FROM orders""")
def status_view(s, d):
    o = read(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.lit("f").alias("filename"), _status().alias("status"), F.lit(None).cast("string").alias("document_type"), F.lit(0).alias("progress_pct"), F.lit("").alias("current_step"), F.lit(None).cast("string").alias("error_message"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("completed_at"))
    return jobs.status_view(o).select("job_id", "status", "created_at", "completed_at")


@register("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'status-done' WHEN 'P' THEN 'status-pending' ELSE 'status-processing' END AS css, CASE o_orderstatus WHEN 'F' THEN '✓ Hoàn thành' WHEN 'P' THEN '⏳ Chờ' ELSE '🤖 AI' END AS label,
CASE WHEN o_orderstatus IN ('F', 'O') THEN 'done' END AS detect, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'done' END AS preprocess, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'done' END AS ocr,
CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'active' END AS ai, CASE o_orderstatus WHEN 'F' THEN '✅' WHEN 'O' THEN '⚙️' ELSE '⏸' END AS ai_mark FROM orders""")
def status_labels(s, d):
    steps = labels.step_states(_status())
    shown = {"css": labels.status_class(_status()), "label": labels.status_label(_status())} | steps | {"ai_mark": labels.mark(steps["ai"])}
    return read(s, d, "orders").select("o_orderkey", *[c.alias(k) for k, c in shown.items()])


@register("""
SELECT event_id, CASE event_id % 7 WHEN 0 THEN '📄 PDF Mềm' WHEN 1 THEN '📷 PDF Scan' WHEN 2 THEN '🖼️ Ảnh Scan' WHEN 3 THEN '📱 Ảnh Điện Thoại' WHEN 4 THEN '🌟 Ảnh Lóa' WHEN 5 THEN '📐 Ảnh Nghiêng' ELSE 'unknown' END AS type_label,
 CASE event_id % 7 WHEN 0 THEN '📄 PDF Mềm' WHEN 1 THEN '📊 Camelot' WHEN 2 THEN '🔤 PaddleOCR' WHEN 3 THEN '🔤 EasyOCR' WHEN 4 THEN '🔤 Tesseract' WHEN 5 THEN '👁️ Gemini Vision' ELSE 'unknown' END AS method_label FROM events""")
def meta_labels(s, d):
    """Every type and method, and one of each that has no label."""
    nth = lambda values: F.get(F.array(*map(F.lit, [*values, "unknown"])), (F.col("event_id") % 7).cast("int"))
    return read(s, d, "events").select("event_id", labels.type_label(nth(labels.TYPE)).alias("type_label"), labels.method_label(nth(labels.METHOD)).alias("method_label"))


@register("""
SELECT c_custkey, coalesce(p.t, c.c_mktsegment) AS status, coalesce(p.v, c.c_acctbal) AS progress FROM customer c LEFT JOIN
(SELECT user_id, arg_max(event_type, event_id) FILTER (event_id % 3 <> 0) AS t, arg_max(value, event_id) FILTER (event_id % 2 = 0) AS v FROM events GROUP BY 1) p ON c.c_custkey = p.user_id""")
def job_patch(s, d):
    base = read(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("progress"))
    e = read(s, d, "events").select(F.col("user_id").alias("c_custkey"), "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("status"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("progress"))
    return jobs.patch(base, e, "c_custkey", "event_id", ["status", "progress"])


@register("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def job_delete(s, d):
    gone = read(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return jobs.delete(read(s, d, "lineitem"), gone, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@register("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def status_changes(s, d):
    return feeds.status_changes(read(s, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@register("""
SELECT user_id, len(t) AS n_requests, CAST(r.rej AS BIGINT) AS n_rejected FROM (SELECT user_id, t, list_reduce(list_transform(t, lambda x: {'held': [x], 'rej': 0}),
 lambda s, n: CASE WHEN len(list_filter(s.held, lambda h: n.held[1] - h < 259200)) >= 5 THEN {'held': list_filter(s.held, lambda h: n.held[1] - h < 259200), 'rej': s.rej + 1} ELSE {'held': list_concat(list_filter(s.held, lambda h: n.held[1] - h < 259200), n.held), 'rej': s.rej} END) AS r
 FROM (SELECT user_id, list(epoch(ts) ORDER BY ts) AS t FROM events GROUP BY 1))""")
def rate_limit_batch(s, d):
    return jobs.rate_limit(read(s, d, "events"), "user_id", "ts", 5, 259200.0)


def _order_jobs(s: SparkSession, d: str) -> DataFrame:
    """Orders as full job rows; a finished one ends when it began."""
    made = {
        "job_id": F.col("o_orderkey"), "filename": F.concat(F.lit("f"), F.col("o_orderkey").cast("string")), "status": _status(), "document_type": F.lit("soft_pdf"), "overall_confidence": F.lit(0.85),
        "progress_pct": F.when(F.col("o_orderstatus") == "F", 100).otherwise(0), "current_step": F.col("o_orderpriority"), "created_at": F.col("o_orderdate"), "completed_at": F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")),
    }
    return read(s, d, "orders").select(*[made.get(c, F.lit(None)).cast(t).alias(c) for c, t in jobs.COLUMNS.items()])


@register("""
SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderkey % 2 = 1 OR o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'extracting' END AS status,
 CASE WHEN o_orderkey % 2 = 1 THEN 'Đang chờ...' ELSE o_orderpriority END AS current_step, CASE WHEN o_orderkey % 2 = 1 THEN '/in/' || o_orderkey END AS file_path, CASE WHEN o_orderkey % 2 = 1 THEN 0.0 ELSE 0.85 END::DOUBLE AS overall_confidence
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def job_insert(s, d):
    """Every second order is a job; each third one, some of them twice, arrives as an upload."""
    there = _order_jobs(s, d).where(F.col("job_id").cast("long") % 2 == 0)
    came = _order_jobs(s, d).where(F.col("job_id").cast("long") % 3 == 0).select("job_id", "filename", F.concat(F.lit("/in/"), "job_id").alias("file_path"), "created_at")
    again = came.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY")).withColumn("file_path", F.lit("/in/again"))
    return jobs.insert(there, came.unionByName(again)).select("job_id", "status", "current_step", "file_path", "overall_confidence")


@register("""
SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 'f' || o_orderkey AS filename, 'soft_pdf' AS document_type, n AS n_items, last AS last_line
FROM orders JOIN (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""")
def result_envelope(s, d):
    results = read(s, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("job_id")).agg(F.count("*").alias("n_items"), F.max("l_linenumber").alias("last_line"))
    return jobs.result(_order_jobs(s, d), results).select("job_id", "filename", "document_type", "result.n_items", "result.last_line")


@register("""
SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 'f' || o_orderkey AS filename, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'extracting' ELSE 'pending' END AS status, 'soft_pdf' AS document_type, CAST(NULL AS VARCHAR) AS extraction_method,
 0.85::DOUBLE AS overall_confidence, CASE WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END AS progress_pct, o_orderpriority AS current_step, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at,
 CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS completed_at
FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 20""")
def history_view(s, d):
    return jobs.history_view(_order_jobs(s, d), 20)


@register("""
WITH s AS (SELECT * FROM events WHERE event_type = 'signup'), l AS (SELECT user_id, ts, arg_max(event_type, event_id) AS last, arg_min(event_type, event_id) FILTER (WHERE event_type IN ('purchase', 'error')) AS final FROM events WHERE event_type <> 'signup' GROUP BY 1, 2),
b AS (SELECT s.event_id, l.last FROM s ASOF LEFT JOIN l ON s.user_id = l.user_id AND s.ts >= l.ts), a AS (SELECT s.event_id, f.final FROM s ASOF LEFT JOIN (SELECT * FROM l WHERE final IS NOT NULL) f ON s.user_id = f.user_id AND s.ts < f.ts)
SELECT s.event_id AS subscriber, s.user_id, b.last AS snapshot, a.final AS ending FROM s JOIN b USING (event_id) JOIN a USING (event_id)""")
def subscribe_snapshot(s, d):
    """Signups subscribe to their user; purchases and errors end a job."""
    e = read(s, d, "events")
    asks = e.where("event_type = 'signup'").withColumn("subscriber", F.col("event_id"))
    return feeds.subscriptions(e.where("event_type <> 'signup'"), asks, "user_id", ["ts", "event_id"], "event_type", ("purchase", "error"))


@register("SELECT e.event_id, c.c_custkey, e.event_type FROM events e JOIN customer c ON e.user_id = c.c_custkey")
def subscriber_fanout(s, d):
    return read(s, d, "events").join(read(s, d, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_custkey", "event_type")


@register("""SELECT event_id, event_type AS status, CAST(event_id % 101 AS INT) AS pct, round(113 - (event_id % 101) / 100.0 * 113, 4) AS ring, (event_id % 101) || '%' AS label FROM events""")
def push_decode(s, d):
    pct = (F.col("event_id") % 101).cast("int")
    payload = F.to_json(F.struct(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("status"), F.lit("x").alias("current_step"), pct.alias("progress_pct")))
    pushed = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("data: "), payload)).otherwise(payload)
    m = F.from_json(F.regexp_replace(pushed, r"^data:\s*", ""), "job_id string, status string, current_step string, progress_pct int")
    return read(s, d, "events").withColumn("m", m).select("event_id", F.col("m.status").alias("status"), F.col("m.progress_pct").alias("pct"), F.round(113 - F.col("m.progress_pct") / 100.0 * 113, 4).alias("ring"), F.concat(F.col("m.progress_pct").cast("string"), F.lit("%")).alias("label"))


@register("SELECT l_orderkey AS job_id, count(*) AS n, round(sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE, 2) AS total FROM lineitem GROUP BY 1")
def result_json_roundtrip(s, d):
    docs = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("thanh_tien"), F.lit(None).cast("string").alias("ghi_chu"))).alias("items"))
    path = scratch(s, "results")
    exports.write_json(docs, path)
    back = s.read.schema("job_id long, items array<struct<thanh_tien:double,ghi_chu:string>>").json(path)
    total = F.aggregate("items", F.lit(0).cast("decimal(18,2)"), lambda a, i: (a + i["thanh_tien"].cast("decimal(18,2)")).cast("decimal(18,2)"))
    return back.select("job_id", F.size("items").cast("long").alias("n"), F.round(total.cast("double"), 2).alias("total"))


# ------------------------------------------------------------------ classification and recognition

_PAGES_SQL = "SELECT doc_id, unnest(range(1, len(p) + 1)) AS page_no, unnest(p) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)"


def _doc_pages(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "t")).select("doc_id", (F.col("p") + 1).alias("page_no"), "t")


@register(f"""
SELECT doc_id, CASE WHEN e = '.pdf' THEN CASE WHEN doc_id % 11 = 0 THEN 'scanned_pdf' WHEN n_chars > 300 THEN 'soft_pdf' ELSE 'scanned_pdf' END WHEN e NOT IN ('.jpg', '.tiff') THEN 'unknown'
  WHEN doc_id % 11 = 0 THEN 'image_photo' WHEN doc_id % 7 > 3 THEN 'image_photo_glare' WHEN doc_id % 5 > 3 THEN 'image_skewed' WHEN doc_id % 50 < 20 THEN 'image_scan' ELSE 'image_photo' END AS doc_type,
 (CASE WHEN e = '.pdf' THEN CASE WHEN doc_id % 11 = 0 THEN 0.5 WHEN n_chars > 300 THEN 0.95 ELSE 0.9 END WHEN e NOT IN ('.jpg', '.tiff') THEN 0
  WHEN doc_id % 11 = 0 THEN 0.5 WHEN doc_id % 7 > 3 THEN 0.85 WHEN doc_id % 5 > 3 THEN 0.8 WHEN doc_id % 50 < 20 THEN 0.8 ELSE 0.75 END)::DOUBLE AS confidence
FROM (SELECT doc_id, n_chars, lower(regexp_extract(name, '(\\.[^./]+)$', 1)) AS e FROM (SELECT *, {_NAME} AS name FROM documents))""")
def classify_document(s, d):
    """Metrics made from the row; each eleventh file can't be read."""
    k = F.col("doc_id")
    known = lambda c: F.when(k % 11 != 0, c)
    found = recognition.document_type(F.col("name"), T.mime_type(F.col("name")), known(F.col("n_chars") / 6), known((k % 7) * 0.04), known((k % 5) * 0.04), known(k % 50 + 40))
    return _names(s, d).select("doc_id", found.alias("c")).select("doc_id", "c.doc_type", "c.confidence")


@register("""
SELECT doc_id, 1 AS table_no, 1 AS row_no, 'Item/Price' AS header, 'a/' || n_chars AS cells FROM documents UNION ALL SELECT doc_id, 1, 2, 'Item/Price', '/x' FROM documents
UNION ALL SELECT doc_id, 2, 1, 'SL/DVT/No', doc_id || '/kg/' FROM documents WHERE doc_id % 2 = 0""")
def table_scan(s, d):
    """Two tables a text, one of them with tabs and only in every second text; a header alone is no table."""
    n, k = F.col("n_chars").cast("string"), F.col("doc_id").cast("string")
    first = F.concat(F.lit("Quote\nItem | Price\na | "), n, F.lit("\n | \n|x\nTotal\n"))
    second = F.concat(F.lit("\nSL\tDVT\tNo\n"), k, F.lit("\tkg\t\nend"))
    text = F.concat(first, F.lit("alone|head\n\n"), F.when(F.col("doc_id") % 2 == 0, second).otherwise("no table"))
    found = files.text_tables(read(s, d, "documents").select("doc_id", text.alias("text")), "doc_id")
    return found.select("doc_id", "table_no", "row_no", F.array_join("header", "/").alias("header"), F.array_join("cells", "/").alias("cells"))


@register(f"SELECT doc_id, CASE WHEN avg(length(trim(t))) > 50 THEN 'soft_pdf' ELSE 'scanned_pdf' END AS doc_type, CASE WHEN avg(length(trim(t))) > 50 THEN 0.95 ELSE 0.9 END AS confidence FROM ({_PAGES_SQL}) WHERE page_no <= 3 GROUP BY 1")
def classify_text(s, d):
    mean = _doc_pages(s, d).where("page_no <= 3").groupBy("doc_id").agg(F.avg(F.char_length(F.trim("t"))).alias("m"))
    return mean.select("doc_id", recognition.pdf_class(F.col("m")).alias("c")).select("doc_id", "c.doc_type", "c.confidence")


@register(f"SELECT doc_id, 'T' || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY page_no) AS text FROM ({_PAGES_SQL}) WHERE trim(t) <> '' GROUP BY 1")
def page_text(s, d):
    return files.document_text(_doc_pages(s, d), "doc_id", "page_no", "t").select("doc_id", F.concat_ws("\n", F.lit("T"), "text").alias("text"))


@register("""SELECT doc_id, count(*) AS n_words, sum(c)::DOUBLE / count(*) / 100 AS confidence, string_agg(w, ' ' ORDER BY i) AS text FROM
(SELECT doc_id, i, w, (doc_id + i * 7) % 100 AS c FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM documents))) WHERE c > 0 AND trim(w) <> '' GROUP BY 1""")
def ocr_words(s, d):
    words = F.split(F.translate("text", "\n", " "), " ", -1)
    seen = F.transform(words, lambda w, i: F.struct((i + 1).alias("i"), w.alias("w"), ((F.col("doc_id") + (i + 1) * 7) % 100).alias("c")))
    return recognition.page_word_lists(read(s, d, "documents").select("doc_id", seen.alias("words")), "doc_id", "words")


_ENGINE = "CASE event_type WHEN 'view' THEN 'paddleocr' WHEN 'click' THEN 'easyocr' WHEN 'purchase' THEN 'tesseract' WHEN 'signup' THEN 'gemini_vision' END"


@register(f"""
WITH c AS (SELECT user_id, {_ENGINE} AS e, max(value) / 200 AS c FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
r AS (SELECT *, CASE e WHEN 'paddleocr' THEN 0 WHEN 'easyocr' THEN 1 WHEN 'tesseract' THEN 2 ELSE 3 END AS k, c >= CASE e WHEN 'tesseract' THEN 0.5 WHEN 'gemini_vision' THEN 0 ELSE 0.65 END AS ok FROM c)
SELECT user_id AS page_id, coalesce(arg_min(e, k) FILTER (ok), 'none') AS engine, round(coalesce(arg_min(c, k) FILTER (ok), 0), 6) AS confidence, coalesce(arg_min(c, k) FILTER (ok), 0) < 0.5 AS vision FROM r GROUP BY 1""")
def engine_cascade(s, d):
    kind = F.col("event_type")
    engine = F.when(kind == "view", "paddleocr").when(kind == "click", "easyocr").when(kind == "purchase", "tesseract").when(kind == "signup", "gemini_vision")
    c = read(s, d, "events").where(kind != "error").groupBy(F.col("user_id").alias("page_id"), engine.alias("engine")).agg((F.max("value") / 200).alias("confidence")).withColumn("text", F.lit("t"))
    return recognition.choose_engine(c, "page_id").select("page_id", "engine", F.round("confidence", 6).alias("confidence"), recognition.needs_vision(F.col("confidence")).alias("vision"))


@register("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ocr_paddleocr' WHEN 1 THEN 'ocr_easyocr' WHEN 2 THEN 'ocr_tesseract' WHEN 3 THEN 'gemini_vision' ELSE 'other' END AS method FROM events")
def engine_methods(s, d):
    names = ["ocr_paddleocr", "easyocr", "tesseract", "gemini_vision", "other"]
    return read(s, d, "events").select("event_id", T.engine_method(F.get(F.array(*map(F.lit, names)), (F.col("event_id") % 5).cast("int"))).alias("method"))


@register("SELECT event_id, CASE WHEN value > 60 THEN 'lattice' WHEN value > 50 THEN 'stream' END AS flavor FROM events WHERE value > 50")
def table_accuracy_gate(s, d):
    return read(s, d, "events").select("event_id", tables.flavor(F.col("value")).alias("flavor")).where("flavor IS NOT NULL")


@register(f"SELECT doc_id, count(*) AS n_rows, string_agg(replace(trim(t), ' ', ' | '), chr(10) ORDER BY page_no) AS body FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_PAGES_SQL})) WHERE n > 1 AND page_no > 1 AND trim(t) <> '' GROUP BY 1")
def table_clean(s, d):
    kept = tables.kept_rows(_doc_pages(s, d).withColumn("cells", F.split(F.trim("t"), " ", -1)), "doc_id", "page_no", "cells")
    line = tables.cell_line(F.col("cells")).alias("x")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", line))), lambda r: r["x"]), "\n")
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_rows"), body.alias("body"))


_GRAY = "list_transform(embedding, lambda x: least(255, greatest(0, 128 + CAST(x AS DOUBLE) * 600)))"


def _gray(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 + x.cast("double") * 600))).alias("g"))


@register(f"SELECT vec_id, round(len(list_filter(g, lambda x: x > 240)) / len(g), 6) AS bright, round(list_stddev_pop(g), 4) AS spread, CASE WHEN len(list_filter(g, lambda x: x > 240)) / len(g) > 0.15 THEN 'image_photo_glare' WHEN list_stddev_pop(g) < 60 THEN 'image_scan' ELSE 'image_photo' END AS class FROM (SELECT vec_id, {_GRAY} AS g FROM embeddings)")
def raster_metrics(s, d):
    b, sd = raster.bright_ratio(F.col("g")), raster.spread(F.col("g"))
    return _gray(s, d).select("vec_id", F.round(b, 6).alias("bright"), F.round(sd, 4).alias("spread"), recognition.image_class(b, F.lit(0.0), sd).alias("class"))


@register("SELECT vec_id, round(median(a), 6) AS angle FROM (SELECT vec_id, unnest(embedding)::DOUBLE * 200 AS a FROM embeddings) WHERE abs(a) < 45 GROUP BY 1 HAVING abs(median(a)) >= 0.3")
def median_angle(s, d):
    lines = read(s, d, "embeddings").select("vec_id", F.explode("embedding").alias("x")).withColumn("a", F.col("x").cast("double") * 200)
    return raster.skew(lines, "vec_id", "a").select("vec_id", F.round("angle", 6).alias("angle"))


@register("SELECT vec_id, round(avg(abs((y2 - y1) / (x2 - x1))), 6) AS slope FROM (SELECT vec_id, embedding[1 + 4 * i]::DOUBLE AS x1, embedding[2 + 4 * i]::DOUBLE AS y1, embedding[3 + 4 * i]::DOUBLE AS x2, embedding[4 + 4 * i]::DOUBLE AS y2 FROM embeddings, range(0, 16) t(i)) WHERE x1 <> x2 GROUP BY 1")
def mean_slope(s, d):
    at = lambda k: F.get("embedding", 4 * F.col("i") + k).cast("double")
    lines = read(s, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    lines = lines.select("vec_id", raster.slope(at(0), at(1), at(2), at(3)).alias("s"))
    return raster.mean_slope(lines, "vec_id", "s").select("vec_id", F.round("slope", 6).alias("slope"))


@register("SELECT vec_id, arg_min(i, x + y) AS tl, arg_min(i, y - x) AS tr, arg_max(i, x + y) AS br, arg_max(i, y - x) AS bl FROM (SELECT vec_id, i, embedding[1 + 2 * i]::DOUBLE AS x, embedding[2 + 2 * i]::DOUBLE AS y FROM embeddings, range(0, 32) t(i)) GROUP BY 1")
def corner_order(s, d):
    p = read(s, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("i")).select("vec_id", "i", F.get("embedding", (2 * F.col("i")).cast("int")).cast("double").alias("x"), F.get("embedding", (2 * F.col("i") + 1).cast("int")).cast("double").alias("y"))
    sm, df = F.col("x") + F.col("y"), F.col("y") - F.col("x")
    return p.groupBy("vec_id").agg(F.min_by("i", sm).alias("tl"), F.min_by("i", df).alias("tr"), F.max_by("i", sm).alias("br"), F.max_by("i", df).alias("bl"))


@register("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 5 AND p_retailprice > 200")
def top5_area(s, d):
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return read(s, d, "part").withColumn("n", n).where("n <= 5 AND p_retailprice > 200").select("p_brand", "p_partkey", "p_retailprice")


# ------------------------------------------------------------------ no SQL counterpart: rows only, held by tests


@register()
def raster_enhance(s, d):
    return raster.enhance(_gray(s, d), "vec_id", "g", 8)


@register("""
SELECT doc_id AS page_id, CASE WHEN strlen(text) > 500 THEN 'paddleocr' ELSE 'tesseract' END AS engine, text, CASE WHEN strlen(text) > 500 THEN 0.9 ELSE 0.55 END::DOUBLE AS confidence FROM documents""")
def ocr_pipeline(s, d):
    """The lazy cascade held by two test doubles, which recognise nothing: the first claims to be sure of long texts only."""
    pages = read(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.encode("text", "UTF-8").alias("content"))
    engines = {"paddleocr": lambda c: (c.decode(), 0.9 if len(c) > 500 else 0.2), "tesseract": lambda c: (c.decode(), 0.55)}
    return recognition.lazy_cascade(pages, engines)


@register("SELECT l_orderkey AS doc_id, 'ACME' AS nha_cung_cap, 'VND' AS don_vi_tien, count(*)::INT AS n_items, 0.875::DOUBLE AS overall_confidence FROM lineitem GROUP BY 1")
def extract_offline(s, d):
    """Order lines as table texts, read by the built-in extractor, parsed and rolled up."""
    lines = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" | ", F.col("l_linenumber").cast("string"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.floor("l_quantity").cast("string"), F.format_number(F.floor("l_extendedprice"), 0)))), "\n").alias("rows"))
    texts = lines.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("Nhà cung cấp: ACME\nSTT | Tên hàng | SL | Đơn giá\n"), "rows").alias("chunk"))
    docs = documents.parse_replies(providers.extract(texts))
    return documents.with_overall_confidence(docs, F.lit(0.85)).select("doc_id", "nha_cung_cap", "don_vi_tien", F.size("items").alias("n_items"), F.round("overall_confidence", 6).alias("overall_confidence"))


@register()
def intake_files(s, d):
    return files.intake(s, d, "*.parquet").select("name", "length", "mime", "admitted")


_STORE = "spark.sql.streaming.stateStore.providerClass"


def event_stream(s: SparkSession, d: str) -> DataFrame:
    schema = read(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def drained(s: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """What a stateful stream gives over all that is there; the session's own state store is set again afterwards."""
    path, before = scratch(s, label), s.conf.get(_STORE, None)
    s.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        feeds.drain(stream, path, f"{path}-state")
    finally:
        s.conf.unset(_STORE) if before is None else s.conf.set(_STORE, before)
    return s.read.schema(stream.schema).parquet(path)


@register(_SQL["status_changes"])
def stream_status_changes(s, d):
    return drained(s, feeds.change_feed(event_stream(s, d).select("event_id", "user_id", "event_type", "ts")), "feed")
