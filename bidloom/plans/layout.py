"""Queries of page layout: tables from word boxes, rendered tables, outlines, blur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import polygons, raster, tables
from ..operators.documents import ITEMS
from ..sources import exports, files, samples
from .catalogue import _GRAY, _LINE_ORDER_SQL, LINE_ORDER, _gray, _order_docs, read, register

_CELLS = "[CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'part ' || l_partkey END, CAST(l_quantity AS BIGINT)::VARCHAR, l_returnflag || ' ' || l_linestatus]"


def _boxed(x: Column, y: Column, text: Column) -> Column:
    """Words of a cell as boxes: five wide a letter, three between words, ten high."""
    words = F.split(text, " ")
    before = lambda i: F.aggregate(F.slice(words, F.lit(1), i), F.lit(0), lambda n, w: n + F.char_length(w) * 5 + 3)
    box = lambda w, i: F.struct((x + before(i)).alias("x0"), (x + before(i) + F.char_length(w) * 5).alias("x1"), y.alias("y0"), (y + 10).alias("y1"), w.alias("text"))
    return F.filter(F.transform(words, box), lambda b: b["text"] != "")


@register(f"""
WITH l AS (SELECT l_orderkey AS k, {_CELLS} AS cells, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem)
SELECT k AS doc_id, 1::INT AS table_no, n::INT AS row_no, 'Item no/Qty/Flag' AS header, array_to_string(cells, '/') AS cells FROM l""")
def tables_from_boxes(s: SparkSession, d: str) -> DataFrame:
    """Order lines drawn as words on a page, a title and a closing line around them; the cells come back, empty ones too."""
    part = lambda x: F.when(x["l_linenumber"] % 3 == 0, "").otherwise(F.concat(F.lit("part "), x["l_partkey"].cast("string")))
    cells = lambda x: F.array(part(x), x["l_quantity"].cast("long").cast("string"), F.concat_ws(" ", x["l_returnflag"], x["l_linestatus"]))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    rows = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    grid = F.concat(F.array(F.array(F.lit("Item no"), F.lit("Qty"), F.lit("Flag"))), F.transform("lines", cells))
    n = F.size("lines")
    boxes = F.flatten(F.flatten(F.transform(grid, lambda r, i: F.transform(r, lambda c, j: _boxed(j * 100 + 10, i * 12 + 40, c)))))
    title = _boxed(F.lit(10), F.lit(10), F.lit("Quotation of all items"))
    closing = _boxed(F.lit(10), n * 12 + 70, F.lit("Thank you"))
    found = tables.from_pages(rows.select("doc_id", F.concat(title, boxes, closing).alias("words")), ["doc_id"])
    return found.select("doc_id", "table_no", "row_no", F.array_join("header", "/").alias("header"), F.array_join("cells", "/").alias("cells"))


@register("""
WITH w AS (SELECT doc_id, n_chars::VARCHAR AS n, doc_id::VARCHAR AS k, doc_id % 2 = 0 AS two, doc_id % 3 = 0 AS none FROM documents)
SELECT doc_id, CASE WHEN none THEN 'no table here' ELSE '=== Bảng 1 ===' || chr(10) || lpad('Item', 5, ' ') || ' ' || lpad('Price', greatest(5, length(n))::INT, ' ') || chr(10) || lpad('a', 5, ' ') || ' ' || lpad(n, greatest(5, length(n))::INT, ' ') || chr(10)
  || 'Total' || ' ' || lpad('', greatest(5, length(n))::INT, ' ') || chr(10) || CASE WHEN two THEN chr(10) || '=== Bảng 2 ===' || chr(10) || lpad('SL', greatest(2, length(k))::INT, ' ') || ' DVT' || chr(10) || lpad(k, greatest(2, length(k))::INT, ' ') || '  kg' || chr(10) ELSE '' END
  || chr(10) || chr(10) || 'Quote' END AS text FROM w""")
def tables_before_text(s: SparkSession, d: str) -> DataFrame:
    """The tables of a text, aligned under numbered headings, before what the page says; every third document has none."""
    n, k = F.col("n_chars").cast("string"), F.col("doc_id").cast("string")
    first = F.concat(F.lit("Quote\nItem | Price\na | "), n, F.lit("\nTotal | \nend\n"))
    second = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("SL\tDVT\n"), k, F.lit("\tkg\n"))).otherwise("")
    docs = read(s, d, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, "no table here").otherwise(F.concat(first, second))
    found = files.text_tables(docs.select("doc_id", text.alias("text")), "doc_id")
    pages = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "no table here").otherwise("Quote").alias("text"))
    return tables.before_text(found, pages, "doc_id").select("doc_id", "text")


@register(f"""
WITH g AS (SELECT vec_id, {_GRAY} AS g FROM embeddings), i AS (SELECT vec_id, g, unnest(range(0, 64)) AS i FROM g), p AS (SELECT vec_id, g, i // 8 AS r, i % 8 AS c, g[i + 1] AS x FROM i),
l AS (SELECT vec_id, x > 240 AS glare, g[(CASE r WHEN 0 THEN 1 ELSE r - 1 END) * 8 + c + 1] + g[(CASE r WHEN 7 THEN 6 ELSE r + 1 END) * 8 + c + 1] + g[r * 8 + (CASE c WHEN 0 THEN 1 ELSE c - 1 END) + 1] + g[r * 8 + (CASE c WHEN 7 THEN 6 ELSE c + 1 END) + 1] - 4 * x AS v FROM p)
SELECT vec_id, round(var_pop(v), 2) AS variance, var_pop(v) < 100 AS blurred, bool_or(glare) AS glare FROM l GROUP BY 1""")
def blur_and_glare(s: SparkSession, d: str) -> DataFrame:
    v = raster.blur_variance(F.col("g"), 8)
    return _gray(s, d).select("vec_id", F.round(v, 2).alias("variance"), (v < 100).alias("blurred"), raster.any_glare(F.col("g")).alias("glare"))


@register("""
WITH RECURSIVE raw AS (SELECT vec_id, embedding AS e, unnest(range(0, 32)) AS i FROM embeddings),
p AS (SELECT vec_id, i, CASE i // 8 WHEN 0 THEN (i % 8) * 10.0 WHEN 1 THEN 80.0 WHEN 2 THEN 80.0 - (i % 8) * 10 ELSE 0.0 END + e[2 * i + 1]::DOUBLE * 20 AS x,
  CASE i // 8 WHEN 0 THEN 0.0 WHEN 1 THEN (i % 8) * 8.0 WHEN 2 THEN 64.0 ELSE 64.0 - (i % 8) * 8 END + e[2 * i + 2]::DOUBLE * 20 AS y FROM raw),
per AS (SELECT a.vec_id, sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) * 0.02 AS tol FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % 32 GROUP BY 1),
f1 AS (SELECT p.vec_id, arg_max(p.i, {'d': sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)), 'i': -p.i}) AS i FROM p JOIN p o ON p.vec_id = o.vec_id AND o.i = 0 GROUP BY 1),
f2 AS (SELECT p.vec_id, arg_max(p.i, {'d': sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)), 'i': -p.i}) AS i FROM p JOIN f1 USING (vec_id) JOIN p o ON p.vec_id = o.vec_id AND o.i = f1.i GROUP BY 1),
kept(vec_id, n, a, b) AS (
  SELECT f1.vec_id, 0, unnest([least(f1.i, f2.i), greatest(f1.i, f2.i)]), unnest([greatest(f1.i, f2.i), least(f1.i, f2.i) + 32]) FROM f1 JOIN f2 USING (vec_id)
  UNION ALL
  SELECT vec_id, n + 1, unnest([a, j]), unnest([j, b]) FROM (
    SELECT k.vec_id, k.n, k.a, k.b, arg_max(p.i + CASE WHEN p.i < k.a THEN 32 ELSE 0 END, {'d': abs((q.x - o.x) * (o.y - p.y) - (o.x - p.x) * (q.y - o.y)) / sqrt(pow(q.x - o.x, 2) + pow(q.y - o.y, 2)), 'i': -(p.i + CASE WHEN p.i < k.a THEN 32 ELSE 0 END)}) AS j,
      max(abs((q.x - o.x) * (o.y - p.y) - (o.x - p.x) * (q.y - o.y)) / sqrt(pow(q.x - o.x, 2) + pow(q.y - o.y, 2))) AS d
    FROM kept k JOIN p o ON o.vec_id = k.vec_id AND o.i = k.a % 32 JOIN p q ON q.vec_id = k.vec_id AND q.i = k.b % 32
      JOIN p ON p.vec_id = k.vec_id AND ((p.i > k.a AND p.i < k.b) OR (p.i + 32 > k.a AND p.i + 32 < k.b)) GROUP BY k.vec_id, k.n, k.a, k.b) JOIN per USING (vec_id) WHERE d > tol AND n < 8),
v AS (SELECT DISTINCT vec_id, a % 32 AS i FROM kept), o AS (SELECT v.vec_id, p.x, p.y, row_number() OVER (PARTITION BY v.vec_id ORDER BY v.i) AS r, count(*) OVER (PARTITION BY v.vec_id) AS n FROM v JOIN p ON p.vec_id = v.vec_id AND p.i = v.i)
SELECT a.vec_id, count(*)::INT AS vertices, round(abs(sum(a.x * b.y - b.x * a.y)) / 2 / 5120, 6) AS area_share, count(*) = 4 AND abs(sum(a.x * b.y - b.x * a.y)) / 2 > 5120 * 0.2 AS is_page
FROM o a JOIN o b ON a.vec_id = b.vec_id AND b.r = a.r % a.n + 1 GROUP BY 1""")
def page_outline(s: SparkSession, d: str) -> DataFrame:
    """Outlines of 32 points along a rectangle of 80 by 64, moved a little: vertices at the tolerance, share of area, and whether a page."""
    along = lambda i, k: F.when(F.floor(i / 8) == k, True)
    step = lambda i: (i % 8).cast("double")
    x = lambda i: F.when(along(i, 0), step(i) * 10).when(along(i, 1), 80.0).when(along(i, 2), 80 - step(i) * 10).otherwise(0.0)
    y = lambda i: F.when(along(i, 0), 0.0).when(along(i, 1), step(i) * 8).when(along(i, 2), 64.0).otherwise(64 - step(i) * 8)
    moved = lambda i, k: F.get("embedding", 2 * i + k).cast("double") * 20
    outline = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((x(i) + moved(i, 0)).alias("x"), (y(i) + moved(i, 1)).alias("y")))
    points = read(s, d, "embeddings").select("vec_id", outline.alias("p"))
    tolerance = polygons.perimeter(F.col("p")) * polygons.TOLERANCE
    kept = points.withColumn("tolerance", tolerance).withColumn("kept", polygons.simplified(F.col("p"), F.col("tolerance")))
    whole = kept.withColumn("v", F.transform("kept", lambda i: F.get("p", i)))
    share = polygons.area(F.col("v")) / 5120
    is_page = (F.size("kept") == 4) & (share > polygons.LEAST_AREA)
    return whole.select("vec_id", F.size("kept").alias("vertices"), F.round(share, 6).alias("area_share"), is_page.alias("is_page"))


@register("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)
SELECT doc_id, (i // 5 + 1)::INT AS page_no, string_agg(line || 'ế', chr(10) ORDER BY i) AS text FROM l GROUP BY doc_id, i // 5""")
def pdf_pages(s: SparkSession, d: str) -> DataFrame:
    """Whole texts, a Vietnamese letter behind each line, written as PDFs of five lines a page and read again."""
    docs = read(s, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.concat(x, F.lit("ế"))), "\n").alias("text"))
    found = files.pdf_pages(samples.as_pdfs(docs, "doc_id", "text", 5), "doc_id")
    return found.select(F.col("path").alias("doc_id"), "page_no", "text")


_SHEET = "['STT', 'Mã SP', 'Tên sản phẩm / Dịch vụ', 'ĐVT', 'Số lượng', 'Đơn giá', 'Chiết khấu %', 'Thành tiền', 'Ghi chú', 'Độ tin cậy AI']"


@register(f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER_SQL}) AS n FROM lineitem),
i AS (SELECT l_orderkey AS doc_id, 'Bảng Giá' AS sheet, (n + 1)::INT AS row, [CASE WHEN l_linenumber % 4 = 0 THEN n ELSE l_linenumber END::VARCHAR, '', 'part <' || l_partkey || '> & "' || l_returnflag || '"', CASE WHEN l_linenumber % 2 = 0 THEN 'kg' ELSE '' END,
  CAST(l_quantity AS BIGINT)::VARCHAR, CAST(floor(l_extendedprice) AS BIGINT)::VARCHAR, '', CAST(CAST(l_quantity AS BIGINT) * CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR), ' x ', CAST(l_linenumber * 10 AS VARCHAR) || '%'] AS cells FROM l),
h AS (SELECT DISTINCT doc_id, sheet, 1::INT AS row, {_SHEET} AS cells FROM i),
s AS (SELECT o_orderkey AS doc_id, 'Tóm Tắt' AS sheet, unnest(range(1, 4))::INT AS row, unnest([['Thông tin', 'Giá trị'], ['Nhà cung cấp', o_orderpriority], ['Số báo giá', '']]) AS cells FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT doc_id, sheet, row, unnest(range(1, len(cells) + 1))::INT AS col, unnest(cells) AS value FROM (FROM i UNION ALL FROM h UNION ALL FROM s)""")
def workbook_cells(s: SparkSession, d: str) -> DataFrame:
    """Orders with their lines as workbooks, read again: all cells of the item sheets, the first rows of the summaries."""
    k, whole = F.col("l_linenumber"), lambda c: F.floor(c).cast("double")
    name = F.concat(F.lit("part <"), F.col("l_partkey").cast("string"), F.lit('> & "'), F.col("l_returnflag"), F.lit('"'))
    text, number = lambda c: c.cast("string"), lambda c: c.cast("double")
    none = F.lit(None)
    item = F.struct(
        F.when(k % 4 != 0, k).cast("int").alias("stt"), text(none).alias("ma_sp"), name.alias("ten_sp"), F.when(k % 2 == 0, "kg").alias("dvt"), whole("l_quantity").alias("so_luong"), whole("l_extendedprice").alias("don_gia"),
        (whole("l_quantity") * whole("l_extendedprice")).alias("thanh_tien"), number(none).alias("chiet_khau_pct"), F.lit(" x ").alias("ghi_chu"), (k / 10).alias("confidence"),
    )
    lines = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, item.alias("item")))).alias("lines"))
    docs = _order_docs(s, d).drop("items").join(lines.select("doc_id", F.transform("lines", lambda x: x["item"]).cast(ITEMS).alias("items")), "doc_id")
    cells = exports.workbook_cells(exports.workbooks(docs))
    numbers = F.when((F.col("sheet") == "Bảng Giá") & F.col("col").isin(5, 6, 8) & (F.col("row") > 1), F.col("value").cast("double").cast("long").cast("string")).otherwise(F.col("value"))
    return cells.where("sheet = 'Bảng Giá' OR row <= 3").withColumn("value", numbers)
