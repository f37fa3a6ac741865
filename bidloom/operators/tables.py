"""Tables: put together from word boxes by their positions, and rendered as aligned text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


#: Ways of finding tables in order of preference, and the accuracy that each must exceed.
ACCURACY = {"lattice": 60, "stream": 50}


def flavor(accuracy: Column) -> Column:
    """The way by which a table of this accuracy is taken; null if by none."""
    return F.coalesce(*[F.when(accuracy > least, name) for name, least in ACCURACY.items()])


def filled(cells: Column) -> Column:
    """Whether a row has a cell that isn't blank."""
    return F.exists(cells, lambda c: F.trim(c) != "")


def cell_line(cells: Column) -> Column:
    return F.array_join(cells, " | ")


def kept_rows(rows: DataFrame, table: str, row: str, cells: str) -> DataFrame:
    """Rows of tables that have a row besides their header (the first), without the header and without blank rows."""
    n = F.count("*").over(Window.partitionBy(table))
    return rows.withColumn("_n", n).where((F.col("_n") > 1) & (F.col(row) > 1) & filled(F.col(cells))).drop("_n")


def _islands(group: np.ndarray, start: np.ndarray, end: np.ndarray, gap: float) -> np.ndarray:
    """Number, from 1 on, the islands of intervals within a group: one ends where the next begins ``gap`` or more behind all before."""
    n = len(group)
    if not n:
        return np.zeros(0, np.int64)
    least = lambda x: np.where(np.isnan(x), -np.inf, x)
    order = np.lexsort((least(end), least(start), group))
    g, s, e = group[order], start[order], end[order]
    first = np.r_[True, g[1:] != g[:-1]]
    at = np.cumsum(first) - 1
    # ends by rank, above those of all groups before, so that one running maximum serves all groups; a missing end has none
    known = np.unique(e[~np.isnan(e)])
    rank = np.where(np.isnan(e), 0, np.searchsorted(known, e) + 1)
    reached = np.r_[0, np.maximum.accumulate(at * (len(known) + 1) + rank)[:-1]] - at * (len(known) + 1)
    none = first | (reached <= 0)
    with np.errstate(invalid="ignore"):
        new = none | (s - np.r_[known, np.nan][np.where(none, len(known), reached - 1)] >= gap)
    total = np.cumsum(new)
    out = np.empty(n, np.int64)
    out[order] = total - total[first][at] + 1
    return out


def _joined_up(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair, in the order of the pairs; ``b`` is not negative."""
    return a * (b.max(initial=0) + 1) + b


def _tables_of(words: pa.ListArray, row_gap: float, cell_gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Page (place in the batch), table_no, row_no, header and cells of all tables on pages of words."""
    flat = words.flatten()
    page = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    x0, x1, y0, y1 = (flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in range(4))
    line = _islands(page, y0, y1, row_gap)
    on = _joined_up(page, line)
    piece = _islands(on, x0, x1, cell_gap)
    many = np.unique(on[piece > 1])
    kept = np.flatnonzero(np.isin(on, many))
    page, line, on, x0, x1 = page[kept], line[kept], on[kept], x0[kept], x1[kept]
    # lines of one table are consecutive, so their number less their rank is the same
    lines, first, back = np.unique(on, return_index=True, return_inverse=True)
    of = page[first]
    rank = np.arange(len(lines)) - np.searchsorted(of, of)
    run = (line[first] - rank)[back]
    table = _joined_up(page, run)
    cell = _islands(table, x0, x1, cell_gap)

    order = np.lexsort((np.where(np.isnan(x0), -np.inf, x0), cell, line, table))
    ties = np.flatnonzero((np.diff(_joined_up(on, cell)[order]) == 0) & (np.diff(np.where(np.isnan(x0), -np.inf, x0)[order]) == 0))
    text = flat.field(4).take(pa.array(kept))
    if len(ties):
        # words at one place go by their text
        for span in np.split(ties, np.flatnonzero(np.diff(ties) > 1) + 1):
            at = slice(span[0], span[-1] + 2)
            order[at] = sorted(order[at], key=lambda i: (text[i].is_valid, text[i].as_py() or ""))
    table, page, line, cell, on = table[order], page[order], line[order], cell[order], on[order]
    text = text.take(pa.array(order))
    told = pc.is_valid(text).to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.r_[True, (np.diff(on) != 0) | (np.diff(cell) != 0)][: len(on)])
    offsets = np.r_[0, np.cumsum(told)][np.r_[start, len(on)]]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text.drop_null().cast(pa.string())), " ")

    # a row for each line, as wide as its table
    table, page, cell, on = table[start], page[start], cell[start], on[start]
    rows, first, back = np.unique(on, return_index=True, return_inverse=True)
    tables, head, mine = np.unique(table[first], return_index=True, return_inverse=True)
    width, height = np.zeros(len(tables), np.int64), np.bincount(mine, minlength=len(tables))
    np.maximum.at(width, mine[back], cell)
    wide = width[mine]
    begin = np.r_[0, np.cumsum(wide)]
    place = np.full(begin[-1], len(joined))
    place[begin[back] + cell - 1] = np.arange(len(joined))
    grid = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.concat_arrays([joined, pa.array([""], pa.string())]).take(pa.array(place)))
    good = (width > 1) & (height > 1)
    before = np.cumsum(good)
    of = page[first][head]
    number = before - np.r_[0, before][np.searchsorted(of, of)]
    nth = np.arange(len(rows)) - head[mine]
    body = np.flatnonzero(good[mine] & (nth > 0))
    return page[first][body], number[mine][body], nth[body], grid.take(pa.array(head[mine][body])), grid.take(pa.array(body))


def from_boxes(words: DataFrame, keys: list[str], row_gap: float = 0.0, cell_gap: float = 8.0) -> DataFrame:
    """(keys, table_no, row_no, header, cells) from words with x0, x1, y0, y1 and text; ``keys`` name a page. One shuffle of the words."""
    page = words.groupBy(*keys).agg(F.collect_list(F.struct("x0", "x1", "y0", "y1", "text")).alias("_words"))
    return from_pages(page, keys, "_words", row_gap, cell_gap)


def from_pages(pages: DataFrame, keys: list[str], words: str = "words", row_gap: float = 0.0, cell_gap: float = 8.0) -> DataFrame:
    """(keys, table_no, row_no, header, cells) from pages with an array of words (x0, x1, y0, y1, text); pages lie in a row each, so
    nothing is shuffled or sorted outside of it, and keys may be null or repeat.

    Words whose heights overlap make a line (islands along y). A line with a gap of ``cell_gap`` or more between words is a table's
    row; lines in one run of such rows make a table. Its columns are the islands along x of all its words together, so a column
    boundary is a gap that all of its rows share. A row without a word in a column has an empty cell there. Tables of one row, or of
    one column, are none. The first row is the header.
    """
    box = F.transform(words, lambda w: F.struct(*[w[c].cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")], w["text"].cast("string").alias("text")))

    def run(batches):
        for batch in batches:
            page, table_no, row_no, header, cells = _tables_of(batch.column(len(keys)), row_gap, cell_gap)
            of = [batch.column(k).take(pa.array(page)) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*of, pa.array(table_no, pa.int32()), pa.array(row_no, pa.int32()), header, cells], names=[*keys, "table_no", "row_no", "header", "cells"])

    texts = ArrayType(StringType())
    schema = StructType([*[pages.schema[k] for k in keys], StructField("table_no", IntegerType()), StructField("row_no", IntegerType()), StructField("header", texts), StructField("cells", texts)])
    return pages.select(*keys, box.alias("_words")).mapInArrow(run, schema)


def aligned(rows: Column) -> Column:
    """Lines of an array of rows of cells: each column as wide as its longest cell, cells flush right, one blank between them."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda r, j: F.coalesce(F.get(r, j), F.lit(""))
    widths = F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.array_max(F.transform(rows, lambda r: F.char_length(cell(r, j)))))
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(widths, lambda w, j: F.lpad(cell(r, j), w, F.lit(" "))), " ")), "\n")


#: Fixed value: the heading of a rendered table.
HEADING = ("=== Bảng ", " ===")


def table_text(tables: DataFrame, key: str) -> DataFrame:
    """(key, text): all tables of a document (key, table_no, row_no, header, cells), each under its numbered heading, aligned."""
    each = tables.groupBy(key, "table_no").agg(F.first("header").alias("header"), F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("r"))
    each = each.withColumn("rows", F.concat(F.array("header"), F.transform("r", lambda x: x["cells"])))
    heading = F.concat(F.lit(HEADING[0]), F.col("table_no").cast("string"), F.lit(HEADING[1]))
    part = F.concat_ws("\n", heading, aligned(F.col("rows")), F.lit(""))
    parts = each.select(key, "table_no", part.alias("part")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("table_no", "part"))).alias("p"))
    return parts.select(key, F.array_join(F.transform("p", lambda x: x["part"]), "\n").alias("text"))


def before_text(tables: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The texts with their document's table text before them, an empty line between; a document without tables stays as it is."""
    rendered = table_text(tables, key).withColumnRenamed("text", "_tables")
    joined = texts.join(rendered, key, "left")
    return joined.withColumn(text, F.when(F.col("_tables").isNull(), F.col(text)).otherwise(F.concat_ws("\n\n", "_tables", text))).drop("_tables")
