"""Exports: JSON results, CSV with a byte-order mark, and spreadsheets."""

from __future__ import annotations

import functools
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Sequence
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from ..functions.money import format_money
from . import storage

#: Columns of the CSV.
CSV_COLUMNS = ("stt", "ma_sp", "ten_sp", "dvt", "so_luong", "don_gia", "chiet_khau_pct", "thanh_tien", "ghi_chu", "confidence")
#: Headings of the item sheet.
SHEET_COLUMNS = ("STT", "Mã SP", "Tên sản phẩm / Dịch vụ", "ĐVT", "Số lượng", "Đơn giá", "Chiết khấu %", "Thành tiền", "Ghi chú", "Độ tin cậy AI")
#: Labels of the summary sheet.
SUMMARY_LABELS = ("Nhà cung cấp", "Số báo giá", "Ngày báo giá", "Khách hàng", "Đơn vị tiền", "Số sản phẩm", "Tổng chưa VAT", "Thuế VAT", "Tổng sau VAT", "Điều kiện thanh toán", "Thời gian giao hàng", "Bảo hành")


def number_text(c: Column) -> Column:
    """A double as plain text with at least one decimal, never in powers of ten."""
    text = F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def csv_rows(items: DataFrame) -> DataFrame:
    """Item rows in export form: numbers as text, empty strings for nulls, positions for missing numbers."""
    doubles = {"so_luong", "don_gia", "chiet_khau_pct", "thanh_tien", "confidence"}
    stt = F.coalesce(F.when(F.col("stt") != 0, F.col("stt")), F.col("pos")).cast("string").alias("stt")
    rest = [(F.coalesce(number_text(F.col(c)), F.lit("")) if c in doubles else F.coalesce(F.col(c), F.lit(""))).alias(c) for c in CSV_COLUMNS[1:]]
    return items.select(*[c for c in items.columns if c == "doc_id"], stt, *rest)


def write_csv(rows: DataFrame, path: str, files: int = 1) -> None:
    """CSV files, one by default, with a byte-order mark before the first heading."""
    first, *rest = rows.columns
    marked = rows.select(F.col(first).alias("\ufeff" + first), *rest)
    marked.coalesce(files).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def export_outcome(fmt: Column, has_result: Column, n_items: Column) -> Column:
    """200, or 404 where there is nothing to export (sheets and CSV need items, JSON a result), or 400 for an unknown format."""
    there = F.when(fmt == "json", has_result).otherwise(has_result & (n_items > 0))
    return F.when(~fmt.isin("excel", "csv", "json"), 400).when(there, 200).otherwise(404)


def export(docs: DataFrame, doc_id: object, fmt: str, path: str, id_col: str = "doc_id") -> None:
    """Writes one document to the folder ``path``: as ``excel`` one file ``<id>.xlsx``, as ``csv`` or ``json`` what Spark's writer makes.

    LookupError where it has no data, ValueError for another format.
    """
    if fmt not in ("excel", "csv", "json"):
        raise ValueError("format is not one of excel, csv, json")
    one = docs.where(F.col(id_col) == F.lit(doc_id))
    found = one.select(F.size("items").alias("n")).first()
    if found is None or (fmt != "json" and found["n"] < 1):
        raise LookupError("no data to export")
    if fmt == "json":
        write_json(one.drop("failures"), path)
    elif fmt == "csv":
        items = one.select(F.posexplode("items").alias("p", "i")).select((F.col("p") + 1).alias("pos"), "i.*")
        write_csv(csv_rows(items.orderBy("pos")), path)
    else:
        storage.write_bytes(docs.sparkSession, f"{path}/{doc_id}.xlsx", bytes(workbooks(one, id_col).first()["content"]))


def summary_lines() -> Column:
    """The twelve lines (pos, label, value) of a document's summary sheet, from its row; missing values are empty texts."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    money = lambda c: format_money(F.col(c), F.col("don_vi_tien"))
    rate = F.coalesce(number_text(F.nullif(F.col("thue_vat_pct"), F.lit(0.0))), F.lit("10"))
    values = [
        text("nha_cung_cap"), text("so_bao_gia"), text("ngay_bao_gia"), text("khach_hang"), text("don_vi_tien"), F.size("items").cast("string"), money("tong_chua_vat"), money("thue_vat_tien"),
        money("tong_sau_vat"), text("dieu_kien_thanh_toan"), text("thoi_gian_giao_hang"), text("bao_hanh"),
    ]
    labels = [F.concat(F.lit(f"{x} ("), rate, F.lit("%)")) if x == "Thuế VAT" else F.lit(x) for x in SUMMARY_LABELS]
    return F.array(*[F.struct(F.lit(i).alias("pos"), k.alias("label"), v.alias("value")) for i, (k, v) in enumerate(zip(labels, values, strict=True), 1)])


def summary_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, label, value), twelve rows a document."""
    return docs.select(id_col, F.inline(summary_lines()))


#: Items whose sheets a worker makes at once.
ITEMS_AT_ONCE = 20_000


def workbooks(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content): for every document with items a workbook of an item sheet and a summary sheet, built where its row lies; ids may
    be null or repeat."""
    import numpy as np
    import pyarrow as pa

    rows = docs.where(F.size("items") > 0).select(id_col, "items", summary_lines().alias("summary"))

    def fields(column: pa.ListArray):
        """The fields of a list of structs by name, and where each row begins in them, with the end behind."""
        flat = column.flatten()
        return {f.name: flat.field(k) for k, f in enumerate(flat.type)}, np.append(0, column.value_lengths().to_numpy().cumsum())

    def build(batches):
        for batch in batches:
            ends, out, a = batch.column(1).value_lengths().to_numpy().cumsum(), [], 0
            while a < batch.num_rows:
                # so many documents at once as have so many items, but one at least
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ITEMS_AT_ONCE, "right")))
                some = batch.slice(a, b - a)
                sheets = zip(_item_sheets(*fields(some.column(1))), _summary_sheets(*fields(some.column(2))), strict=True)
                out += [_workbook(("Bảng Giá", "Tóm Tắt"), pair) for pair in sheets]
                a = b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "content"])

    return rows.mapInArrow(build, StructType([docs.schema[id_col], StructField("content", BinaryType())]))


#: The namespace of sheets, and the tags of sheets as ``_sheet`` and ``_row`` make them: those are read without a parser of all XML.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_HEAD = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><cols>'
_MID, _TAIL = "</cols><sheetData>", "</sheetData></worksheet>"
_TEXT_CELL, _TEXT_END, _NUMBER_CELL, _NUMBER_END = '" t="inlineStr"><is><t xml:space="preserve">', "</t></is></c>", '"><v>', "</v></c>"
_COLS = re.compile(rb'(?:<col min="\d+" max="\d+" width="\d+" customWidth="1"/>)*')
_NUMBER = re.compile(rf"{_NUMBER_CELL}[^<>&]*{_NUMBER_END}".encode())
#: Texts that need no parser, with zero bytes between them.
_PLAIN = re.compile(r"[^<>&\x01-\x08\x0b-\x1f\ufffd-\uffff]*(?:&(?:lt|gt|amp|quot|apos);[^<>&\x01-\x08\x0b-\x1f\ufffd-\uffff]*)*")
_B = {k: x.encode() for k, x in {"head": _HEAD, "mid": _MID, "tail": _TAIL, "text": _TEXT_CELL, "end": _TEXT_END, "number": _NUMBER_CELL, "number_end": _NUMBER_END, "row_end": f"{_TEXT_END}</row>"}.items()}


_ROW = re.compile(rf'<row r="\d+"><c s="[012]{_TEXT_CELL}'.encode())
_BETWEEN = [f'{_TEXT_END}<c s="{s}{_TEXT_CELL}'.encode() for s in "012"]


def _plain_cells(sheet: bytes) -> tuple[list[str], list[int]] | None:
    """The texts of a sheet in the form of ``_sheet``, and how many each row has; None for any other, and where a row has none."""
    middle = sheet.find(_B["mid"])
    if middle < 0 or b"\0" in sheet or not sheet.startswith(_B["head"]) or not sheet.endswith(_B["tail"]) or not _COLS.fullmatch(sheet, len(_B["head"]), middle):
        return None
    body = sheet[middle + len(_B["mid"]) : len(sheet) - len(_B["tail"])]
    numbers = body.count(_B["number"])
    if numbers:
        if body.count(_B["number_end"]) != numbers or len(_NUMBER.findall(body)) != numbers:
            return None
        body = body.replace(_B["number"], _B["text"]).replace(_B["number_end"], _B["end"])
    for tags in _BETWEEN:
        body = body.replace(tags, b"\0")
    first, *rows = _ROW.split(body)
    if first or not rows or not all([row.endswith(_B["row_end"]) for row in rows]):
        return None
    lengths = [row.count(b"\0") + 1 for row in rows]
    text = b"".join(rows)[: -len(_B["row_end"])].replace(_B["row_end"], b"\0").decode("utf-8", "replace")
    # no text holds a tag, so nothing stood between the texts but what was taken away
    if not _PLAIN.fullmatch(text):
        return None
    texts = (unescape(text, {"&quot;": '"', "&apos;": "'"}) if "&" in text else text).split("\0")
    return (texts, lengths) if len(texts) == sum(lengths) else None


@functools.lru_cache(maxsize=64)
def _inflated(packed: bytes) -> bytes:
    return zlib.decompress(packed, -15)


@functools.lru_cache(maxsize=64)
def _sheet_names(workbook: bytes) -> list[str]:
    return [sheet.get("name") for sheet in ElementTree.fromstring(workbook).iter(f"{{{_MAIN}}}sheet")]


def _sheet_cells(sheet: bytes) -> tuple[list[str], list[int]]:
    """The texts of a sheet's cells, row by row, and how many each row has."""
    plain = _plain_cells(sheet)
    if plain is not None:
        return plain
    rows = [["".join(cell.itertext()) for cell in row] for row in ElementTree.fromstring(sheet).iter(f"{{{_MAIN}}}row")]
    return [x for row in rows for x in row], list(map(len, rows))


#: Cells that a worker holds before it hands them on.
CELLS_AT_ONCE = 100_000


def workbook_cells(books: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, sheet, row, col, value): the cells of workbooks (id, content) as texts, from 1; empty cells are empty texts.

    Each file is read where its row lies; ids may be null or repeat.
    """
    import numpy as np
    import pyarrow as pa

    def sheets(content: bytes):
        parts = _unzipped(content)
        for k, name in enumerate(_sheet_names(parts("xl/workbook.xml", _inflated)), 1):
            yield name, *_sheet_cells(parts(f"xl/worksheets/sheet{k}.xml"))

    def cells(batches):
        for batch in batches:
            # a row of cells: its place in the batch, its sheet, its number and its length
            at, names, numbers, lengths, values = found = [], [], [], [], []

            def told():
                n = np.array(lengths, np.int64)  # noqa: B023
                each = np.repeat(np.arange(len(n)), n)
                cols = np.arange(len(each)) - np.repeat(n.cumsum() - n, n) + 1
                owner, row, sheet = np.array(at, np.int64)[each], np.array(numbers, np.int32)[each], pa.array(names, pa.string()).take(pa.array(each))  # noqa: B023
                arrays = [batch.column(0).take(pa.array(owner)), sheet, pa.array(row), pa.array(cols.astype(np.int32)), pa.array(values, pa.string())]  # noqa: B023
                for x in found:  # noqa: B023
                    x.clear()
                return pa.RecordBatch.from_arrays(arrays, names=[id_col, "sheet", "row", "col", "value"])

            for i, content in enumerate(batch.column(1).to_pylist()):
                for name, texts, counts in sheets(content):
                    n = len(counts)
                    values += texts
                    lengths += counts
                    numbers += range(1, n + 1)
                    names += [name] * n
                    at += [i] * n
                if len(values) >= CELLS_AT_ONCE:
                    yield told()
            yield told()

    schema = StructType([books.schema[id_col], StructField("sheet", StringType()), StructField("row", IntegerType()), StructField("col", IntegerType()), StructField("value", StringType())])
    return books.select(id_col, "content").mapInArrow(cells, schema)


def write_json(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").option("ignoreNullFields", False).json(path)


#: Fixed value: the widest column.
WIDEST = 50


def column_width(longest: int) -> int:
    return min(longest + 4, WIDEST)


def _escaped(text: str) -> str:
    return escape(text) if "&" in text or "<" in text or ">" in text else text


def _cell(v: object) -> str:
    """A cell behind its style: numbers as numbers, all else as text."""
    if type(v) is str:
        return f"{_TEXT_CELL}{_escaped(v)}{_TEXT_END}"
    return f"{_NUMBER_CELL}{v}{_NUMBER_END}" if isinstance(v, (int, float)) else f"{_TEXT_CELL}{escape(str(v or ''))}{_TEXT_END}"


def _start(r: int) -> str:
    """A cell of row r up to its style: the first row is filled, even ones are striped."""
    return f'<c s="{1 if r == 1 else 2 if r % 2 == 0 else 0}'


def _row(r: int, cells: Sequence[str]) -> str:
    start = _start(r)
    return f'<row r="{r}">{start}{start.join(cells)}</row>' if cells else f'<row r="{r}"></row>'


@functools.lru_cache(maxsize=4096)
def _col(i: int, width: int) -> str:
    return f'<col min="{i}" max="{i}" width="{width}" customWidth="1"/>'


def _sheet(rows: Iterable[str], widths: Iterable[int]) -> bytes:
    return "".join([_HEAD, *map(_col, range(1, 1 << 20), widths), _MID, *rows, _TAIL]).encode()


def _joined(*parts):
    """Arrow columns of texts, and texts, put together row by row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (*parts, "")])


def _text_cells(column):
    """The cells of an Arrow column of texts, and how long the texts are."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    safe = column
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = pc.replace_substring(safe, mark, name)
    return _joined(_TEXT_CELL, safe, _TEXT_END), pc.utf8_length(column).to_numpy(zero_copy_only=False)


def _number_cells(values: list):
    """The same for numbers; nulls are empty texts."""
    import pyarrow as pa

    texts = ["" if v is None else str(v) for v in values]
    return pa.array([f"{_NUMBER_CELL}{x}{_NUMBER_END}" if x else _cell("") for x in texts], pa.large_string()), list(map(len, texts))


def _sheets(columns: list, starts, heads: Sequence[str]) -> list[bytes]:
    """Sheets with the headings, of rows that lie one behind the other, at least one a sheet: ``columns`` has the cells of each column
    and the lengths of their texts, ``starts`` tells where each sheet begins, and where the last one ends. What ``_row`` and ``_sheet``
    make of one sheet, for many at once."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    text = pa.large_string()
    place = np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))
    tags = [(f'<row r="{r}">{_start(r)}', _start(r)) for r in range(2, 2 + int(np.diff(starts).max(initial=0)))]
    first, later = (pa.array(x, text).take(pa.array(place)) for x in zip(*tags, strict=True))
    cells = [x for k, (column, _) in enumerate(columns) for x in (later if k else first, column)]
    rows = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), _joined(*cells, "</row>")), pa.scalar("", text))
    cols = []
    for i, ((_, lengths), head) in enumerate(zip(columns, heads, strict=True), 1):
        longest = np.maximum(np.maximum.reduceat(np.asarray(lengths), starts[:-1]), len(head))
        cols.append(pa.array([_col(i, w) for w in range(WIDEST + 1)], text).take(pa.array(np.minimum(longest + 4, WIDEST))))
    heading = _row(1, [_cell(x) for x in heads])
    return _joined(_HEAD, *cols, f"{_MID}{heading}", rows, _TAIL).cast(pa.large_binary()).to_pylist()


def _item_sheets(items: dict, starts) -> list[bytes]:
    """The item sheets of documents whose items lie in the fields; none is without items."""
    import numpy as np
    import pyarrow as pa

    places = (np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts)) + 1).tolist()
    stt = _number_cells([x or k for x, k in zip(items["stt"].to_pylist(), places, strict=True)])
    confidence = _text_cells(pa.array([f"{x:.0%}" for x in items["confidence"].to_pylist()], pa.string()))
    text, number = lambda f: _text_cells(items[f]), lambda f: _number_cells(items[f].to_pylist())
    columns = [stt, text("ma_sp"), text("ten_sp"), text("dvt"), number("so_luong"), number("don_gia"), number("chiet_khau_pct"), number("thanh_tien"), text("ghi_chu"), confidence]
    return _sheets(columns, starts, SHEET_COLUMNS)


def _summary_sheets(lines: dict, starts) -> list[bytes]:
    return _sheets([_text_cells(lines["label"]), _text_cells(lines["value"])], starts, ("Thông tin", "Giá trị"))


@functools.lru_cache(maxsize=64)
def _frame(names: tuple[str, ...]) -> bytes:
    """A workbook of sheets of these names, but without the sheets: what all such workbooks share."""
    ns, numbers = "http://schemas.openxmlformats.org", range(1, len(names) + 1)
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in numbers)
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i}" Type="{ns}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{ns}/package/2006/relationships">{rels}<Relationship Id="s" Type="{ns}/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{ns}/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF4472C4"/></patternFill></fill><fill><patternFill patternType="solid"><fgColor rgb="FFF2F2F2"/></patternFill></fill></fills><borders count="1"><border/></borders><cellXfs count="3"><xf/><xf fillId="2" applyFill="1"/><xf fillId="3" applyFill="1"/></cellXfs></styleSheet>')
    return file.getvalue()


#: Records of a ZIP file, little-endian: a part's head, its entry in the directory, the directory's end.
_PART, _ENTRY, _END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")


def _with_parts(frame: bytes, parts: dict[str, bytes]) -> bytes:
    """The ZIP file with deflated parts put behind those it has, whose bytes and entries are taken over as they are."""
    _, _, _, _, n, length, start, _ = _END.unpack_from(frame, len(frame) - _END.size)
    out, entries, at = [frame[:start]], [frame[start : start + length]], start
    for name, data in parts.items():
        title, packer = name.encode(), zlib.compressobj(3, zlib.DEFLATED, -15)  # above 3 it takes longer than it saves
        packed = packer.compress(data) + packer.flush()
        told = (20, 0, 8, 0, 33, zlib.crc32(data), len(packed), len(data), len(title), 0)  # 33: the first day of 1980
        out += [_PART.pack(b"PK\3\4", *told), title, packed]
        entries += [_ENTRY.pack(b"PK\1\2", 20, *told, 0, 0, 0, 0, at), title]
        at += _PART.size + len(title) + len(packed)
    directory = b"".join(entries)
    return b"".join([*out, directory, _END.pack(b"PK\5\6", 0, 0, n + len(parts), n + len(parts), len(directory), at, 0)])


def _unzipped(content: bytes) -> Callable[..., bytes]:
    """Reads parts of a ZIP file by name: plain ones by their entries, since opening an archive takes longer than its parts; others by the library."""
    entries, end = {}, len(content) - _END.size
    if end >= 0 and content[end : end + 4] == b"PK\5\6":
        _, _, _, _, n, _, at, _ = _END.unpack_from(content, end)
        while len(entries) < n and content[at : at + 4] == b"PK\1\2":
            _, _, _, flags, how, _, _, crc, packed, size, name, extra, note, _, _, _, start = _ENTRY.unpack_from(content, at)
            at += _ENTRY.size
            plain = how == 8 and not flags & 1 and max(packed, size, start) < 0xFFFFFFFF
            entries[content[at : at + name].decode("utf-8", "replace")] = (start, packed, crc) if plain else None
            at += name + extra + note

    def read(name: str, inflate: Callable[[bytes], bytes] = lambda packed: zlib.decompress(packed, -15)) -> bytes:
        if entries.get(name) is None:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                return z.read(name)
        start, packed, crc = entries[name]
        *_, title, extra = _PART.unpack_from(content, start)
        start += _PART.size + title + extra
        data = inflate(content[start : start + packed])
        if zlib.crc32(data) != crc:
            raise zipfile.BadZipFile(f"bad checksum of {name}")
        return data

    return read


def _workbook(names: tuple[str, ...], sheets: Iterable[bytes]) -> bytes:
    return _with_parts(_frame(names), {f"xl/worksheets/sheet{i}.xml": sheet for i, sheet in enumerate(sheets, 1)})


def write_xlsx(path: str | BinaryIO, sheets: Iterable[tuple[str, Sequence[Sequence]]]) -> None:
    """A workbook of one document: header fill, striped rows, widths by the longest text. One document's rows only."""
    sheets = list(sheets)
    made = []
    for _, rows in sheets:
        widths = [column_width(max([len(str(v)) for v in column if v is not None], default=0)) for column in zip(*rows, strict=True)]
        made.append(_sheet([_row(r, [_cell(v) for v in row]) for r, row in enumerate(rows, 1)], widths))
    content = _workbook(tuple(n for n, _ in sheets), made)
    if isinstance(path, str):
        with open(path, "wb") as f:
            f.write(content)
    else:
        path.write(content)
