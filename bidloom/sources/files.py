"""File intake: binary files with type and admission, and text of simple PDFs."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def intake(spark: SparkSession, folder: str, pattern: str = "*", limit_mb: int = T.LIMIT_MB) -> DataFrame:
    """Path, size, MIME type and whether suffix and size are admissible. Content over the size gate is never read: its type is told by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    # in bytes, as the reader takes only plain comparisons of the length
    within = F.col("length") <= limit_mb * 1048576

    def rows(chosen: DataFrame, mime: Column) -> DataFrame:
        return chosen.select("path", name.alias("name"), "length", mime.alias("mime"), (T.allowed(name) & T.small_enough(F.col("length"), limit_mb)).alias("admitted"), T.job_key(F.col("path")).alias("job_id"))

    return rows(files.where(within), T.mime_type(name, F.col("content"))).unionByName(rows(files.where(~within), T.mime_type(name)))


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_REF = re.compile(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R")
_NUMBER = rb"[-+0-9.]+"
_TOKEN = re.compile(
    rb"/([^\s/<>\[\]()]+)\s+" + _NUMBER + rb"\s+Tf\b"
    rb"|(" + _NUMBER + rb")\s+(" + _NUMBER + rb")\s+T[dD]\b"
    rb"|(?:" + _NUMBER + rb"\s+){5}(" + _NUMBER + rb")\s+Tm\b"
    rb"|(T\*)"
    rb"|(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(Tj|')"
    rb"|\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ",
    re.S,
)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]*)>", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
#: What a letter behind a backslash stands for.
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}


def _body(piece: bytes) -> bytes:
    """A stream's bytes, inflated where they are deflated; by its length where that is given, else up to its end mark."""
    head, mark, rest = piece.partition(b"stream")
    start = re.match(rb"\r?\n", rest)
    if not mark or not start:
        return b""
    length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R|\d)", head)
    data = rest[start.end() :]
    data = data[: int(length.group(1))] if length else re.split(rb"\r?\nendstream", data, maxsplit=1)[0]
    try:
        return zlib.decompressobj().decompress(data)
    except zlib.error:
        return data


def _objects(content: bytes) -> dict[int, bytes]:
    """The numbered objects of a file, those inside object streams too."""
    found = {int(n): body for n, body in _OBJECT.findall(content)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            data, first = _body(body), re.search(rb"/First\s+(\d+)", body)
            at = int(first.group(1)) if first else 0
            numbers = list(map(int, data[:at].split()))
            starts = [*(at + x for x in numbers[1::2]), len(data)]
            found |= {n: data[a:b] for n, a, b in zip(numbers[::2], starts, starts[1:], strict=False)}
    return found


@functools.lru_cache(maxsize=256)
def _font(wide: bool, table: bytes) -> _Font:
    """Fonts are not changed once they are made, and many files share one."""
    return _Font(wide, table)


class _Font:
    """How a font's codes read: two bytes each or one, by its table of Unicode texts, else as Latin-1."""

    def __init__(self, wide: bool = False, table: bytes = b""):
        self.wide, self.chars, self.ranges = wide, {}, []
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
            for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", block):
                self.chars[int(code, 16)] = text(to)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
            for a, b, to, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]*)>|\[(.*?)\])", block, re.S):
                if many:
                    self.chars |= {int(a, 16) + i: text(h) for i, h in enumerate(re.findall(rb"<([0-9A-Fa-f]*)>", many))}
                else:
                    self.ranges.append((int(a, 16), int(b, 16), bytes.fromhex(to.decode())))
        # two-byte codes that all stand for themselves are read at once
        self.as_is = wide and not self.chars and all(len(to) == 2 and int.from_bytes(to, "big") == a for a, _, to in self.ranges)

    def _char(self, code: int) -> bytes:
        if code in self.chars:
            return self.chars[code].encode("utf-16-be")
        for a, b, to in self.ranges:
            if a <= code <= b:
                return to[:-2] + (int.from_bytes(to[-2:], "big") + code - a & 0xFFFF).to_bytes(2, "big")

        return (code & 0xFFFF).to_bytes(2, "big")

    def read(self, raw: bytes) -> str:
        if self.as_is and len(raw) % 2 == 0:
            return raw.decode("utf-16-be", "replace")
        step = 2 if self.wide else 1
        codes = (int.from_bytes(raw[i : i + step], "big") for i in range(0, len(raw), step))
        # code units are put together before they are read, as a pair of them may be one character
        return b"".join(map(self._char, codes)).decode("utf-16-be", "replace")


def _fonts(objects: dict[int, bytes]) -> dict[bytes, _Font]:
    """Fonts by the names under which pages know them."""
    out: dict[bytes, _Font] = {}
    for body in objects.values():
        for name, n in _REF.findall(body.split(b"stream", 1)[0]):
            font = objects.get(int(n), b"")
            if name not in out and re.search(rb"/Type\s*/Font\b", font):
                table = re.search(rb"/ToUnicode\s+(\d+)", font)
                out[name] = _font(b"/Type0" in font, _body(objects.get(int(table.group(1)), b"")) if table else b"")
    return out


def _raw(string: re.Match) -> bytes:
    if string.group(2) is not None:
        digits = b"".join(string.group(2).split())
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    plain = lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1)[:1].isdigit() else _ESCAPED.get(m.group(1), m.group(1))
    return _ESCAPE.sub(plain, string.group(1))


def pdf_text(content: bytes) -> list[str]:
    """Text of each content stream of a PDF with plain or Flate streams, by the Unicode tables of its fonts (Latin-1 without one).

    A line ends where the text position moves down, up or to the next line; what is shown without a move belongs together.
    """
    objects = _objects(content)
    fonts, pages = _fonts(objects), []
    bodies = [_body(b) for b in objects.values() if b"stream" in b] or [_body(m.group(0)) for m in _STREAM.finditer(content)]
    for data in bodies:
        if not re.search(rb"\bBT\b", data) or b"begincmap" in data:
            continue
        font, height, lines = _Font(), None, [""]
        for t in _TOKEN.finditer(data):
            name, _, dy, y, down, shown, how, many = t.groups()
            if name is not None:
                font = fonts.get(name, _Font())
            elif shown is not None or many is not None:
                if how == b"'":
                    lines.append("")
                lines[-1] += "".join(font.read(_raw(m)) for m in _STRING.finditer(shown if shown is not None else many))
            elif down or (dy is not None and float(dy) != 0) or (y is not None and y != height):
                lines.append("")
                height = y
        pages.append("\n".join(lines[1:] if lines[0] == "" and len(lines) > 1 else lines))
    return pages


def pdf_pages(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, page_no, text) of every page; the path column may be of any type."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, i, t) for p, c in zip(f[path_col], f[content_col], strict=True) for i, t in enumerate(pdf_text(c), 1)], columns=["path", "page_no", "text"])

    kind = files.schema[path_col].dataType.simpleString()
    return files.select(path_col, content_col).mapInPandas(run, f"path {kind}, page_no int, text string")


def document_text(pages: DataFrame, doc: str, page: str = "page_no", text: str = "text") -> DataFrame:
    """Non-blank pages joined by an empty line, in order."""
    kept = pages.where(F.trim(F.col(text)) != "")
    return kept.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda p: p[text]), "\n\n").alias("text"))


def text_tables(pages: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, table_no, row_no, header, cells) of the tables in texts: runs of lines with two or more cells, cut by | or tab.

    The first line of a run is its header. Rows of blank cells go, and so do runs without another row. One pass, no shuffle.
    """
    cells = lambda line: F.transform(F.split(line, r"[|\t]"), lambda c: F.trim(c))
    filled = lambda line: F.exists(cells(line), lambda c: c != "")
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00\r]", ""), "\n")
    # a line outside tables becomes a mark, so that what lies between two marks is one run
    marked = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"[|\t]"), x).otherwise("\x00")), "\n")
    runs = F.transform(F.split(marked, "\\x00"), lambda run: F.filter(F.split(run, "\n"), lambda x: x != ""))
    parts = F.transform(runs, lambda r: F.struct(F.get(r, F.lit(0)).alias("head"), F.filter(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), filled).alias("body")))
    tables = pages.select(*keys, F.posexplode(F.filter(parts, lambda p: F.size(p["body"]) > 0)).alias("t", "part"))
    rows = tables.select(*keys, (F.col("t") + 1).alias("table_no"), cells(F.col("part.head")).alias("header"), F.posexplode("part.body").alias("r", "row"))
    return rows.select(*keys, "table_no", (F.col("r") + 1).alias("row_no"), "header", cells(F.col("row")).alias("cells"))
