"""Sample uploads: texts as PDFs whose pages can be read again, whatever their script."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: A table that reads two-byte codes as what they are, UTF-16.
_UNICODE = b"begincmap\n1 beginbfrange\n<0000> <FFFF> <0000>\nendbfrange\nendcmap"


def pdf_of(pages: list[list[str]], deflate: bool = True) -> bytes:
    """A PDF of the given lines of pages, in one font of two-byte codes with its table of Unicode texts."""

    def stream(data: bytes) -> bytes:
        packed, how = (zlib.compress(data), b" /Filter /FlateDecode") if deflate else (data, b"")
        return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(packed), how, packed)

    def body(lines: list[str]) -> bytes:
        shown = (b"<%s> Tj" % x.encode("utf-16-be").hex().encode() for x in lines)
        return b"BT\n/F1 10 Tf\n40 800 Td\n" + b"\n0 -12 Td\n".join(shown) + b"\nET"

    kids = b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(pages)))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages)),
        b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /ToUnicode 4 0 R >>",
        stream(_UNICODE),
    ]
    for i, lines in enumerate(pages):
        objects += [b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (6 + 2 * i), stream(body(lines))]
    out, at = b"%PDF-1.4\n", []
    for n, x in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    table = b"".join(b"%010d 00000 n \n" % x for x in at)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, table, len(objects) + 1, len(out))


def as_pdfs(texts: DataFrame, id_col: str, text_col: str, lines_a_page: int = 40) -> DataFrame:
    """(id, content): each text as a PDF, so many lines a page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            lines = [(t or "").split("\n") for t in f[text_col]]
            made = [pdf_of([x[i : i + lines_a_page] for i in range(0, len(x), lines_a_page)]) for x in lines]
            yield pd.DataFrame({id_col: f[id_col], "content": made})

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, content binary")
