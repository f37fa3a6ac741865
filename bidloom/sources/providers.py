"""Providers of recognition and extraction: built-in ones are deterministic and need no network."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Headings that name a column of a price table.
HEADINGS = {
    "stt": ("stt", "no.", "#"),
    "ma_sp": ("mã hàng", "mã sp", "code", "part no"),
    "ten_sp": ("tên hàng", "tên sp", "tên sản phẩm", "mô tả", "description", "item"),
    "dvt": ("đvt", "đơn vị", "unit", "uom"),
    "so_luong": ("số lượng", "sl", "qty", "quantity"),
    "don_gia": ("đơn giá", "giá", "unit price", "rate"),
    "thanh_tien": ("thành tiền", "tổng", "amount", "total"),
    "chiet_khau_pct": ("chiết khấu", "ck", "discount"),
    "ghi_chu": ("ghi chú", "note", "remarks"),
}
_FIELD_OF = {name: field for field, names in reversed(HEADINGS.items()) for name in names}
_HEADER_FIELDS = {"nhà cung cấp": "nha_cung_cap", "số báo giá": "so_bao_gia", "ngày báo giá": "ngay_bao_gia", "ngày": "ngay_bao_gia", "khách hàng": "khach_hang", "bảo hành": "bao_hanh"}
_TOTALS = (("chưa vat", "tong_chua_vat"), ("thuế vat", "thue_vat_tien"), ("tổng cộng", "tong_sau_vat"), ("sau vat", "tong_sau_vat"))


def extract_table(text: str) -> str:
    """Reply of the built-in extractor: heading lines ``key: value`` and a table with cells split by | or tab, as JSON."""
    doc: dict = {"don_vi_tien": "VND", "items": []}
    columns: list[str | None] = []
    for line in text.splitlines():
        cells = [c.strip() for c in line.replace("\t", "|").split("|")]
        low = line.lower()
        total = next((f for mark, f in _TOTALS if mark in low), None)
        if total:
            numbers = re.findall(r"[0-9][0-9.,]*", line.rsplit(":", 1)[-1])
            doc.setdefault(total, numbers[-1] if numbers else None)
        elif len(cells) < 3:
            key, _, value = line.partition(":")
            if value.strip() and key.strip().lower() in _HEADER_FIELDS:
                doc.setdefault(_HEADER_FIELDS[key.strip().lower()], value.strip())
        elif not columns:
            found = [_FIELD_OF.get(c.lower()) for c in cells]
            columns = found if "ten_sp" in found else []
        else:
            row = {k: c for k, c in zip(columns, cells, strict=False) if k and c}
            if row.get("ten_sp"):
                doc["items"].append(row | {"confidence": 0.9})
    return json.dumps(doc, ensure_ascii=False)


def extract_lines(text: str) -> str:
    """Reply with one item for each line ``name | price``; other lines give none."""
    cells = [[c.strip() for c in line.split("|")] for line in text.splitlines()]
    return json.dumps({"items": [{"ten_sp": c[0], "don_gia": c[1]} for c in cells if len(c) == 2 and c[0]]}, ensure_ascii=False)


def with_retry(call: Callable[[str], str], attempts: int = 3, first_wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """Calls again after 2, 4, ... seconds; the last failure is raised."""

    def run(x: str) -> str:
        for k in range(1, attempts + 1):
            try:
                return call(x)
            except Exception:
                if k == attempts:
                    raise
                sleep(first_wait * 2 ** (k - 1))
        raise AssertionError

    return run


def lines_reply(text: Column) -> Column:
    """``extract_lines`` as an expression, for texts of such lines alone: no Python, whatever their number."""
    cells = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda line: F.transform(F.split(line, "[|]", -1), lambda c: F.trim(c)))
    items = F.transform(F.filter(cells, lambda c: (F.size(c) == 2) & (c[0] != "")), lambda c: F.struct(c[0].alias("ten_sp"), c[1].alias("don_gia")))
    return F.to_json(F.struct(items.alias("items")))


def extract(
    chunks: DataFrame,
    extractor: Callable[[str], str] = extract_table,
    text_col: str = "chunk",
    attempts: int = 3,
    first_wait: float = 2.0,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Adds ``reply``, the extractor's answer for each chunk, ``attempts``, how often it was asked, and ``error``.

    A chunk that fails ``attempts`` times has a null reply and the last failure's message (its class where it has none) as error; the
    other chunks, and the job, go on. A model provider takes ``text_col="prompt"``.
    """

    def asked(text: str) -> tuple[str | None, int, str | None]:
        tried = 0

        def counted(x: str) -> str:
            nonlocal tried
            tried += 1
            return extractor(x)

        try:
            return with_retry(counted, attempts, first_wait, sleep)(text), tried, None
        except Exception as e:  # whatever a provider raises concerns its chunk alone
            return None, tried, str(e) or type(e).__name__

    @F.pandas_udf("reply string, attempts int, error string")
    def ask(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([asked(t) for t in texts], columns=["reply", "attempts", "error"])

    return chunks.select("*", ask(F.col(text_col)).alias("_asked")).select(*chunks.columns, "_asked.*")


def available(engines: dict[str, Callable[[bytes], tuple[str, float]]], probe: bytes = b"") -> list[str]:
    """The engines that answer a probe; one that raises is left out."""
    found = []
    for name in sorted(engines):
        try:
            engines[name](probe)
        except Exception:  # an engine that cannot run here
            continue
        found.append(name)
    return found


def health(spark: SparkSession, engines: dict[str, Callable[[bytes], tuple[str, float]]], version: str = "1.0.0") -> DataFrame:
    """One row: status, version and the engines that answer, each probed once on the driver."""
    return spark.createDataFrame([("ok", version, available(engines))], "status string, version string, ocr_engines array<string>")
