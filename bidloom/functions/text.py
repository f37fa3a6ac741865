"""Text, naming and JSON-region expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import strip_ws

#: Fixed values.
LIMIT_MB = 50
ALLOWED_SUFFIXES = (".pdf", ".jpg", ".jpeg", ".png", ".webp", ".tiff", ".bmp", ".heic")
MIME_BY_SUFFIX = {".pdf": "application/pdf", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".tiff": "image/tiff", ".bmp": "image/bmp"}
METHOD_OF_ENGINE = {"paddleocr": "ocr_paddleocr", "easyocr": "ocr_easyocr", "tesseract": "ocr_tesseract", "gemini_vision": "gemini_vision"}


def lookup(values: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in values.items()]), lambda p: p["k"] == key), F.lit(0))["v"], default)


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def allowed(name: Column) -> Column:
    return suffix(name).isin(*ALLOWED_SUFFIXES)


def small_enough(n_bytes: Column, limit_mb: float = LIMIT_MB) -> Column:
    return n_bytes / 1048576.0 <= limit_mb


def mime_type(name: Column, content: Column | None = None) -> Column:
    """By magic bytes where there is content, else by suffix, else application/octet-stream."""
    by_name = lookup(MIME_BY_SUFFIX, suffix(name), F.lit("application/octet-stream"))
    if content is None:
        return by_name
    head = F.hex(F.substring(content, 1, 12))
    magic = (
        F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("424D"), "image/bmp").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "image/tiff").when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")
    )
    return F.coalesce(magic, by_name)


def name_key(c: Column) -> Column:
    return F.lower(strip_ws(c))


def safe_name(c: Column) -> Column:
    """Last part of the path, spaces to underscores."""
    return F.replace(F.regexp_extract(c, r"([^/\\]*)$", 1), F.lit(" "), F.lit("_"))


def html_escape(c: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
    return reduce(lambda text, p: F.replace(text, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(c, F.lit("")))


def engine_method(engine: Column) -> Column:
    return lookup(METHOD_OF_ENGINE, F.regexp_replace(engine, "^ocr_", ""), engine)


def iso_timestamp(ts: Column) -> Column:
    """ISO form; microseconds only where there are any."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def json_region(c: Column) -> Column:
    """The text of a reply that should be its JSON: the object behind a fence, the whole reply, or what lies between the outer braces."""
    text = strip_ws(c)
    fenced = F.regexp_extract(text, r"```[^{]*(\{[\s\S]*\})", 1)
    outer = F.regexp_extract(text, r"(\{[\s\S]*\})", 1)
    return F.when(text.contains("```"), fenced).when(text.startswith("{"), text).when(outer != "", outer).otherwise(text)


def job_id(path: Column) -> Column:
    """Eleven hex digits that a path determines, as the reference shows them; of some million paths two may share them."""
    return F.substring(F.sha2(path, 256), 1, 11)


def job_key(path: Column) -> Column:
    """32 hex digits that a path determines: no two paths of any collection share them."""
    return F.substring(F.sha2(path, 256), 1, 32)


def prompt(text: Column, filename: Column, number: Column, total: Column) -> Column:
    """User part of the request for one chunk; the chunk's number only where there is more than one."""
    note = F.when(total > 1, F.concat(F.lit(" (trang "), number.cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("File: "), filename, note, F.lit("\n\n=== NỘI DUNG OCR ===\n"), text, F.lit("\n=== HẾT NỘI DUNG ==="))
