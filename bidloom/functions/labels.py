"""What a reader is shown of statuses, steps, document types and methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lookup

#: Labels and marks.
STATUS = {"done": "✓ Hoàn thành", "failed": "✗ Thất bại", "pending": "⏳ Chờ", "preprocessing": "⚙️ Xử lý", "ocr": "🔤 OCR", "extracting": "🤖 AI"}
STATUS_CLASS = {"done": "status-done", "failed": "status-failed", "pending": "status-pending"}
METHOD = {"pdfplumber": "📄 PDF Mềm", "camelot": "📊 Camelot", "ocr_paddleocr": "🔤 PaddleOCR", "ocr_easyocr": "🔤 EasyOCR", "ocr_tesseract": "🔤 Tesseract", "gemini_vision": "👁️ Gemini Vision"}
TYPE = {"soft_pdf": "📄 PDF Mềm", "scanned_pdf": "📷 PDF Scan", "image_scan": "🖼️ Ảnh Scan", "image_photo": "📱 Ảnh Điện Thoại", "image_photo_glare": "🌟 Ảnh Lóa", "image_skewed": "📐 Ảnh Nghiêng"}
MARK = {"active": "⚙️", "done": "✅"}
NO_MARK = "⏸"
#: The steps of a job, each by the status in which it is under way; after the last one comes done.
STEPS = {"detect": "detecting", "preprocess": "preprocessing", "ocr": "ocr", "ai": "extracting"}


def status_label(status: Column) -> Column:
    return lookup(STATUS, status, status)


def status_class(status: Column) -> Column:
    return lookup(STATUS_CLASS, status, F.lit("status-processing"))


def method_label(method: Column) -> Column:
    return lookup(METHOD, method, method)


def type_label(doc_type: Column) -> Column:
    return lookup(TYPE, doc_type, doc_type)


def step_states(status: Column) -> dict[str, Column]:
    """For each step ``done`` if the job is past it, ``active`` if it is under way, else null; no step where the status names none."""
    at = F.array_position(F.array(*map(F.lit, [*STEPS.values(), "done"])), status)
    return {name: F.when(at > i, "done").when(at == i, "active") for i, name in enumerate(STEPS, 1)}


def mark(state: Column) -> Column:
    return lookup(MARK, state, F.lit(NO_MARK))
