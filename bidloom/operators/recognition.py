"""Classification and the recognition cascade."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup, suffix

#: Engines in order of preference and the least confidence each needs.
GATES = {"paddleocr": 0.65, "easyocr": 0.65, "tesseract": 0.50, "gemini_vision": 0.0}


def pdf_class(mean_chars: Column) -> Column:
    """A PDF with more than 50 characters a page is soft."""
    return F.when(mean_chars > 50, F.struct(F.lit("soft_pdf").alias("doc_type"), F.lit(0.95).alias("confidence"))).otherwise(F.struct(F.lit("scanned_pdf").alias("doc_type"), F.lit(0.90).alias("confidence")))


def image_class(bright: Column, slope: Column, spread: Column) -> Column:
    return F.when(bright > 0.15, "image_photo_glare").when(slope > 0.15, "image_skewed").when(spread < 60, "image_scan").otherwise("image_photo")


#: Confidence in each class of image.
IMAGE_CONFIDENCE = {"image_photo_glare": 0.85, "image_skewed": 0.80, "image_scan": 0.80, "image_photo": 0.75}


def document_type(name: Column, mime: Column, mean_chars: Column, bright: Column, slope: Column, spread: Column) -> Column:
    """(doc_type, confidence) of a file: PDFs by their characters a page, images by their metrics, all else unknown with 0.

    Null metrics say that the file could not be read: a PDF then counts as scanned and an image as a photo, both with 0.5.
    """
    kind = lambda doc_type, confidence: F.struct(doc_type.alias("doc_type"), confidence.cast("double").alias("confidence"))
    unread = lambda doc_type: kind(F.lit(doc_type), F.lit(0.5))
    image = image_class(bright, slope, spread)
    seen = kind(image, lookup(IMAGE_CONFIDENCE, image, F.lit(0.0)))
    images = (mime.startswith("image/")) | suffix(name).isin(".jpg", ".jpeg", ".png", ".webp", ".tiff", ".bmp")
    pdf = F.when(mean_chars.isNull(), unread("scanned_pdf")).otherwise(pdf_class(mean_chars))
    return F.when(mime == "application/pdf", pdf).when(images & bright.isNull(), unread("image_photo")).when(images, seen).otherwise(kind(F.lit("unknown"), F.lit(0.0)))


def choose_engine(candidates: DataFrame, page: str, engine: str = "engine", confidence: str = "confidence", text: str = "text") -> DataFrame:
    """For each page the first engine in order of preference that passes its gate; ``none`` with confidence 0 where none does."""
    rank = F.create_map(*[x for i, e in enumerate(GATES) for x in (F.lit(e), F.lit(i))])[F.col(engine)]
    gate = F.create_map(*[x for e, g in GATES.items() for x in (F.lit(e), F.lit(g))])[F.col(engine)]
    best = F.min(F.when(F.col(confidence) >= gate, F.struct(rank.alias("r"), F.col(engine).alias("e"), F.col(confidence).alias("c"), F.col(text).alias("t"))))
    picked = candidates.groupBy(page).agg(best.alias("b"))
    return picked.select(page, F.coalesce("b.e", F.lit("none")).alias("engine"), F.coalesce("b.c", F.lit(0.0)).alias("confidence"), F.coalesce("b.t", F.lit("")).alias("text"))


Engine = Callable[[bytes], tuple[str, float]]


def lazy_cascade(pages: DataFrame, engines: dict[str, Engine], id_col: str = "page_id", content_col: str = "content") -> DataFrame:
    """Runs the engines page by page, the next one only where the one before fails its gate or raises."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, content in zip(frame[id_col], frame[content_col], strict=True):
                row = (page, "none", "", 0.0)
                for name, gate in GATES.items():
                    if name in engines:
                        try:
                            text, confidence = engines[name](content)
                        except Exception:  # an engine that fails is passed over, as one below its gate
                            continue
                        if confidence >= gate:
                            row = (page, name, text, confidence)
                            break
                out.append(row)
            yield pd.DataFrame(out, columns=["page_id", "engine", "text", "confidence"])

    return pages.select(id_col, content_col).mapInPandas(run, "page_id long, engine string, text string, confidence double")


def word_kept(word: Column, confidence: Column) -> Column:
    """Whether a recognised word counts: it is not blank, and its engine is at all sure of it."""
    return (confidence > 0) & (F.trim(word) != "")


def page_words(words: DataFrame, page: str, order: str, word: str, confidence: str) -> DataFrame:
    """(page, n_words, confidence, text) of the words that count: mean of their 0 to 100, and their text in order."""
    kept = words.where(word_kept(F.col(word), F.col(confidence)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, word))), lambda x: x[word]), " ")
    return kept.groupBy(page).agg(F.count("*").alias("n_words"), (F.sum(confidence).cast("double") / F.count("*") / 100).alias("confidence"), text.alias("text"))


def page_word_lists(pages: DataFrame, page: str, words: str, order: str = "i", word: str = "w", confidence: str = "c") -> DataFrame:
    """The same from pages with an array of words: each row's words are sifted and summed where they lie, and only a page's row is
    shuffled, not its words. Rows of one page are put together; a page without a word that counts gives no row."""
    kept = pages.select(page, F.filter(words, lambda x: word_kept(x[word], x[confidence])).alias("_kept")).where(F.size("_kept") > 0)
    total = F.aggregate("_kept", F.lit(0).cast("double"), lambda n, x: n + x[confidence])
    placed = F.sort_array(F.transform("_kept", lambda x: F.struct(x[order].alias(order), x[word].alias(word))))
    part = kept.select(page, F.size("_kept").cast("long").alias("_n"), total.alias("_sum"), placed.alias("_words"))
    # words travel as one text, with marks between them that no word holds unmasked, and their places beside it
    masked = lambda w: F.replace(F.replace(w, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    unmasked = lambda w: F.replace(F.replace(w, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))
    text = F.array_join(F.transform("_words", lambda x: masked(x[word])), "\x00")
    part = part.select(page, "_n", "_sum", F.struct(F.transform("_words", lambda x: x[order]).alias("at"), text.alias("text")).alias("_part"))
    whole = part.groupBy(page).agg(F.sum("_n").alias("n_words"), F.sum("_sum").alias("_sum"), F.collect_list("_part").alias("_parts"))
    apart = lambda p: F.arrays_zip(p["at"].alias("i"), F.split(p["text"], "\\x00", -1).alias("w"))
    merged = F.array_join(F.transform(F.sort_array(F.flatten(F.transform("_parts", apart))), lambda x: unmasked(x["w"])), " ")
    joined = F.when(F.size("_parts") == 1, unmasked(F.replace(F.get("_parts", F.lit(0))["text"], F.lit("\x00"), F.lit(" ")))).otherwise(merged)
    return whole.select(page, "n_words", (F.col("_sum") / F.col("n_words") / 100).alias("confidence"), joined.alias("text"))


def vision_confidence(text: Column) -> Column:
    return F.when(F.char_length(text) > 20, 0.85).otherwise(0.3)


def needs_vision(confidence: Column) -> Column:
    return confidence < 0.5
