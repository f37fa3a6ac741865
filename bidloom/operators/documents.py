"""Structured documents: reading replies as JSON, merging chunks, roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import overall_confidence, repaired_total, safe_money
from ..functions.text import json_region, name_key, prompt
from .chunking import BUDGET, chunk_lines

TEXT_FIELDS = ("nha_cung_cap", "so_bao_gia", "ngay_bao_gia", "khach_hang", "dieu_kien_thanh_toan", "thoi_gian_giao_hang", "bao_hanh", "ghi_chu_chung")
MONEY_FIELDS = ("tong_chua_vat", "thue_vat_pct", "thue_vat_tien", "tong_sau_vat")
ITEM = "stt int, ma_sp string, ten_sp string, dvt string, so_luong double, don_gia double, thanh_tien double, chiet_khau_pct double, ghi_chu string, confidence double"
ITEM_FIELDS = tuple(c.split()[0] for c in ITEM.split(", "))
ITEMS = f"array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>"


def _once(df: DataFrame, keep: str, *columns: Column) -> DataFrame:
    """The columns beside those kept, handed on by a generator of one row: filters above it do not copy what was computed below it.

    They are computed below it, as a generator's own expressions are interpreted.
    """
    made = df.select(keep, *columns)
    if keep == "*":
        return made.select("*")
    return made.select(keep, F.inline(F.array(F.struct(*[c for c in made.columns if c != keep]))))


def _field(v: Column) -> Column:
    """A field's value as ``k``, its kind (null where it is missing), and ``t``, its text; both are taken from the value once."""
    return F.struct(F.schema_of_variant(v).alias("k"), F.try_variant_get(v, "$", "string").alias("t"))


def _is_text(field: Column) -> Column:
    return field["k"] == "STRING"


def _is_number(field: Column) -> Column:
    return (field["k"] == "BIGINT") | (field["k"] == "DOUBLE") | field["k"].startswith("DECIMAL")


def _text_or_none(field: Column) -> Column:
    return F.coalesce(_is_text(field) | (field["k"] == "VOID"), F.lit(True))


def _money(field: Column) -> Column:
    """Numbers pass as they are, texts go through the money rule."""
    return F.when(_is_number(field), field["t"].try_cast("double")).otherwise(safe_money(field["t"]))


def _stt(field: Column) -> Column:
    whole = F.regexp_replace(field["t"], "[.]0+$", "").try_cast("int")
    return F.when(_is_number(field) | _is_text(field), whole).when(field["k"] == "BOOLEAN", F.when(field["t"] == "true", 1).otherwise(0))


def _confidence(field: Column) -> Column:
    return F.when(field["k"].isNull(), 0.8).when(_is_number(field) | _is_text(field), field["t"].try_cast("double"))


def _good_item(i: Column) -> Column:
    stt_ok = F.coalesce(i["stt"]["k"] == "VOID", F.lit(True)) | _stt(i["stt"]).isNotNull()
    named = _is_text(i["ten_sp"]) & (i["ten_sp"]["t"] != "")
    good = named & stt_ok & _confidence(i["confidence"]).between(0, 1)
    for f in ("ma_sp", "dvt", "ghi_chu"):
        good = good & _text_or_none(i[f])
    return F.coalesce(good, F.lit(False))


def _item(i: Column) -> Column:
    read = {f: i[f]["t"] for f in ("ma_sp", "ten_sp", "dvt", "ghi_chu")} | {f: i[f] for f in ("so_luong", "don_gia", "thanh_tien", "chiet_khau_pct")}
    read |= {"stt": _stt(i["stt"]), "confidence": _confidence(i["confidence"])}
    return F.struct(*[read[f].alias(f) for f in ITEM_FIELDS])


def _with_money(i: Column) -> Column:
    """The item with its money read and its total repaired; the money rule stands once a field."""
    money = {f: _money(i[f]) for f in ("so_luong", "don_gia", "thanh_tien", "chiet_khau_pct")}
    return F.struct(*[money.get(f, i[f]).alias(f) for f in ITEM_FIELDS])


def parse_replies(replies: DataFrame, id_col: str = "doc_id", reply_col: str = "reply") -> DataFrame:
    """One row a reply: its document fields and ``items``. A reply that is no strict JSON object, or with one bad document-level
    field, gives an empty document in VND; a bad item is left out alone, and so is one with an empty name. Each reply is read within
    its own row, so ids may be null or repeat and nothing is shuffled."""
    region = _once(replies, id_col, json_region(F.col(reply_col)).alias("_j"))
    # both wraps parse only where nothing trails the value; the second one is only gone through
    value = F.try_parse_json(F.concat(F.lit('{"d":'), "_j", F.lit("}")))
    alone = F.json_array_length(F.concat(F.lit("["), "_j", F.lit("]"))) == 1
    strict = _once(region, id_col, F.when(F.col("_j").rlike(r"^\s*\{") & alone, value).alias("_v"))
    heads = (*TEXT_FIELDS, *MONEY_FIELDS, "don_vi_tien")
    # one walk over the value, whose fields stay what they are; what is no object in the list of items is null
    parts = ", ".join([*(f"{f}: variant" for f in heads), f"items: array<struct<{', '.join(f'{f}: variant' for f in ITEM_FIELDS)}>>"])
    read = _once(strict, id_col, "_v", F.try_variant_get("_v", "$.d", f"struct<{parts}>").alias("_d"))
    d = F.col("_d")
    no_items = F.variant_get("_v", "$.d.items", "variant").isNull()
    fields = _once(read, id_col, d.isNotNull().alias("_ok"), *[_field(d[f]).alias(f) for f in heads], (d["items"].isNotNull() | no_items).alias("_items_ok"), d["items"].alias("_items"))
    good = F.col("_ok") & F.col("_items_ok") & F.coalesce(_is_text(F.col("don_vi_tien")), F.lit(True))
    for f in TEXT_FIELDS:
        good = good & _text_or_none(F.col(f))
    checked = _once(fields, "*", good.alias("_good"))
    ok = lambda c: F.when(F.col("_good"), c)
    raw = F.transform(ok(F.col("_items")), lambda i: F.struct(*[_field(i[f]).alias(f) for f in ITEM_FIELDS]))
    items = F.transform(F.transform(F.filter(raw, _good_item), _item), _with_money)
    repaired = F.transform(items, lambda i: i.withField("thanh_tien", repaired_total(i["so_luong"], i["don_gia"], i["thanh_tien"])))
    return _once(
        checked,
        id_col,
        *[ok(F.col(f)["t"]).alias(f) for f in TEXT_FIELDS],
        F.coalesce(ok(F.col("don_vi_tien")["t"]), F.lit("VND")).alias("don_vi_tien"),
        *[ok(_money(F.col(f))).alias(f) for f in MONEY_FIELDS],
        F.coalesce(repaired, F.array()).cast(ITEMS).alias("items"),
    )


def item_valid(name: Column, confidence: Column) -> Column:
    """Whether an item stays: it has a name, and its confidence lies between 0 and 1."""
    return F.coalesce((name != "") & confidence.between(0, 1), F.lit(False))


def first_wins(items: DataFrame, doc: str, name: str, *order: str) -> DataFrame:
    """Of items with the same stripped lower-case name the first of a document; blank names all stay."""
    key = name_key(F.col(name))
    first = F.row_number().over(Window.partitionBy(doc, key).orderBy(*order))
    return items.withColumn("_n", first).where((F.col("_n") == 1) | (key == "")).drop("_n")


def merge_chunks(chunks: DataFrame, doc: str, chunk: str, meta: list[str], *more: Column) -> DataFrame:
    """Document fields of the first chunk, and further aggregates over all of its chunks."""
    return chunks.groupBy(doc).agg(*[F.min_by(m, chunk).alias(m) for m in meta], *more)


def _by_name(items: Column) -> Column:
    """The items as (k, i, x), sorted by stripped lower-case name, then place."""
    return F.array_sort(F.transform(items, lambda x, i: F.struct(name_key(x["ten_sp"]).alias("k"), i.alias("i"), x.alias("x"))))


def _first_of_each_name(keyed: Column) -> Column:
    """Of the sorted items the first of each name, back in order; blank names all stay. ``keyed`` is a column, made once a row."""
    first = F.filter(keyed, lambda r, j: (r["k"] == "") | (j == 0) | (F.get(keyed, F.greatest(j - 1, F.lit(0)))["k"] != r["k"]))
    return F.transform(F.array_sort(F.transform(first, lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x")))), lambda r: r["x"])


def extract_documents(
    texts: DataFrame,
    ask: Callable[[DataFrame], DataFrame],
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: int = BUDGET,
    filename: Column | None = None,
) -> DataFrame:
    """Structured documents of whole texts: cut into chunks, each asked for a reply, replies parsed and put together again.

    ``ask`` adds ``reply`` to rows with ``chunk`` and ``prompt`` (the chunk in the words of a request, with ``filename`` and its
    number), and may add ``attempts`` and ``error``. Document fields are those of the first chunk; items of all chunks are united in
    their order, and only where a text is longer than the budget (even if it fits one chunk, as line breaks don't count there) the
    first of each name stays. ``failures`` lists (no, attempts, error) of the chunks that gave no reply.

    One row a text: ids may be null or repeat, as texts are told apart by id and content, and equal rows are asked for once a row but
    come out as so many rows. Null texts give no items. One shuffle by text; a document's chunks meet in one array.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.lit("") if filename is None else F.coalesce(filename, F.lit(""))
    doc = F.struct(F.col(id_col).alias("id"), F.sha2(text, 256).alias("digest"), name.alias("name"))
    # each chunk brings the number of chunks with it, so that no row of a chunk holds the others; outer, as there is always one: the
    # filter that stands before other generators would cut the texts again
    counted = F.transform(F.array(chunk_lines(text, budget)), lambda all: F.transform(all, lambda c, i: F.struct(F.size(all).alias("total"), i.alias("no"), c.alias("chunk"))))
    cut = texts.select(doc.alias("doc"), (F.char_length(text) > budget).alias("long"), counted[0].alias("chunks"))
    chunks = cut.select("doc", "long", F.inline_outer("chunks"))
    asked = ask(chunks.withColumn("prompt", prompt(F.col("chunk"), F.col("doc.name"), F.col("no") + 1, F.col("total"))))
    told = {c: (F.col(c) if c in asked.columns else F.lit(None)).cast(t).alias(c) for c, t in (("attempts", "int"), ("error", "string"))}
    replies = asked.select(F.struct("doc", "no", "long", "total", *told.values()).alias("key"), "reply")
    parsed = parse_replies(replies, "key")
    heads = [c for c in parsed.columns if c not in ("key", "items")]
    part = F.struct("key.no", F.when(F.col("key.no") == 0, F.struct(*heads)).alias("head"), "items", "key.attempts", "key.error")
    whole = parsed.groupBy("key.doc", "key.long", "key.total").agg(F.array_sort(F.collect_list(part)).alias("p"))
    # equal rows bring each chunk several times
    whole = whole.withColumn("copies", F.size("p") / F.col("total")).withColumn("p", F.filter("p", lambda x, i: i % F.col("copies") == 0))
    items = F.flatten(F.transform("p", lambda x: x["items"]))
    lost = F.transform(F.filter("p", lambda x: x["error"].isNotNull()), lambda x: F.struct(x["no"].alias("no"), x["attempts"].alias("attempts"), x["error"].alias("error")))
    found = whole.select(F.col("doc.id").alias(id_col), F.get("p", F.lit(0))["head"].alias("h"), "long", items.alias("items"), lost.alias("failures"), "copies")
    found = found.withColumn("_keyed", F.when(F.col("long"), _by_name(F.col("items"))))
    found = found.withColumn("items", F.when(F.col("long"), _first_of_each_name(F.col("_keyed"))).otherwise(F.col("items")))
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(id_col, "h.*", "items", "failures")


def with_overall_confidence(docs: DataFrame, base: Column) -> DataFrame:
    n = F.size("items")
    mean = F.aggregate("items", F.lit(0.0), lambda s, i: s + i["confidence"]) / n
    return docs.withColumn("overall_confidence", overall_confidence(F.when(n > 0, mean), n, base))
