"""Money, numbers and confidence as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: all Unicode white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c: Column) -> Column:
    """Unicode white space off both ends (Spark's trim takes spaces only); what lies between is not searched."""
    return F.btrim(c, F.lit(WHITE))


def safe_money(c: Column) -> Column:
    """A money text as a double: separators and currency marks go, what is left must be a plain number; else null.

    Every point, comma and space is deleted, so "1.5" is 15 and "35 000 VND" is 35000; marks are case-sensitive; "1.2K" and
    "12 vnd" are null. So are, on purpose, "1_000", digits other than 0 to 9, "nan" and "inf", which a looser reading would take.
    """
    text = strip_ws(F.translate(c, ",. ", ""))
    for mark in ("VND", "đ", "$", "USD", "EUR"):
        text = F.replace(text, F.lit(mark), F.lit(""))
    text = strip_ws(text)
    return F.when(text.rlike(r"^[+-]?[0-9]+([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def repaired_total(qty: Column, price: Column, total: Column) -> Column:
    """The line total, or quantity times price where it is null or zero and both factors are there and not zero."""
    return F.when((F.coalesce(total, F.lit(0.0)) == 0) & (qty != 0) & (price != 0), qty * price).otherwise(total)


def format_money(v: Column, currency: Column) -> Column:
    return F.when(v.isNull(), "").when(currency == "VND", F.concat(F.format_number(v, 0), F.lit(" đ"))).otherwise(F.concat(F.format_number(v, 2), F.lit(" "), currency))


def format_percent(c: Column) -> Column:
    return F.concat(F.format_number(c * 100, 0), F.lit("%"))


def ui_number(v: Column) -> Column:
    """Points between thousands, a comma before at most three decimals, no trailing zeros; a dash for null."""
    plain = F.regexp_replace(F.format_number(v, 3), r"\.?0+$", "")
    return F.when(v.isNull(), "—").otherwise(F.translate(plain, ",.", ".,"))


def ui_money(v: Column, currency: Column) -> Column:
    decimals = F.regexp_replace(F.format_number(v, 3), r"0$", "")
    return F.when(v.isNull(), "—").when(currency == "VND", F.concat(ui_number(v), F.lit(" đ"))).otherwise(F.concat(decimals, F.lit(" "), currency))


def confidence_band(c: Column) -> Column:
    c = F.coalesce(c, F.lit(0.0))
    return F.when(c >= 0.85, "conf-high").when(c >= 0.6, "conf-medium").otherwise("conf-low")


def percent_label(c: Column) -> Column:
    """Half-up percent."""
    return F.concat(F.floor(F.coalesce(c, F.lit(0.0)) * 100 + 0.5).cast("string"), F.lit("%"))


def overall_confidence(item_avg: Column, n_items: Column, base: Column) -> Column:
    return F.when(n_items > 0, (item_avg + base) / 2).otherwise(base)
