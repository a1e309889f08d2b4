"""Amounts: plain and accounting decimals, rich literals with currency and unit."""

from __future__ import annotations

from decimal import ROUND_FLOOR, Context, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import exact

#: what amounts are computed in where they fit it exactly: 28 digits before the point and 10 after
AMOUNT = "decimal(38,10)"
#: fixed values: patterns of amounts
GROUPED = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"
UNSIGNED = r"^(\d+(\.\d+)?|\d{1,3}(,\d{3})+(\.\d+)?)$"
RICH = r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d{1,3}(?:[  ]\d{3})+|\d+)(?:\.\d+)?$"
CURRENCY = r"(?i)^(USD|HKD|CNY|RMB|HK\$|US\$|人民币|人民幣|港币|港幣|美元|[$¥￥])\s*"
CURRENCIES = {"US$": "USD", "美元": "USD", "HK$": "HKD", "港币": "HKD", "港幣": "HKD", "RMB": "CNY", "人民币": "CNY", "人民幣": "CNY"}
UNITS = {"元": 1, "千元": 1000, "万元": 10_000, "萬元": 10_000, "百万元": 1_000_000, "百萬元": 1_000_000, "亿元": 100_000_000, "億元": 100_000_000}


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def amount_text(text: Column, accounting: bool = True) -> Column:
    """The amount as a plain decimal literal of any length, or null. Exponents are amounts; texts of more than 256
    characters aren't. accounting: thousands in threes and (1.00) for negatives, whose inside has no sign."""

    def formatted(t: Column) -> Column:
        inside = strip(F.regexp_extract(t, r"^\((.*)\)$", 1))
        negative = exact.let(inside, lambda x: F.when(x.rlike(UNSIGNED), F.concat(F.lit("-"), F.replace(x, F.lit(","), F.lit("")))))
        grouped = F.when(t.rlike(GROUPED), F.replace(t, F.lit(","), F.lit("")))
        return F.when(t.rlike(r"^\(.*\)$"), negative).when(t.contains(","), grouped).otherwise(t)

    t = strip(text)
    return F.when(F.length(text) <= 256, exact.plain(exact.let(t, formatted) if accounting else t))


def fitting(text: Column) -> Column:
    """A plain literal as AMOUNT; null where that would round it or can't hold it."""
    return F.when(exact.fits(text, 27, 10), text.try_cast(AMOUNT))


def amount(text: Column, accounting: bool = True) -> Column:
    """decimal or null; null, too, for what AMOUNT can't hold exactly (amount_text has those)."""
    return fitting(amount_text(text, accounting))


def amount_tolerance(tolerance: str) -> Column:
    """The tolerance for differences of two AMOUNTs: both have 10 places, so its further places don't matter, nor what it
    exceeds their largest distance by."""
    return F.lit(min(Decimal(tolerance), Decimal("2e27")).quantize(Decimal("1e-10"), ROUND_FLOOR, Context(prec=60))).cast(AMOUNT)


def close(left: Column, right: Column, tolerance: str) -> Column:
    """|left - right| <= tolerance of two plain literals, exactly. Those that fit AMOUNT are compared as such."""
    t = amount_tolerance(tolerance)
    texts = F.struct(left.alias("l"), right.alias("r"), fitting(left).alias("a"), fitting(right).alias("b"))
    near = lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), F.abs(x["a"] - x["b"]) <= t).otherwise(exact.within(x["l"], x["r"], tolerance))
    return exact.let(texts, near)


def rich(literal: Column) -> Column:
    """struct<kind, value, currency, percent, places, parentheses> of a literal from a financial table."""
    # fixed values: the minus sign and brackets of wide forms
    text = F.translate(strip(literal), "−（）", "-()")
    negative = text.rlike(r"^\(.*\)$")
    inner = F.when(negative, strip(F.regexp_extract(text, r"^\((.*)\)$", 1))).otherwise(text)
    raw = F.upper(F.regexp_extract(inner, CURRENCY, 1))
    currency = raw
    for k, v in CURRENCIES.items():
        currency = F.when(raw == k, F.lit(v)).otherwise(currency)
    body = F.regexp_replace(inner, CURRENCY, "")
    percent = body.rlike("[%％]$")
    body = F.when(percent, strip(F.regexp_replace(body, "[%％]$", ""))).otherwise(body)
    clean = F.regexp_replace(body, "[,  ]", "")
    digits = F.regexp_replace(clean, r"^[+-]+", "")
    bad = ~body.rlike(RICH) | (negative & clean.rlike("^[+-]")) | (F.length(F.replace(digits, F.lit("."), F.lit(""))) > 40)
    kind = (
        F.when(literal.isNull(), "unknown")
        .when(text == "", "blank")
        .when(text.isin("—", "–", "-", "--", "－"), "dash")
        .when((F.length(text) > 100) | bad, "unknown")
        .when((F.length(digits) > 1) & digits.startswith("0") & ~digits.startswith("0."), "identifier")
        .otherwise("number")
    )
    number = kind == "number"
    value = clean.try_cast(AMOUNT) * F.when(negative, -1).otherwise(1) * F.when(percent, F.lit(0.01).cast("decimal(3,2)")).otherwise(F.lit(1).cast("decimal(3,2)"))
    return F.struct(
        kind.alias("kind"),
        F.when(number, value.cast(AMOUNT)).alias("value"),
        F.when(number & (currency != ""), currency).alias("currency"),
        F.when(number, percent).alias("percent"),
        F.when(number, F.length(F.regexp_extract(digits, r"\.(\d+)$", 1))).alias("places"),
        F.when(number, negative).alias("parentheses"),
    )


def unit(text: Column) -> Column:
    """The unit that a text names, if it names just one."""
    # fixed values: unit names, and the two forms that name one
    names = "百万元|百萬元|千元|万元|萬元|亿元|億元|元"
    a = F.regexp_extract_all(text, F.lit(rf"(?:单位|單位)\s*[:：]\s*(?:(?:人民币|人民幣|港币|港幣|美元)\s*)?({names})"), 1)
    b = F.regexp_extract_all(text, F.lit(rf"[（(]\s*({names})\s*[)）]"), 1)
    hits = F.array_distinct(F.concat(a, b))
    return F.when(F.size(hits) == 1, hits[0])
