"""Decimal literals of any length as text: order keys, differences and sums without rounding, by built-in functions.

A number's text has up to DIGITS digits before the point and as many after it. Where arithmetic is needed it is a vector
of limbs, LIMB digits each, highest first; sums of limbs may leave that range, and carry() brings them back into it.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = 27
LIMBS = 24
DIGITS = LIMB * LIMBS // 2
WIDE = "decimal(38,0)"
NUMBER = r"^([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?$"
#: what plain() leaves as it is
PLAIN = rf"^-?(0|[1-9]\d{{0,{DIGITS - 1}}})(\.\d{{1,{DIGITS}}})?$"
VALID = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,4})?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it; the plan stays small, too."""
    return F.transform(F.array(value), body)[0]


def plain(text: Column) -> Column:
    """The literal without plus sign, padding zeros, a bare point or an exponent; its digits after the point stay.
    Null for what isn't a finite decimal, or has more than DIGITS digits on a side of the point."""
    return F.when(text.rlike(PLAIN), text).otherwise(let(text, lambda t: F.when(t.rlike(VALID), F.when(t.rlike("[eE]"), _moved(t)).otherwise(_bounded(t)))))


def short(text: Column) -> Column:
    """The literal itself if it is a decimal without an exponent, else null: all that short literals need."""
    return F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), text)


def _bounded(t: Column) -> Column:
    zeros = F.regexp_replace(F.regexp_replace(t, r"^(?<s>-?)\+?0*(?=\d)|\.$", "${s}"), r"^(?<s>-?)\+?\.", "${s}0.")
    return F.when(t.rlike(rf"^[+-]?0*\d{{0,{DIGITS}}}(\.\d{{0,{DIGITS}}})?$"), zeros)


def _moved(t: Column) -> Column:
    """The digits of a literal with an exponent, with the point where it belongs."""
    part = lambda i: F.regexp_extract(t, NUMBER, i)
    read = F.struct(F.concat(part(2), part(3)).alias("digits"), (F.length(part(2)) + part(4).try_cast("int")).alias("point"), F.when(part(1) == "-", "-").otherwise("").alias("sign"))

    def written(x: Column) -> Column:
        digits, point, n = x["digits"], x["point"], F.length(x["digits"])
        whole = F.when(point <= 0, F.lit("0")).otherwise(F.rpad(F.substr(digits, F.lit(1), point), point, F.lit("0")))
        after = F.when(point >= n, F.lit("")).when(point >= 0, F.substr(digits, point + 1)).otherwise(F.lpad(digits, n - point, F.lit("0")))
        return F.when(F.abs(point) <= 4 * DIGITS, _bounded(F.concat(x["sign"], whole, F.when(after != "", F.concat(F.lit("."), after)).otherwise(""))))

    return let(read, lambda x: let(written(x), lambda w: w))


def parts(text: Column) -> Column:
    """struct<below, whole, after>: is it below zero, its digits before the point, and those after it, without padding
    zeros; of a plain() text."""
    whole = F.ltrim(F.substring_index(F.ltrim(text, F.lit("-")), ".", 1), F.lit("0"))
    after = F.when(F.instr(text, ".") > 0, F.rtrim(F.substring_index(text, ".", -1), F.lit("0"))).when(text.isNotNull(), "")
    read = F.struct(text.startswith("-").alias("minus"), whole.alias("whole"), after.alias("after"))
    return let(read, lambda x: F.struct((x["minus"] & ((x["whole"] != "") | (x["after"] != ""))).alias("below"), x["whole"].alias("whole"), x["after"].alias("after")))


def order_key(text: Column) -> Column:
    """Text that sorts as the plain() numbers do, equal where they are equal."""

    def key(p: Column) -> Column:
        size = F.concat(F.lpad(F.length(p["whole"]).cast("string"), 3, "0"), p["whole"], F.lit("."), p["after"])
        return F.when(p["below"], F.concat(F.lit("N"), F.translate(size, "0123456789", "9876543210"), F.lit("~"))).otherwise(F.concat(F.lit("P"), size))

    return let(parts(text), key)


def order_key_of(value: str) -> str:
    """The order key of a literal, on the driver."""
    n = Decimal(value)
    if not n.is_finite():
        raise ValueError(value)
    sign, whole, after = n < 0, *(f"{n.copy_abs():f}".split(".") + [""])[:2]
    whole, after = whole.lstrip("0"), after.rstrip("0")
    if max(len(whole), len(after)) > DIGITS:
        raise ValueError(f"more than {DIGITS} digits on a side of the point")
    key = f"{len(whole):03d}{whole}.{after}"
    return "N" + key.translate(str.maketrans("0123456789", "9876543210")) + "~" if sign else "P" + key


def fits(text: Column, whole: int, after: int) -> Column:
    """Does a plain() text have at most so many digits before and after the point?"""
    return text.rlike(rf"^-?\d{{1,{whole}}}(\.\d{{1,{after}}}0*)?$")


def limbs(text: Column) -> Column:
    """array<decimal> of LIMBS limbs of a plain() text, each with the number's sign."""

    def cut(p: Column) -> Column:
        digits = F.concat(F.lpad(p["whole"], DIGITS, "0"), F.rpad(p["after"], DIGITS, "0"))
        sign = F.when(p["below"], F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
        read = F.struct(digits.alias("digits"), sign.alias("sign"))
        return let(read, lambda d: F.transform(F.sequence(F.lit(0), F.lit(LIMBS - 1)), lambda i: (F.substr(d["digits"], i * LIMB + 1, F.lit(LIMB)).cast(f"decimal({LIMB},0)") * d["sign"]).cast(WIDE)))

    return F.when(text.isNotNull(), let(parts(text), cut))


def limb_columns(text: Column, length: int) -> dict[int, Column]:
    """The limbs, by their places in limbs(), that a plain() text of at most so many characters can fill; as columns of
    their own they are cut and summed without arrays. All other limbs are zero."""
    n = min(-(-length // LIMB), LIMBS // 2)
    bare = F.regexp_replace(text, "^-", "")
    whole = F.lpad(F.substring_index(bare, ".", 1), n * LIMB, "0")
    after = F.rpad(F.when(F.instr(bare, ".") > 0, F.substring_index(bare, ".", -1)).otherwise(""), n * LIMB, "0")
    sign = F.when(text.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    cut = lambda side, i: (F.substring(side, i * LIMB + 1, LIMB).cast(f"decimal({LIMB},0)") * sign).cast(f"decimal({LIMB},0)")
    half = LIMBS // 2
    return {half - n + i: cut(whole, i) for i in range(n)} | {half + i: cut(after, i) for i in range(n)}


def limbs_of(value: str) -> list[Decimal]:
    n = Decimal(value)
    whole, after = (f"{n.copy_abs():f}".split(".") + [""])[:2]
    half = LIMB * LIMBS // 2
    digits = whole.zfill(half) + after.ljust(half, "0")
    return [Decimal(digits[i : i + LIMB]) * (-1 if n < 0 else 1) for i in range(0, 2 * half, LIMB)]


def sign_of(v: Column) -> Column:
    """-1, 0 or 1 for a vector whose limbs are below three times their range: what lies above a limb outweighs the rest
    once it is four or more, so it is cut there."""
    base = F.lit(Decimal(10**LIMB)).cast("decimal(28,0)")
    four = F.lit(Decimal(4)).cast(WIDE)
    step = lambda acc, x: (F.greatest(F.least(acc, four), -four) * base + x).cast(WIDE)
    return F.signum(F.aggregate(v, F.lit(Decimal(0)).cast(WIDE), step).cast("double")).cast("int")


def within(left: Column, right: Column, tolerance: str) -> Column:
    """|left - right| <= tolerance for two plain() texts."""
    bound = F.array(*(F.lit(x).cast(WIDE) for x in limbs_of(tolerance)))

    def ordered(p: Column) -> Column:
        up = order_key(p["l"]) >= order_key(p["r"])
        return let(up, lambda u: F.zip_with(limbs(F.when(u, p["l"]).otherwise(p["r"])), limbs(F.when(u, p["r"]).otherwise(p["l"])), lambda a, b: (a - b).cast(WIDE)))

    # what decimals hold needs no limbs; a difference of two such has 31 digits before the point
    bound_, near = Decimal(tolerance), None
    if bound_.is_finite() and abs(bound_) < 10**30 and bound_.as_tuple().exponent >= -7:
        number = lambda t: F.when(fits(t, 30, 7), t.try_cast("decimal(37,7)"))
        near = F.abs(number(left) - number(right)) <= F.lit(bound_).cast("decimal(38,7)")
    both = let(F.struct(left.alias("l"), right.alias("r")), lambda p: F.when(p["l"].isNotNull() & p["r"].isNotNull(), ordered(p)))
    exact = sign_of(F.zip_with(both, bound, lambda a, b: (a - b).cast(WIDE))) <= 0
    return exact if near is None else F.coalesce(near, exact)


def carried(v: Column) -> Column:
    """struct<out, carry>: the limbs of a vector in [0, 10^LIMB), lowest first, and what is left above them."""
    base = F.lit(Decimal(10**LIMB)).cast("decimal(28,0)")
    start = F.struct(F.array().cast(f"array<{WIDE}>").alias("out"), F.lit(Decimal(0)).cast(WIDE).alias("carry"))

    def step(acc: Column, x: Column) -> Column:
        n = (acc["carry"] + x).cast(WIDE)
        low = F.pmod(n, base).cast(WIDE)
        return F.struct(F.concat(acc["out"], F.array(low)).alias("out"), ((n - low).cast(WIDE) / base).cast(WIDE).alias("carry"))

    return F.aggregate(F.reverse(v), start, step)


def text_of(v: Column, places: Column) -> Column:
    """The number that a vector of summed limbs stands for, with so many places; null if it has more than DIGITS digits
    before the point."""

    def signed(x: Column) -> Column:
        flip = let(carried(x)["carry"] < 0, lambda m: F.struct(m.alias("minus"), F.transform(x, lambda y: F.when(m, -y).otherwise(y).cast(WIDE)).alias("limbs")))
        return let(flip, lambda f: let(F.struct(f["minus"].alias("minus"), carried(f["limbs"]).alias("done")), text))

    def text(r: Column) -> Column:
        digits = F.array_join(F.transform(F.reverse(r["done"]["out"]), lambda y: F.lpad(y.cast("string"), LIMB, "0")), "")
        whole = F.regexp_replace(F.substring(digits, 1, DIGITS), r"^0+(?=\d)", "")
        after = F.when(places > 0, F.concat(F.lit("."), F.substr(digits, F.lit(DIGITS + 1), places))).otherwise("")
        return F.when(r["done"]["carry"] == 0, F.concat(F.when(r["minus"], "-").otherwise(""), whole, after))

    return F.when(v.isNotNull(), let(v, signed))
