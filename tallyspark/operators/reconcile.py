"""Exact one-to-one reconciliation of two cell tables.

Every input row lands in one category: same, different, only_left, only_right, ambiguous_left or ambiguous_right. A key
that occurs more than once on a side is ambiguous; rows are never paired many to many.

A first aggregation counts each key on both sides; it combines on the map side, so a key with very many rows costs one
row a task. Rows of keys that no side repeats then meet in one join by key, in which no key can be hot; the rows of repeated
keys are only picked out. Each side is read once for the counts and once for each of these two.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.exact import let, order_key_of
from tallyspark.functions.exact import short as short_literal
from tallyspark.functions.money import AMOUNT, amount_text, amount_tolerance, close, fitting, strip
from tallyspark.functions.text import folded

CATEGORIES = ("same", "different", "only_left", "only_right", "ambiguous_left", "ambiguous_right")


@dataclass(frozen=True)
class Spec:
    """keys and compare: pairs (left column, right column). amounts: left columns compared as numbers."""

    keys: tuple[tuple[str, str], ...]
    compare: tuple[tuple[str, str], ...] = ()
    amounts: frozenset[str] = field(default_factory=frozenset)
    tolerance: str = "0"
    type_policy: str = "strict"
    null_policy: str = "never_match"
    trim_text: bool = False
    casefold_text: bool = False
    amount_format: str = "plain-decimal-v1"

    def __post_init__(self):
        if not self.keys or self.type_policy not in ("strict", "text") or self.null_policy not in ("never_match", "equal"):
            raise ValueError("bad policy")
        if Decimal(self.tolerance) < 0 or not self.amounts <= {a for a, _ in self.compare}:
            raise ValueError("bad amounts")


def token(c: Column, spec: Spec) -> Column:
    """The text that two equal cells share; null where a cell never matches."""
    value = c["value"]
    if spec.type_policy == "text":
        # plain ASCII needs no Unicode forms; only other texts go to the Arrow function
        ascii_ = value.rlike(r"^[\x00-\x7F]*$")
        plain = strip(value) if spec.trim_text else value
        plain = F.lower(plain) if spec.casefold_text else plain
        value = F.when(ascii_, plain).otherwise(folded(F.when(~ascii_, value), F.lit(spec.trim_text), F.lit(spec.casefold_text)))
    kind = F.lit("text") if spec.type_policy == "text" else c["kind"]
    null = F.lit('["null",null]') if spec.null_policy == "equal" else F.lit(None).cast("string")
    return F.when(c["kind"] == "unknown_formula", F.lit(None).cast("string")).when(c["kind"] == "null", null).otherwise(F.to_json(F.array(kind, value)))


#: a literal of so many characters without an exponent fits money.AMOUNT, whatever it says
SHORT = 11


def short_amounts(left: DataFrame, right: DataFrame, spec: Spec) -> bool:
    """Whether all compared amounts are short, so that decimals hold them: one small aggregate a side over lengths."""
    for df, at in ((left, 0), (right, 1)):
        names = [p[at] for p in spec.compare if p[0] in spec.amounts]
        if names:
            value = lambda a: F.col(a)["value"]
            long = F.greatest(F.lit(0), *(F.when(value(a).rlike("[eE]"), 1 << 20).otherwise(F.length(value(a))) for a in names))
            if (df.agg(F.max(long)).first()[0] or 0) > SHORT:
                return False
    return True


def equal(left: Column, right: Column, spec: Spec, is_amount: bool, short: bool = False) -> Column:
    nulls = (left["kind"] == "null") & (right["kind"] == "null")
    odd = left["kind"].isin("null", "unknown_formula") | right["kind"].isin("null", "unknown_formula")
    if is_amount and short and spec.amount_format != "financial-v1":
        number = lambda c: F.when(c["kind"].isin("text", "decimal", "integer"), short_literal(strip(c["value"])).try_cast(AMOUNT))
        same = F.coalesce(F.abs(number(left) - number(right)) <= amount_tolerance(spec.tolerance), F.lit(False))
    elif is_amount:
        accounting = spec.amount_format == "financial-v1"
        number = lambda c: F.when(c["kind"].isin("text", "decimal", "integer"), amount_text(c["value"], accounting))
        same = let(F.struct(number(left).alias("l"), number(right).alias("r")), lambda x: F.coalesce(close(x["l"], x["r"], spec.tolerance), F.lit(False)))
    else:
        same = F.coalesce(token(left, spec) == token(right, spec), F.lit(False))
    return F.when(nulls, F.lit(spec.null_policy == "equal")).when(odd, F.lit(False)).otherwise(same)


def _keyed(df: DataFrame, at: int, spec: Spec, cols: list[str]) -> DataFrame:
    """key_json (null where a key cell matches nothing) and row: row_id, source_row and the cells of cols."""
    tokens = [token(F.col(k[at]), spec) for k in spec.keys]
    known = F.lit(True)
    for t in tokens:
        known = known & t.isNotNull()
    return df.select(F.when(known, F.to_json(F.array(*tokens))).alias("key_json"), F.struct("row_id", "source_row", *cols).alias("row"))


def _side(df: DataFrame, at: int, spec: Spec) -> DataFrame:
    return _keyed(df, at, spec, list(dict.fromkeys(k[at] for k in (*spec.keys, *spec.compare))))


def key_counts(left: DataFrame, right: DataFrame, spec: Spec) -> DataFrame:
    """key_json, n_l, n_r: how often each key occurs on both sides. Only keys and numbers are shuffled, counted in each task
    first, so a key that a third of all rows has is one row a task."""
    keys = lambda df, at, l, r: _keyed(df, at, spec, []).filter("key_json is not null").select("key_json", F.lit(l).alias("l"), F.lit(r).alias("r"))  # noqa: E731, E741
    both = keys(left, 0, 1, 0).unionByName(keys(right, 1, 0, 1))
    return both.groupBy("key_json").agg(F.sum("l").alias("n_l"), F.sum("r").alias("n_r"))


def differences(spec: Spec, short: bool) -> Column:
    """The compared columns in which L and R differ."""
    if not spec.compare:
        return F.expr("cast(array() as array<string>)")
    return F.array_compact(F.array(*(F.when(~equal(F.col("L")[a], F.col("R")[b], spec, a in spec.amounts, short), F.lit(f"{a}:{b}")) for a, b in spec.compare)))


def _pairs(left: DataFrame, right: DataFrame, repeated: DataFrame, how: str) -> DataFrame:
    """key_json, L, R: the rows of keys that no side repeats, brought together."""
    once = lambda df, name: df.filter("key_json is not null").join(repeated, "key_json", "left_anti").select("key_json", F.col("row").alias(name))
    return once(left, "L").join(once(right, "R"), "key_json", how)


def reconcile(left: DataFrame, right: DataFrame, spec: Spec) -> DataFrame:
    """category, reason, key_json, left_row_id, left_source_row, right_row_id, right_source_row, different_columns, L, R."""
    lhs, rhs = _side(left, 0, spec), _side(right, 1, spec)
    repeated = key_counts(left, right, spec).filter("n_l > 1 or n_r > 1").select("key_json")
    single = _pairs(lhs, rhs, repeated, "full_outer")
    pair = F.col("L").isNotNull() & F.col("R").isNotNull()
    single = single.withColumn("different_columns", F.when(pair, differences(spec, short_amounts(left, right, spec))))
    category = F.when(pair, F.when(F.size("different_columns") == 0, "same").otherwise("different")).when(F.col("L").isNotNull(), "only_left").otherwise("only_right")
    single = single.withColumn("category", category).withColumn("reason", F.when(~pair, "no_match"))
    none_l, none_r = (F.lit(None).cast(x.schema["row"].dataType) for x in (lhs, rhs))
    both = lhs.select("key_json", F.col("row").alias("L"), none_r.alias("R")).unionByName(rhs.select("key_json", none_l.alias("L"), F.col("row").alias("R")))
    none = F.lit(None).cast("array<string>")
    # a second key that the first determines lets AQE split a key with very many rows
    many = repeated.withColumn("h", F.xxhash64("key_json"))
    members = both.filter("key_json is not null").withColumn("h", F.xxhash64("key_json")).join(many, ["key_json", "h"], "left_semi").drop("h")
    members = members.withColumn("category", F.when(F.col("L").isNotNull(), "ambiguous_left").otherwise("ambiguous_right")).withColumn("reason", F.lit("repeated_key")).withColumn("different_columns", none)
    loose = both.filter("key_json is null").withColumn("category", F.when(F.col("L").isNotNull(), "only_left").otherwise("only_right")).withColumn("reason", F.lit("null_or_unknown_key")).withColumn("different_columns", none)
    cols = ["category", "reason", "key_json", "different_columns", "L", "R"]
    out = single.select(*cols).unionByName(members.select(*cols)).unionByName(loose.select(*cols))
    return out.select("category", "reason", "key_json", F.col("L.row_id").alias("left_row_id"), F.col("L.source_row").alias("left_source_row"), F.col("R.row_id").alias("right_row_id"), F.col("R.source_row").alias("right_source_row"), "different_columns", "L", "R")


def coverage(result: DataFrame) -> DataFrame:
    """One row: totals of both sides, and rows or pairs of each category. Totals equal the inputs' rows."""
    n = lambda *c: F.count_if(F.col("category").isin(*c))
    return result.agg(
        n("same", "different", "only_left", "ambiguous_left").alias("left_total"),
        n("same", "different", "only_right", "ambiguous_right").alias("right_total"),
        n("same").alias("same"),
        n("different").alias("different"),
        n("only_left").alias("only_left"),
        n("only_right").alias("only_right"),
        n("ambiguous_left").alias("ambiguous_left"),
        n("ambiguous_right").alias("ambiguous_right"),
        F.count_distinct(F.when(F.col("category").startswith("ambiguous"), F.col("key_json"))).alias("ambiguous_keys"),
    )


def covered(left: DataFrame, right: DataFrame, spec: Spec) -> DataFrame:
    """What coverage(reconcile(left, right, spec)) gives, from the keys' counts: rows meet only where cells are compared."""
    counts = key_counts(left, right, spec)
    many = (F.col("n_l") > 1) | (F.col("n_r") > 1)
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    c = counts.agg(
        F.count_if((F.col("n_l") == 1) & (F.col("n_r") == 1)).alias("pairs"),
        F.count_if((F.col("n_l") == 1) & (F.col("n_r") == 0)).alias("only_left"),
        F.count_if((F.col("n_l") == 0) & (F.col("n_r") == 1)).alias("only_right"),
        total("n_l", many).alias("ambiguous_left"),
        total("n_r", many).alias("ambiguous_right"),
        F.count_if(many).alias("ambiguous_keys"),
    )
    loose = lambda df, at, name: _keyed(df, at, spec, []).filter("key_json is null").agg(F.count(F.lit(1)).alias(name))
    c = c.withColumns({"loose_left": loose(left, 0, "n").scalar(), "loose_right": loose(right, 1, "n").scalar()})
    different = F.lit(0).cast("long")
    if spec.compare:
        pairs = _pairs(_side(left, 0, spec), _side(right, 1, spec), counts.filter(many).select("key_json"), "inner")
        different = pairs.select(differences(spec, short_amounts(left, right, spec)).alias("d")).agg(F.count_if(F.size("d") > 0).alias("n")).scalar()
    c = c.withColumn("different", different).withColumns({"only_left": F.col("only_left") + F.col("loose_left"), "only_right": F.col("only_right") + F.col("loose_right")})
    same = F.col("pairs") - F.col("different")
    sides = [(F.col("pairs") + F.col(f"only_{s}") + F.col(f"ambiguous_{s}")).alias(f"{s}_total") for s in ("left", "right")]
    return c.select(*sides, same.alias("same"), "different", "only_left", "only_right", "ambiguous_left", "ambiguous_right", "ambiguous_keys")


def deltas(result: DataFrame, spec: Spec) -> DataFrame:
    """A row for each compared amount of each pair: left, right, delta and whether it is within the tolerance.

    Amounts and deltas are decimals with 10 places, null where those can't hold an amount exactly; the verdict is exact
    for amounts of any length."""
    accounting = spec.amount_format == "financial-v1"
    text = lambda c: amount_text(c["value"], accounting)
    each = F.array(*(F.struct(F.lit(f"{a}:{b}").alias("field"), text(F.col("L")[a]).alias("l"), text(F.col("R")[b]).alias("r")) for a, b in spec.compare if a in spec.amounts))
    df = result.filter("L is not null and R is not null").select("left_row_id", "right_row_id", F.explode(each).alias("x")).select("left_row_id", "right_row_id", "x.*")
    df = df.withColumns({"left_amount": fitting(F.col("l")), "right_amount": fitting(F.col("r"))})
    df = df.withColumn("delta", F.col("right_amount") - F.col("left_amount")).withColumn("within_tolerance", F.coalesce(close(F.col("l"), F.col("r"), spec.tolerance), F.lit(False)))
    return df.drop("l", "r")


def digest(df: DataFrame) -> str:
    """A hash of a table's rows whatever their order: counts and sums of two 64-bit hashes a row, one row to the driver."""
    row = F.struct(*df.columns)
    sums = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")) for seed in (1, 2)]
    return hashlib.sha256(repr(tuple(map(str, df.agg(F.count(F.lit(1)), *sums).first()))).encode()).hexdigest()


def comparison_id(left_revision: str, right_revision: str, spec: Spec, left: DataFrame, right: DataFrame) -> str:
    """The name of a comparison: the same for equal revisions, rows and policy, and for nothing else."""
    policy = asdict(spec) | {"amounts": sorted(spec.amounts), "tolerance": order_key_of(spec.tolerance)}
    body = {"left": [left_revision, digest(left)], "right": [right_revision, digest(right)], "policy": policy}
    return "cmp" + hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:32]
