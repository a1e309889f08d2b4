"""The closed set of cleaning steps over cell tables (row_id, source_row, c1..cN). Each step is lazy.

A step gives the changed table; steps that reject values also give a table of errors (row_id, source_row, column, code,
raw). Nothing is collected: events are counted by events().
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import exact
from tallyspark.functions.money import strip

OPERATORS = ("trim", "trim_columns", "rename", "map", "cast", "filter", "filter_compare", "group_summary", "duplicates")
MAX_MAP = 1000
#: amounts of at most so many digits before and after the point are summed as this type; longer ones by limbs
WHOLE, PLACES = 15, 12
EXACT = f"decimal({WHOLE + PLACES},{PLACES})"


class StepError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    operator: str
    parameters: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise StepError(f"unknown operator {self.operator}")
        p = self.parameters
        if self.operator == "map" and not (0 < len(p.get("values", {})) <= MAX_MAP):
            raise StepError("a map has 1 to 1000 entries")
        if self.operator == "cast" and p.get("target") not in ("decimal", "integer", "boolean", "date"):
            raise StepError("unknown target of a cast")
        if self.operator == "filter" and p.get("condition") not in ("is_null", "not_null", "equals", "not_equals"):
            raise StepError("unknown condition")
        if self.operator == "filter_compare":
            if p.get("comparison") not in ("gt", "ge", "lt", "le", "between") or p.get("value_kind") not in ("decimal", "date", "text"):
                raise StepError("unknown comparison")
            if p["comparison"] == "between" and _literal(p["value_kind"], p["value"]) > _literal(p["value_kind"], p["upper"]):
                raise StepError("the interval is reversed")

    def revision(self, parent: str) -> str:
        """sha256 of the canonical JSON of parent and step: known before any data is read."""
        body = {"parent": parent, "step": {"operator": self.operator, "parameters": self.parameters}}
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def _literal(kind: str, value: str):
    from decimal import Decimal

    return Decimal(value) if kind == "decimal" else date.fromisoformat(value) if kind == "date" else value


def with_cell(c: Column, kind: Column, value: Column) -> Column:
    return F.struct(kind.alias("kind"), c["raw"].alias("raw"), value.alias("value"), c["formula"].alias("formula"), c["warning"].alias("warning"))


def trim(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unicode white space off text cells; raw stays."""
    if len(set(columns)) != len(columns):
        raise StepError("columns repeat")
    return df.withColumns({c: F.when(F.col(c)["kind"] == "text", with_cell(F.col(c), F.col(c)["kind"], strip(F.col(c)["value"]))).otherwise(F.col(c)).alias(c, metadata=df.schema[c].metadata) for c in columns})


def rename(df: DataFrame, column: str, header: str) -> DataFrame:
    return df.withMetadata(column, {**df.schema[column].metadata, "header": header})


def map_values(df: DataFrame, column: str, values: dict[str, str]) -> DataFrame:
    """Exact values of text cells replaced; others pass."""
    lookup = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    c = F.col(column)
    return df.withColumn(column, F.when(c["kind"] == "text", with_cell(c, c["kind"], F.coalesce(lookup[c["value"]], c["value"]))).otherwise(c).alias(column, metadata=df.schema[column].metadata))


#: a number as plain_decimal() leaves it, one with white space around it, and one with an exponent
BARE_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"
PLAIN_NUMBER = r"(?U)^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$"
EXPONENT_NUMBER = r"(?U)^\s*[+-]?(\d+(\.\d*)?|\.\d+)[eE][+-]?\d+\s*$"


def plain_decimal(v: Column) -> Column:
    """A decimal literal as written, without plus sign, padding zeros or a bare point. Exponents are written out, digit
    by digit; one that needs more than exact.DIGITS places isn't a decimal.

    Each part is one replacement after the other on the same value, so a filter that Spark pushes below it stays small.
    """
    text = F.regexp_replace(v, r"(?U)^\s*\+?|\.?\s*$", "")
    text = F.regexp_replace(text, r"^(?<s>-?)0+(?=\d)", "${s}")
    text = F.regexp_replace(text, r"^(?<s>-?)\.", "${s}0.")
    return F.when(v.rlike(BARE_NUMBER), v).when(v.rlike(PLAIN_NUMBER), text).when(v.rlike(EXPONENT_NUMBER), exact.plain(strip(v)))


#: fixed value: an ISO week date
WEEK = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?$"


def cast_value(df: DataFrame, c: Column, target: str) -> DataFrame:
    """df with _value, the cell's value as target, or null if it doesn't fit. Parts are columns, each computed once."""
    v = c["value"]
    if target in ("decimal", "integer"):
        value = F.when(c["kind"] != "boolean", plain_decimal(v))
        if target == "integer":
            whole = F.regexp_replace(value, r"^(-?\d+)\.0*$", "$1")
            value = F.when(whole.rlike(r"^-?\d+$"), F.regexp_replace(whole, "^-0$", "0"))
        return df.withColumn("_value", value)
    if target == "boolean":
        df = df.withColumn("_t", F.lower(strip(v)))
        return df.withColumn("_value", F.when(F.col("_t").isin("true", "1"), "true").when(F.col("_t").isin("false", "0"), "false")).drop("_t")
    part = lambda i: F.regexp_extract(v, WEEK, i).try_cast("int")
    df = df.withColumns({"_y": part(1), "_w": part(2), "_d": F.coalesce(part(3), F.lit(1))})
    fourth = F.make_date("_y", F.lit(1), F.lit(4))
    by_week = F.date_add(F.date_sub(fourth, F.weekday(fourth)), ((F.col("_w") - 1) * 7 + F.col("_d") - 1).cast("int"))
    ok = (F.col("_w") >= 1) & (F.col("_w") <= F.weekofyear(F.make_date("_y", F.lit(12), F.lit(28))))
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v.try_cast("date"))
    compact = F.when(v.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(v, 1, 4), F.substring(v, 5, 2), F.substring(v, 7, 2)).try_cast("date"))
    return df.withColumn("_value", F.coalesce(iso, compact, F.when(ok, by_week)).cast("string")).drop("_y", "_w", "_d")


def cast(df: DataFrame, column: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Null cells pass, an uncomputed formula and a value that doesn't fit stay as they are, with an error."""
    c = F.col(column)
    todo = ~c["kind"].isin("null", "unknown_formula")
    done = cast_value(df, c, target).withColumn("_value", F.when(todo, F.col("_value")))
    code = F.when(c["kind"] == "unknown_formula", "formula_cache_unknown").when(todo & F.col("_value").isNull(), f"invalid_{target}")
    errors = done.withColumn("code", code).filter("code is not null").select("row_id", "source_row", F.lit(column).alias("column"), "code", c["raw"].alias("raw"))
    out = done.withColumn(column, F.when(F.col("_value").isNotNull(), with_cell(c, F.lit(target), F.col("_value"))).otherwise(c).alias(column, metadata=df.schema[column].metadata)).drop("_value")
    return out, errors


def keep(df: DataFrame, column: str, condition: str, value: str | None = None) -> DataFrame:
    """is_null and not_null look at the kind; equals and not_equals at the value, and never keep nulls."""
    c = F.col(column)
    if condition == "is_null":
        return df.filter(c["kind"] == "null")
    if condition == "not_null":
        return df.filter(c["kind"] != "null")
    same = c["value"].eqNullSafe(F.lit(value))
    return df.filter((c["kind"] != "null") & (same if condition == "equals" else ~same))


def keep_compared(df: DataFrame, column: str, comparison: str, value_kind: str, value: str, upper: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed comparison; cells of another kind (nulls, too) are left out with an error. between is inclusive. Decimals of
    any length are compared without rounding, by keys that sort as they do."""
    c = F.col(column)
    kinds = c["kind"].isin("decimal", "integer") if value_kind == "decimal" else c["kind"] == value_kind
    if value_kind == "decimal":
        v, bound = exact.let(exact.plain(c["value"]), exact.order_key), lambda x: F.lit(exact.order_key_of(x))
    else:
        sql = {"date": "date", "text": "string"}[value_kind]
        v, bound = c["value"].try_cast(sql), lambda x: F.lit(x).cast(sql)
    lo = bound(value)

    def judge(v: Column) -> Column:
        fits = F.coalesce(kinds & v.isNotNull() if value_kind == "decimal" else kinds, F.lit(False))
        test = {"gt": v > lo, "ge": v >= lo, "lt": v < lo, "le": v <= lo}.get(comparison)
        if comparison == "between":
            test = (v >= lo) & (v <= bound(upper))
        return F.struct(fits.alias("fits"), (fits & test).alias("test"))

    # exploded, as a filter would be pushed below the casts before it, which then are computed again for each of its parts
    judged = df.withColumn("_fits", F.explode(F.array(exact.let(v, judge))))
    errors = judged.filter("not _fits.fits").select("row_id", "source_row", F.lit(column).alias("column"), F.lit("comparison_type_unknown").alias("code"), c["raw"].alias("raw"))
    return judged.filter("_fits.test").drop("_fits"), errors


def key_of(columns: list[str]) -> list[Column]:
    return [x for c in columns for x in (F.col(c)["kind"].alias(f"{c}_kind"), F.col(c)["value"].alias(f"{c}_value"))]


def long_amounts(df: DataFrame, amounts: list[str]) -> dict[str, int]:
    """The most characters of the amount columns that may hold amounts beyond EXACT: one small aggregate over lengths. A literal without an exponent
    of at most PLACES characters fits whatever it says."""
    if not amounts:
        return {}
    value = lambda a: F.col(a)["value"]
    most = df.agg(*(F.max(F.when(value(a).rlike("[eE]"), 1 << 20).otherwise(F.length(value(a)))).alias(a) for a in amounts)).first()
    return {a: most[a] for a in amounts if (most[a] or 0) > PLACES}


def group_summary(df: DataFrame, columns: list[str], amounts: list[str], lineage: bool = False) -> DataFrame:
    """Rows per distinct key (kind and value; nulls together) and an exact sum of each amount.

    One amount that isn't a number makes its group's sum an error cell, never a partial sum. Sums and counts combine on
    the map side; the lineage array, which holds a whole group, is only built when asked for. Only columns that long_amounts
    names (it runs a job when the plan is made) are summed limb by limb too, where EXACT can't hold an amount; only limbs that
    the longest literal can fill, each an aggregate of the same pass.
    """
    keys = key_of(columns)
    work, long = df, long_amounts(df, amounts)
    for a in amounts:
        c = F.col(a)
        work = work.withColumn(f"{a}_text", F.when(c["kind"].isin("decimal", "integer"), exact.plain(c["value"]) if a in long else exact.short(c["value"])))
        fits = exact.fits(F.col(f"{a}_text"), WHOLE, PLACES) if a in long else F.lit(True)
        work = work.withColumn(f"{a}_num", F.when(fits, F.col(f"{a}_text").try_cast(EXACT)))
    aggs = [F.count(F.lit(1)).alias("row_count"), F.min("source_row").alias("first_row")]
    for a in amounts:
        dot = F.instr(F.col(f"{a}_text"), F.lit("."))
        places = F.when(dot > 0, F.length(f"{a}_text") - dot).otherwise(0)
        aggs += [F.coalesce(F.sum(f"{a}_num"), F.lit(0).cast("decimal(37,12)")).alias(f"{a}_sum"), F.count_if(F.col(f"{a}_text").isNull()).alias(f"{a}_bad"), F.max(places).alias(f"{a}_scale")]
        if a in long:
            beyond = F.when(F.col(f"{a}_num").isNull(), F.col(f"{a}_text"))
            aggs += [F.sum(limb).alias(f"{a}_limb{at}") for at, limb in exact.limb_columns(beyond, long[a]).items()]
    if lineage:
        aggs.append(F.sort_array(F.collect_list(F.struct("source_row", "row_id"))).alias("source_rows"))
    out = work.groupBy(*keys).agg(*aggs)
    key_json = F.to_json(F.array(*(F.array(F.col(f"{c}_kind"), F.col(f"{c}_value")) for c in columns)))
    out = out.withColumn("row_id", F.concat(F.lit("r"), F.substring(F.sha2(key_json, 256), 1, 32)))
    for a in amounts:
        digits = F.col(f"{a}_sum").cast("decimal(38,12)").cast("string")
        total, frac = F.substring_index(digits, ".", 1), F.substr(F.substring_index(digits, ".", -1), F.lit(1), F.col(f"{a}_scale"))
        text = F.when(F.col(f"{a}_scale") > 0, F.concat(total, F.lit("."), frac)).otherwise(total)
        if a in long:
            held = {at: f"{a}_limb{at}" for at in range(exact.LIMBS) if f"{a}_limb{at}" in out.columns}
            vector = F.array(*(F.col(held[at]).cast(exact.WIDE) if at in held else F.lit(0).cast(exact.WIDE) for at in range(exact.LIMBS)))
            out = out.withColumn(f"{a}_long", F.when(F.col(next(iter(held.values()))).isNotNull(), vector)).drop(*held.values())
            parts = F.zip_with(exact.limbs(F.col(f"{a}_sum").cast("string")), f"{a}_long", lambda x, y: (x + y).cast(exact.WIDE))
            text = F.when(F.col(f"{a}_long").isNull(), text).otherwise(exact.text_of(parts, F.col(f"{a}_scale")))
        out = out.withColumn(f"{a}_total", F.when(F.col(f"{a}_bad") == 0, text))
        out = out.withColumn(f"{a}_kind", F.when(F.col(f"{a}_total").isNotNull(), "decimal").otherwise("error")).drop(f"{a}_sum", f"{a}_bad", f"{a}_scale", f"{a}_long")
    return out


def mark_duplicates(df: DataFrame, columns: list[str], include_null: bool = False) -> DataFrame:
    """Adds group_size where a key (kind and value) occurs more than once; no row is removed.

    Sizes are counted with partial sums and joined back on the key and its hash, so a key that holds much of the table is
    split over tasks instead of being gathered by a window.
    """
    key = F.struct(*key_of(columns))
    nulls = F.lit(False)
    for c in columns:
        nulls = nulls | (F.col(c)["kind"] == "null")
    work = df.withColumn("_key", key).withColumn("_h", F.xxhash64("_key")).withColumn("_use", F.lit(True) if include_null else ~nulls)
    size = work.filter("_use").groupBy("_key").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1").select(F.to_json("_key").alias("_k"), F.xxhash64("_key").alias("_h"), "group_size")
    hit = work.withColumn("_k", F.to_json("_key")).join(size, ["_k", "_h"], "left")
    return hit.withColumn("group_size", F.when(F.col("_use"), F.col("group_size"))).drop("_key", "_k", "_h", "_use")


def events(before: DataFrame, after: DataFrame, errors: DataFrame | None) -> DataFrame:
    """One row: input_rows, output_rows, errors_total."""
    n = before.agg(F.count(F.lit(1)).alias("input_rows")).crossJoin(after.agg(F.count(F.lit(1)).alias("output_rows")))
    if errors is None:
        return n.withColumn("errors_total", F.lit(0).cast("long"))
    return n.crossJoin(errors.agg(F.count(F.lit(1)).alias("errors_total")))


def fuse_trims(steps: list[Step]) -> list[Step]:
    """Neighbouring trims become one trim_columns."""
    out: list[Step] = []
    for s in steps:
        cols = [s.parameters["column"]] if s.operator == "trim" else s.parameters.get("columns") if s.operator == "trim_columns" else None
        if cols and out and out[-1].operator == "trim_columns":
            had = out[-1].parameters["columns"]
            out[-1] = Step("trim_columns", {"columns": [*had, *(c for c in cols if c not in had)]})
        elif cols:
            out.append(Step("trim_columns", {"columns": list(cols)}))
        else:
            out.append(s)
    return out


def remap(step: Step, columns: dict[str, str]) -> Step:
    """A saved step for a table whose columns have other ids."""
    p = {k: columns.get(v, v) if k == "column" else [columns.get(x, x) for x in v] if k in ("columns", "amount_columns") else v for k, v in step.parameters.items()}
    return Step(step.operator, p)


def resolve(df: DataFrame, name: str) -> str:
    """The id of a column named by its id or by a header that only it has."""
    if name in df.columns:
        return name
    found = [f.name for f in df.schema.fields if f.metadata.get("header") == name]
    if len(found) != 1:
        raise StepError(f"{len(found)} columns have the header {name!r}")
    return found[0]


def apply(df: DataFrame, step: Step) -> tuple[DataFrame, DataFrame | None]:
    """(table, errors or None) after a step."""
    p = step.parameters
    match step.operator:
        case "trim":
            return trim(df, [p["column"]]), None
        case "trim_columns":
            return trim(df, p["columns"]), None
        case "rename":
            return rename(df, p["column"], p["header"]), None
        case "map":
            return map_values(df, p["column"], p["values"]), None
        case "cast":
            return cast(df, p["column"], p["target"])
        case "filter":
            return keep(df, p["column"], p["condition"], p.get("value")), None
        case "filter_compare":
            return keep_compared(df, p["column"], p["comparison"], p["value_kind"], p["value"], p.get("upper"))
        case "group_summary":
            return group_summary(df, p["columns"], p.get("amount_columns", [])), None
        case "duplicates":
            return mark_duplicates(df, p["columns"], p.get("include_null", False)), None
    raise StepError(step.operator)


def replay(df: DataFrame, steps: list[Step], columns: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """All steps in turn; the errors of all of them together."""
    errors = None
    for s in fuse_trims([remap(s, columns or {}) for s in steps]):
        df, e = apply(df, s)
        errors = e if errors is None else errors if e is None else errors.unionByName(e)
    return df, errors


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    if not 1 <= limit <= 200:
        raise StepError("a page has 1 to 200 rows")
    return df.orderBy("source_row").offset(offset).limit(limit)
