"""Cells: a literal with its kind, so that null, '', 0 and an uncomputed formula stay distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: the closed set of kinds
KINDS = ("null", "text", "decimal", "integer", "boolean", "date", "error", "unknown_formula")
CELL = "struct<kind:string,raw:string,value:string,formula:string,warning:string>"


def cell(kind: Column | str, value: Column, raw: Column | None = None, warning: Column | None = None, formula: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    kind = F.when(value.isNull() & (kind != "unknown_formula"), F.lit("null")).otherwise(kind)
    return F.struct(
        kind.alias("kind"),
        (value if raw is None else raw).cast("string").alias("raw"),
        value.cast("string").alias("value"),
        (none if formula is None else formula).alias("formula"),
        (none if warning is None else F.when(value.isNotNull(), warning)).alias("warning"),
    )


def typed(value: Column, dtype: T.DataType) -> Column:
    """The cell of a typed column; binary and nested types are rejected."""
    if isinstance(dtype, T.StringType):
        return cell("text", value)
    if isinstance(dtype, T.BooleanType):
        return cell("boolean", value.cast("string"))
    if isinstance(dtype, T.IntegralType):
        return cell("integer", value.cast("string"))
    if isinstance(dtype, T.DecimalType):
        return cell("decimal", value.cast("string"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        finite = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.when(value.isNotNull(), F.raise_error(F.lit("non-finite number"))).cast("double")).otherwise(value)
        return cell("decimal", finite.cast("string"), warning=F.lit("binary_float_source"))
    if isinstance(dtype, T.DateType):
        return cell("date", value.cast("string"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return cell("text", F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    raise ValueError(f"nested or binary columns aren't tables of cells: {dtype.simpleString()}")


def row_id(revision: str, source_row: Column) -> Column:
    """'r' and 32 hex digits of sha256(revision:row)."""
    return F.concat(F.lit("r"), F.substring(F.sha2(F.concat_ws(":", F.lit(revision), source_row.cast("string")), 256), 1, 32))


def to_cells(df: DataFrame, order: str, revision: str = "rev", columns: list[str] | None = None) -> DataFrame:
    """row_id, source_row and one cell column c1.. for each column; headers stay in the metadata.

    order names a unique integer column that numbers the source rows, so no global sort is needed.
    """
    names = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    source = F.col(order).cast("long") + 1
    return df.select(row_id(revision, source).alias("row_id"), source.alias("source_row"), *(typed(F.col(n), types[n]).alias(f"c{i}", metadata={"header": n}) for i, n in enumerate(names, 1)))


def headers(df: DataFrame) -> dict[str, str | None]:
    return {f.name: f.metadata.get("header") for f in df.schema.fields if f.name.startswith("c")}


def described(df: DataFrame) -> DataFrame:
    """A row for each column of a cell table: name, role (locator or business), header, rows, nulls, warnings, and the kinds of
    its cells in order. One pass, as counts and flags that combine on the map side."""
    names = headers(df)
    kinds = ("text", "boolean", "integer", "decimal", "date", "unknown_formula", "error")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in names:
        kind = F.col(c)["kind"]
        aggs += [F.count_if(kind == "null").alias(f"{c}_nulls"), F.count_if(F.col(c)["warning"].isNotNull()).alias(f"{c}_warnings")]
        aggs += [F.coalesce(F.bool_or(kind == k), F.lit(False)).alias(f"{c}_{k}") for k in kinds]
    one = df.agg(*aggs)
    none = F.lit(None).cast("string")

    def row(c: str):
        if c not in names:
            return F.struct(F.lit(c).alias("name"), F.lit("locator").alias("role"), none.alias("header"), F.col("rows"), F.lit(0).cast("long").alias("nulls"), F.lit(0).cast("long").alias("warnings"), none.alias("kinds"))
        seen = F.concat_ws(",", *(F.when(F.col(f"{c}_{k}"), k) for k in kinds))
        return F.struct(F.lit(c).alias("name"), F.lit("business").alias("role"), F.lit(names[c]).alias("header"), F.col("rows"), F.col(f"{c}_nulls").alias("nulls"), F.col(f"{c}_warnings").alias("warnings"), seen.alias("kinds"))

    return one.select(F.inline(F.array(*map(row, df.columns))))
