"""Fact alignment of two documents: full outer on (entity, work item, field) with a ladder of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("entity", "work_item", "field")


def aliased(facts: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Entities by their canonical names. aliases: alias, canonical."""
    name = F.lower(F.trim("entity"))
    if aliases is None:
        return facts.withColumn("entity", name)
    a = aliases.select(F.lower(F.trim("alias")).alias("_a"), F.lower(F.trim("canonical")).alias("_c"))
    return facts.withColumn("_a", name).join(a, "_a", "left").withColumn("entity", F.coalesce("_c", "_a")).drop("_a", "_c")


def value_key(value: Column, kind: Column) -> Column:
    """A comparable form: dates as ISO, numbers and percentages as plain numbers, text folded."""
    t = F.trim(value)
    cjk = F.regexp_replace(F.regexp_replace(t, "[年月/.]", "-"), "日$", "")
    parts = F.split(cjk, "-")
    date = F.when(cjk.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat_ws("-", F.get(parts, 0), F.lpad(F.get(parts, 1), 2, "0"), F.lpad(F.get(parts, 2), 2, "0")))
    number = F.regexp_replace(F.regexp_replace(t, ",", ""), "[%％]$", "").try_cast("decimal(28,6)").cast("string")
    return F.when(kind == "date", date).when(kind.isin("number", "percentage"), number).otherwise(F.lower(F.regexp_replace(t, r"\s+", "")))


def align(left: DataFrame, right: DataFrame, kinds: dict[str, str], tolerance: float = 0.0, aliases: DataFrame | None = None) -> DataFrame:
    """entity, work_item, field, value_a, value_b, status: consistent, conflict, needs_semantic, only_a, only_b or
    insufficient (several values on a side, another as_of, a value that can't be read, or no such entity there)."""
    kind = F.lit("text")
    for k, v in kinds.items():
        kind = F.when(F.col("field") == k, v).otherwise(kind)

    def side(df: DataFrame, p: str) -> DataFrame:
        df = aliased(df, aliases).withColumn("k", value_key(F.col("value"), kind))
        return df.groupBy(*KEY).agg(F.count_distinct("k").alias(f"n_{p}"), F.count_if(F.col("k").isNull()).alias(f"bad_{p}"), F.min("k").alias(f"k_{p}"), F.min("value").alias(f"value_{p}"), F.min("as_of").alias(f"as_of_{p}"))

    a, b = side(left, "a"), side(right, "b")
    known = lambda df, p: aliased(df, aliases).select("entity").distinct().withColumn(f"known_{p}", F.lit(True))
    j = a.join(b, list(KEY), "full_outer").join(known(left, "a"), "entity", "left").join(known(right, "b"), "entity", "left").withColumn("kind", kind)
    numeric = F.col("kind").isin("number", "percentage")
    near = F.abs(F.col("k_a").cast("decimal(28,6)") - F.col("k_b").cast("decimal(28,6)")) <= F.lit(tolerance).cast("decimal(18,6)")
    status = (
        F.when(F.col("n_a").isNull(), F.when(F.col("known_a"), "only_b").otherwise("insufficient"))
        .when(F.col("n_b").isNull(), F.when(F.col("known_b"), "only_a").otherwise("insufficient"))
        .when((F.col("n_a") > 1) | (F.col("n_b") > 1) | (F.col("bad_a") > 0) | (F.col("bad_b") > 0), "insufficient")
        .when(~F.col("as_of_a").eqNullSafe(F.col("as_of_b")), "insufficient")
        .when(F.col("k_a") == F.col("k_b"), "consistent")
        .when(numeric, F.when(near, "consistent").otherwise("conflict"))
        .when(F.col("kind") == "date", "conflict")
        .otherwise("needs_semantic")
    )
    return j.select(*KEY, "value_a", "value_b", status.alias("status"))


def summary(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
