"""Sinks: cleaned tables and comparison results, guarded CSV, read-back checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.cells import headers


def safe_csv(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading quote."""
    return F.when(c.rlike("^[\\uFEFF \\t\\r\\n]*[=+\\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def flat(df: DataFrame, guard: bool = False) -> DataFrame:
    """source_row and a column 'cN | header' per cell; null is ''."""
    names = headers(df)
    value = lambda c: F.coalesce(F.col(c)["value"], F.lit(""))
    return df.select("source_row", *((safe_csv(value(c)) if guard else value(c)).alias(f"{c} | {h}" if h else c) for c, h in names.items()))


def business(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the cells under their headers alone, the lineage: source_row and row_id)."""
    names = headers(df)
    return df.select(*(F.col(c)["value"].alias(h or c) for c, h in names.items())), df.select("source_row", "row_id")


def result_rows(result: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """The flat layout of a reconciliation: category, keys, sources, differences and each cell's kind, raw and value."""
    cells = [F.col(s)[c][p].alias(f"{s}_{c}_{p}") for s, cols in (("L", left), ("R", right)) for c in cols for p in ("kind", "raw", "value")]
    return result.select("category", "key_json", "left_row_id", "left_source_row", "right_row_id", "right_source_row", F.to_json("different_columns").alias("different_columns_json"), *cells)


def write_checked(df: DataFrame, path: str, form: str = "parquet") -> int:
    """Write df, read it back and compare both ways; the number of rows. A difference raises."""
    w = df.write.option("header", True).option("emptyValue", '""').option("escape", '"').option("quoteAll", True)
    getattr(w, form)(path)
    r = df.sparkSession.read.schema(df.schema)
    back = r.option("header", True).option("escape", '"').option("multiLine", True).csv(path) if form == "csv" else r.parquet(path)
    if form == "csv":
        texts = [c for c, t in df.dtypes if t == "string"]
        df, back = df.fillna("", texts), back.fillna("", texts)
    n = F.count(F.lit(1)).alias("n")
    cols = df.columns
    a, b = df.groupBy(*cols).agg(n), back.groupBy(*cols).agg(n)
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise ValueError(f"{path} doesn't read back as written")
    return back.count()


def utf16_units(c: Column) -> Column:
    """UTF-16 units of a text: a character beyond the basic plane takes two."""
    return F.char_length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def split_long(c: Column, limit: int = 32_000) -> Column:
    """A text in parts of at most limit UTF-16 units, as an array. A text that fits is one part; others are cut every
    limit // 2 characters, which fit whatever they are."""
    n = F.ceil(F.greatest(F.char_length(c), F.lit(1)) / F.lit(limit // 2))
    return F.when(utf16_units(c) <= limit, F.array(c)).otherwise(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.substr(c, i * (limit // 2) + 1, F.lit(limit // 2))))
