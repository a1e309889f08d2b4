"""Correspondence of two versions of a table by anchors, and set joins by prefix."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def anchors(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Cells (by, row, col, text) whose text occurs once in both versions: by, text, row, col, row_b, col_b."""

    def once(df: DataFrame, p: str) -> DataFrame:
        g = df.filter("text <> ''").groupBy(*by, "text").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias(f"row{p}"), F.min("col").alias(f"col{p}"))
        return g.filter("n = 1").drop("n")

    # as of all joins here: cells come out of lists, so Spark takes them for few and would broadcast them
    return once(left, "").join(once(right, "_b").hint("merge"), [*by, "text"])


def line_map(found: DataFrame, by: list[str], line: str, support: int) -> DataFrame:
    """Each line's counterpart with enough anchors, if neither has another as good."""
    n = found.groupBy(*by, line, f"{line}_b").agg(F.count(F.lit(1)).alias("n"))
    rank = lambda c: F.rank().over(Window.partitionBy(*by, c).orderBy(F.desc("n")))
    ties = lambda c: F.count(F.lit(1)).over(Window.partitionBy(*by, c, "n"))
    n = n.withColumns({"r1": rank(line), "r2": rank(f"{line}_b"), "t1": ties(line), "t2": ties(f"{line}_b")})
    return n.filter((F.col("n") >= support) & (F.col("r1") == 1) & (F.col("r2") == 1) & (F.col("t1") == 1) & (F.col("t2") == 1)).select(*by, line, f"{line}_b")


def match_cells(left: DataFrame, right: DataFrame, by: list[str], support: int = 2) -> DataFrame:
    """by, row, col, row_b, col_b, same: cells whose row and column both have a counterpart."""
    found = anchors(left, right, by)
    rows, cols = line_map(found, by, "row", support), line_map(found, by, "col", support)
    j = left.join(rows.hint("merge"), [*by, "row"]).join(cols.hint("merge"), [*by, "col"])
    other = right.select(*by, F.col("row").alias("row_b"), F.col("col").alias("col_b"), F.col("text").alias("text_b"))
    return j.join(other.hint("merge"), [*by, "row_b", "col_b"]).select(*by, "row", "col", "row_b", "col_b", (F.col("text") == F.col("text_b")).alias("same"))


def reliability(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Per table the share of its rows and columns that hold an anchor."""
    f = anchors(left, right, by).groupBy(*by).agg(F.count_distinct("row").alias("rows"), F.count_distinct("col").alias("cols"))
    all_ = left.groupBy(*by).agg(F.count_distinct("row").alias("all_rows"), F.count_distinct("col").alias("all_cols"))
    j = all_.join(f.hint("merge"), by, "left").fillna(0, ["rows", "cols"])
    return j.select(*by, (F.col("rows") / F.col("all_rows")).alias("row_share"), (F.col("cols") / F.col("all_cols")).alias("col_share"))


def values_conserved(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Per table whether a change of structure kept every text as often as it was."""
    n = lambda df, c: df.groupBy(*by, "text").agg(F.count(F.lit(1)).alias(c))
    j = n(before, "x").join(n(after, "y"), [*by, "text"], "full_outer")
    return j.groupBy(*by).agg((F.count_if(~F.col("x").eqNullSafe(F.col("y"))) == 0).alias("conserved"))


def set_join(sets: DataFrame, least: float) -> DataFrame:
    """a < b, similarity: distinct sets (id, items) with Jaccard of at least `least`, by prefixes of their rarest items.

    Equal sets count as one, under their least id.
    """
    s = sets.select("id", F.sort_array(F.array_distinct("items")).alias("items")).filter("size(items) > 0")
    reps = s.groupBy("items").agg(F.min("id").alias("id"))
    df = reps.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    long = reps.select("id", F.size("items").alias("n"), F.explode("items").alias("item")).join(df, "item")
    w = Window.partitionBy("id").orderBy("df", "item")
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1
    prefix = long.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= keep).select("id", "n", "item")
    other = prefix.select(F.col("id").alias("b"), F.col("n").alias("m"), "item")
    near = prefix.withColumnRenamed("id", "a").join(other, "item").filter((F.col("a") < F.col("b")) & (F.least("n", "m") >= F.greatest("n", "m") * F.lit(least) - 1e-9)).select("a", "b").distinct()
    full = reps.select("id", "items")
    j = near.join(full.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(full.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    sim = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return j.select("a", "b", sim.alias("similarity")).filter(F.col("similarity") >= least - 1e-9)


def roles(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """The number that follows each role's name in a text (name, a colon or blank, number), as a column per role."""
    number = r"\s*[:：]?\s*(-?\d[\d,]*(?:\.\d+)?)"
    return df.select("*", *(F.replace(F.nullif(F.regexp_extract(text, "(?i)" + n + number, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("decimal(28,4)").alias(n) for n in names))


