"""Work queues: unions, pages, cursors, latest rows, set checks and interval merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.ordinals import ordinals, running
from tallyspark.session import shared_dir


def todo_order() -> list[Column]:
    return [F.asc("priority"), F.desc("sort_at"), F.asc("id"), F.asc("kind")]


def union_todos(*branches: DataFrame) -> DataFrame:
    """Branches of one schema; filters on the result reach each branch."""
    return reduce(DataFrame.unionByName, branches)


def todo_page(todos: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page and one row more, which says whether another page follows. Spark keeps the top rows of each task only."""
    return todos.orderBy(*todo_order()).offset(offset).limit(limit + 1)


def cursors(todos: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """The page offset of each wanted todo: the number of todos before it, by ranges of the order, not one global window.

    Rows are counted by (priority, sort_at); earlier groups are summed over those counts, range by range, and only the
    wanted groups' rows are ranked one by one.
    """
    key = ["priority", "sort_at"]
    n = todos.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    n = running(n, [F.asc("priority"), F.desc("sort_at")], {"upto": "n"}).withColumn("before", F.col("upto") - F.col("n"))
    mine = wanted.select("kind", "id", *key)
    groups = mine.select(*key).distinct()
    rank = Window.partitionBy(*key).orderBy("id", "kind")
    ranked = todos.join(groups, key, "left_semi").withColumn("at", F.row_number().over(rank) - 1)
    return ranked.join(mine, ["kind", "id", *key], "left_semi").join(n, key).withColumn("cursor", F.expr(f"(before + at) div {limit} * {limit}"))


def keyset_page(df: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    return df.filter(F.col(key) > after).orderBy(key).limit(limit)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts each task's groups before the shuffle (window group limit)."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rn") <= k)


def single_value(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """The value of a group if all its rows have the same, else null; by min and max, which combine on the map side."""
    same = F.min(column) == F.max(column)
    return df.groupBy(*by).agg(F.when(same, F.min(column)).alias(name), F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each group, by max of a struct: no sort, and a group is one row a task in the shuffle."""
    return df.groupBy(*by).agg(F.max(F.struct(*order, *(F.col(c).alias(f"_{c}") for c in columns))).alias("x")).select(*by, *(F.col(f"x._{c}").alias(c) for c in columns))


def agreeing(df: DataFrame, by: list[str], source: str, reading: str, chunk: int) -> DataFrame:
    """Groups with two sources at least and one reading, numbered by chunks."""
    g = df.groupBy(*by).agg(F.count_distinct(source).alias("sources"), F.min(reading).alias("reading"), F.max(reading).alias("most"))
    g = g.filter("sources >= 2 and reading = most").drop("most")
    return ordinals(g, [F.col(c) for c in by], "chunk").withColumn("chunk", F.expr(f"chunk div {chunk}"))


def ancestors(edges: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """node, anc, depth for all ancestors along node -> parent, by doubling; a cycle is an error."""
    shared_dir(edges.sparkSession)
    known = edges.select("node", F.col("parent").alias("anc"), F.lit(1).alias("depth")).checkpoint()
    step = 1
    while True:
        far = known.filter(F.col("depth") == step).select(F.col("node"), F.col("anc").alias("mid"))
        more = far.join(known.select(F.col("node").alias("mid"), "anc", F.col("depth").alias("more")), "mid").select("node", "anc", (F.col("more") + step).alias("depth")).checkpoint()
        if not more.limit(1).count():
            return known
        if step > max_depth or more.filter("node = anc").limit(1).count():
            raise ValueError("the parent chain has a cycle")
        known = known.unionByName(more).checkpoint()
        step *= 2


def missing(required: DataFrame, delivered: DataFrame, key: list[str]) -> DataFrame:
    return required.join(delivered, key, "left_anti")


def ordered_concat(tables: list[DataFrame], ordinal: str = "ordinal") -> DataFrame:
    """Tables of the same columns one after the other; part and a running ordinal say where a row came from."""
    out, before = [], 0
    for i, t in enumerate(tables):
        if t.columns != tables[0].columns:
            raise ValueError("the tables have different headers")
        out.append(t.withColumn(ordinal, F.col(ordinal) + before).withColumn("part", F.lit(i)))
        before += t.count()
    return reduce(DataFrame.unionByName, out)


def conservation(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: keys added, dropped and repeated by a change of a set."""
    b = before.groupBy(key).agg(F.count(F.lit(1)).alias("b"))
    a = after.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    return b.join(a, key, "full_outer").agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("dropped"), F.count_if(F.coalesce("a", F.lit(0)) > F.coalesce("b", F.lit(1))).alias("repeated"))


def idempotent(requests: DataFrame, key: str, body: str, receipt: str) -> DataFrame:
    """Per request key the first receipt, and whether bodies differ (a conflict)."""
    return requests.groupBy(key).agg(F.min(receipt).alias("receipt"), F.count(F.lit(1)).alias("n"), (F.min(body) != F.max(body)).alias("conflict"))


def warm(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """All but the first row of each group."""
    first = df.groupBy(by).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(first, by).filter(F.struct(*order) != F.col("_first")).drop("_first")


def warm_p75(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    return warm(df, by, order).groupBy(by).agg(F.percentile(value, 0.75).alias("p75"), F.count(F.lit(1)).alias("warm"))


def merge_intervals(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Overlapping or touching intervals of each group merged (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(a, b)
    upto = F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.when(F.col(a) <= upto, 0).otherwise(1))
    df = df.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return df.groupBy(*by, "_island").agg(F.min(a).alias(a), F.max(b).alias(b)).drop("_island")
