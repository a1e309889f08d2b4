"""Evaluation: confusion, ranking metrics, thresholds, intervals, edit rates and splits.

Rank metrics need no global sort of rows: counts per distinct score combine first, and those counts are summed in score
order range by range, as there may be as many scores as rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.ordinals import running

Z95 = 1.959963984540054


def by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, pos, neg and the counts above and below each score; one row per distinct score."""
    g = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return running(g, [F.desc(score)], {"tp": "pos", "fp": "neg"})


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the chance that a positive scores above a negative, ties as half."""
    g = by_score(df, score, label)
    n = g.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") / 2).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return n.select((F.col("u") / (F.col("p") * F.col("n"))).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the sum of precision at each score times its share of the positives; ties together."""
    g = by_score(df, score, label)
    n = g.agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("x"), F.sum("pos").alias("p"))
    return n.select((F.col("x") / F.col("p")).alias("average_precision"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def accuracy_macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy and the mean F1 over classes, from the confusion counts."""
    c = confusion(df, truth, predicted)
    each = c.select(F.explode(F.array(F.struct(F.col(truth).alias("k"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col(predicted).alias("k"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("x")).select("x.*")
    f1 = each.groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    return f1.agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(F.when(F.col("t") + F.col("p") > 0, 2 * F.col("tp") / (F.col("t") + F.col("p"))).otherwise(0.0)).alias("macro_f1"))


def group_threshold(df: DataFrame, group: str, score: str, most_fpr: float) -> DataFrame:
    """One row: the threshold over which at most that share of groups (each by its largest score) lies."""
    g = df.groupBy(group).agg(F.max(score).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    g = running(g, [F.desc("m")], {"at_least": "n"})
    total = g.agg(F.sum("n").alias("all_groups"))
    return g.crossJoin(F.broadcast(total)).filter(F.col("at_least") > F.floor(F.col("all_groups") * F.lit(most_fpr))).agg(F.max("m").alias("threshold"))


def balanced_recall(df: DataFrame, source: str, hit: Column) -> DataFrame:
    """One row: the mean over sources of each source's recall."""
    return df.groupBy(source).agg(F.avg(hit.cast("double")).alias("r")).agg(F.avg("r").alias("balanced_recall"), F.count(F.lit(1)).alias("sources"))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval."""
    p, z2 = hits / n, Z95 * Z95
    mid, half = p + z2 / (2 * n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)


def class_thresholds(df: DataFrame, cls: str, score: str, correct: str, least_precision: float, least_accepted: int) -> DataFrame:
    """Per class the lowest score over which precision holds with enough accepted rows."""
    g = df.groupBy(cls, score).agg(F.count(F.lit(1)).alias("n"), F.sum(correct).alias("k"))
    down = Window.partitionBy(cls).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("accepted", F.sum("n").over(down)).withColumn("good", F.sum("k").over(down))
    ok = (F.col("accepted") >= least_accepted) & (F.col("good") >= F.col("accepted") * F.lit(least_precision))
    return g.groupBy(cls).agg(F.min(F.when(ok, F.col(score))).alias("threshold"))


@F.pandas_udf(T.DoubleType())
def clopper_pearson_upper(hits: pd.Series, n: pd.Series) -> pd.Series:
    """The exact 95 % upper bound of a share, by bisection on the binomial distribution."""

    def upper(k: int, m: int) -> float:
        if m == 0 or k >= m:
            return 1.0
        logs = [math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) for i in range(k + 1)]
        lo, hi = k / m, 1.0
        for _ in range(60):
            p = (lo + hi) / 2
            below = math.fsum(math.exp(c + i * math.log(p) + (m - i) * math.log1p(-p)) for i, c in enumerate(logs)) if 0 < p < 1 else 0.0
            lo, hi = (p, hi) if below > 0.05 else (lo, p)
        return hi

    return pd.Series([upper(int(k), int(m)) for k, m in zip(hits, n, strict=True)])


def cluster_bootstrap(df: DataFrame, cluster: str, value: Column, draws: int = 2000, seed: int = 7) -> DataFrame:
    """One row: mean, and the 2.5 and 97.5 % points of the mean over resampled clusters.

    Each cluster is weighted in every draw by Poisson(1) counts seeded by its name, so draws are sums that combine in
    parallel and no task holds all clusters.
    """
    g = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))

    def weigh(batches):
        total, size = np.zeros(draws), np.zeros(draws)
        for pdf in batches:
            for key, s, n in pdf.itertuples(index=False):
                w = np.random.default_rng([seed, *str(key).encode()]).poisson(1.0, draws)
                total += w * float(s)
                size += w * float(n)
        yield pd.DataFrame({"draw": np.arange(draws), "s": total, "n": size})

    d = g.select(cluster, "s", "n").mapInPandas(weigh, "draw int, s double, n double").groupBy("draw").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    means = d.filter("n > 0").select((F.col("s") / F.col("n")).alias("m"))
    mean = g.agg((F.sum("s") / F.sum("n")).alias("mean"))
    return mean.crossJoin(means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high")))


def grouped_split(df: DataFrame, group: str, shares: tuple[int, ...] = (70, 15, 15), seed: str = "split") -> DataFrame:
    """split: 0.. by a hash of the group, so a group never lies in two splits and no row moves."""
    x = F.pmod(F.xxhash64(F.lit(seed), F.col(group).cast("string")), F.lit(sum(shares)))
    out, upto = F.lit(len(shares) - 1), 0
    edges = []
    for i, share in enumerate(shares[:-1]):
        upto += share
        edges.append((upto, i))
    for edge, i in reversed(edges):
        out = F.when(x < edge, F.lit(i)).otherwise(out)
    return df.withColumn("split", out)


def decimal_places_outliers(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Rows whose number of decimal places isn't the group's most frequent one (ties: the smaller)."""
    places = F.length(F.regexp_extract(column, r"\.(\d+)$", 1))
    g = df.withColumn("places", places)
    n = g.groupBy(*by, "places").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.max(F.struct("n", (-F.col("places")).alias("p"))).alias("x")).select(*by, (-F.col("x.p")).alias("mode"))
    return g.join(n, by).filter("places <> mode")


def total_check(details: DataFrame, totals: DataFrame, by: list[str], amount: str, places: int) -> DataFrame:
    """Sum of details against the stated total; rounding of each detail may add half a unit of the last place."""
    g = details.groupBy(*by).agg(F.sum(amount).alias("summed"), F.count(F.lit(1)).alias("n"))
    j = g.join(totals, by)
    room = F.expr(f"cast((n + 1) * {0.5 * 10**-places!r} as decimal(18,{places + 2}))")
    return j.withColumn("difference", F.col("summed") - F.col("total")).withColumn("ok", F.abs("difference") <= room)


def contiguous_totals(rows: DataFrame, by: list[str], totals: list[str]) -> DataFrame:
    """Each total row against the details above it: by, row, first, last, n, summed, total, difference, status.

    Rows are (by, row, label, amount, places): an exact amount (null: none, or not a number) and how many places it was
    written with. A total row has one of the labels (blanks, case and a closing colon don't count). Its details are the run
    of rows right above it, up to the total or the row without label and amount before. Status: equal; rounding_possible,
    where the difference is within half a unit of the last place of each number; suspect; uncertain, where there is no
    detail, or a detail or the total has no amount. Windows are inside one table.
    """
    name = F.lower(F.regexp_replace(F.trim(F.coalesce("label", F.lit(""))), "[\\s:：]+$", ""))
    w = Window.partitionBy(*by).orderBy("row")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumn("is_total", name.isin([t.lower() for t in totals]))
    r = r.withColumn("ends", F.col("is_total") | ((name == "") & F.col("amount").isNull()))
    # a run of details and the row that ends it have the same number of ends before them
    r = r.withColumn("run", F.coalesce(F.sum(F.col("ends").cast("long")).over(earlier), F.lit(0)))
    room = F.expr("cast(0.5 as double) * power(cast(10 as double), -places)")
    detail = ~F.col("ends")
    g = r.groupBy(*by, "run").agg(
        F.max(F.when(F.col("is_total"), F.col("row"))).alias("row"),
        F.min(F.when(detail, F.col("row"))).alias("first"),
        F.max(F.when(detail, F.col("row"))).alias("last"),
        F.count_if(detail).alias("n"),
        F.count_if(detail & F.col("amount").isNull()).alias("unknown"),
        F.sum(F.when(detail, F.col("amount"))).alias("summed"),
        F.max(F.when(F.col("is_total"), F.col("amount"))).alias("total"),
        F.sum(F.when(F.col("amount").isNotNull(), room)).alias("room"),
    ).filter("row is not null")
    known = (F.col("n") > 0) & (F.col("unknown") == 0) & F.col("total").isNotNull()
    difference = F.when(known, F.col("total") - F.col("summed"))
    status = F.when(~known, "uncertain").when(difference == 0, "equal").when(F.abs(difference).cast("double") <= F.col("room") + 1e-12, "rounding_possible").otherwise("suspect")
    return g.select(*by, "row", "first", "last", "n", "summed", "total", difference.alias("difference"), status.alias("status"))
