"""Queries over evaluation statistics. Scores are integers made of doc_id and the label, the same in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import stats
from tallyspark.plans.registry import query, table

COLUMNS = {
    "doc_id": "l.doc_id",
    "label": "l.quality",
    "toxic": "l.toxic",
    "score": "l.doc_id * 7919 % 1000 + 200 * l.quality",
    "source": "d.source",
    "lang": "d.lang",
    "pred": "CASE WHEN l.doc_id * 7919 % 1000 + 200 * l.quality >= 600 THEN 1 ELSE 0 END",
}
SCORED = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in COLUMNS.items()) + " FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def scored(spark, d):
    j = table(spark, d, "labels").alias("l").join(table(spark, d, "documents").select("doc_id", "source", "lang").alias("d"), F.expr("l.doc_id = d.doc_id"))
    return j.selectExpr(*(f"{v} AS {k}" for k, v in COLUMNS.items()))


@query("a15_class_by_split", f"SELECT label, count_if(doc_id % 3 = 0) AS train, count_if(doc_id % 3 = 1) AS validation, count_if(doc_id % 3 = 2) AS test FROM ({SCORED}) GROUP BY label")
def a15(spark, d):
    names = F.when(F.expr("doc_id % 3 = 0"), "train").when(F.expr("doc_id % 3 = 1"), "validation").otherwise("test")
    g = scored(spark, d).withColumn("split", names).groupBy("label").pivot("split", ["train", "validation", "test"]).count()
    return g.fillna(0)


@query("a16_confusion", f"SELECT label, pred, count(*) AS n FROM ({SCORED}) GROUP BY label, pred")
def a16(spark, d):
    return stats.confusion(scored(spark, d), "label", "pred")


@query("a16_accuracy_macro_f1", f"WITH s AS ({SCORED}), k AS (SELECT 0 AS k UNION ALL SELECT 1), f AS (SELECT k, count_if(label = k AND pred = k) AS tp, count_if(label = k) AS t, count_if(pred = k) AS p FROM s, k GROUP BY k) SELECT CAST(sum(tp) AS DOUBLE) / sum(t) AS accuracy, avg(2.0::DOUBLE * tp / (t + p)) AS macro_f1 FROM f")
def a16b(spark, d):
    return stats.accuracy_macro_f1(scored(spark, d), "label", "pred")


@query("a17_auroc", f"WITH s AS ({SCORED}) SELECT CAST(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS DOUBLE) / count(*) AS auroc FROM s a, s b WHERE a.label = 1 AND b.label = 0")
def a17(spark, d):
    return stats.auroc(scored(spark, d), "score", "label").select(F.col("auroc").cast("double").alias("auroc"))


@query("a17_average_precision", f"WITH g AS (SELECT score, count_if(label = 1) AS pos, count(*) AS n FROM ({SCORED}) GROUP BY score), c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS a FROM g) SELECT sum(pos * CAST(tp AS DOUBLE) / a) / sum(pos) AS average_precision FROM c")
def a17b(spark, d):
    return stats.average_precision(scored(spark, d), "score", "label")


@query("w04_cumulative_precision", f"WITH g AS (SELECT score, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM ({SCORED}) GROUP BY score) SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM g")
def w04(spark, d):
    return stats.by_score(scored(spark, d), "score", "label").select("score", "tp", "fp")


@query("a18_group_threshold", f"WITH m AS (SELECT source, max(score) AS m FROM ({SCORED}) WHERE label = 0 GROUP BY source), n AS (SELECT m, (SELECT count(*) FROM m y WHERE y.m >= x.m) AS at_least FROM m x) SELECT max(m) AS threshold FROM n WHERE at_least > floor((SELECT count(*) FROM m) * 0.1)")
def a18(spark, d):
    return stats.group_threshold(scored(spark, d).filter("label = 0"), "source", "score", 0.1)


@query("a19_balanced_recall", f"WITH r AS (SELECT source, avg(CAST(pred AS DOUBLE)) AS r FROM ({SCORED}) WHERE label = 1 GROUP BY source) SELECT round(avg(r), 9) AS balanced_recall, count(*) AS sources FROM r")
def a19(spark, d):
    r = stats.balanced_recall(scored(spark, d).filter("label = 1"), "source", F.col("pred"))
    return r.select(F.round("balanced_recall", 9).alias("balanced_recall"), "sources")


@query("a20_cluster_bootstrap")
def a20(spark, d):
    return stats.cluster_bootstrap(scored(spark, d), "source", F.col("pred"))


@query("a21_clopper_pearson")
def a21(spark, d):
    g = scored(spark, d).groupBy("lang").agg(F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("upper", stats.clopper_pearson_upper("hits", "n"))


@query("a22_wilson", f"WITH g AS (SELECT lang, CAST(sum(pred) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM ({SCORED}) GROUP BY lang), z AS (SELECT *, k / n AS p, {stats.Z95!r}::DOUBLE AS z FROM g) SELECT lang, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high FROM z")
def a22(spark, d):
    g = scored(spark, d).groupBy("lang").agg(F.sum("pred").cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("lang", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("a23_class_thresholds", f"WITH c AS (SELECT lang, score, CAST(sum(count(*)) OVER (PARTITION BY lang ORDER BY score DESC) AS BIGINT) AS accepted, CAST(sum(sum(label)) OVER (PARTITION BY lang ORDER BY score DESC) AS BIGINT) AS good FROM ({SCORED}) GROUP BY lang, score) SELECT lang, min(CASE WHEN accepted >= 3 AND good >= accepted * 0.8 THEN score END) AS threshold FROM c GROUP BY lang")
def a23(spark, d):
    return stats.class_thresholds(scored(spark, d), "lang", "score", "label", 0.8, 3)


@query("a24_iou_f1", f"WITH c AS (SELECT count_if(label = 1 AND pred = 1) AS tp, count_if(label = 0 AND pred = 1) AS fp, count_if(label = 1 AND pred = 0) AS fn FROM ({SCORED})) SELECT CAST(tp AS DOUBLE) / (tp + fp + fn) AS iou, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1 FROM c")
def a24(spark, d):
    c = scored(spark, d).agg(F.count_if(F.expr("label = 1 and pred = 1")).alias("tp"), F.count_if(F.expr("label = 0 and pred = 1")).alias("fp"), F.count_if(F.expr("label = 1 and pred = 0")).alias("fn"))
    return c.select((F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn"))).alias("iou"), (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


@query("a25_quantiles", "SELECT event_type, quantile_cont(value, 0.75) AS p75, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def a25(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", 0.75).alias("p75"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


@query("a27_latency", "SELECT quantile_cont(value, 0.95) AS p95, median(value) AS p50, max(value) AS most FROM events")
def a27(spark, d):
    return table(spark, d, "events").agg(F.percentile("value", 0.95).alias("p95"), F.percentile("value", 0.5).alias("p50"), F.max("value").alias("most"))


@query("a26_character_error", "SELECT p_brand, CAST(sum(levenshtein(p_name, p_type)) AS BIGINT) AS edits, CAST(sum(length(p_name)) AS BIGINT) AS chars FROM part GROUP BY p_brand")
def a26(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.sum(F.levenshtein("p_name", "p_type").cast("long")).alias("edits"), F.sum(F.length("p_name").cast("long")).alias("chars"))


@query("f14_levenshtein", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance FROM part")
def f14(spark, d):
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@query("f20_softmax", "WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), s AS (SELECT vec_id, exp(a) / (exp(a) + exp(b) + exp(c)) AS a, exp(b) / (exp(a) + exp(b) + exp(c)) AS b, exp(c) / (exp(a) + exp(b) + exp(c)) AS c FROM e) SELECT vec_id, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS best, round(greatest(a, b, c), 6) AS share, greatest(a, b, c) >= 0.36 AS accepted FROM s")
def f20(spark, d):
    x = F.transform(F.slice("embedding", 1, 3), lambda v: F.exp(v.cast("double")))
    df = table(spark, d, "embeddings").select("vec_id", x.alias("x")).withColumn("total", F.aggregate("x", F.lit(0.0), lambda a, v: a + v))
    top = F.array_max("x")
    return df.select("vec_id", (F.array_position("x", top) - 1).cast("int").alias("best"), F.round(top / F.col("total"), 6).alias("share"), (top / F.col("total") >= 0.36).alias("accepted"))


@query("a13_decimal_places", "WITH t AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 40 = 0 THEN '12.5' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS v FROM customer), p AS (SELECT *, length(regexp_extract(v, '\\.(\\d+)$', 1)) AS places FROM t), m AS (SELECT c_mktsegment, mode(places) AS mode FROM p GROUP BY 1) SELECT c_custkey, CAST(places AS INTEGER) AS places FROM p JOIN m USING (c_mktsegment) WHERE places <> mode")
def a13(spark, d):
    v = F.when(F.expr("c_custkey % 40 = 0"), "12.5").otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    return stats.decimal_places_outliers(table(spark, d, "customer").withColumn("v", v), "v", ["c_mktsegment"]).select("c_custkey", "places")


LINES = "SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem"


@query("a14_total_check", f"WITH g AS (SELECT l_orderkey, sum(v) AS summed, count(*) AS n FROM ({LINES}) GROUP BY 1), t AS (SELECT l_orderkey, sum(v) + CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE 0 END AS total FROM ({LINES}) GROUP BY 1) SELECT l_orderkey, CAST(summed - total AS DECIMAL(18,2)) AS difference, abs(summed - total) <= (n + 1) * 0.005 AS ok FROM g JOIN t USING (l_orderkey)")
def a14(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    totals = li.groupBy("l_orderkey").agg((F.sum("v") + F.when(F.col("l_orderkey") % 9 == 0, 1).otherwise(0)).alias("total"))
    return stats.total_check(li, totals, ["l_orderkey"], "v", 2).select("l_orderkey", F.col("difference").cast("decimal(18,2)").alias("difference"), "ok")


@query("f27_grouped_split")
def f27(spark, d):
    s = stats.grouped_split(table(spark, d, "documents").withColumn("content", F.md5("text")), "content")
    return s.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"))
