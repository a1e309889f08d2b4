"""Queries over joins by likeness, components, votes and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import similar
from tallyspark.operators.components import connected_components
from tallyspark.plans.registry import query, table

BOX_L = {"id": "p_partkey", "x0": "p_partkey * 37 % 997", "y0": "p_partkey * 91 % 983", "x1": "p_partkey * 37 % 997 + 5 + p_size", "y1": "p_partkey * 91 % 983 + 12"}
BOX_R = {"id": "s_suppkey", "x0": "s_suppkey * 53 % 991", "y0": "s_suppkey * 29 % 977", "x1": "s_suppkey * 53 % 991 + 30", "y1": "s_suppkey * 29 % 977 + 25"}
_sel = lambda m: ", ".join(f"{v} AS {k}" for k, v in m.items())
_exprs = lambda m: [f"{v} AS {k}" for k, v in m.items()]
BOXES = f"WITH l AS (SELECT {_sel(BOX_L)} FROM part), r AS (SELECT {_sel(BOX_R)} FROM supplier), j AS (SELECT l.id AS l_id, r.id AS r_id, CAST((least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) AS BIGINT) AS area FROM l, r WHERE l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1)"


def boxes(spark, d):
    return table(spark, d, "part").selectExpr(*_exprs(BOX_L)), table(spark, d, "supplier").selectExpr(*_exprs(BOX_R))


@query("j22_box_overlap", BOXES + " SELECT l_id, r_id, area FROM j")
def j22(spark, d):
    return similar.box_overlap_join(*boxes(spark, d), 32)


@query("w02_best_with_margin", BOXES + ", k AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY area DESC, r_id) AS n, lead(area) OVER (PARTITION BY l_id ORDER BY area DESC, r_id) AS nx FROM j) SELECT l_id, r_id, area FROM k WHERE n = 1 AND area >= 50 AND area - coalesce(nx, 0) >= 20")
def w02(spark, d):
    return similar.clear(similar.best_overlaps(*boxes(spark, d), 32), 50, 20)


@query("j24_mutual_best", BOXES + ", a AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY area DESC, r_id) AS n, lead(area) OVER (PARTITION BY l_id ORDER BY area DESC, r_id) AS nx FROM j), b AS (SELECT *, row_number() OVER (PARTITION BY r_id ORDER BY area DESC, l_id) AS n, lead(area) OVER (PARTITION BY r_id ORDER BY area DESC, l_id) AS nx FROM j) SELECT a.l_id, a.r_id, a.area FROM a JOIN b ON a.l_id = b.l_id AND a.r_id = b.r_id WHERE a.n = 1 AND b.n = 1 AND a.area - coalesce(a.nx, 0) >= 5 AND b.area - coalesce(b.nx, 0) >= 5")
def j24(spark, d):
    return similar.mutual_overlaps(*boxes(spark, d), 32, 5)


@query("j25_unique_anchors", "WITH a AS (SELECT CAST(c_acctbal AS INT) AS v, min(c_custkey) AS c_custkey FROM customer GROUP BY 1 HAVING count(*) = 1), b AS (SELECT CAST(s_acctbal AS INT) AS v, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(*) = 1) SELECT v, c_custkey, s_suppkey FROM a JOIN b USING (v)")
def j25(spark, d):
    a = table(spark, d, "customer").select(F.rint("c_acctbal").cast("int").alias("v"), "c_custkey")
    b = table(spark, d, "supplier").select(F.rint("s_acctbal").cast("int").alias("v"), "s_suppkey")
    return similar.unique_anchors(a, b, "v", "c_custkey", "s_suppkey")


GRID = "SELECT l_orderkey AS t, l_linenumber AS r, l_suppkey % 4 AS c, min(l_partkey) AS v FROM lineitem WHERE {} GROUP BY 1, 2, 3"


@query("j28_grid_diff", f"WITH a AS ({GRID.format('true')}), b AS ({GRID.format('l_returnflag <> ' + chr(39) + 'R' + chr(39))}) SELECT coalesce(a.t, b.t) AS t, coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, CASE WHEN b.v IS NULL THEN 'removed' WHEN a.v IS NULL THEN 'added' ELSE 'changed' END AS what FROM a FULL OUTER JOIN b ON a.t = b.t AND a.r = b.r AND a.c = b.c WHERE a.v IS DISTINCT FROM b.v")
def j28(spark, d):
    li = table(spark, d, "lineitem")
    grid = lambda df, v: df.groupBy(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("r"), F.expr("l_suppkey % 4").alias("c")).agg(F.min("l_partkey").alias(v))
    j = grid(li, "va").join(grid(li.filter("l_returnflag <> 'R'"), "vb"), ["t", "r", "c"], "full_outer").filter("not (va <=> vb)")
    return j.select("t", "r", "c", F.when(F.col("vb").isNull(), "removed").when(F.col("va").isNull(), "added").otherwise("changed").alias("what"))


@query("j29_cosine_top_k", "WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, CAST(v.embedding AS DOUBLE[])), 5) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, CAST(v.embedding AS DOUBLE[])) DESC, v.vec_id) AS rn FROM q, embeddings v WHERE v.vec_id <> q.vec_id) SELECT query_id, vec_id, score, rn FROM s WHERE rn <= 5")
def j29(spark, d):
    e = table(spark, d, "embeddings")
    return similar.cosine_top_k(e, e.filter("vec_id % 50 = 0"), 5).select("query_id", "vec_id", F.round("score", 5).alias("score"), "rn")




def code_sql(first: int) -> str:
    return " + ".join(f"CASE WHEN embedding[{i + first}] > 0 THEN {1 << i} ELSE 0 END" for i in range(16))


@query("j30_hamming_pairs", f"WITH c AS (SELECT vec_id AS id, CAST({code_sql(1)} AS BIGINT) AS code FROM embeddings), m AS (SELECT code, min(id) AS id FROM c GROUP BY code) SELECT m.id AS a, c.id AS b, 0 AS distance FROM c JOIN m USING (code) WHERE c.id <> m.id UNION ALL SELECT x.id, y.id, CAST(bit_count(xor(x.code, y.code)) AS INTEGER) FROM m x, m y WHERE x.id < y.id AND bit_count(xor(x.code, y.code)) <= 2")
def j30(spark, d):
    codes = table(spark, d, "embeddings").selectExpr("vec_id AS id", f"CAST({code_sql(0)} AS BIGINT) AS code")
    return similar.hamming_pairs(codes, 16, 4, 2)


@query("f22_hamming", "SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS INTEGER) AS distance FROM events")
def f22(spark, d):
    return table(spark, d, "events").select("event_id", F.bit_count(F.col("event_id").bitwiseXOR(F.col("user_id"))).cast("int").alias("distance"))


@query("f21_norm_dot", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm, label FROM embeddings")
def f21(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x)), 5).alias("norm"), "label")


@query("u08_components", "SELECT c_custkey AS node, c_custkey - c_custkey % 5 AS component FROM customer")
def u08(spark, d):
    c = table(spark, d, "customer")
    edges = c.filter("c_custkey % 5 <> 0").selectExpr("c_custkey - 1 AS src", "c_custkey AS dst")
    comp = connected_components(edges)
    return c.select(F.col("c_custkey").alias("node")).join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


@query("u09_leak_check", "SELECT md5(text) AS content, count(DISTINCT doc_id % 3) AS splits, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1")
def u09(spark, d):
    g = table(spark, d, "documents").groupBy(F.md5("text").alias("content")).agg(F.count_distinct(F.expr("doc_id % 3")).alias("splits"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return g.filter("splits > 1")


VOTES = "SELECT l_orderkey, l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1, 2"


@query("a10_weighted_votes", VOTES)
def a10(spark, d):
    li = table(spark, d, "lineitem").withColumn("w", F.col("l_quantity").cast("long"))
    return similar.votes(li, ["l_orderkey"], "l_suppkey", "l_returnflag", "w")


@query("a11_vote_decision", f"WITH v AS ({VOTES}), b AS (SELECT l_orderkey, max(weight) AS most, sum(weight) AS total FROM v GROUP BY 1), t AS (SELECT v.l_orderkey, count(*) AS tied, min(l_returnflag) AS w, min(sources) AS s, min(most) AS most, min(total) AS total FROM v JOIN b ON v.l_orderkey = b.l_orderkey AND v.weight = b.most GROUP BY 1), r AS (SELECT *, CASE WHEN tied > 1 THEN 'tie' WHEN s < 2 THEN 'few_sources' WHEN most < total * 0.6 THEN 'low_support' ELSE 'accepted' END AS reason FROM t) SELECT l_orderkey, CASE WHEN reason = 'accepted' THEN w END AS winner, reason FROM r")
def a11(spark, d):
    li = table(spark, d, "lineitem").withColumn("w", F.col("l_quantity").cast("long"))
    return similar.decide(similar.votes(li, ["l_orderkey"], "l_suppkey", "l_returnflag", "w"), ["l_orderkey"], "l_returnflag", 0.6, 2)


@query("a12_multiset_overlap", "WITH a AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2), j AS (SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL OUTER JOIN b ON a.event_type = b.event_type AND a.user_id = b.user_id) SELECT event_type, CAST(sum(least(x, y)) AS BIGINT) AS shared, CAST(greatest(sum(x), sum(y)) AS BIGINT) AS larger, CAST(sum(least(x, y)) AS DOUBLE) / greatest(sum(x), sum(y)) AS ratio FROM j GROUP BY 1")
def a12(spark, d):
    e = table(spark, d, "events")
    return similar.multiset_overlap(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["event_type"], "user_id")
