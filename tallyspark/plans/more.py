"""Queries over layouts, literal files, pages of ledgers and dataset snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import cells
from tallyspark.operators import layout, matching, queue, recipe, similar, tables
from tallyspark.operators.reconcile import Spec, reconcile
from tallyspark.plans.cleaning import CLASSIFIED, SPEC, sides
from tallyspark.plans.registry import query, table
from tallyspark.plans.similar import BOX_L, BOX_R
from tallyspark.session import shared_path
from tallyspark.sources import literal, sinks

_exprs = lambda m: [f"{v} AS {k}" for k, v in m.items()]
_sel = lambda m: ", ".join(_exprs(m))
PAIRS = f"WITH l AS (SELECT {_sel(BOX_L)} FROM part), r AS (SELECT {_sel(BOX_R)} FROM supplier), j AS (SELECT l.id AS l_id, r.id AS r_id, (least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) AS area, (l.x1 - l.x0) * (l.y1 - l.y0) AS ls, (r.x1 - r.x0) * (r.y1 - r.y0) AS rs FROM l, r WHERE l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1)"


@query("j23_token_cells", PAIRS + ", k AS (SELECT *, CAST(area AS DOUBLE) / ls AS inside FROM j), n AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY inside DESC, r_id) AS n, coalesce(lead(inside) OVER (PARTITION BY l_id ORDER BY inside DESC, r_id), 0) AS nx FROM k) SELECT l_id AS token, r_id AS cell, round(inside, 6) AS inside FROM n WHERE n = 1 AND inside >= 0.4 AND inside - nx >= 0.1")
def j23(spark, d):
    out = layout.assign_tokens(table(spark, d, "part").selectExpr(*_exprs(BOX_L)), table(spark, d, "supplier").selectExpr(*_exprs(BOX_R)), 32, 0.4, 0.1)
    return out.select("token", "cell", F.round("inside", 6).alias("inside"))


@query("f18_box_iou", PAIRS + " SELECT l_id, r_id, round(CAST(area AS DOUBLE) / (ls + rs - area), 6) AS iou FROM j")
def f18(spark, d):
    p = similar.box_pairs(table(spark, d, "part").selectExpr(*_exprs(BOX_L)), table(spark, d, "supplier").selectExpr(*_exprs(BOX_R)), 32)
    box = lambda c: tuple(F.col(f"{c}_{k}") for k in ("x0", "y0", "x1", "y1"))
    return p.select("l_id", "r_id", F.round(layout.box_iou(box("l"), box("r")), 6).alias("iou"))


@query("f18_polygon_area", "SELECT p_partkey, CAST(p_size * 3 AS DOUBLE) / 2 AS area FROM part")
def f18p(spark, d):
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero, size = F.lit(0), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", layout.polygon_area(F.array(pt(zero, zero), pt(size, zero), pt(zero, F.lit(3)))).alias("area"))


@query("f19_affine", "SELECT p_partkey, 2.0::DOUBLE * p_size + 5 AS x, 3.0::DOUBLE * p_size - 1 AS y FROM part")
def f19(spark, d):
    row = lambda *v: F.array(*map(F.lit, map(float, v)))
    scale, move = F.array(row(2, 0, 0), row(0, 3, 0), row(0, 0, 1)), F.array(row(1, 0, 5), row(0, 1, -1), row(0, 0, 1))
    m = layout.matmul(move, scale)
    return table(spark, d, "part").select("p_partkey", layout.affine(m, F.col("p_size"), F.col("p_size")).alias("p")).select("p_partkey", "p.x", "p.y")


@query("f19_inverse_and_bounds", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 10 AS DOUBLE) AS y, CAST(0 - p_partkey % 10 - 4 AS DOUBLE) AS x0, 2.0::DOUBLE * p_size + p_partkey % 3 AS y0, CAST(0 - p_partkey % 10 AS DOUBLE) AS x1, 2.0::DOUBLE * (p_size + 7) + p_partkey % 3 AS y1 FROM part")
def f19_inverse(spark, d):
    """A quarter turn with a stretch that differs from part to part: a point there and back, and the bounds of a turned box."""
    row = lambda *v: F.array(*(F.expr(str(x)).cast("double") for x in v))
    m = F.array(row(0, -1, 0), row(2, 0, "p_partkey % 3"), row(0, 0, 1))
    x, y = F.col("p_size").cast("double"), F.expr("p_partkey % 10").cast("double")
    df = table(spark, d, "part").select("p_partkey", m.alias("m"), x.alias("px"), y.alias("py"))
    there = layout.affine(F.col("m"), F.col("px"), F.col("py"))
    df = df.withColumn("p", there).withColumn("back", layout.affine(layout.inverse(F.col("m")), F.col("p.x"), F.col("p.y")))
    df = df.withColumn("b", layout.moved_box(F.col("m"), (F.col("px"), F.col("py"), F.col("px") + 7, F.col("py") + 4)))
    return df.select("p_partkey", F.col("back.x").alias("x"), F.col("back.y").alias("y"), "b.x0", "b.y0", "b.x1", "b.y1")


BLOCK_L = BOX_L | {"text": "'t' || CAST(p_partkey % 3 AS STRING)"}
BLOCK_R = BOX_R | {"text": "'t' || CAST(s_suppkey % 3 AS STRING)"}


@query("j34_page_merge", PAIRS + ", p AS (SELECT * FROM j WHERE area > least(ls, rs) * 0.5), c AS (SELECT l_id, r_id FROM p WHERE l_id % 3 <> r_id % 3) SELECT 'conflict' AS status, count(*) AS n FROM c UNION ALL SELECT 'native', count(*) FROM l WHERE id NOT IN (SELECT l_id FROM c) UNION ALL SELECT 'recognised', count(*) FROM r WHERE id NOT IN (SELECT r_id FROM p)")
def j34(spark, d):
    out = layout.merge_blocks(table(spark, d, "part").selectExpr(*_exprs(BLOCK_L)), table(spark, d, "supplier").selectExpr(*_exprs(BLOCK_R)), 32)
    # a status that no block has counts 0
    n = out.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("conflict", "native", "recognised")))
    return n.select(F.explode(F.array(*(F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in n.columns))).alias("x")).select("x.status", "x.n")


@query("s01_csv_literal", "SELECT n_nationkey + 2 AS source_row, n_name AS name, CASE WHEN n_regionkey = 0 THEN 'null' ELSE 'text' END AS region_kind FROM nation")
def s01(spark, d):
    path = shared_path(spark, "csv-in")
    line = F.concat_ws(",", F.concat(F.lit('"'), "n_name", F.lit('"')), F.when(F.col("n_regionkey") == 0, "").otherwise(F.col("n_regionkey").cast("string")))
    n = table(spark, d, "nation").orderBy("n_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    n.select(F.concat(F.lit("name,region\n"), "t").alias("value")).coalesce(1).write.text(path)
    r = literal.read_csv(spark, f"{path}/part-*.txt")
    return r.select("source_row", r.cells[0]["value"].alias("name"), r.cells[1]["kind"].alias("region_kind"))


@query("s01_csv_files", "SELECT o_orderkey, 'of ' || o_custkey || chr(10) || '\"' || o_orderstatus || '\", ' || o_orderpriority AS note, CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE 'text' END AS kind FROM orders")
def s01_files(spark, d):
    """All orders as CSV files with line breaks, quotes and delimiters inside fields, read again."""
    path = shared_path(spark, "csv-files")
    line = F.expr("""concat(o_orderkey, ',"of ', o_custkey, '\n""', o_orderstatus, '"", ', o_orderpriority, '",', CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '""' ELSE 'x' END)""")
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    r = literal.read_csv(spark, f"{path}/part-*.txt", header_row=None)
    return r.select(r.cells[0]["value"].cast("long").alias("o_orderkey"), r.cells[1]["value"].alias("note"), r.cells[2]["kind"].alias("kind"))


@query("s09_verified_content", "SELECT count(*) AS n FROM region")
def s09(spark, d):
    path = shared_path(spark, "verified")
    table(spark, d, "region").coalesce(1).write.parquet(path)
    one = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.sha2("content", 256)).first()[0]
    ok = literal.verified(spark, f"{path}/*.parquet", one).filter(F.octet_length("content") > 0).agg(F.count(F.lit(1)).alias("files"))
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).crossJoin(ok).filter("files = 1").select("n")


@query("s14_normalised_pages", "WITH b AS (SELECT page_id, url, string_split(html, '<p>')[2:] AS parts FROM pages), u AS (SELECT page_id, url, unnest(parts) AS t, unnest(range(1, len(parts) + 1)) AS i FROM b) SELECT page_id, url, CAST(i AS INTEGER) AS place, regexp_replace(regexp_replace(t, '(?s)</p>.*', ''), '<[^>]*>', '', 'g') AS text FROM u")
def s14(spark, d):
    blocks = F.transform(F.slice(F.split("html", "<p>"), 2, 1_000_000_000), lambda t, i: F.struct((i + 1).alias("order"), F.lit("paragraph").alias("type"), F.regexp_replace(F.regexp_replace(t, "(?s)</p>.*", ""), "<[^>]*>", "").alias("text")))
    doc = table(spark, d, "pages").select("page_id", F.struct(F.col("url").alias("url"), blocks.alias("blocks")).alias("document"))
    return doc.select("page_id", "document.url", F.explode("document.blocks").alias("b")).select("page_id", "url", F.col("b.order").alias("place"), "b.text")


@query("k02_comparison_export", CLASSIFIED + " SELECT category, count(*) AS n FROM x WHERE category IN ('different', 'only_left') GROUP BY category")
def k02(spark, d):
    rows = sinks.result_rows(reconcile(*sides(spark, d), SPEC).filter("category in ('different', 'only_left')"), ["c1", "c2"], ["c1", "c2"])
    path = shared_path(spark, "comparison")
    sinks.write_checked(rows, path)
    return spark.read.parquet(path).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k06_table_schema",
    """WITH n AS (SELECT count(*) AS n, count_if(o_orderkey % 3 = 0) AS gone FROM orders)
SELECT t.name, role, header, n AS rows, CASE WHEN t.name = 'c4' THEN gone ELSE 0 END AS nulls, CASE WHEN t.name = 'c2' THEN n ELSE 0 END AS warnings, kinds FROM n,
(VALUES ('row_id', 'locator', NULL, NULL), ('source_row', 'locator', NULL, NULL), ('c1', 'business', 'o_orderstatus', 'text'), ('c2', 'business', 'o_totalprice', 'decimal'), ('c3', 'business', 'day', 'date'), ('c4', 'business', 'part', 'integer')) AS t(name, role, header, kinds)""",
)
def k06(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"), F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 END").alias("part"))
    return cells.described(cells.to_cells(o, "o_orderkey", columns=["o_orderstatus", "o_totalprice", "day", "part"]))


@query("k11_dataset_snapshot", "SELECT quality, count_if(doc_id % 2 = 0) AS train, count_if(doc_id % 2 = 1) AS test FROM labels GROUP BY quality")
def k11(spark, d):
    df = table(spark, d, "labels").withColumn("split", F.when(F.expr("doc_id % 2 = 0"), "train").otherwise("test"))
    path = shared_path(spark, "snapshot")
    sinks.write_checked(df, path)
    return spark.read.parquet(path).groupBy("quality").pivot("split", ["train", "test"]).count().fillna(0)


@query("l04_sorted_keys", "SELECT c_mktsegment || '|' || c_custkey AS k FROM customer ORDER BY k LIMIT 100")
def l04(spark, d):
    return table(spark, d, "customer").select(F.concat_ws("|", "c_mktsegment", "c_custkey").alias("k")).orderBy("k").limit(100)


@query("l06_text_paging", "SELECT doc_id, substr(text, 101, 100) AS page FROM documents")
def l06(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 101, 100).alias("page"))


@query("l07_review_order", "SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_orderstatus, o_orderkey LIMIT 200")
def l07(spark, d):
    return table(spark, d, "orders").orderBy("o_orderpriority", "o_orderstatus", "o_orderkey").limit(200).select("o_orderkey")


@query("l09_issue_page", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 40 OFFSET 80")
def l09(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'P'").orderBy("o_orderkey").offset(80).limit(40).select("o_orderkey", "o_orderstatus")


@query("u04_subset_with_parents", "SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS item, 'root' AS parent_set FROM documents WHERE lang = 'fr'")
def u04(spark, d):
    return table(spark, d, "documents").filter("lang = 'fr'").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("item"), F.lit("root").alias("parent_set"))


@query("j08_conservation", "SELECT count(*) AS left_rows, true AS conserved FROM orders")
def j08(spark, d):
    left, right = sides(spark, d)
    r = reconcile(left, right, SPEC)
    seen = r.filter("left_row_id is not null").select(F.col("left_row_id").alias("row_id"))
    c = queue.conservation(left.select("row_id"), seen, "row_id")
    return left.agg(F.count(F.lit(1)).alias("left_rows")).crossJoin(c.select((F.col("added") + F.col("dropped") + F.col("repeated") == 0).alias("conserved")))


@query("c17_implied_cast", "SELECT count_if(o_orderkey % 41 <> 0 AND o_orderkey % 53 <> 0 OR o_orderkey % 41 <> 0) AS same FROM orders WHERE o_orderkey % 97 <> 0")
def c17(spark, d):
    o = table(spark, d, "orders")
    text = lambda df, e: cells.to_cells(df.selectExpr("o_orderkey", f"CAST({e} AS STRING) AS price"), "o_orderkey")
    price = "CAST(o_totalprice AS DECIMAL(18,2))"
    left, right = text(o, price), text(o.filter("o_orderkey % 97 <> 0"), f"{price} + CASE WHEN o_orderkey % 41 = 0 THEN 5 WHEN o_orderkey % 53 = 0 THEN 0.01 ELSE 0 END")
    both = [recipe.cast(df, "c2", "decimal")[0] for df in (left, right)]
    spec = Spec(keys=(("c1", "c1"),), compare=(("c2", "c2"),), amounts=frozenset({"c2"}), tolerance="0.01")
    return reconcile(*both, spec).agg(F.count_if(F.col("category") == "same").alias("same"))


@query("t03_completeness", "SELECT count(*) AS tables, CAST(count_if(n_nationkey % 2 = 0) AS BIGINT) AS complete FROM nation")
def t03(spark, d):
    html = "'<table><tr><td>a</td><td>' || n_name || '</td></tr><tr><td>b</td>' || CASE WHEN n_nationkey % 2 = 0 THEN '<td>c</td>' ELSE '' END || '</tr></table>'"
    c = tables.cells_of(table(spark, d, "nation").selectExpr("n_nationkey", f"{html} AS html"), "n_nationkey", "html")
    return tables.validate(c, ["n_nationkey"]).agg(F.count(F.lit(1)).alias("tables"), F.count_if("complete").alias("complete"))


#: tables of three columns out of four rows of parts; the second version lost its row 1 and moved a column
VERSION = "SELECT p_partkey // 4 AS t, p_partkey % 4 AS row, c.col, CASE c.col WHEN 0 THEN p_name || p_partkey WHEN 1 THEN 'x' ELSE p_brand || '-' || p_partkey END AS text FROM part, (VALUES (0), (1), (2)) AS c(col)"


def versions(spark, d):
    cols = F.array(*(F.struct(F.lit(i).alias("col"), t.alias("text")) for i, t in enumerate((F.concat("p_name", F.col("p_partkey").cast("string")), F.lit("x"), F.concat_ws("-", "p_brand", "p_partkey")))))
    a = table(spark, d, "part").select(F.expr("p_partkey div 4").alias("t"), F.expr("p_partkey % 4").alias("row"), F.explode(cols).alias("c")).select("t", "row", "c.col", "c.text")
    b = a.filter("row <> 1").withColumn("row", F.when(F.col("row") > 1, F.col("row") - 1).otherwise(F.col("row"))).withColumn("col", F.lit(2) - F.col("col"))
    return a, b


@query("j26_cell_correspondence", f"SELECT t, row, col, CASE WHEN row > 1 THEN row - 1 ELSE row END AS row_b, 2 - col AS col_b, true AS same FROM ({VERSION}) WHERE row <> 1 AND col <> 1")
def j26(spark, d):
    return matching.match_cells(*versions(spark, d), ["t"])


@query("t05_reliability", "SELECT p_partkey // 4 AS t, 0.75::DOUBLE AS row_share, round(2.0::DOUBLE / 3, 6) AS col_share FROM part GROUP BY 1")
def t05(spark, d):
    return matching.reliability(*versions(spark, d), ["t"]).withColumn("col_share", F.round("col_share", 6))


@query("t06_values_conserved", "SELECT p_partkey // 4 AS t, false AS conserved FROM part GROUP BY 1")
def t06(spark, d):
    return matching.values_conserved(*versions(spark, d), ["t"])


@query("j31_set_join", "WITH s AS (SELECT p_partkey AS id, list_sort(list_distinct(string_split(p_name || ' ' || p_brand || ' ' || p_type, ' '))) AS items FROM part), m AS (SELECT items, min(id) AS id FROM s GROUP BY items) SELECT x.id AS a, y.id AS b, CAST(len(list_intersect(x.items, y.items)) AS DOUBLE) / len(list_distinct(list_concat(x.items, y.items))) AS similarity FROM m x, m y WHERE x.id < y.id AND len(list_intersect(x.items, y.items)) >= 0.6 * len(list_distinct(list_concat(x.items, y.items)))")
def j31(spark, d):
    return matching.set_join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ").alias("items")), 0.6)


@query("f30_roles", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(28,4)) AS paid, CAST(o_custkey AS DECIMAL(28,4)) AS owed FROM orders")
def f30(spark, d):
    text = "'Paid: ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) || '; owed ' || o_custkey || ' units'"
    return matching.roles(table(spark, d, "orders").selectExpr("o_orderkey", f"{text} AS t"), "t", ["paid", "owed"]).drop("t")
