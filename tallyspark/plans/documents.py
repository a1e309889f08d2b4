"""Queries over amounts, facts, texts, tables in documents, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import cells, money, text
from tallyspark.operators import alignment, facts, tables
from tallyspark.operators.reconcile import reconcile
from tallyspark.plans.cleaning import BASE, CLASSIFIED, SPEC, dirty, sides
from tallyspark.plans.registry import query, table
from tallyspark.session import shared_path
from tallyspark.sources import sinks
from tallyspark.streaming import events as streams

CENTS = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
LITERAL = f"CASE o_orderkey % 6 WHEN 0 THEN '(' || {CENTS} || ')' WHEN 1 THEN ' ' || {CENTS} || ' ' WHEN 2 THEN '12,34.50' WHEN 3 THEN '1,234,567.' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') WHEN 4 THEN '(-' || {CENTS} || ')' ELSE '-' || {CENTS} END"
PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"


@query("f01_accounting_amount", f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN -{PRICE} WHEN 1 THEN {PRICE} WHEN 3 THEN CAST('1234567.' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') AS DECIMAL(18,2)) WHEN 5 THEN -{PRICE} END AS amount FROM orders")
def f01(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey", f"{LITERAL} AS t")
    return df.select("o_orderkey", money.amount(F.col("t")).cast("decimal(18,2)").alias("amount"))


RICH = f"CASE o_orderkey % 6 WHEN 0 THEN 'HK$ ' || {CENTS} WHEN 1 THEN '12.5%' WHEN 2 THEN '—' WHEN 3 THEN '007' WHEN 4 THEN '（1,234.5）' ELSE '' END"


@query("f02_rich_amount", f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN 'dash' WHEN 3 THEN 'identifier' WHEN 5 THEN 'blank' ELSE 'number' END AS kind, CASE o_orderkey % 6 WHEN 0 THEN CAST({PRICE} AS DECIMAL(20,4)) WHEN 1 THEN 0.125 WHEN 4 THEN -1234.5 END AS value, CASE WHEN o_orderkey % 6 = 0 THEN 'HKD' END AS currency FROM orders")
def f02(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey", f"{RICH} AS t").select("o_orderkey", money.rich(F.col("t")).alias("x"))
    return df.select("o_orderkey", "x.kind", F.col("x.value").cast("decimal(20,4)").alias("value"), "x.currency")


UNIT = "CASE o_orderkey % 4 WHEN 0 THEN '单位：人民币 万元' WHEN 1 THEN '金额（元）' WHEN 2 THEN '单位:元（千元）' ELSE 'none' END"


@query("f03_unit", "SELECT o_orderkey % 4 AS k, CASE o_orderkey % 4 WHEN 0 THEN '万元' WHEN 1 THEN '元' END AS unit, count(*) AS n FROM orders GROUP BY 1, 2")
def f03(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey % 4 AS k", f"{UNIT} AS t")
    return df.select("k", money.unit(F.col("t")).alias("unit")).groupBy("k", "unit").agg(F.count(F.lit(1)).alias("n"))


@query("f05_comparable_text", "SELECT doc_id, replace(lower(regexp_replace(text, '\\s+', '', 'g')), 'ß', 'ss') AS k FROM documents")
def f05(spark, d):
    return table(spark, d, "documents").select("doc_id", text.comparable(F.col("text")).alias("k"))


@query("f06_collapsed", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents")
def f06(spark, d):
    return table(spark, d, "documents").select("doc_id", text.collapsed(F.col("text")).alias("t"))


KIND = f"CASE o_orderkey % 5 WHEN 0 THEN '2026-01-02' WHEN 1 THEN '000123' WHEN 2 THEN {CENTS} WHEN 3 THEN '42' ELSE o_orderpriority END"


@query("f07_field_kind", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'date' WHEN 1 THEN 'identifier' WHEN 2 THEN 'amount' WHEN 3 THEN 'number' ELSE CASE WHEN o_orderpriority LIKE '% %' OR length(o_orderpriority) < 6 THEN 'text' ELSE 'identifier' END END AS kind FROM orders")
def f07(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{KIND} AS t").select("o_orderkey", text.field_kind(F.col("t")).alias("kind"))


@query("f08_fingerprint", "SELECT c_custkey, sha256('[\"' || c_name || '\",\"' || c_mktsegment || '\"]') AS h FROM customer")
def f08(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.sha2(F.to_json(F.array("c_name", "c_mktsegment")), 256).alias("h"))


@query("f09_line_search", "SELECT doc_id, CAST(n AS BIGINT) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE contains(lower(line), 'licensed')")
def f09(spark, d):
    return text.search_lines(table(spark, d, "documents"), "doc_id", "text", "Licensed").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("f13_chunks", "SELECT conv_id, turn, CASE WHEN octet_length(encode(text)) = 0 THEN 0 ELSE length(text) END AS covered FROM conversations")
def f13(spark, d):
    df = table(spark, d, "conversations").select("conv_id", "turn", F.explode_outer(text.chunks("text", F.lit(200), F.lit(40))).alias("c"))
    return df.groupBy("conv_id", "turn").agg(F.coalesce(F.max("c.end"), F.lit(0)).cast("long").alias("covered"))


@query("f12_markdown_render", "SELECT n_nationkey, '| ' || n_name || ' | ' || n_regionkey || ' |' AS row FROM nation")
def f12(spark, d):
    return table(spark, d, "nation").select("n_nationkey", text.markdown_row(F.col("n_name"), F.col("n_regionkey")).alias("row"))


@query(
    "f16_line_diff",
    """WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), n AS (SELECT doc_id, x, len(x) AS n FROM t)
SELECT doc_id, 'replace' AS op, 0 AS a0, 1 AS a1, 0 AS b0, CASE WHEN n = 1 THEN 2 ELSE 1 END AS b1, x[1] AS before, CASE WHEN n = 1 THEN 'first line' || chr(10) || 'last line' ELSE 'first line' END AS after FROM n
UNION ALL SELECT doc_id, 'insert', CAST(n AS INTEGER), CAST(n AS INTEGER), CAST(n AS INTEGER), CAST(n + 1 AS INTEGER), NULL, 'last line' FROM n WHERE n > 1""",
)
def f16(spark, d):
    """Each text against a copy with another first line and one line more."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat(F.regexp_replace("text", "^[^\n]*", "first line"), F.lit("\nlast line")).alias("other"))
    return alignment.line_changes(docs, ["doc_id"], "text", "other").drop("moved")


@query("f25_digit_runs", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]{8,}')) AS runs, length(regexp_replace(text, '[0-9 ]', '', 'g')) AS rest FROM documents")
def f25(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]{8,}"), 0)).cast("long").alias("runs"), F.length(F.regexp_replace("text", "[0-9 ]", "")).cast("long").alias("rest"))


@query("f26_number_tokens", "SELECT lang, CAST(sum(len(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) AS n FROM documents GROUP BY lang")
def f26(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), 0))).alias("n"))


@query("j12_fact_alignment", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 7 = 0 AND c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN CASE WHEN seg_a > 0 THEN 'only_b' ELSE 'insufficient' END WHEN c_custkey % 5 = 0 THEN CASE WHEN seg_b > 0 THEN 'only_a' ELSE 'insufficient' END WHEN c_custkey % 11 = 0 THEN 'insufficient' WHEN c_custkey % 3 = 0 THEN 'conflict' ELSE 'consistent' END AS status FROM customer, (SELECT 1 AS seg_a, 1 AS seg_b)) WHERE status IS NOT NULL GROUP BY status")
def j12(spark, d):
    c = table(spark, d, "customer")
    price = F.col("c_acctbal").cast("decimal(18,2)")
    left = c.filter("c_custkey % 7 <> 0").select(F.col("c_mktsegment").alias("entity"), F.col("c_name").alias("work_item"), F.lit("price").alias("field"), price.cast("string").alias("value"), F.lit("2026-01").alias("as_of"))
    shifted = price + F.when(F.expr("c_custkey % 3 = 0"), 2).otherwise(F.lit(0.3).cast("decimal(3,1)"))
    right = c.filter("c_custkey % 5 <> 0").select(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("entity"), F.col("c_name").alias("work_item"), F.lit("price").alias("field"), F.concat(shifted.cast("string"), F.lit("%")).alias("value"), F.when(F.expr("c_custkey % 11 = 0"), "2026-02").otherwise("2026-01").alias("as_of"))
    return facts.summary(facts.align(left, right, {"price": "percentage"}, 0.5))


@query("k10_status_counts", CLASSIFIED + " SELECT category, count(*) AS n FROM x GROUP BY category")
def k10(spark, d):
    return reconcile(*sides(spark, d), SPEC).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


HTML = "'<table><tr><th colspan=2>' || p_brand || '</th></tr><tr><td>' || p_partkey || '</td><td>a<br>b</td></tr></table>'"


@query("s10_html_tables", "SELECT p_partkey, 0 AS table_no, 0 AS row, 0 AS col, 1 AS row_span, 2 AS col_span, p_brand AS text, true AS is_header FROM part UNION ALL SELECT p_partkey, 0, 1, 0, 1, 1, CAST(p_partkey AS VARCHAR), false FROM part UNION ALL SELECT p_partkey, 0, 1, 1, 1, 1, 'a' || chr(10) || 'b', false FROM part")
def s10(spark, d):
    return tables.cells_of(table(spark, d, "part").selectExpr("p_partkey", f"{HTML} AS html"), "p_partkey", "html")


@query("s11_markdown_tables", "SELECT p_partkey, 0 AS row, 0 AS col, 'name' AS text FROM part UNION ALL SELECT p_partkey, 0, 1, 'a|b' FROM part UNION ALL SELECT p_partkey, 1, 0, p_name FROM part UNION ALL SELECT p_partkey, 1, 1, '`x|y`' FROM part")
def s11(spark, d):
    md = "'intro' || chr(10) || '| name | a\\\\|b |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || p_name || ' | `x|y` |' || chr(10) || 'end'"
    return tables.cells_of(table(spark, d, "part").selectExpr("p_partkey", f"{md} AS t"), "p_partkey", "t", markdown=True).select("p_partkey", "row", "col", "text")


def part_cells(spark, d):
    return tables.cells_of(table(spark, d, "part").selectExpr("p_partkey", f"{HTML} AS html"), "p_partkey", "html")


@query("t01_grid_validation", "SELECT p_partkey, 2 AS n_rows, 2 AS n_cols, CAST(4 AS BIGINT) AS covered, CAST(0 AS BIGINT) AS overlaps, true AS complete FROM part")
def t01(spark, d):
    return tables.validate(part_cells(spark, d), ["p_partkey"])


@query("t02_dense_grid", "SELECT p_partkey, r AS slot_row, c AS slot_col, CASE WHEN r = 0 THEN p_brand WHEN c = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'a' || chr(10) || 'b' END AS text FROM part, (VALUES (0), (1)) AS a(r), (VALUES (0), (1)) AS b(c)")
def t02(spark, d):
    return tables.slots(part_cells(spark, d), ["p_partkey"]).select("p_partkey", "slot_row", "slot_col", "text")


@query("t04_fingerprints", "SELECT p_partkey, sha256('[{\"row\":0,\"col\":0,\"row_span\":1,\"col_span\":2,\"is_header\":true},{\"row\":1,\"col\":0,\"row_span\":1,\"col_span\":1,\"is_header\":false},{\"row\":1,\"col\":1,\"row_span\":1,\"col_span\":1,\"is_header\":false}]') AS topology FROM part")
def t04(spark, d):
    return tables.fingerprints(part_cells(spark, d), ["p_partkey"]).select("p_partkey", "topology")


@query("s12_table_to_rows", "SELECT n_nationkey, 0 AS row, n_name || ';' || n_regionkey AS cells FROM nation")
def s12(spark, d):
    html = "'<table><tr><td>' || n_name || '</td><td>' || n_regionkey || '</td></tr></table>'"
    c = tables.cells_of(table(spark, d, "nation").selectExpr("n_nationkey", f"{html} AS html"), "n_nationkey", "html")
    return tables.to_csv_rows(c, ["n_nationkey"]).select("n_nationkey", "row", F.concat_ws(";", "cells").alias("cells"))


@query("k01_flat_export", "SELECT c_custkey + 1 AS source_row, c_name AS name, c_mktsegment AS seg FROM customer")
def k01(spark, d):
    df = cells.to_cells(table(spark, d, "customer"), "c_custkey", columns=["c_name", "c_mktsegment"])
    out = sinks.flat(df)
    sinks.write_checked(out, shared_path(spark, "export"), "csv")
    return out.toDF("source_row", "name", "seg")


@query("k03_result_layout", CLASSIFIED + " SELECT category, left_source_row, right_source_row, CASE WHEN category IN ('same', 'different') THEN '[' || concat_ws(',', CASE WHEN d1 <> '' THEN '\"' || d1 || '\"' END, CASE WHEN d2 <> '' THEN '\"' || d2 || '\"' END) || ']' END AS different_columns_json FROM x")
def k03(spark, d):
    left, right = sides(spark, d)
    rows = sinks.result_rows(reconcile(left, right, SPEC), ["c1", "c2"], ["c1", "c2"])
    return rows.select("category", "left_source_row", "right_source_row", "different_columns_json")


@query("k04_csv_guard", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '''=1+1' WHEN 1 THEN ''' -2.50' WHEN 2 THEN '''@x' ELSE 'plain' END AS t FROM orders")
def k04(spark, d):
    t = F.expr("CASE o_orderkey % 4 WHEN 0 THEN '=1+1' WHEN 1 THEN ' -2.50' WHEN 2 THEN '@x' ELSE 'plain' END")
    return table(spark, d, "orders").select("o_orderkey", sinks.safe_csv(t).alias("t"))


@query("k05_read_back", f"SELECT id + 1 AS source_row, coalesce(name, '') AS name, coalesce(amount, '') AS amount, coalesce(flag, '') AS flag FROM ({BASE})")
def k05(spark, d):
    path = shared_path(spark, "read-back")
    sinks.write_checked(sinks.flat(dirty(spark, d)), path)
    back = spark.read.parquet(path)
    return back.select("source_row", *(F.col(f"`{c} | {h}`").alias(h) for c, h in (("c2", "name"), ("c3", "amount"), ("c4", "flag"))))


@query("k07_business_and_lineage", "SELECT 'business' AS what, c_name AS value, NULL AS source_row FROM customer UNION ALL SELECT 'lineage', 'r' || substr(sha256('rev:' || (c_custkey + 1)), 1, 32), c_custkey + 1 FROM customer")
def k07(spark, d):
    out, lineage = sinks.business(cells.to_cells(table(spark, d, "customer"), "c_custkey", columns=["c_name"]))
    rows = out.select(F.lit("business").alias("what"), F.col("c_name").alias("value"), F.lit(None).cast("long").alias("source_row"))
    return rows.unionByName(lineage.select(F.lit("lineage").alias("what"), F.col("row_id").alias("value"), "source_row"))


LONG = "length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 3000"


@query("k08_long_text_parts", f"SELECT doc_id, CAST(i AS INTEGER) AS no, CASE WHEN {LONG} THEN substr(text, CAST(i AS BIGINT) * 1500 + 1, 1500) ELSE text END AS part FROM (SELECT *, unnest(range(CASE WHEN {LONG} THEN CAST(ceil(length(text) / 1500.0) AS BIGINT) ELSE 1 END)) AS i FROM documents)")
def k08(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(sinks.split_long(F.col("text"), 3000)).alias("no", "part"))


@query("r01_outbox_stream", "SELECT event_id, user_id, event_type FROM events")
def r01(spark, d):
    return streams.drain(streams.stream(spark, f"{d}/events.parquet").select("event_id", "user_id", "event_type"), "outbox")


@query("r03_status_stream", "SELECT user_id, CASE WHEN count_if(event_type = 'error') > 0 THEN 'failed' WHEN count_if(event_type = 'purchase') > 0 THEN 'completed' WHEN count_if(event_type = 'click') > 0 THEN 'running' ELSE 'queued' END AS status, max(event_id) AS generation FROM events GROUP BY user_id")
def r03s(spark, d):
    return streams.drain(streams.projected(streams.stream(spark, f"{d}/events.parquet")), "status", "complete")


@query("r05_window_stream", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def r05(spark, d):
    out = streams.drain(streams.windowed(streams.stream(spark, f"{d}/events.parquet")), "windows", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("r04_idempotent_stream", "SELECT count(DISTINCT user_id) AS keys FROM events")
def r04s(spark, d):
    return streams.drain(streams.first_requests(streams.stream(spark, f"{d}/events.parquet"), "user_id").select("event_id", "user_id"), "requests").agg(F.count_distinct("user_id").alias("keys"))
