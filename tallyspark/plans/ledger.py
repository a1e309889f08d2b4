"""Queries over work queues: unions of todos, facets, paging, latest per key, joins, sets and events.

orders stand for issues, customers for findings, events for an event log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import paging, queue
from tallyspark.plans.registry import query, table

PRIORITY = "CAST(substr(o_orderpriority, 1, 1) AS INT)"
TODOS = f"""SELECT 'issue' AS kind, o_orderkey AS id, {PRIORITY} AS priority, CAST(o_orderdate AS DATE) AS sort_at, o_orderstatus AS state FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'finding', c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 4 END, DATE '1996-01-01', CASE WHEN c_custkey % 3 = 0 THEN 'O' ELSE 'P' END FROM customer WHERE c_acctbal < 1000"""


def todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").selectExpr("'issue' AS kind", "o_orderkey AS id", f"{PRIORITY} AS priority", "CAST(o_orderdate AS DATE) AS sort_at", "o_orderstatus AS state")
    findings = table(spark, sf_dir, "customer").filter("c_acctbal < 1000").selectExpr("'finding' AS kind", "c_custkey AS id", "CASE WHEN c_acctbal < 0 THEN 1 ELSE 4 END AS priority", "DATE '1996-01-01' AS sort_at", "CASE WHEN c_custkey % 3 = 0 THEN 'O' ELSE 'P' END AS state")
    return queue.union_todos(issues, findings)


@query("u01_union_todos", f"SELECT kind, state, priority, count(*) AS n FROM ({TODOS}) GROUP BY kind, state, priority")
def u01(spark, d):
    return todos(spark, d).groupBy("kind", "state", "priority").agg(F.count(F.lit(1)).alias("n"))


@query("l01_todo_page", f"SELECT kind, id, priority, sort_at FROM ({TODOS}) ORDER BY priority, sort_at DESC, id, kind LIMIT 51 OFFSET 100")
def l01(spark, d):
    return queue.todo_page(todos(spark, d), offset=100, limit=50).select("kind", "id", "priority", "sort_at")


@query("w01_rank_cursor", f"SELECT kind, id, CAST((rn - 1) // 50 * 50 AS BIGINT) AS cursor FROM (SELECT kind, id, row_number() OVER (ORDER BY priority, sort_at DESC, id, kind) AS rn FROM ({TODOS})) WHERE id % 500 = 7")
def w01(spark, d):
    t = todos(spark, d)
    return queue.cursors(t, t.filter("id % 500 = 7"), limit=50).select("kind", "id", "cursor")


@query("l02_keyset_page", "SELECT event_id, event_type FROM events WHERE event_id > 5000 ORDER BY event_id LIMIT 100")
def l02(spark, d):
    return queue.keyset_page(table(spark, d, "events"), "event_id", after=5000, limit=100).select("event_id", "event_type")


@query("l03_snapshot_guard", "SELECT CAST(count(*) AS BIGINT) AS n, max(event_id) AS revision FROM events")
def l03(spark, d):
    e = table(spark, d, "events")
    return e.agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("revision"))


PAGED = [paging.Order("priority"), paging.Order("sort_at", descending=True), paging.Order("id"), paging.Order("kind")]


@query("l03_guarded_pages", f"SELECT CAST((rn - 1) // 200 AS INTEGER) AS page, kind, id, priority, sort_at FROM (SELECT *, row_number() OVER (ORDER BY priority, sort_at DESC, id, kind) AS rn FROM ({TODOS}) WHERE state = 'O') WHERE rn <= 600")
def l03_pages(spark, d):
    """Three pages of open todos, each found by the cursor of the one before."""
    t, cursor, found = todos(spark, d), None, []
    for no in range(3):
        got = paging.page(t, {"state": "O"}, PAGED, 200, b"key of the service", cursor)
        found += [(no, r.kind, r.id, r.priority, r.sort_at) for r in got.rows]
        cursor = got.cursor
        if cursor is None:
            break
    return spark.createDataFrame(found, "page int, kind string, id long, priority int, sort_at date")


@query("l05_top_k_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 3")
def l05(spark, d):
    return queue.top_k(table(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("l08_filtered_page_counts", f"SELECT state, count(*) AS n, count_if(priority <= 2 AND id < 300) AS before FROM ({TODOS}) GROUP BY state")
def l08(spark, d):
    return todos(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("priority <= 2 and id < 300")).alias("before"))


@query("a02_single_value_guard", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS status, count(*) AS n FROM orders GROUP BY o_custkey")
def a02(spark, d):
    return queue.single_value(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "status")


@query("a03_min_concat", "SELECT o_custkey, min(o_orderpriority || '|' || o_orderstatus) AS first FROM orders GROUP BY o_custkey")
def a03(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.concat_ws("|", "o_orderpriority", "o_orderstatus")).alias("first"))


@query("a04_state_counts", "SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1")
def a04(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("n"))


ROLLUP = "CASE WHEN count_if(event_type = 'error') > 0 THEN 'failed' WHEN count_if(event_type = 'purchase') > 0 THEN 'completed' WHEN count_if(event_type = 'click') > 0 THEN 'running' ELSE 'queued' END"


@query("a05_status_rollup", f"SELECT user_id, count_if(event_type = 'error') AS failed, count_if(event_type = 'purchase') AS done, {ROLLUP} AS status FROM events GROUP BY user_id")
def a05(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("done"), F.expr(ROLLUP).alias("status"))


@query("a06_storage_bytes", "SELECT source, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes FROM documents GROUP BY source")
def a06(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))


@query("a07_tally_and_time", "SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM events GROUP BY event_type")
def a07(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"))


@query("a08_facets", "SELECT DISTINCT lang, source FROM documents")
def a08(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("a29_durations", "SELECT user_id, CAST(sum(greatest(0, s)) AS BIGINT) AS seconds FROM (SELECT user_id, event_id % 600 - 60 AS s FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, 100 - event_id % 300 FROM events WHERE event_type = 'click') GROUP BY user_id")
def a29(spark, d):
    e = table(spark, d, "events")
    both = e.filter("event_type = 'view'").selectExpr("user_id", "event_id % 600 - 60 AS s").unionByName(e.filter("event_type = 'click'").selectExpr("user_id", "100 - event_id % 300 AS s"))
    return both.groupBy("user_id").agg(F.sum(F.greatest(F.lit(0).cast("long"), "s")).alias("seconds"))


@query("a30_derived_state_counts", "SELECT CASE WHEN o_orderkey IS NULL THEN 'idle' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state, count(*) AS n, count(DISTINCT c_mktsegment || '|' || c_custkey) AS customers FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def a30(spark, d):
    df = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    state = F.when(F.col("o_orderkey").isNull(), "idle").when(F.col("o_orderstatus") == "F", "done").otherwise("open")
    return df.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.concat_ws("|", "c_mktsegment", "c_custkey")).alias("customers"))


@query("a31_agreeing_sources", "SELECT l_partkey, l_linenumber, count(DISTINCT l_suppkey) AS sources, min(l_returnflag) AS reading, (row_number() OVER (ORDER BY l_partkey, l_linenumber) - 1) // 64 AS chunk FROM lineitem GROUP BY l_partkey, l_linenumber HAVING count(DISTINCT l_suppkey) >= 2 AND count(DISTINCT l_returnflag) = 1")
def a31(spark, d):
    return queue.agreeing(table(spark, d, "lineitem"), ["l_partkey", "l_linenumber"], "l_suppkey", "l_returnflag", chunk=64)


@query("j15_inner_events_users", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'error'")
def j15(spark, d):
    return table(spark, d, "events").filter("event_type = 'error'").join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name")


STALE = "concat_ws(',', CASE WHEN o_orderkey IS NULL THEN 'no_result' END, CASE WHEN l_n IS NULL THEN 'no_lines' END, CASE WHEN c_acctbal < 0 THEN 'owner_blocked' END)"


@query("j16_staleness_reasons", f"SELECT c_custkey, o_orderkey, {STALE} AS reasons FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS l_n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def j16(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("l_n"))
    df = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return df.select("c_custkey", "o_orderkey", F.expr(STALE).alias("reasons"))


@query("j17_scalar_subquery", "SELECT n_name, count(*) AS n, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def j17(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return table(spark, d, "nation").join(c, "n_nationkey").join(s, "n_nationkey", "left").select("n_name", "n", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("j18_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j18(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j19_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j19(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j20_latest_version", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def j20(spark, d):
    return queue.latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("w07_latest_event", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def w07(spark, d):
    return queue.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


@query("j21_json_lateral", "SELECT event_id, j.key AS k, CAST(j.value AS BIGINT) AS v FROM events, json_each(props) AS j")
def j21(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("k", "v"))


@query("f23_json_functions", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_array_length('[1, 2, 3]') AS n, '{\"id\":' || event_id || '}' AS made FROM events")
def f23(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.json_array_length(F.lit("[1, 2, 3]")).alias("n"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("made"))


@query("j33_ancestors", "WITH RECURSIVE up(node, anc, depth) AS (SELECT c_custkey, c_custkey // 2, 1 FROM customer WHERE c_custkey >= 1 UNION ALL SELECT node, anc // 2, depth + 1 FROM up WHERE anc > 0) SELECT node, anc, depth FROM up WHERE anc > 0")
def j33(spark, d):
    edges = table(spark, d, "customer").filter("c_custkey >= 1").selectExpr("c_custkey AS node", "c_custkey div 2 AS parent").filter("parent > 0")
    return queue.ancestors(edges).select("node", "anc", "depth")


@query("j35_required_minus_delivered", "SELECT p.p_partkey, r.r_regionkey FROM part p CROSS JOIN region r WHERE NOT EXISTS (SELECT 1 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE l.l_partkey = p.p_partkey AND n.n_regionkey = r.r_regionkey)")
def j35(spark, d):
    # the requirement is parts times the five regions; regions are a fixed list
    required = table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r_regionkey"))
    where = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    delivered = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(where, F.col("l_suppkey") == F.col("s_suppkey"))
    return queue.missing(required, delivered.selectExpr("l_partkey AS p_partkey", "n_regionkey AS r_regionkey"), ["p_partkey", "r_regionkey"])


@query("u02_union_distinct", "SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events")
def u02(spark, d):
    return table(spark, d, "orders").selectExpr("o_custkey AS id").union(table(spark, d, "events").select("user_id")).distinct()


@query("u03_ordered_concat", "SELECT 0 AS part, c_custkey + 1 AS ordinal, c_name AS name FROM customer UNION ALL SELECT 1, (SELECT count(*) FROM customer) + s_suppkey + 1, s_name FROM supplier")
def u03(spark, d):
    a = table(spark, d, "customer").selectExpr("c_custkey + 1 AS ordinal", "c_name AS name")
    b = table(spark, d, "supplier").selectExpr("s_suppkey + 1 AS ordinal", "s_name AS name")
    return queue.ordered_concat([a, b])


@query("u05_symmetric_difference", "(SELECT 'left' AS side, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) UNION ALL SELECT 'right', k FROM (SELECT DISTINCT user_id AS k FROM events) WHERE k NOT IN (SELECT c_custkey FROM customer)")
def u05(spark, d):
    c, o, e = (table(spark, d, t) for t in ("customer", "orders", "events"))
    left = c.select(F.col("c_custkey").alias("k")).join(o.select(F.col("o_custkey").alias("k")), "k", "left_anti")
    right = e.select(F.col("user_id").alias("k")).distinct().join(c.select(F.col("c_custkey").alias("k")), "k", "left_anti")
    return left.select(F.lit("left").alias("side"), "k").unionByName(right.select(F.lit("right").alias("side"), "k"))


@query("u06_conservation", "SELECT CAST(0 AS BIGINT) AS added, count_if(o_orderkey % 97 = 0) AS dropped, CAST(0 AS BIGINT) AS repeated FROM orders")
def u06(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return queue.conservation(o, o.filter("o_orderkey % 97 <> 0"), "o_orderkey")


@query("r02_events_since", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 7500 ORDER BY event_id LIMIT 200")
def r02(spark, d):
    return queue.keyset_page(table(spark, d, "events"), "event_id", after=7500, limit=200).select("event_id", "user_id", "event_type")


@query("r03_status_projection", f"SELECT user_id, {ROLLUP} AS status, max(event_id) AS generation FROM events GROUP BY user_id")
def r03(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.expr(ROLLUP).alias("status"), F.max("event_id").alias("generation"))


@query("r04_idempotency", "SELECT k, min(event_id) AS receipt, count(*) AS n, count(DISTINCT event_type) > 1 AS conflict FROM (SELECT event_id, event_type, user_id % 50 AS k FROM events) GROUP BY k")
def r04(spark, d):
    return queue.idempotent(table(spark, d, "events").selectExpr("event_id", "event_type", "user_id % 50 AS k"), "k", "event_type", "event_id")


@query("r06_eta", "SELECT event_type, quantile_cont(v, 0.75) AS p75, count(*) AS warm FROM (SELECT event_type, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn > 1 GROUP BY event_type")
def r06(spark, d):
    return queue.warm_p75(table(spark, d, "events"), "event_type", ["ts", "event_id"], "value")


@query("w05_drop_cold_start", "SELECT event_type, count(*) - 1 AS n FROM events GROUP BY event_type")
def w05(spark, d):
    return queue.warm(table(spark, d, "events"), "event_type", ["ts", "event_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("w06_merged_intervals", "WITH s AS (SELECT user_id, event_id AS a, event_id + 40 AS b FROM events), m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b) AS island FROM m) SELECT user_id, min(a) AS a, max(b) AS b FROM g GROUP BY user_id, island")
def w06(spark, d):
    return queue.merge_intervals(table(spark, d, "events").selectExpr("user_id", "event_id AS a", "event_id + 40 AS b"), ["user_id"], "a", "b")


@query("f10_asset_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring') AND p_brand LIKE 'Brand#1%' AND p_size < 30")
def f10(spark, d):
    text = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return table(spark, d, "part").filter(text.contains("ring") & F.col("p_brand").startswith("Brand#1") & (F.col("p_size") < 30)).select("p_partkey")


@query("f11_padded_time", "SELECT event_id, rpad(substr(CAST(event_id AS VARCHAR), 1, 3), 6, '0') AS padded, nullif(event_type, 'view') AS t, instr(props, 'k') AS at FROM events")
def f11(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.rpad(F.substring(F.col("event_id").cast("string"), 1, 3), 6, "0").alias("padded"), F.nullif("event_type", F.lit("view")).alias("t"), F.instr("props", "k").alias("at"))


@query("f24_epoch_duration", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 + 30 AS elapsed FROM events")
def f24(spark, d):
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", sec.alias("sec"), (sec - 1704067200 + 30).alias("elapsed"))


@query("s05_raw_ingest", "SELECT 'lineitem' AS name, count(*) AS n, CAST(11 AS INTEGER) AS columns FROM lineitem")
def s05(spark, d):
    df = table(spark, d, "lineitem")
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("lineitem").alias("name"), "n", F.lit(len(df.columns)).alias("columns"))


@query("s07_sample", "SELECT doc_id, substr(text, 1, 512) AS text FROM documents ORDER BY doc_id LIMIT 5")
def s07(spark, d):
    return table(spark, d, "documents").orderBy("doc_id").limit(5).select("doc_id", F.substring("text", 1, 512).alias("text"))
