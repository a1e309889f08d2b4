"""Queries over the cleaning steps and the reconciliation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import cells
from tallyspark.operators import recipe
from tallyspark.operators.reconcile import Spec, comparison_id, coverage, covered, deltas, reconcile
from tallyspark.plans.registry import query, table

#: the same expressions make the untidy input of the queries and of their SQL twins
DIRTY = {
    "id": "c_custkey",
    "name": "CASE WHEN c_custkey % 7 = 0 THEN '  ' || c_name || ' ' ELSE c_name END",
    "amount": "CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'bad' WHEN c_custkey % 17 = 0 THEN '10.00' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) END",
    "flag": "CASE c_custkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN ' FALSE ' WHEN 2 THEN 'yes' WHEN 3 THEN '1' ELSE NULL END",
    "day": "CASE c_custkey % 4 WHEN 0 THEN '1998-0' || CAST(1 + c_custkey % 9 AS STRING) || '-15' WHEN 1 THEN '19980230' WHEN 2 THEN '1998-9-1' ELSE '19981231' END",
    "seg": "c_mktsegment",
}
BASE = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in DIRTY.items()) + " FROM customer"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").selectExpr(*(f"{v} AS {k}" for k, v in DIRTY.items()))
    return cells.to_cells(df, "id")  # c1 id, c2 name, c3 amount, c4 flag, c5 day, c6 seg


def val(c: str, name: str):
    return F.col(c)["value"].alias(name)


@query("c01_trim", f"SELECT id + 1 AS source_row, trim(name) AS name FROM ({BASE})")
def c01(spark, d):
    return recipe.trim(dirty(spark, d), ["c2"]).select("source_row", val("c2", "name"))


@query("c02_trim_columns", f"SELECT id + 1 AS source_row, trim(name) AS name, trim(flag) AS flag FROM ({BASE})")
def c02(spark, d):
    return recipe.trim(dirty(spark, d), ["c2", "c4"]).select("source_row", val("c2", "name"), val("c4", "flag"))


@query("c03_rename", f"SELECT count(*) AS n, 'balance' AS header FROM ({BASE})")
def c03(spark, d):
    df = recipe.rename(dirty(spark, d), "c3", "balance")
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("header", F.lit(cells.headers(df)["c3"]))


@query("c04_map", f"SELECT id + 1 AS source_row, CASE seg WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE seg END AS seg FROM ({BASE})")
def c04(spark, d):
    return recipe.map_values(dirty(spark, d), "c6", {"BUILDING": "B", "MACHINERY": "M"}).select("source_row", val("c6", "seg"))


@query("c05_cast_decimal", f"SELECT id + 1 AS source_row, CASE WHEN amount IS NULL THEN 'null' WHEN amount = 'bad' THEN 'text' ELSE 'decimal' END AS kind, amount AS value FROM ({BASE})")
def c05(spark, d):
    return recipe.cast(dirty(spark, d), "c3", "decimal")[0].select("source_row", F.col("c3.kind").alias("kind"), val("c3", "value"))


@query("c05_cast_errors", f"SELECT id + 1 AS source_row, 'invalid_decimal' AS code, amount AS raw FROM ({BASE}) WHERE amount = 'bad'")
def c05e(spark, d):
    return recipe.cast(dirty(spark, d), "c3", "decimal")[1].select("source_row", "code", "raw")


@query("c06_cast_integer", f"SELECT id + 1 AS source_row, CASE WHEN amount IS NULL THEN 'null' WHEN amount <> 'bad' AND amount LIKE '%.00' THEN 'integer' ELSE 'text' END AS kind, CASE WHEN amount <> 'bad' AND amount LIKE '%.00' THEN CAST(CAST(CAST(amount AS DECIMAL(18,2)) AS BIGINT) AS VARCHAR) ELSE amount END AS value FROM ({BASE})")
def c06(spark, d):
    return recipe.cast(dirty(spark, d), "c3", "integer")[0].select("source_row", F.col("c3.kind").alias("kind"), val("c3", "value"))


@query("c07_cast_boolean", f"SELECT id + 1 AS source_row, CASE WHEN flag IS NULL THEN 'null' WHEN flag = 'yes' THEN 'text' ELSE 'boolean' END AS kind, CASE flag WHEN '1' THEN 'true' WHEN ' FALSE ' THEN 'false' ELSE flag END AS value FROM ({BASE})")
def c07(spark, d):
    return recipe.cast(dirty(spark, d), "c4", "boolean")[0].select("source_row", F.col("c4.kind").alias("kind"), val("c4", "value"))


@query("c08_cast_date", f"SELECT id + 1 AS source_row, CASE WHEN day IN ('19980230', '1998-9-1') THEN 'text' ELSE 'date' END AS kind, CASE WHEN day = '19981231' THEN '1998-12-31' ELSE day END AS value FROM ({BASE})")
def c08(spark, d):
    return recipe.cast(dirty(spark, d), "c5", "date")[0].select("source_row", F.col("c5.kind").alias("kind"), val("c5", "value"))


@query("c09_filter_null", f"SELECT count_if(amount IS NULL) AS is_null, count_if(amount IS NOT NULL) AS not_null FROM ({BASE})")
def c09(spark, d):
    df = dirty(spark, d)
    return recipe.keep(df, "c3", "is_null").agg(F.count(F.lit(1)).alias("is_null")).crossJoin(recipe.keep(df, "c3", "not_null").agg(F.count(F.lit(1)).alias("not_null")))


@query("c10_filter_equals", f"SELECT id + 1 AS source_row, 'equals' AS condition FROM ({BASE}) WHERE flag = 'yes' UNION ALL SELECT id + 1, 'not_equals' FROM ({BASE}) WHERE flag <> 'yes'")
def c10(spark, d):
    df = dirty(spark, d)
    return recipe.keep(df, "c4", "equals", "yes").select("source_row", F.lit("equals").alias("condition")).unionByName(recipe.keep(df, "c4", "not_equals", "yes").select("source_row", F.lit("not_equals").alias("condition")))


AMOUNTS = f"SELECT id + 1 AS source_row, seg, flag, amount, TRY_CAST(amount AS DECIMAL(38,12)) AS n FROM ({BASE})"


@query("c11_filter_compare", f"SELECT source_row, amount AS value FROM ({AMOUNTS}) WHERE n BETWEEN 100 AND 2000.5")
def c11(spark, d):
    df, _ = recipe.cast(dirty(spark, d), "c3", "decimal")
    return recipe.keep_compared(df, "c3", "between", "decimal", "100", "2000.5")[0].select("source_row", val("c3", "value"))


@query("c11_compare_errors", f"SELECT source_row, 'comparison_type_unknown' AS code, amount AS raw FROM ({AMOUNTS}) WHERE n IS NULL")
def c11e(spark, d):
    df, _ = recipe.cast(dirty(spark, d), "c3", "decimal")
    return recipe.keep_compared(df, "c3", "gt", "decimal", "0")[1].select("source_row", "code", "raw")


@query("c11_compare_dates", f"SELECT id + 1 AS source_row FROM ({BASE}) WHERE day LIKE '1998-0%' AND TRY_CAST(day AS DATE) >= DATE '1998-05-15'")
def c11d(spark, d):
    df, _ = recipe.cast(dirty(spark, d), "c5", "date")
    df = recipe.keep(df, "c5", "not_equals", "1998-12-31")
    return recipe.keep_compared(df, "c5", "ge", "date", "1998-05-15")[0].select("source_row")


@query(
    "c12_group_summary",
    f"SELECT seg, flag, count(*) AS row_count, CASE WHEN count(*) = count(n) THEN 'decimal' ELSE 'error' END AS total_kind, CASE WHEN count(*) = count(n) THEN CAST(CAST(sum(n) AS DECIMAL(38,2)) AS VARCHAR) END AS total, min(source_row) AS first_row FROM ({AMOUNTS}) WHERE source_row % 143 <> 1 AND (amount IS NULL OR amount <> 'bad' OR seg = 'BUILDING') GROUP BY seg, flag",
)
def c12(spark, d):
    df, _ = recipe.cast(dirty(spark, d), "c3", "decimal")
    df = df.filter("source_row % 143 <> 1").filter("c3.value is null or c3.value <> 'bad' or c6.value = 'BUILDING'")
    out = recipe.group_summary(df, ["c6", "c4"], ["c3"])
    return out.select(F.col("c6_value").alias("seg"), F.col("c4_value").alias("flag"), "row_count", F.col("c3_kind").alias("total_kind"), F.col("c3_total").alias("total"), "first_row")


@query("c13_duplicates", f"SELECT source_row, CASE WHEN amount IS NOT NULL AND c > 1 THEN c END AS group_size FROM (SELECT source_row, amount, count(*) OVER (PARTITION BY amount, seg) AS c FROM ({AMOUNTS}))")
def c13(spark, d):
    return recipe.mark_duplicates(dirty(spark, d), ["c3", "c6"]).select("source_row", "group_size")


@query("c13_duplicates_null", f"SELECT source_row, CASE WHEN c > 1 THEN c END AS group_size FROM (SELECT source_row, count(*) OVER (PARTITION BY flag, seg) AS c FROM ({AMOUNTS}))")
def c13n(spark, d):
    return recipe.mark_duplicates(dirty(spark, d), ["c4", "c6"], include_null=True).select("source_row", "group_size")


@query("c14_step_event", f"SELECT count(*) AS input_rows, count(*) AS output_rows, count_if(amount = 'bad') AS errors_total FROM ({BASE})")
def c14(spark, d):
    df = dirty(spark, d)
    return recipe.events(df, *recipe.cast(df, "c3", "decimal"))


STEPS = [recipe.Step("trim", {"column": "c2"}), recipe.Step("trim", {"column": "c4"}), recipe.Step("cast", {"column": "c3", "target": "decimal"}), recipe.Step("filter_compare", {"column": "c3", "comparison": "gt", "value_kind": "decimal", "value": "500"})]
REPLAYED = f"SELECT source_row, trim(name) AS name, amount FROM (SELECT id + 1 AS source_row, name, amount, TRY_CAST(amount AS DECIMAL(38,12)) AS n FROM ({BASE})) WHERE n > 500"


@query("c15_fused_replay", REPLAYED)
def c15(spark, d):
    return recipe.replay(dirty(spark, d), STEPS)[0].select("source_row", val("c2", "name"), val("c3", "amount"))


@query("c18_replay_mapped", REPLAYED)
def c18(spark, d):
    df = dirty(spark, d)
    df = df.select("row_id", "source_row", "c1", F.col("c3").alias("c2"), F.col("c2").alias("c3"), "c4", "c5", "c6")
    return recipe.replay(df, STEPS, {"c2": "c3", "c3": "c2"})[0].select("source_row", val("c3", "name"), val("c2", "amount"))


@query("c16_resolve_header", f"SELECT seg, count(*) AS n FROM ({BASE}) GROUP BY seg")
def c16(spark, d):
    df = dirty(spark, d)
    c = recipe.resolve(df, "seg")
    return df.groupBy(F.col(c)["value"].alias("seg")).agg(F.count(F.lit(1)).alias("n"))


@query("c19_page", f"SELECT id + 1 AS source_row, name FROM ({BASE}) ORDER BY source_row LIMIT 50 OFFSET 100")
def c19(spark, d):
    return recipe.page(dirty(spark, d), 100, 50).select("source_row", val("c2", "name"))


@query("s04_parquet_cells", "SELECT o_orderkey + 1 AS source_row, CAST(o_orderkey AS VARCHAR) AS key_value, 'integer' AS key_kind, o_orderstatus AS status_value, 'text' AS status_kind, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS date_value, 'text' AS date_kind FROM orders")
def s04(spark, d):
    df = cells.to_cells(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderkey")
    return df.select("source_row", *(x for c, n in (("c1", "key"), ("c2", "status"), ("c3", "date")) for x in (val(c, f"{n}_value"), F.col(c)["kind"].alias(f"{n}_kind"))))


@query("s08_kind_profile", f"SELECT 'amount' AS header, kind, count(*) AS n FROM (SELECT CASE WHEN amount = 'bad' THEN 'text' ELSE 'decimal' END AS kind FROM ({BASE}) WHERE amount IS NOT NULL) GROUP BY kind UNION ALL SELECT 'flag', 'text', count(flag) FROM ({BASE})")
def s08(spark, d):
    df, _ = recipe.cast(dirty(spark, d), "c3", "decimal")
    long = df.select(F.explode(F.array(*(F.struct(F.lit(h).alias("header"), F.col(c)["kind"].alias("kind")) for c, h in (("c3", "amount"), ("c4", "flag"))))).alias("x"))
    return long.filter("x.kind <> 'null'").groupBy("x.header", "x.kind").agg(F.count(F.lit(1)).alias("n"))


# reconciliation: orders against a changed copy of itself
CHANGED = {
    "k": "CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderkey END",
    "price": "CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 41 = 0 THEN 5 WHEN o_orderkey % 53 = 0 THEN 0.01 ELSE 0 END",
    "status": "CASE WHEN o_orderkey % 61 = 0 THEN 'X' ELSE o_orderstatus END",
    "row_no": "o_orderkey * 2",
}
LEFT = {"k": "CASE WHEN o_orderkey % 103 = 0 THEN NULL ELSE o_orderkey END", "price": "CAST(o_totalprice AS DECIMAL(18,2))", "status": "o_orderstatus", "row_no": "o_orderkey"}
_sel = lambda m, extra="": "SELECT " + ", ".join(f"{v} AS {k}" for k, v in m.items()) + f" FROM orders {extra}"
SIDES = f"l AS ({_sel(LEFT)}), r AS ({_sel(CHANGED, 'WHERE o_orderkey % 97 <> 0')} UNION ALL {_sel(CHANGED | {'row_no': 'o_orderkey * 2 + 1'}, 'WHERE o_orderkey % 89 = 0 AND o_orderkey % 97 <> 0')})"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    make = lambda m: [f"{v} AS {k}" for k, v in m.items()]
    right = orders.filter("o_orderkey % 97 <> 0")
    right = right.selectExpr(*make(CHANGED)).unionByName(right.filter("o_orderkey % 89 = 0").selectExpr(*make(CHANGED | {"row_no": "o_orderkey * 2 + 1"})))
    as_cells = lambda df: cells.to_cells(df, "row_no", columns=["k", "price", "status"])
    return as_cells(orders.selectExpr(*make(LEFT))), as_cells(right)


SPEC = Spec(keys=(("c1", "c1"),), compare=(("c2", "c2"), ("c3", "c3")), amounts=frozenset({"c2"}), tolerance="0.01")
CLASSIFIED = f"""WITH {SIDES},
n AS (SELECT k, count_if(s = 'l') AS nl, count_if(s = 'r') AS nr FROM (SELECT k, 'l' AS s FROM l UNION ALL SELECT k, 'r' FROM r) WHERE k IS NOT NULL GROUP BY k),
x AS (
SELECT CASE WHEN abs(l.price - r.price) <= 0.01 AND l.status = r.status THEN 'same' ELSE 'different' END AS category, n.k, l.row_no + 1 AS left_source_row, r.row_no + 1 AS right_source_row,
  CASE WHEN abs(l.price - r.price) <= 0.01 THEN '' ELSE 'c2:c2' END AS d1, CASE WHEN l.status = r.status THEN '' ELSE 'c3:c3' END AS d2, l.price AS lp, r.price AS rp
  FROM n JOIN l ON l.k = n.k JOIN r ON r.k = n.k WHERE nl = 1 AND nr = 1
UNION ALL SELECT 'only_left', n.k, l.row_no + 1, NULL, '', '', NULL, NULL FROM n JOIN l ON l.k = n.k WHERE nl = 1 AND nr = 0
UNION ALL SELECT 'only_right', n.k, NULL, r.row_no + 1, '', '', NULL, NULL FROM n JOIN r ON r.k = n.k WHERE nl = 0 AND nr = 1
UNION ALL SELECT 'ambiguous_left', n.k, l.row_no + 1, NULL, '', '', NULL, NULL FROM n JOIN l ON l.k = n.k WHERE nl > 1 OR nr > 1
UNION ALL SELECT 'ambiguous_right', n.k, NULL, r.row_no + 1, '', '', NULL, NULL FROM n JOIN r ON r.k = n.k WHERE nl > 1 OR nr > 1
UNION ALL SELECT 'only_left', NULL, l.row_no + 1, NULL, '', '', NULL, NULL FROM l WHERE k IS NULL
UNION ALL SELECT 'only_right', NULL, NULL, r.row_no + 1, '', '', NULL, NULL FROM r WHERE k IS NULL)"""


@query("reconcile_orders_rows", CLASSIFIED + " SELECT category, left_source_row, right_source_row, concat_ws(',', nullif(d1, ''), nullif(d2, '')) AS different_columns FROM x")
def reconcile_rows(spark, d):
    return reconcile(*sides(spark, d), SPEC).select("category", "left_source_row", "right_source_row", F.concat_ws(",", F.coalesce("different_columns", F.array().cast("array<string>"))).alias("different_columns"))


@query(
    "reconcile_orders_coverage",
    CLASSIFIED
    + " SELECT count_if(category IN ('same', 'different', 'only_left', 'ambiguous_left')) AS left_total, count_if(category IN ('same', 'different', 'only_right', 'ambiguous_right')) AS right_total, count_if(category = 'same') AS same, count_if(category = 'different') AS different, count_if(category = 'only_left') AS only_left, count_if(category = 'only_right') AS only_right, count_if(category = 'ambiguous_left') AS ambiguous_left, count_if(category = 'ambiguous_right') AS ambiguous_right, count(DISTINCT CASE WHEN category LIKE 'ambiguous%' THEN k END) AS ambiguous_keys FROM x",
)
def reconcile_coverage(spark, d):
    return covered(*sides(spark, d), SPEC)


@query("j09_comparison_identity", "SELECT 'same rows in another order' AS what, true AS same_id UNION ALL SELECT 'another revision', false UNION ALL SELECT 'a cell changed', false UNION ALL SELECT 'a row missing', false UNION ALL SELECT 'another tolerance', false UNION ALL SELECT 'the same tolerance written otherwise', true UNION ALL SELECT 'sides exchanged', false")
def j09(spark, d):
    left, right = sides(spark, d)
    least = left.agg(F.min("source_row").alias("r")).scalar()
    changed = left.withColumn("c3", F.when(F.col("source_row") == least, recipe.with_cell(F.col("c3"), F.lit("text"), F.lit("changed"))).otherwise(F.col("c3")))
    first = comparison_id("l", "r", SPEC, left, right)
    others = {
        "same rows in another order": comparison_id("l", "r", SPEC, left.repartition(5, "row_id"), right),
        "another revision": comparison_id("l2", "r", SPEC, left, right),
        "a cell changed": comparison_id("l", "r", SPEC, changed, right),
        "a row missing": comparison_id("l", "r", SPEC, left.filter(F.col("source_row") > least), right),
        "another tolerance": comparison_id("l", "r", replace(SPEC, tolerance="0.02"), left, right),
        "the same tolerance written otherwise": comparison_id("l", "r", replace(SPEC, tolerance="0.010"), left, right),
        "sides exchanged": comparison_id("r", "l", SPEC, right, left),
    }
    return spark.createDataFrame([(k, v == first) for k, v in others.items()], "what string, same_id boolean")


@query("j11_amount_deltas", CLASSIFIED + " SELECT left_source_row, 'c2:c2' AS field, CAST(rp - lp AS DECIMAL(18,2)) AS delta, abs(rp - lp) <= 0.01 AS within_tolerance FROM x WHERE lp IS NOT NULL AND rp IS NOT NULL")
def j11(spark, d):
    r = reconcile(*sides(spark, d), SPEC)
    return deltas(r, SPEC).join(r.select("left_row_id", "left_source_row"), "left_row_id").select("left_source_row", "field", F.col("delta").cast("decimal(18,2)").alias("delta"), "within_tolerance")


@query(
    "j04_null_policy_equal",
    f"WITH {SIDES}, n AS (SELECT k, count_if(s = 'l') AS nl, count_if(s = 'r') AS nr FROM (SELECT k, 'l' AS s FROM l UNION ALL SELECT k, 'r' FROM r) GROUP BY k) SELECT CAST(coalesce(sum(nl) FILTER (WHERE nl > 1 OR nr > 1), 0) AS BIGINT) AS ambiguous_left, CAST(coalesce(sum(nr) FILTER (WHERE nl > 1 OR nr > 1), 0) AS BIGINT) AS ambiguous_right, count_if(nl > 1 OR nr > 1) AS ambiguous_keys FROM n",
)
def j04(spark, d):
    spec = Spec(keys=(("c1", "c1"),), null_policy="equal")
    return coverage(reconcile(*sides(spark, d), spec)).select("ambiguous_left", "ambiguous_right", "ambiguous_keys")


@query("j03_text_policy", f"WITH b AS ({BASE}), l AS (SELECT lower(trim(name)) AS k FROM b), r AS (SELECT lower(c_name) AS k FROM customer WHERE c_custkey % 3 = 0) SELECT CAST(count_if(r.k IS NOT NULL) AS BIGINT) AS same, count_if(r.k IS NULL) AS only_left FROM l LEFT JOIN r ON l.k = r.k")
def j03(spark, d):
    right = table(spark, d, "customer").filter("c_custkey % 3 = 0").selectExpr("c_custkey AS id", "upper(c_name) AS name")
    spec = Spec(keys=(("c2", "c2"),), type_policy="text", trim_text=True, casefold_text=True)
    return coverage(reconcile(dirty(spark, d), cells.to_cells(right, "id"), spec)).select("same", "only_left")


@query("j02_ambiguous_lineitem", "WITH l AS (SELECT l_orderkey AS a, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT l_orderkey AS a, l_linenumber AS b, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2), x AS (SELECT l.n AS nl, coalesce(r.n, 0) AS nr FROM l LEFT JOIN r ON l.a = r.a AND l.b = r.b) SELECT count_if(nl = 1 AND nr = 1) AS same, count_if(nl = 1 AND nr = 0) AS only_left, count_if(nl > 1 OR nr > 1) AS ambiguous_keys, CAST(sum(CASE WHEN nl > 1 OR nr > 1 THEN nl ELSE 0 END) AS BIGINT) AS ambiguous_left FROM x")
def j02(spark, d):
    li = table(spark, d, "lineitem").withColumn("no", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    side = lambda df: cells.to_cells(df.select("no", "l_orderkey", "l_linenumber"), "no", columns=["l_orderkey", "l_linenumber"])
    spec = Spec(keys=(("c1", "c1"), ("c2", "c2")))
    return covered(side(li), side(li.filter("l_linestatus = 'O'")), spec).select("same", "only_left", "ambiguous_keys", "ambiguous_left")


@query("c05_cast_exponents", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey // CAST(10 ** l_linenumber AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(l_orderkey % CAST(10 ** l_linenumber AS BIGINT) AS VARCHAR), l_linenumber, '0') AS value FROM lineitem")
def c05x(spark, d):
    li = table(spark, d, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber").alias("no"), "l_orderkey", "l_linenumber", F.concat_ws("e-", "l_orderkey", "l_linenumber").alias("amount"))
    df = recipe.cast(cells.to_cells(li, "no", columns=["l_orderkey", "l_linenumber", "amount"]), "c3", "decimal")[0]
    return df.select(F.col("c1.value").cast("long").alias("l_orderkey"), F.col("c2.value").cast("int").alias("l_linenumber"), val("c3", "value"))


def long_amounts(spark, d):
    """lineitem with amounts of 14 places and of 30 digits."""
    li = table(spark, d, "lineitem").select(
        F.xxhash64("l_orderkey", "l_linenumber").alias("no"), "l_returnflag", F.concat("l_orderkey", F.lit(".0000000000000"), "l_linenumber").alias("fine"), F.concat(F.lit("1"), F.lpad(F.col("l_orderkey").cast("string"), 29, "0")).alias("long")
    )
    df = cells.to_cells(li, "no", columns=["l_returnflag", "fine", "long"])
    return recipe.cast(recipe.cast(df, "c2", "decimal")[0], "c3", "decimal")[0]


LONG = "SELECT l_returnflag AS flag, CAST(l_orderkey || '.0000000000000' || l_linenumber AS DECIMAL(38,14)) AS fine, CAST('1' || lpad(CAST(l_orderkey AS VARCHAR), 29, '0') AS DECIMAL(38,0)) AS long FROM lineitem"


@query("c12_long_sums", f"SELECT flag, count(*) AS row_count, CAST(sum(fine) AS VARCHAR) AS fine, CAST(sum(long) AS VARCHAR) AS long FROM ({LONG}) GROUP BY flag")
def c12l(spark, d):
    out = recipe.group_summary(long_amounts(spark, d), ["c1"], ["c2", "c3"])
    return out.select(F.col("c1_value").alias("flag"), "row_count", F.col("c2_total").alias("fine"), F.col("c3_total").alias("long"))


@query("c11_long_compare", f"SELECT CAST(fine AS VARCHAR) AS fine, count(*) AS n FROM ({LONG}) WHERE fine > 100.00000000000002 AND long <= 100000000000000000000000004000 GROUP BY 1")
def c11l(spark, d):
    df = recipe.keep_compared(long_amounts(spark, d), "c2", "gt", "decimal", "100.00000000000002")[0]
    df = recipe.keep_compared(df, "c3", "le", "decimal", "1" + "0" * 25 + "4000")[0]
    return df.groupBy(F.col("c2.value").alias("fine")).agg(F.count(F.lit(1)).alias("n"))


@query("j06_long_amounts", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <= 1 THEN 'same' ELSE 'different' END AS category FROM orders")
def j06l(spark, d):
    """Amounts of 30 digits that differ by 0, 1 or 2, at a tolerance of 1."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("id"))
    side = lambda more: cells.to_cells(o.select("o_orderkey", "id", F.concat(F.lit("7"), F.lpad((F.col("o_orderkey") + more).cast("string"), 29, "0")).alias("amount")), "o_orderkey", columns=["id", "amount"])
    r = reconcile(side(F.lit(0)), side(F.col("o_orderkey") % 3), Spec((("c1", "c1"),), (("c2", "c2"),), frozenset({"c2"}), tolerance="1"))
    return r.select(F.col("L.c1.value").cast("long").alias("id"), "category")
