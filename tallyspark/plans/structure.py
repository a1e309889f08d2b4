"""Queries over the structure of tables: correspondence, edits, regions, alignment, fusion, and resumable state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators import alignment, correspondence, fusion, geometry, grids, lineage, ordinals, recipe, stats, tables
from tallyspark.plans.cleaning import BASE, dirty
from tallyspark.plans.registry import query, table
from tallyspark.session import shared_path, written
from tallyspark.streaming import events as streams

#: the lines of each order, numbered
LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_tax, l_discount) - 1 AS ln FROM lineitem"
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_tax", "l_discount"]
KEY = ["l_orderkey"]


def lines(spark, d) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    return table(spark, d, "lineitem").withColumn("ln", F.row_number().over(w) - 1)


def unit(df: DataFrame, row: str, col: int, text: str, rows: str = "1", header: str = "false") -> DataFrame:
    return df.selectExpr("l_orderkey", f"{row} AS row", f"{col} AS col", f"{rows} AS row_span", "1 AS col_span", f"{text} AS text", f"{header} AS is_header")


def flags(spark, d) -> tuple[DataFrame, DataFrame]:
    """A grid a order of its lines' return flags and suppliers; and one in which runs of a flag are one cell, which keeps all
    their texts unless the order's number is a multiple of three."""
    li = lines(spark, d)
    supplier = "CAST(l_suppkey AS STRING)"
    current = li.select(*KEY, F.expr("ln AS row"), F.posexplode(F.array("l_returnflag", F.expr(supplier))).alias("col", "text"))
    w = Window.partitionBy("l_orderkey").orderBy("ln")
    runs = li.withColumn("new", F.coalesce((F.lag("l_returnflag").over(w) != F.col("l_returnflag")).cast("int"), F.lit(1)))
    run = Window.partitionBy("l_orderkey", "run")
    runs = runs.withColumn("run", F.sum("new").over(w)).withColumns({"first": F.min("ln").over(run), "n": F.count(F.lit(1)).over(run).cast("int")})
    text = "CASE WHEN l_orderkey % 3 = 0 THEN l_returnflag ELSE trim(repeat(concat(l_returnflag, ' '), n)) END"
    cell = "named_struct('col', {}, 'row_span', {}, 'text', {}, 'stands', {})"
    proposed = runs.select(*KEY, F.expr("ln AS row"), F.explode(F.expr(f"array({cell.format(0, 'n', text, 'ln = first')}, {cell.format(1, 1, supplier, 'true')})")).alias("c")).filter("c.stands")
    rest = ["1 AS col_span", "false AS is_header"]
    return current.selectExpr(*KEY, "row", "col", "1 AS row_span", "text", *rest), proposed.selectExpr(*KEY, "row", "c.col", "c.row_span", "c.text", *rest)


RUNS = f"""l AS ({LINES}), s AS (SELECT *, CASE WHEN lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY ln) = l_returnflag THEN 0 ELSE 1 END AS new FROM l),
n AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY ln) AS run FROM s), r AS (SELECT l_orderkey, run, l_returnflag, min(ln) AS first, count(*) AS n FROM n GROUP BY ALL)"""


@query("t07_variants", f"WITH {RUNS} SELECT l_orderkey, 'merge' AS kind, CAST(first AS INTEGER) AS r0, 0 AS c0, CAST(first + n AS INTEGER) AS r1, 1 AS c1, CAST(n AS INTEGER) AS cells, l_orderkey % 3 <> 0 AS conserved FROM r WHERE n > 1")
def t07(spark, d):
    v = grids.variants(*flags(spark, d), KEY)
    return v.select(*KEY, "kind", *grids.REGION, F.size("before").alias("cells"), "conserved")


@query("t06_patch_outcomes", f"WITH {RUNS} SELECT l_orderkey, CAST(first AS INTEGER) AS r0, CASE WHEN l_orderkey % 3 = 0 THEN 'not_conserved' WHEN l_orderkey % 5 = 0 AND first = 0 THEN 'stale' ELSE 'applied' END AS outcome FROM r WHERE n > 1")
def t06_outcomes(spark, d):
    current, proposed = flags(spark, d)
    patches = written(grids.variants(current, proposed, KEY), "patches")
    # the first row of some tables has changed since the patches were made
    moved = current.withColumn("text", F.expr("CASE WHEN l_orderkey % 5 = 0 AND row = 0 AND col = 0 THEN 'edited' ELSE text END"))
    return grids.judged(moved, patches, KEY).select(*KEY, "r0", "outcome")


@query("t06_patched_grid", f"WITH {RUNS} SELECT l_orderkey, CAST(ln AS INTEGER) AS row, 1 AS col, 1 AS row_span, CAST(l_suppkey AS VARCHAR) AS text FROM l UNION ALL SELECT l_orderkey, CAST(first AS INTEGER), 0, CAST(n AS INTEGER), trim(repeat(l_returnflag || ' ', n)) FROM r WHERE l_orderkey % 3 <> 0 OR n = 1 UNION ALL SELECT l_orderkey, CAST(ln AS INTEGER), 0, 1, l_returnflag FROM n JOIN r USING (l_orderkey, run, l_returnflag) WHERE l_orderkey % 3 = 0 AND r.n > 1")
def t06_grid(spark, d):
    current, proposed = flags(spark, d)
    return grids.apply(current, written(grids.variants(current, proposed, KEY), "patches"), KEY).select(*KEY, "row", "col", "row_span", "text")


@query("t07_inserted_rows", f"WITH l AS ({LINES}), u AS (SELECT l_orderkey FROM l GROUP BY 1 HAVING count(DISTINCT l_partkey) = count(*)) SELECT l_orderkey, 'insert_rows' AS kind, 1 AS r0, 2 AS r1, l_orderkey % 2 = 0 AS conserved FROM u")
def t07_inserted(spark, d):
    li = lines(spark, d).withColumn("part", F.expr("CAST(l_partkey AS STRING)"))
    blank = "CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'total' END"
    own = "named_struct('row', {}, 'text', {})"
    first = f"array({own.format('0L', 'part')}, {own.format('1L', blank)})"
    shifted = li.select(*KEY, F.explode(F.expr(f"CASE WHEN ln = 0 THEN {first} ELSE array({own.format('ln + 1L', 'part')}) END")).alias("c"))
    proposed = unit(shifted, "c.row", 0, "c.text")
    current = unit(li, "ln", 0, "part")
    return grids.insertions(current, proposed, KEY).select(*KEY, "kind", "r0", "r1", "conserved")


def versions(spark, d) -> tuple[DataFrame, DataFrame]:
    """The lines of each order as a table of four columns, and a later version: the second line of some orders is gone,
    some quantities are changed, and the columns of some are turned around."""
    li = lines(spark, d)
    text = ["l_partkey", "l_returnflag", "cast(l_quantity as int)", "l_linestatus"]
    grid = li.select(*KEY, F.col("ln").alias("row"), F.posexplode(F.array(*(F.expr(f"cast({t} as string)") for t in text))).alias("col", "text"))
    later = grid.filter("not (l_orderkey % 3 = 0 and row = 1)")
    later = later.withColumn("text", F.expr("case when l_orderkey % 4 = 0 and col = 2 then concat(text, '.5') else text end"))
    later = later.withColumn("row", F.expr("case when l_orderkey % 3 = 0 and row > 1 then row - 1 else row end"))
    return grid, later.withColumn("col", F.expr("case when l_orderkey % 5 = 0 then 3 - col else col end"))


@query("j26_correspondence")
def j26_correspondence(spark, d):
    return correspondence.correspond(*versions(spark, d), KEY)


#: two boxes turned by 45 degrees: |x - cx| + |y - cy| <= r is a box in x + y and x - y
DIAMONDS = "SELECT p_partkey, p_partkey * 37 % 101 AS cx, p_partkey * 53 % 89 AS cy, 5.0 + p_size AS r, p_partkey * 37 % 101 + p_size % 11 AS dx, p_partkey * 53 % 89 - p_size % 7 AS dy, 8.0 + p_size % 13 AS q FROM part"


def diamond(x: str, y: str, r: str):
    p = lambda a, b: F.struct(F.expr(a).cast("double").alias("x"), F.expr(b).cast("double").alias("y"))
    return F.array(p(f"{x} + {r}", y), p(x, f"{y} + {r}"), p(f"{x} - {r}", y), p(x, f"{y} - {r}"))


@query("f18_polygon_iou", f"WITH d AS ({DIAMONDS}), o AS (SELECT *, greatest(least(cx + cy + r, dx + dy + q) - greatest(cx + cy - r, dx + dy - q), 0) * greatest(least(cx - cy + r, dx - dy + q) - greatest(cx - cy - r, dx - dy - q), 0) AS w FROM d) SELECT p_partkey, round(CAST(w / (4 * r * r + 4 * q * q - w) AS DOUBLE), 6) AS iou FROM o")
def f18_iou(spark, d):
    df = table(spark, d, "part").selectExpr("p_partkey", "p_partkey * 37 % 101 AS cx", "p_partkey * 53 % 89 AS cy", "5.0 + p_size AS r", "p_partkey * 37 % 101 + p_size % 11 AS dx", "p_partkey * 53 % 89 - p_size % 7 AS dy", "8.0 + p_size % 13 AS q")
    df = df.select("p_partkey", diamond("cx", "cy", "r").alias("a"), diamond("dx", "dy", "q").alias("b"))
    return df.select("p_partkey", F.round(geometry.polygon_iou(F.col("a"), F.col("b")), 6).alias("iou"))


#: each order is a table on its customer's page; the other reading of the page has it shifted, and a third of them elsewhere
SPOT = "o_orderkey * 7 % 300"
SHIFTED = "o_orderkey * 7 % 300 + CASE WHEN o_orderkey % 3 = 0 THEN 500 ELSE o_orderkey % 30 END"


@query(
    "j27_table_identity",
    f"""WITH t AS (SELECT o_custkey AS page, o_orderkey AS id, {SPOT} AS x, {SHIFTED} AS z FROM orders),
c AS (SELECT l_orderkey AS id, CAST(l_partkey AS VARCHAR) AS text, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT id, sum(n) AS total FROM c GROUP BY 1),
p AS (SELECT a.page, a.id, b.id AS candidate, greatest(100 - abs(a.x - b.z), 0) / (200.0 - greatest(100 - abs(a.x - b.z), 0)) AS iou, (SELECT count(*) FROM c u JOIN c v USING (text) WHERE u.id = a.id AND v.id = b.id AND u.n = 1 AND v.n = 1) AS anchors, greatest(least(coalesce(sa.total, 0), coalesce(sb.total, 0)), 1) AS least FROM t a JOIN t b ON a.page = b.page LEFT JOIN s sa ON sa.id = a.id LEFT JOIN s sb ON sb.id = b.id),
k AS (SELECT *, 2 * iou + anchors / least AS score FROM p WHERE (iou >= 0.6 OR anchors >= 2) AND iou >= 0.15),
b AS (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY score DESC, candidate) AS no, lead(score) OVER (PARTITION BY page, id ORDER BY score DESC, candidate) AS next FROM k),
u AS (SELECT *, count(*) OVER (PARTITION BY page, candidate) AS takers FROM b WHERE no = 1 AND (next IS NULL OR score - next >= 0.2))
SELECT page, id, candidate, anchors, round(CAST(iou AS DOUBLE), 6) AS iou FROM u WHERE takers = 1""",
)
def j27(spark, d):
    o = table(spark, d, "orders")
    place = lambda x: geometry.box(F.expr(x), F.lit(0), F.expr(f"{x} + 100"), F.lit(50)).alias("region")
    a, b = (o.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("id"), place(x)) for x in (SPOT, SHIFTED))
    cells = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("id"), F.col("l_partkey").cast("string").alias("text"))
    return geometry.identify(a, b, cells, cells, ["page"], 100).select("page", "id", "candidate", "anchors", F.round("iou", 6).alias("iou"))


@query("f15_alignment_cost", r"WITH c AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '#', 'g') AS t FROM conversations) SELECT a.conv_id, a.turn, CAST(levenshtein(a.t, b.t) AS INTEGER) AS cost FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def f15_cost(spark, d):
    # the twin counts bytes, so letters outside ASCII are one sign here
    c = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[^\x00-\x7F]", "#").alias("text"))
    pairs = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other")), ["conv_id", "turn"])
    return alignment.costs(pairs, ["conv_id", "turn"], "text", "other")


@query("f15_corrected_errors", "SELECT doc_id, CAST(length(text) - length(replace(text, 'e', '')) AS INTEGER) AS corrected, CAST(length(text) - length(replace(text, ',', '')) AS INTEGER) AS introduced, CAST(length(replace(text, ',', '')) - length(replace(text, 'e', '')) AS INTEGER) AS net FROM documents")
def f15_gains(spark, d):
    # the first reading took each e for another letter; the second mends that but reads each comma as another sign
    docs = table(spark, d, "documents").select("doc_id", "text", F.translate("text", "e", "є").alias("before"), F.translate("text", ",", "‚").alias("after"))
    return alignment.gains(docs, ["doc_id"], "text", "before", "after")


@query(
    "f17_relocated_span",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 0 END END AS span_start FROM customer",
)
def f17(spark, d):
    # the span is the customer's name inside 'name (segment) ...'; a third of the new texts hold it twice with the same surroundings
    c = table(spark, d, "customer")
    old = F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(") "))
    new = F.expr("concat(case when c_custkey % 2 = 0 then 'new: ' else '' end, c_name, ' (', c_mktsegment, ') ', case when c_custkey % 3 = 0 then concat('| ', c_name, ' (', c_mktsegment, ') ') else '' end)")
    at = alignment.relocate(old, new, F.lit(0), F.char_length("c_name"))
    return c.select("c_custkey", at["start"].alias("span_start"))


#: three readings of the customer table, one column after the other; the second misreads some names, the third some segments and all balances
READINGS = "SELECT c_custkey, c_nationkey AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row FROM customer"


def readings(spark, d) -> dict[str, DataFrame]:
    c = table(spark, d, "customer").withColumn("row", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1)

    def reading(name: str, segment: str, balance: str) -> DataFrame:
        return c.select(F.col("c_nationkey").alias("t"), "row", F.posexplode(F.array(F.expr(name), F.expr(segment), F.expr(balance))).alias("col", "text"))

    money = "cast(cast(c_acctbal as decimal(18,2)) as string)"
    first = reading("concat('id ', c_custkey)", "case when c_custkey % 7 = 0 then lower(c_mktsegment) else c_mktsegment end", money)
    second = reading("concat('id ', c_custkey)", "c_mktsegment", f"case when c_custkey % 4 = 0 then concat(c_custkey, '.00') else {money} end")
    third = reading("concat('id ', c_custkey)", "case when c_custkey % 5 = 0 then 'ILLEGIBLE' else c_mktsegment end", f"case when c_custkey % 4 = 0 then concat(c_custkey, '.00') else {money} end")
    return {"first": first, "second": second, "third": third}


@query(
    "t08_fusion",
    f"""WITH r AS ({READINGS}), c AS (SELECT r.t, CAST(r.row AS INTEGER) AS row, customer.*, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS money FROM r JOIN customer USING (c_custkey))
SELECT t, row, 0 AS col, 'id ' || c_custkey AS selected, 'numeric_protection' AS reason FROM c
UNION ALL SELECT t, row, 1, CASE WHEN c_custkey % 35 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END, CASE WHEN c_custkey % 35 = 0 THEN 'tie' ELSE 'evidence_rule_passed' END FROM c
UNION ALL SELECT t, row, 2, money, 'numeric_protection' FROM c""",
)
def t08(spark, d):
    return fusion.fuse(readings(spark, d), "first", ["t"]).select("t", "row", "col", "selected", "reason")


@query(
    "t08_text_fusion",
    r"""WITH d AS (SELECT doc_id, text, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS head FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND NOT regexp_matches(head, '[0-9]') THEN 'a better line' || substr(text, length(head) + 1) ELSE text END AS text,
 CASE WHEN doc_id % 3 = 1 THEN 'insufficient_evidence' WHEN doc_id % 3 = 2 THEN 'tie' WHEN regexp_matches(head, '[0-9]') THEN 'numeric_protection' ELSE 'evidence_rule_passed' END AS reason FROM d""",
)
def t08_texts(spark, d):
    """Whole documents in three readings of unlike weight: the other two agree on another first line, or only one has the text."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    head = lambda line: F.regexp_replace("text", "^[^\n]*", line)
    second = docs.filter("doc_id % 3 <> 2").select("doc_id", head("a better line").alias("text"))
    third = docs.filter("doc_id % 3 <> 1").select("doc_id", F.when(F.expr("doc_id % 3 = 0"), head("a better line")).otherwise(head("one more line")).alias("text"))
    texts, units = fusion.fuse_texts({"first": docs, "second": second, "third": third}, "first", ["doc_id"], fusion.Policy(weights={"second": 2}))
    return texts.join(units.select("doc_id", "reason"), "doc_id", "left").select("doc_id", "text", "reason")


@query(
    "c20_lineage",
    f"""WITH b AS ({BASE}), n AS (SELECT count(*) AS n FROM b), f AS (SELECT count(*) AS n FROM b WHERE seg = 'BUILDING'), g AS (SELECT count(*) AS n FROM b WHERE amount IS NOT NULL)
SELECT n AS n_rows, CAST(0 AS BIGINT) AS depth, '' AS operators FROM n UNION ALL SELECT n, 1, 'trim' FROM n UNION ALL SELECT f.n, 2, 'trim>filter' FROM f UNION ALL SELECT g.n, 2, 'trim>filter' FROM g UNION ALL SELECT f.n, 3, 'trim>filter>rename' FROM f""",
)
def c20(spark, d):
    df = dirty(spark, d)
    graph = lineage.Graph(spark, shared_path(spark, "lineage"))
    root = graph.root("customer", df)
    a = graph.commit(root, recipe.Step("trim", {"column": "c2"}), df)
    b = graph.commit(a, recipe.Step("filter", {"column": "c6", "condition": "equals", "value": "BUILDING"}), df)
    graph.commit(b, recipe.Step("rename", {"column": "c2", "header": "holder"}), df)
    graph.commit(graph.undo(b), recipe.Step("filter", {"column": "c3", "condition": "not_null"}), df)
    return graph.paths().select("n_rows", "depth", "operators")


@query("r05_paging_index", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY o_key) - 1 AS ordinal FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_tax, l_discount) AS o_key FROM lineitem)")
def r05_index(spark, d):
    li = table(spark, d, "lineitem")
    numbered = ordinals.ordinals(li, [F.col(c) for c in ["l_orderkey", *ORDER]], "key")
    index = ordinals.PageIndex(spark, shared_path(spark, "index"))
    while not index.build(numbered, "key", 4, stop_after=1):  # each run is stopped after a batch and goes on
        pass
    return index.rows().select("l_orderkey", "l_linenumber", "l_partkey", "ordinal")


@query("r04_receipts", "WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, min(event_id) OVER (PARTITION BY user_id) AS receipt, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS first FROM events) SELECT user_id, event_id, receipt, CASE WHEN event_id = receipt THEN 'accepted' WHEN event_type = first THEN 'repeated' ELSE 'conflict' END AS outcome FROM e")
def r04_receipts(spark, d):
    requests = streams.receipts(streams.stream(spark, f"{d}/events.parquet"), "user_id", "event_id", "event_type")
    return streams.drain(requests, "receipts")


@query("r01_backlog", "WITH a AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'purchase') AS acked FROM events GROUP BY 1) SELECT CAST(e.user_id AS VARCHAR) AS user_id, count(*) AS appended, max(event_id) AS last, coalesce(max(acked), -1) AS acked, count_if(event_id > coalesce(acked, -1)) AS pending FROM events e JOIN a USING (user_id) GROUP BY e.user_id")
def r01_backlog(spark, d):
    # every event is appended, and a purchase confirms all of its user's up to itself
    kinds = F.explode(F.when(F.col("event_type") == "purchase", F.array(F.lit("append"), F.lit("ack"))).otherwise(F.array(F.lit("append"))))
    records = streams.stream(spark, f"{d}/events.parquet").select("user_id", kinds.alias("kind"), F.col("event_id").alias("generation"))
    return streams.drain_latest(streams.backlog(records, "user_id"), "backlog", "user_id")


#: pages whose tables differ from part to part: plain, captioned, overlapping, with spans out of bounds, unclosed, spanning rows, and none
PAGE = """p_name || '<p>x</p>' || chr(10) || CASE p_partkey % 8
 WHEN 0 THEN '<table><tr><td>a<br>b</td><td>c</td></tr><tr><td>d</td><td>' || p_brand || '</td></tr></table>'
 WHEN 1 THEN '<TABLE><caption> ' || p_brand || '  &amp; more</caption><tr><th>a</th></tr></TABLE>'
 WHEN 2 THEN '<table><tr><td>a</td><td rowspan=2>b</td></tr><tr><td colspan=2>c</td></tr></table>'
 WHEN 3 THEN '<table><tr><td colspan=0>a</td></tr></table><table><tr><td>b</td></tr></table>'
 WHEN 4 THEN '<table><tr><td>a</td><td rowspan=999999999>b</td></tr></table>'
 WHEN 5 THEN '<table><tr><td>a</td><td>b'
 WHEN 6 THEN '<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>'
 ELSE 'no table' END"""


@query(
    "s10_table_errors",
    f"""WITH p AS (SELECT p_partkey, p_brand, p_partkey % 8 AS k, lower({PAGE}) AS html FROM part), n AS (SELECT *, 0 AS no FROM p WHERE k < 7 UNION ALL SELECT *, 1 FROM p WHERE k = 3),
e AS (SELECT *, CASE WHEN no = 1 THEN strpos(html, '</table>') + 8 ELSE strpos(html, '<table>') END AS s, CASE WHEN no = 1 THEN length(html) - 7 ELSE strpos(html, '</table>') END AS z FROM n)
SELECT p_partkey, no AS table_no, CASE WHEN k = 1 THEN p_brand || ' & more' END AS caption, CAST(s - 1 AS INTEGER) AS start, CAST(CASE WHEN z > 0 THEN z - 1 END AS INTEGER) AS end_at,
 CASE WHEN k IN (0, 2, 6) THEN 2 ELSE 1 END AS n_rows, CASE WHEN k IN (1, 3) THEN 1 ELSE 2 END AS n_cols, CASE k WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 6 THEN 3 ELSE 2 END AS n_cells,
 CASE WHEN k = 2 THEN 'overlap' WHEN k = 4 OR k = 3 AND no = 0 THEN 'span' WHEN k = 5 THEN 'unclosed' END AS error,
 CAST(CASE WHEN k = 2 OR k = 3 AND no = 0 THEN strpos(html, '<td colspan') WHEN k = 4 THEN strpos(html, '<td rowspan') WHEN k = 5 THEN s END - 1 AS INTEGER) AS error_at FROM e""",
)
def s10_errors(spark, d):
    pages = table(spark, d, "part").selectExpr("p_partkey", f"{PAGE} AS html")
    return tables.tables_of(pages, "p_partkey", "html").withColumnRenamed("end", "end_at")


@query(
    "t01_varied_grids",
    """WITH p AS (SELECT p_partkey, p_partkey % 8 AS k FROM part), n AS (SELECT *, 0 AS table_no FROM p WHERE k < 7 UNION ALL SELECT *, 1 FROM p WHERE k = 3)
SELECT p_partkey, table_no, CASE WHEN k IN (0, 2, 6) THEN 2 ELSE 1 END AS n_rows, CASE WHEN k IN (1, 3) THEN 1 ELSE 2 END AS n_cols, CAST(CASE WHEN k IN (0, 2, 6) THEN 4 WHEN k IN (1, 3) THEN 1 ELSE 2 END AS BIGINT) AS covered, CAST(CASE WHEN k = 2 THEN 1 ELSE 0 END AS BIGINT) AS overlaps, k <> 2 AS complete FROM n""",
)
def t01_varied(spark, d):
    pages = table(spark, d, "part").selectExpr("p_partkey", f"{PAGE} AS html")
    return tables.validate(tables.cells_of(pages, "p_partkey", "html"), ["p_partkey", "table_no"])


@query(
    "t02_varied_slots",
    """WITH p AS (SELECT p_partkey, p_brand, p_partkey % 8 AS k FROM part), s AS (SELECT * FROM (VALUES (0, 0, 0, 'a\nb'), (0, 0, 1, 'c'), (0, 1, 0, 'd'), (0, 1, 1, NULL), (1, 0, 0, 'a'), (2, 0, 0, 'a'), (2, 0, 1, 'b'), (2, 1, 1, 'b'), (2, 1, 0, 'c'), (2, 1, 1, 'c'), (3, 0, 0, 'a'), (3, 0, 0, 'b'), (4, 0, 0, 'a'), (4, 0, 1, 'b'), (5, 0, 0, 'a'), (5, 0, 1, 'b'), (6, 0, 0, 'a'), (6, 1, 0, 'a'), (6, 0, 1, 'b'), (6, 1, 1, 'c')) AS t(k, slot_row, slot_col, text))
SELECT p_partkey, slot_row, slot_col, CASE WHEN s.text IS NULL THEN p_brand ELSE s.text END AS text FROM p JOIN s USING (k)""",
)
def t02_varied(spark, d):
    pages = table(spark, d, "part").selectExpr("p_partkey", f"{PAGE} AS html")
    return tables.slots(tables.cells_of(pages, "p_partkey", "html"), ["p_partkey"]).select("p_partkey", "slot_row", "slot_col", "text")


#: the lines of an order as a table with a total row after every third line and at the end; some totals are off
LEDGER = f"""l AS ({LINES}), m AS (SELECT l_orderkey, ln, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, ln // 3 AS block FROM l),
t AS (SELECT l_orderkey, block, sum(amount) + CASE l_orderkey % 5 WHEN 0 THEN 0.01 WHEN 1 THEN 7 ELSE 0 END AS total, count(*) AS n, min(ln) AS first, max(ln) AS last, sum(CASE WHEN l_orderkey % 7 = 0 AND ln % 3 = 1 THEN 1 ELSE 0 END) AS unknown FROM m GROUP BY 1, 2)"""


@query(
    "a14_contiguous_totals",
    f"""WITH {LEDGER} SELECT l_orderkey, CAST(last + block + 1 AS BIGINT) AS row, CAST(first + block AS BIGINT) AS first, CAST(last + block AS BIGINT) AS last, n, CASE WHEN unknown = 0 THEN CAST(CASE l_orderkey % 5 WHEN 0 THEN 0.01 WHEN 1 THEN 7 ELSE 0 END AS DECIMAL(18,2)) END AS difference,
 CASE WHEN unknown > 0 THEN 'uncertain' WHEN l_orderkey % 5 = 0 THEN 'rounding_possible' WHEN l_orderkey % 5 = 1 THEN 'suspect' ELSE 'equal' END AS status FROM t""",
)
def a14_contiguous(spark, d):
    li = lines(spark, d).select("l_orderkey", "ln", F.expr("ln div 3").alias("block"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    unknown = F.expr("l_orderkey % 7 = 0 and ln % 3 = 1")
    details = li.select("l_orderkey", (F.col("ln") + F.col("block")).cast("long").alias("row"), F.concat(F.lit("line "), "ln").alias("label"), F.when(~unknown, F.col("amount")).alias("amount"), F.lit(2).alias("places"))
    off = F.expr("case l_orderkey % 5 when 0 then 0.01BD when 1 then 7BD else 0BD end")
    totals = li.groupBy("l_orderkey", "block").agg((F.sum("amount") + off).cast("decimal(28,2)").alias("amount"), F.max("ln").alias("last"))
    label = F.when(F.col("block") == 0, "Subtotal: ").otherwise("TOTAL")
    totals = totals.select("l_orderkey", (F.col("last") + F.col("block") + 1).cast("long").alias("row"), label.alias("label"), "amount", F.lit(2).alias("places"))
    found = stats.contiguous_totals(details.unionByName(totals), ["l_orderkey"], ["total", "subtotal"])
    return found.select("l_orderkey", "row", "first", "last", "n", F.col("difference").cast("decimal(18,2)").alias("difference"), "status")
