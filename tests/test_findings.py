"""Cases of the review of round 3: queries on small tables of their own against their SQL twins, and bounds of steps."""

import random
from decimal import Decimal, localcontext

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import cells, exact
from tallyspark.operators import alignment, correspondence, fusion, geometry, grids, matching, recipe, similar
from tallyspark.plans import registry
from tests.test_queries import rows as plain_rows
from tests.test_structure import plain_correspondence


@pytest.fixture
def twin(spark, tmp_path_factory):
    """Run a query on tables made here, and say whether it gives what its SQL twin does."""

    def run(name, **tables):
        tmp_path = tmp_path_factory.mktemp("tables")
        con = duckdb.connect()
        for t, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        df = registry.queries()[name](spark, str(tmp_path))
        rel = con.sql(registry.oracle_sql()[name])
        got, want = plain_rows(df.columns, [tuple(r) for r in df.collect()]), plain_rows(rel.columns, rel.fetchall())
        assert got == want
        return got[1]

    return run


def test_substitutions_alone_need_no_table_of_costs(monkeypatch):
    def rows(a, b):
        raise AssertionError("a table of costs was made")

    monkeypatch.setattr(alignment, "_rows", rows)
    truth = "The first letters, and more of these, are here. " * 5000
    found = alignment.steps(truth, truth.replace("e", "є"))
    assert sum(s["n"] for s in found if s["op"] == "substitute") == truth.count("e") and {s["op"] for s in found} == {"equal", "substitute"}
    assert alignment.distance(truth, truth.replace(",", "‚")) == truth.count(",")


def test_distance_is_the_cost_of_the_path():
    r = np.random.default_rng(5)
    for _ in range(300):
        a, b = ("".join(r.choice(list("abcd"), r.integers(0, 40))) for _ in range(2))
        assert alignment.distance(a, b) == sum(s["n"] for s in alignment.steps(a, b) if s["op"] != "equal")


def test_results_of_paths_leave_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PIECE", 3)
    df = spark.range(50).select("id", F.lit("abcdef").alias("a"), F.concat(F.lit("a"), "id", F.lit("def")).alias("b")).coalesce(1)
    found = {r.id: "".join(s.text or "" for s in r.steps) for r in alignment.aligned(df, ["id"], "a", "b").collect()}
    assert len(found) == 50 and all(alignment.steps("abcdef", f"a{i}def") and str(i)[0] in t for i, t in found.items())


def test_anchors_round_halves_as_sql_does(spark, twin):
    money = spark.createDataFrame([(1, 2.5), (2, 3.5), (3, -0.5), (4, 7.0), (5, 0.49999999999999994)], "c_custkey long, c_acctbal double")
    found = twin("j25_unique_anchors", customer=money, supplier=money.toDF("s_suppkey", "s_acctbal"))
    assert [r[2] for r in found] == ["2", "4", "7"]


def boxed(spark, parts, suppliers):
    return {"part": spark.createDataFrame(parts, "p_partkey long, p_size long"), "supplier": spark.createDataFrame(suppliers, "s_suppkey long")}


def test_page_merge_counts_statuses_that_no_block_has(spark, twin):
    assert twin("j34_page_merge", **boxed(spark, [(1, 10)], [(100,)])) == [("0", "conflict"), ("1", "native"), ("1", "recognised")]


def test_overlaps_with_ties_and_equal_boxes(spark, twin):
    # keys a whole period apart stand in one place, so bests tie
    step = 997 * 983 * 991 * 977
    tables = boxed(spark, [(k + i * step, 1 + k % 50) for k in range(1, 300) for i in range(k % 3 + 1)], [(k + i * step,) for k in range(1, 120) for i in range(k % 2 + 1)])
    for name in ("w02_best_with_margin", "j24_mutual_best", "j23_token_cells", "f18_box_iou", "j22_box_overlap"):
        twin(name, **tables)


def test_pairs_of_boxes_stay_in_their_task(spark, twin):
    df = similar.best_overlaps(*(spark.range(50).select("id", F.col("id").alias("x0"), F.lit(0).alias("y0"), (F.col("id") + 9).alias("x1"), F.lit(5).alias("y1")) for _ in "lr"), 4)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "RepartitionByExpression" in plan
    assert {(r.l_id, r.r_id, r.area, r.next) for r in df.collect() if r.l_id == 20} == {(20, 20, 45, 40)}


def test_a_false_anchor_spoils_no_votes(spark):
    """A misread value that stands elsewhere in the table crosses the anchors of all rows between."""
    good = [(1, i, c, t) for i in range(12) for c, t in enumerate((f"id {i}", f"v {i}"))]
    first = [(t, i, c, "apple" if (i, c) == (1, 1) else x) for t, i, c, x in good]
    second = [(t, i, c, "apple" if (i, c) == (10, 1) else "gone" if (i, c) == (1, 1) else x) for t, i, c, x in good]
    readings = {n: spark.createDataFrame(x, "t int, row int, col int, text string") for n, x in (("first", first), ("second", second))}
    found = {(r.row, r.col): r.coverage for r in fusion.fuse(readings, "first", ["t"]).collect()}
    assert len(found) == 24 and set(found.values()) == {1.0}


@pytest.mark.parametrize("bits", [16, 18, 64])
def test_hamming_pairs_meet_in_all_bands_that_must_agree(spark, bits):
    r = np.random.default_rng(bits)
    base = [int(x) for x in r.integers(0, 2**63, 12)]
    codes = [(b ^ (1 << int(i)) ^ (1 << int(j))) & ((1 << bits) - 1) for b in base for i, j in r.integers(0, bits, (9, 2))]
    signed = [(n, c - (1 << 64) if c >> 63 else c) for n, c in enumerate(codes)]
    found = similar.hamming_pairs(spark.createDataFrame(signed, "id long, code long"), bits, 4, 2)
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()
    least = {c: min(n for n, d in signed if d == c) for _, c in signed}
    want = {(least[c], n, 0) for n, c in signed if least[c] != n}
    for a, x in least.items():
        want |= {(x, y, bin((a ^ b) & (2**64 - 1)).count("1")) for b, y in least.items() if x < y and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_long_amounts_are_summed_in_one_pass(spark):
    values = ["1" + "0" * 40 + ".5", "-" + "9" * 41, ".25", "-0.00000000000000000000000000000000001", "1e3", "7"]
    for some in (values, values[:2], values[:4]):
        df = cells.to_cells(spark.createDataFrame(list(enumerate(some)), "id int, v string").selectExpr("id", "'k' as k", "v"), "id", columns=["k", "v"])
        out = recipe.group_summary(recipe.cast(df, "c2", "decimal")[0], ["c1"], ["c2"])
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan
        with localcontext() as ctx:
            ctx.prec = 200
            assert Decimal(out.first().c2_total) == sum(map(Decimal, some))


def test_differences_at_the_edge_of_decimals(spark):
    pairs = [("9" * 30 + ".5", "-" + "9" * 30, "1"), ("9" * 30, "9" * 29 + "8", "1"), ("9" * 31, "9" * 30 + "7", "1"), ("1.0000001", "0", "1"), ("1.00000001", "0", "1"), ("1." + "0" * 20, "0", "1"), ("2", "2.00000001", "0.00000001")]
    df = spark.createDataFrame(pairs, "a string, b string, t string")
    for a, b, t in pairs:
        got = df.filter((F.col("a") == a) & (F.col("b") == b)).select(exact.within(F.col("a"), F.col("b"), t)).first()[0]
        with localcontext() as ctx:
            ctx.prec = 100
            assert got == (abs(Decimal(a) - Decimal(b)) <= Decimal(t)), (a, b, t)


def test_correspondence_shuffles_each_version_once(spark):
    cells = spark.createDataFrame([(t, i, j, f"{(i * j) % 5}") for t in range(3) for i in range(6) for j in range(3)], "t int, row int, col int, text string")
    plan = correspondence.correspond(cells, cells, ["t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Scan parquet" not in plan


def test_votes_are_counted_in_pieces(monkeypatch):
    r = np.random.default_rng(4)
    versions = [[[{"row": i, "col": j, "text": str(r.integers(0, 9))} for i in range(8) for j in range(4) if r.random() < 0.9] for _ in range(40)] for _ in "ab"]
    for a, b in zip(*versions, strict=True):
        # most rows are the other's, so that votes find them
        b[:] = [{**y, "text": x["text"]} if r.random() < 0.8 else y for x, y in zip(a, b, strict=False)]
    kind = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("text", pa.string())]))
    a, b = (pa.array(v, kind) for v in versions)
    found = []
    for pairs in (1, 1_000_000):
        monkeypatch.setattr(correspondence, "PAIRS", pairs)
        found.append(correspondence.matched(a, b, np.zeros(40, bool), 1, 20, False).to_pylist())
    assert found[0] == found[1] and {"supported", "anchor"} <= {c["outcome"] for t in found[0] for c in t}


def test_cells_out_of_lists_are_not_broadcast(spark):
    cells = spark.range(20).select("id", F.explode(F.array(F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit("a").alias("text"), F.lit(False).alias("is_header")))).alias("c")).select("id", "c.*")
    patches = grids.variants(cells, cells, ["id"])
    for df in (matching.match_cells(cells, cells, ["id"]), matching.reliability(cells, cells, ["id"]), patches, grids.judged(cells, patches, ["id"]), grids.apply(cells, patches, ["id"])):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_grids_meet_in_one_shuffle_a_side(spark):
    cells = spark.createDataFrame([(t, i, 0, 1, 1, str(i), False) for t in range(3) for i in range(4)], "t int, row int, col int, row_span int, col_span int, text string, is_header boolean")
    for df in (grids.variants(cells, cells, ["t"]), grids.insertions(cells, cells, ["t"])):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2


def test_regions_in_pieces_and_cells_that_overlap(monkeypatch):
    cell = lambda row, col, rows=1, cols=1, text="", header=False: {"row": row, "col": col, "row_span": rows, "col_span": cols, "text": text, "is_header": header}
    unit = [cell(i, j, text=f"{i}{j}") for i in range(2) for j in range(2)]
    whole = [cell(0, 0, 2, 2, "all")]
    a = [unit, unit, [*unit, unit[0]], unit, [cell(0, 0, 1, 2), cell(0, 0, 1, 2)], unit]
    b = [whole, [*unit[:3], cell(1, 1, header=True)], whole, [*whole, *whole], [cell(0, 0, 1, 2, header=True)], unit]
    kind = pa.list_(pa.struct([*((c, pa.int32()) for c in grids.CELL[:4]), ("text", pa.string()), ("is_header", pa.bool_())]))
    for slots in (1, 1_000_000):
        monkeypatch.setattr(grids, "SLOTS", slots)
        found = [(int(t[i]), *(int(r[i]) for r in region), len(x[i]), len(y[i])) for t, region, x, y in grids._regions(grids._Grids(pa.array(a, kind), pa.array(b, kind))) for i in range(len(t))]
        assert sorted(found) == [(0, 0, 0, 2, 2, 4, 1), (1, 1, 1, 2, 2, 1, 1)]


def test_upright_boxes_have_the_iou_of_their_sides(spark):
    r = np.random.default_rng(8)
    corners = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    cases = []
    for _ in range(60):
        a, b = ((x, y, x + int(w), y + int(h)) for x, y, w, h in (map(float, r.integers(1, 9, 4)) for _ in "ab"))
        w, h = (max(0.0, min(a[i + 2], b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
        union = sum((v[2] - v[0]) * (v[3] - v[1]) for v in (a, b)) - w * h
        p, q = corners(*a), corners(*b)
        turn = int(r.integers(0, 4))
        cases.append((p[turn:] + p[:turn], q[:: 1 if r.random() < 0.5 else -1], w * h / union))
    point = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([*cases, (corners(0.0, 0.0, 0.0, 5.0), corners(0.0, 0.0, 1.0, 1.0), None)], f"a {point}, b {point}, iou double")
    found = df.select("iou", geometry.polygon_iou(F.col("a"), F.col("b")).alias("got"), geometry._upright(F.col("a")).alias("upright")).collect()
    assert all(x.got == x.iou and x.upright for x in found[:-1]) and not found[-1].upright


def test_large_tables_are_matched_whole(spark):
    """More than 20,000 cells; ids and sums stand once, kinds in a fifth of the rows, and a misread sum crosses most anchors."""
    kinds = ["a", "b", "c", "d", "e"]
    cells = [(1, i, c, t) for i in range(7000) for c, t in enumerate((f"id {i}", kinds[i * i % 5], f"{i}.5"))]
    first = [(t, i, c, "false" if (i, c) == (3, 2) else x) for t, i, c, x in cells]
    second = [(t, i, c, "false" if (i, c) == (6990, 2) else "" if c == 2 and i % 3 == 0 else x) for t, i, c, x in cells]
    schema = "t int, row int, col int, text string"
    found = correspondence.correspond(spark.createDataFrame(first, schema), spark.createDataFrame(second, schema), ["t"], settle=True).collect()
    assert len(found) == 21_000 and all((x.row, x.col) == (x.row_b, x.col_b) for x in found)
    assert {x.outcome for x in found} == {"anchor", "supported", "changed"}


@pytest.mark.parametrize("common", [0, 1, 16])
def test_votes_of_common_texts_are_those_of_brute_force(monkeypatch, common):
    monkeypatch.setattr(correspondence, "COMMON", common)
    r = random.Random(common)
    tables = []
    for t in range(40):
        h, w, u = r.randint(1, 12), r.randint(1, 5), r.choice([2, 3, 30])
        a = {(i, j): r.choice(["", *map(str, range(u))]) if r.random() < 0.8 else f"{i}.{j}" for i in range(h) for j in range(w)}
        gone = r.randrange(h + 1)
        tables.append((a, {(i - (i > gone), w - 1 - j if t % 5 == 0 else j): v if r.random() < 0.9 else "new" for (i, j), v in a.items() if i != gone}))
    kind = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("text", pa.string())]))
    a, b = (pa.array([[{"row": k[0], "col": k[1], "text": v} for k, v in x[i].items()] for x in tables], kind) for i in (0, 1))
    for pairs in (1, 1_000_000):
        monkeypatch.setattr(correspondence, "PAIRS", pairs)
        found = correspondence.matched(a, b, np.zeros(40, bool), 1, None, False).to_pylist()
        for x, (left, right) in zip(found, tables, strict=True):
            assert {(c["row"], c["col"]): (c["row_b"], c["col_b"], c["outcome"]) for c in x} == plain_correspondence(left, right)


def test_tables_of_a_page_meet_without_shuffles(spark, sf):
    """Cells and regions are dealt out once each; before, the pairs were dealt out again for each step and written."""
    plan = registry.queries()["j27_table_identity"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "SortMergeJoin" not in plan and "table-pairs" not in plan


@pytest.mark.parametrize("by", [["page"], []])
def test_identity_with_and_without_regions(spark, by):
    """Boxes, turned boxes and tables without a region or without cells, against the rules by pairs of pairs."""
    r = random.Random(5)
    box = lambda x, y: [(x, y), (x + 10.0, y), (x + 10.0, y + 10.0), (x, y + 10.0)]
    diamond = lambda x, y: [(x + 5.0, y), (x + 10.0, y + 5.0), (x + 5.0, y + 10.0), (x, y + 5.0)]
    sides = []
    for _ in "ab":
        tables, texts = [], []
        for page in range(6 if by else 1):
            for n in range(8):
                shape = r.choice([box, box, diamond, None])
                tables.append((page, page * 8 + n, shape and shape(n * 4.0 + r.choice([0.0, 1.0]), 0.0)))
                texts += [(page, page * 8 + n, r.choice(["", f"{n}", f"{n}x", f"{n}y", "z", f"{n // 2}w"])) for _ in range(r.choice([0, 4, 6]))]
        sides.append((tables, texts))
    region, cell = "page int, id int, region array<struct<x:double,y:double>>", "page int, id int, text string"
    (a, a_cells), (b, b_cells) = ((spark.createDataFrame(t, region), spark.createDataFrame(c, cell)) for t, c in sides)
    ious = a.crossJoin(b.select(*(F.col(c).alias(f"{c}_b") for c in b.columns))).select("id", "id_b", geometry.polygon_iou(F.col("region"), F.col("region_b")).alias("iou"))
    iou = {(x.id, x.id_b): x.iou or 0.0 for x in ious.collect()}
    (tables, texts), (others, other_texts) = sides
    count = lambda texts, id_: {t: sum(x[1:] == (id_, t) for x in texts) for t in {x[2] for x in texts if x[1] == id_} - {""}}
    kept = []
    for page, i, p in tables:
        for page_b, j, q in others:
            if page == page_b:
                m, n = count(texts, i), count(other_texts, j)
                anchors = sum(m[t] == 1 == n.get(t) for t in m)
                if (iou[i, j] >= 0.6 or anchors >= 2) and not (p and q and iou[i, j] < 0.15):
                    kept.append((i, j, 2 * iou[i, j] + anchors / max(min(sum(m.values()), sum(n.values())), 1), anchors))
    best = []
    for i in {k[0] for k in kept}:
        first, *rest = sorted((k for k in kept if k[0] == i), key=lambda k: (-k[2], k[1]))
        if not rest or first[2] - rest[0][2] >= 0.2:
            best.append(first)
    want = sorted((i, j, round(s, 9), n) for i, j, s, n in best if sum(k[1] == j for k in best) == 1)
    got = [(x.id, x.candidate, round(x.score, 9), x.anchors) for x in geometry.identify(a, b, a_cells, b_cells, by, 7.0).collect()]
    assert sorted(got) == want and want


def test_casts_before_a_comparison_are_computed_once(spark, sf):
    """Before, the filter went below both casts and named each of them again wherever it named its value."""
    plan = registry.queries()["c11_long_compare"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.split("\n") if x.lstrip(" :+-").startswith("Filter")]
    assert filters and not any("RLIKE" in x for x in filters) and len(plan) < 60_000


def test_keys_and_plain_literals_without_patterns(spark):
    texts = ["0", "-0", "-0.0", "007", "+5", "5.", ".5", "-.50", "1.2300", "-12", " 3 ", "10", "-10.01", "٣", "1e2", "", "a", "1..2", "--1", "9" * 40, "1" + "0" * 40 + ".10", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", recipe.plain_decimal(F.col("t")).alias("p")).select("t", "p", exact.order_key(F.col("p")).alias("k"))
    found = {x.t: (x.p, x.k) for x in df.collect()}
    assert [found[x][0] for x in texts[:13]] == ["0", "-0", "-0.0", "7", "5", "5", "0.5", "-0.50", "1.2300", "-12", "3", "10", "-10.01"]
    numbers = [x for x in texts if found[x][0] is not None and found[x][0].isascii()]
    assert all(found[x][1] == exact.order_key_of(found[x][0]) for x in numbers) and len(numbers) == 16
    assert all(found[x] == (None, None) for x in ("", "a", "1..2", "--1", None))
