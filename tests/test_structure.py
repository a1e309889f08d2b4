"""Structure of tables: edits and undo, correspondence and polygons against brute force, alignment, resumable state."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import alignment, correspondence, fusion, geometry, grids, lineage, ordinals
from tallyspark.operators.recipe import Step, StepError
from tallyspark.plans import structure
from tallyspark.session import written
from tallyspark.streaming import events as streams

CELLS = "t int, row int, col int, row_span int, col_span int, text string, is_header boolean"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def random_grid(r, t, height, width):
    """Unit cells, some of them merged into rectangles."""
    taken, out = set(), []
    for y in range(height):
        for x in range(width):
            if (y, x) in taken:
                continue
            h, w = (r.randint(1, 2), r.randint(1, 2)) if r.random() < 0.4 else (1, 1)
            area = {(a, b) for a in range(y, min(y + h, height)) for b in range(x, min(x + w, width))}
            if area & taken:
                area = {(y, x)}
            taken |= area
            out.append((t, y, x, max(a for a, _ in area) - y + 1, max(b for _, b in area) - x + 1, " ".join(f"{a}.{b}" for a, b in sorted(area)), y == 0))
    return out


def test_patches_apply_and_are_undone(spark):
    r = random.Random(7)
    now, then = [], []
    for t in range(30):
        h, w = r.randint(2, 4), r.randint(2, 4)
        now += random_grid(r, t, h, w)
        then += random_grid(r, t, h, w)
    a, b = spark.createDataFrame(now, CELLS), spark.createDataFrame(then, CELLS)
    patches = written(grids.variants(a, b, ["t"]), "p")
    judged = {(p.t, p.r0, p.c0, p.r1, p.c1): p for p in grids.judged(a, patches, ["t"]).collect()}
    assert {p.outcome for p in judged.values()} == {"applied", "not_conserved"}
    twice = grids.judged(a, patches.unionByName(patches.withColumn("r1", F.col("r1") + 1)), ["t"])
    assert {p.outcome for p in twice.collect()} == {"overlapping", "not_conserved"}
    # brute force: the rectangles of any cell that whole cells tile on both sides in unlike ways
    expected = set()
    for t in range(30):
        mine, other = [c for c in now if c[0] == t], [c for c in then if c[0] == t]
        for _, y, x, h, w, _, _ in mine + other:
            slots = {(i, j) for i in range(y, y + h) for j in range(x, x + w)}
            inside = lambda g: [c for c in g if {(i, j) for i in range(c[1], c[1] + c[3]) for j in range(c[2], c[2] + c[4])} <= slots]  # noqa: E731, B023
            p, q = inside(mine), inside(other)
            whole = lambda g: sum(c[3] * c[4] for c in g) == len(slots)  # noqa: E731, B023
            if whole(p) and whole(q) and {c[1:5] + c[6:] for c in p} != {c[1:5] + c[6:] for c in q}:
                expected.add((t, y, x, y + h, x + w))
    assert set(judged) == expected
    after = written(grids.apply(a, patches, ["t"]), "after")
    assert rows(after) != rows(a)
    texts = lambda df: Counter("".join(x.text.split()) for x in df.select("text").collect())
    assert "".join(sorted("".join(texts(after).elements()))) == "".join(sorted("".join(texts(a).elements())))
    applied = spark.createDataFrame([p for p in judged.values() if p.outcome == "applied"], grids.judged(a, patches, ["t"]).schema).drop("outcome")
    back = grids.apply(after, grids.undo(applied), ["t"])
    assert rows(back) == rows(grids.plain(a, ["t"]))
    # the same patches a second time don't find what they were made for
    assert {p.outcome for p in grids.judged(after, applied, ["t"]).collect()} == {"stale"}


@pytest.mark.parametrize("axis", ["row", "col"])
def test_inserted_lines(spark, axis):
    def grid(t, lines, width=2):
        cells = [(t, i, j, 1, 1, f"{line}{j}" if line else "", False) for i, line in enumerate(lines) for j in range(width)]
        return cells if axis == "row" else [(t, c, r, w, h, x, y) for t, r, c, h, w, x, y in cells]

    old = grid(1, "abc") + grid(2, "abc") + grid(3, "aba") + grid(4, "abc") + grid(5, "abc")
    new = grid(1, ["a", "", "", "b", "c"]) + grid(2, ["a", "", "b", "", "c"]) + grid(3, ["a", "b", "", "a"]) + grid(4, ["b", "a", "c", "x"]) + grid(5, ["a", "b", "c", "x"])
    a, b = spark.createDataFrame(old, CELLS), spark.createDataFrame(new, CELLS)
    patches = written(grids.insertions(a, b, ["t"], axis), "p")
    found = {p.t: (p.kind, *((p.r0, p.r1) if axis == "row" else (p.c0, p.c1)), p.conserved) for p in patches.collect()}
    # 2: two places; 3: equal lines can't be told apart; 4: the order changed; 5: the new line has values
    assert found == {1: (f"insert_{axis}s", 1, 3, True), 5: (f"insert_{axis}s", 3, 4, False)}
    after = written(grids.apply(a, patches, ["t"]), "after")
    assert rows(after.filter("t = 1")) == rows(grids.plain(b, ["t"]).filter("t = 1"))
    assert rows(after.filter("t = 5")) == rows(grids.plain(a, ["t"]).filter("t = 5"))
    one = grids.undo(patches.filter("t = 1"))
    assert rows(grids.apply(after, one, ["t"]).filter("t = 1")) == rows(grids.plain(a, ["t"]).filter("t = 1"))


def plain_correspondence(left, right, support=1):
    """The rules of correspond() by pairs of pairs, for one table: {(row, col): (row_b, col_b, outcome)}."""
    text = dict(left)
    n, m = Counter(left.values()), Counter(right.values())
    place = {v: k for k, v in right.items()}
    anchors = [(k, place[v]) for k, v in left.items() if v and n[v] == m[v] == 1]
    sign = lambda x: (x > 0) - (x < 0)
    bad = {a for a, p in anchors for b, q in anchors if any(sign(a[i] - b[i]) != sign(p[i] - q[i]) for i in (0, 1))}
    good = [(a, p) for a, p in anchors if a not in bad]
    maps = [{a[i]: p[i] for a, p in good} for i in (0, 1)]

    def added(i):
        o, votes = 1 - i, Counter()
        for k, v in left.items():
            for q, w in right.items():
                if v and v == w and k[i] not in maps[i] and q[i] not in maps[i].values() and maps[o].get(k[o]) == q[o]:
                    low = max([b for a, b in maps[i].items() if a < k[i]], default=-1)
                    high = min([b for a, b in maps[i].items() if a > k[i]], default=1 << 30)
                    if low < q[i] < high:
                        votes[k[i], q[i]] += 1
        best = []
        for (a, b), x in votes.items():
            rivals = [y for (c, e), y in votes.items() if (c == a) != (e == b)]
            if x >= support and all(x > y for y in rivals):
                best.append((a, b))
        return [(a, b) for a, b in best if all(sign(a - c) == sign(b - e) for c, e in best)]

    while True:
        size = len(maps[0]) + len(maps[1])
        maps[0].update(added(0))
        maps[1].update(added(1))
        if len(maps[0]) + len(maps[1]) == size:
            break
    out = {}
    for k, v in text.items():
        q = (maps[0].get(k[0]), maps[1].get(k[1]))
        if k in bad:
            out[k] = (None, None, "conflict")
        elif None in q:
            out[k] = (None, None, "ambiguous" if v and v in right.values() else "unmatched")
        else:
            what = "removed" if q not in right else "changed" if right[q] != v else "anchor" if (k, q) in good else "supported"
            out[k] = (*q, what)
    return out


def test_correspondence_is_that_of_brute_force(spark):
    r = random.Random(3)
    left, right, expected, kinds = [], [], {}, Counter()
    for t in range(60):
        h, w = r.randint(1, 6), r.randint(1, 4)
        a = {(i, j): r.choice(["", *map(str, range(r.choice([4, 30])))]) for i in range(h) for j in range(w)}
        gone, turned = r.randrange(h + 1), r.random() < 0.1
        b = {(i - (i > gone), w - 1 - j if turned else j): v if r.random() < 0.9 else "new" for (i, j), v in a.items() if i != gone}
        left += [(t, *k, v) for k, v in a.items()]
        right += [(t, *k, v) for k, v in b.items()]
        for k, v in plain_correspondence(a, b).items():
            expected[t, *k] = v
            kinds[v[2]] += 1
    schema = "t int, row int, col int, text string"
    found = correspondence.correspond(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["t"]).collect()
    assert {(x.t, x.row, x.col): (x.row_b, x.col_b, x.outcome) for x in found} == expected
    assert set(kinds) == {"anchor", "supported", "changed", "removed", "conflict", "ambiguous", "unmatched"} - ({"removed"} if "removed" not in kinds else set())


def test_correspondence_over_a_whole_table(spark, sf):
    left, right = (df.toPandas() for df in structure.versions(spark, sf))
    found = structure.j26_correspondence(spark, sf).toPandas()
    table = lambda df: {k: {(x.row, x.col): x.text for x in g.itertuples()} for k, g in df.groupby("l_orderkey")}
    a, b = table(left), table(right)
    expected = {(k, *c): v for k in a for c, v in plain_correspondence(a[k], b.get(k, {})).items()}
    none = lambda v: None if v != v else int(v)
    assert {(x.l_orderkey, x.row, x.col): (none(x.row_b), none(x.col_b), x.outcome) for x in found.itertuples()} == expected


def test_large_tables_are_reported(spark, monkeypatch):
    monkeypatch.setattr(correspondence, "MAX_CELLS", 2)
    df = spark.createDataFrame([(1, 0, i, str(i)) for i in range(3)] + [(2, 0, 0, "x")], "t int, row int, col int, text string")
    found = correspondence.correspond(df, df, ["t"]).collect()
    assert sorted((x.t, x.outcome) for x in found) == [(1, "too_large")] * 3 + [(2, "anchor")]


def exact_iou(a, b):
    """Convex polygons in rationals: the hull of the corners of each inside the other and of all crossings of edges."""
    side = lambda p, q, x: (q[0] - p[0]) * (x[1] - p[1]) - (q[1] - p[1]) * (x[0] - p[0])
    area = lambda p: sum(u[0] * v[1] - v[0] * u[1] for u, v in zip(p, p[1:] + p[:1], strict=True)) / 2
    a, b = ([tuple(map(Fraction, p)) for p in x] for x in (a, b))
    a, b = (x if area(x) > 0 else x[::-1] for x in (a, b))
    edges = lambda p: list(zip(p, p[1:] + p[:1], strict=True))
    inside = lambda p, x: all(side(u, v, x) >= 0 for u, v in edges(p))
    points = {p for p in a if inside(b, p)} | {p for p in b if inside(a, p)}
    for p, q in edges(a):
        for u, v in edges(b):
            d = (q[0] - p[0]) * (v[1] - u[1]) - (q[1] - p[1]) * (v[0] - u[0])
            if d:
                s = ((u[0] - p[0]) * (v[1] - u[1]) - (u[1] - p[1]) * (v[0] - u[0])) / d
                x = (p[0] + s * (q[0] - p[0]), p[1] + s * (q[1] - p[1]))
                if 0 <= s <= 1 and inside(a, x) and inside(b, x):
                    points.add(x)
    hull = []
    for part in (sorted(points), sorted(points, reverse=True)):
        chain = []
        for x in part:
            while len(chain) > 1 and side(chain[-2], chain[-1], x) <= 0:
                chain.pop()
            chain.append(x)
        hull += chain[:-1]
    shared = area(hull) if len(hull) > 2 else Fraction(0)
    return shared / (area(a) + area(b) - shared)


def test_polygon_iou_is_the_rational_one(spark):
    r = random.Random(5)

    def convex():
        from math import cos, pi, sin

        n, turn, cx, cy = r.randint(3, 7), r.random(), r.randint(0, 8), r.randint(0, 8)
        pts = [(round(cx + 8 * cos(2 * pi * (k / n + turn)), 3), round(cy + 5 * sin(2 * pi * (k / n + turn)), 3)) for k in range(n)]
        return pts if r.random() < 0.5 else pts[::-1]

    pairs = [(i, convex(), convex()) for i in range(200)]
    pairs += [(900, [(0, 0), (4, 0), (4, 4), (0, 4)], [(4, 0), (8, 0), (8, 4), (4, 4)]), (901, [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)])]
    kind = geometry.POLYGON
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in a], [(float(x), float(y)) for x, y in b]) for i, a, b in pairs], f"i int, a {kind}, b {kind}")
    found = {x.i: x.iou for x in df.select("i", geometry.polygon_iou(F.col("a"), F.col("b")).alias("iou")).collect()}
    for i, a, b in pairs:
        assert found[i] == pytest.approx(float(exact_iou([(str(x), str(y)) for x, y in a], [(str(x), str(y)) for x, y in b])), abs=1e-9), i


def test_what_is_convex(spark):
    from math import cos, pi, sin

    star = [(cos(4 * pi * k / 5), sin(4 * pi * k / 5)) for k in range(5)]
    cases = {"box": [(0, 0), (2, 0), (2, 1), (0, 1)], "turned": [(0, 1), (2, 1), (2, 0), (0, 0)], "bow tie": [(0, 0), (2, 2), (2, 0), (0, 2)], "dart": [(0, 0), (4, 0), (1, 1), (0, 4)], "star": star, "line": [(0, 0), (1, 1), (2, 2)], "none": [], "flat corner": [(0, 0), (1, 0), (2, 0), (2, 2)]}
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in v]) for k, v in cases.items()], f"k string, p {geometry.POLYGON}")
    assert {x.k for x in df.filter(geometry.is_convex(F.col("p"))).collect()} == {"box", "turned", "flat corner"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


@pytest.mark.parametrize("limit", [alignment.LIMIT, 2])
def test_edit_paths(limit, monkeypatch):
    monkeypatch.setattr(alignment, "LIMIT", limit)
    r = random.Random(limit)
    for _ in range(1500):
        a, b = ("".join(r.choice("abé\U0001f600") for _ in range(r.randint(0, 14))) for _ in range(2))
        steps = alignment.steps(a, b)
        assert "".join(a[s["a"] : s["a"] + s["n"]] if s["op"] == "equal" else s["text"] or "" for s in steps) == b
        assert sum(s["n"] for s in steps if s["op"] != "equal") == distance(a, b)


def test_cost_is_levenshtein_of_whole_texts(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    pairs = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other")), ["conv_id", "turn"])
    found = alignment.aligned(pairs, ["conv_id", "turn"], "text", "other").withColumn("cost", alignment.cost(F.col("steps"))).join(pairs, ["conv_id", "turn"])
    assert found.filter(F.col("cost") != F.levenshtein(F.coalesce("text", F.lit("")), F.coalesce("other", F.lit("")))).count() == 0
    assert found.count() == pairs.count() > 0


def test_gains_of_a_second_reading(spark):
    cases = [("same", "same", "same", 0, 0), ("cat", "cot", "cat", 1, 0), ("cat", "cat", "cot", 0, 1), ("cat", "cut", "cot", 0, 0), ("cat", "caxt", "cat", 1, 0), ("cat", "caxt", "cayyt", 0, 1), ("", "x", None, 1, 0), ("ab", "", "ab", 2, 0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, a string, b string, fixed int, broken int")
    found = {x.i: (x.corrected, x.introduced, x.net) for x in alignment.gains(df, ["i"], "t", "a", "b").collect()}
    assert found == {i: (c[3], c[4], c[3] - c[4]) for i, c in enumerate(cases)}


def test_relocated_spans(spark):
    r = random.Random(9)

    def expected(old, new, a, z, n=3):
        if old == new:
            return a, z
        before, span, behind = old[max(0, a - n) : a], old[a:z], old[z : z + n]
        for pattern, skip in ((before + span + behind, len(before)), (before + span, len(before)), (span + behind, 0), (span, 0)):
            places = [i for i in range(len(new)) if pattern and new.startswith(pattern, i)]
            if places:
                return (places[0] + skip, places[0] + skip + z - a) if len(places) == 1 else None
        return None

    cases = []
    for i in range(300):
        old = "".join(r.choice("abc") for _ in range(r.randint(0, 12)))
        cut = r.randint(0, len(old))
        new = old[:cut] + "".join(r.choice("abcd") for _ in range(r.randint(0, 4))) + old[cut + r.randint(0, 2) :]
        a = r.randint(0, len(old))
        cases.append((i, old, new, a, r.randint(a, len(old))))
    cases.append((300, "abc", "abc", 2, 9))
    df = spark.createDataFrame(cases, "i int, old string, new string, a int, z int")
    found = df.select("i", alignment.relocate(F.col("old"), F.col("new"), F.col("a"), F.col("z"), 3).alias("at")).collect()
    assert {x.i: tuple(x["at"]) if x["at"] else None for x in found} == {c[0]: expected(*c[1:]) if c[4] <= len(c[1]) else None for c in cases}


def test_outcomes_of_fusion(spark):
    def votes(unit, *values, base=None, reliable=True):
        return [(unit, f"s{i}", v, base if base is not None else values[0], reliable) for i, v in enumerate(values)]

    given = votes(1, "a", "b", "b") + votes(2, "a", "b") + votes(3, "a") + votes(4, "1.5", "1.6", "1.6") + votes(5, "a", "b", "b", reliable=False) + votes(6, "x", "x", "x") + votes(7, "a", "b", "b", "c", "d")
    df = spark.createDataFrame(given, "u int, source string, value string, base string, reliable boolean")
    found = {x.u: (x.selected, x.reason, x.needs_review) for x in fusion.decided(df, ["u"], 3, fusion.Policy()).collect()}
    assert found == {1: ("b", "evidence_rule_passed", True), 2: ("a", "tie", True), 3: ("a", "insufficient_evidence", True), 4: ("1.5", "numeric_protection", True), 5: ("a", "alignment_unreliable", True), 6: ("x", "evidence_rule_passed", False), 7: ("a", "insufficient_evidence", True)}
    free = fusion.Policy(weights={"s0": 5}, replace_numbers=True, least_support=0.3)
    assert {x.u: x.selected for x in fusion.decided(df, ["u"], 3, free).filter("u in (1, 4)").collect()} == {1: "a", 4: "1.5"}
    assert {x.reason for x in fusion.decided(df, ["u"], 3, fusion.Policy(replace=False)).filter("u = 6").collect()} == {"suggestions_only"}


def test_a_source_that_lost_a_row_still_votes(spark):
    grid = lambda lines: spark.createDataFrame([(1, i, j, v) for i, line in enumerate(lines) for j, v in enumerate(line)], "t int, row int, col int, text string")
    a = grid([["red", "one"], ["green", "tvvo"], ["blue", "three"], ["grey", "four"]])
    b = grid([["green", "two"], ["blue", "three"], ["grey", "four"]])
    c = grid([["red", "one"], ["green", "two"], ["blue", "three"], ["grey", "four"]])
    strange = grid([["p", "q"], ["r", "s"], ["t", "u"], ["v", "w"]])
    found = {(x.row, x.col): (x.selected, x.reason) for x in fusion.fuse({"a": a, "b": b, "c": c}, "a", ["t"]).collect()}
    assert found[1, 1] == ("two", "evidence_rule_passed") and found[0, 1] == ("one", "evidence_rule_passed") and len(found) == 8
    assert {x.reason for x in fusion.fuse({"a": a, "c": c, "z": strange}, "a", ["t"]).collect()} == {"alignment_unreliable"}


def test_ordinals_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("hot"))
    found = ordinals.ordinals(df, [F.desc("hot"), F.col("k")], start=5, ranges=7).toPandas().sort_values("ordinal")
    assert found["ordinal"].tolist() == list(range(5, 1005))
    assert list(zip(-found["hot"], found["k"], strict=True)) == sorted(zip(-found["hot"], found["k"], strict=True))
    sums = ordinals.running(df, [F.col("k")], {"upto": "hot"}, ranges=7).toPandas().sort_values("k")
    assert sums["upto"].tolist() == sums["hot"].cumsum().tolist()
    assert ordinals.ordinals(df.limit(0), [F.col("k")]).count() == 0


@pytest.mark.parametrize("stop", [1, 2, 3])
def test_a_stopped_index_goes_on(spark, tmp_path, stop):
    df = spark.range(500).select((F.col("id") * 37 % 500 + 1000).alias("k"), F.col("id").alias("v"))
    whole = ordinals.PageIndex(spark, f"file://{tmp_path}/whole")
    assert whole.build(df, "k", 4) and whole.next_ordinal() == 500
    parts = ordinals.PageIndex(spark, f"file://{tmp_path}/parts")
    assert not parts.build(df, "k", 4, stop_after=stop) and parts.batches_done() == stop
    # a batch without its note, as a crash leaves it, is written anew
    spark.range(3).write.parquet(f"file://{tmp_path}/parts/batch={stop}")
    with pytest.raises(ValueError):
        parts.build(df.filter("k < 1400"), "k", 4)
    assert ordinals.PageIndex(spark, f"file://{tmp_path}/parts").build(df, "k", 4)
    assert rows(parts.rows()) == rows(whole.rows()) == sorted([(1000 + i, v, i) for v, i in ((v, v * 37 % 500) for v in range(500))], key=str)
    assert [x.ordinal for x in parts.page(498, 10).orderBy("ordinal").collect()] == [498, 499]


def test_lineage(spark, tmp_path):
    from tallyspark.functions import cells

    df = cells.to_cells(spark.createDataFrame([(i, f" n{i} ", str(i % 3)) for i in range(20)], "i int, name string, g string"), "i")
    graph = lineage.Graph(spark, f"file://{tmp_path}/graph")
    assert graph.nodes().count() == 0
    root = graph.root("names", df)
    trim, keep, drop = Step("trim", {"column": "c2"}), Step("filter", {"column": "c3", "condition": "equals", "value": "1"}), Step("filter", {"column": "c3", "condition": "not_equals", "value": "1"})
    a = graph.commit(root, trim, df)
    b = graph.commit(a, keep, df)
    assert graph.commit(a, keep, df) == b and graph.nodes().count() == 3
    c = graph.commit(graph.undo(b), drop, df)
    assert graph.history(b) == [root, a, b] and graph.history(c) == [root, a, c] and graph.nodes().count() == 4
    assert graph.verified(b, df).count() + graph.verified(c, df).count() == 20
    for revision in (root, a, b, c):
        assert lineage.digest(graph.verified(revision, df)) == (graph.get(revision).n_rows, graph.get(revision).digest)
    with pytest.raises(StepError):
        graph.verified(b, df.limit(5))
    with pytest.raises(StepError):
        graph.undo(root)
    with pytest.raises(StepError):
        graph.commit("no such revision", trim, df)
    assert {(x.depth, x.operators) for x in graph.paths().collect()} == {(0, ""), (1, "trim"), (2, "trim>filter")}


REQUESTS = [[(1, "k1", "a"), (2, "k1", "a"), (3, "k2", None)], [(4, "k1", "b"), (5, None, "x")], [(6, "k2", None), (7, "k2", "")], [(8, None, "x"), (9, "k3", "z"), (10, "k1", "a")]]


def test_receipts_after_a_restart(spark, tmp_path):
    def run(folder, *stops):
        for upto in stops:
            for i, part in enumerate(REQUESTS[:upto]):
                if not (tmp_path / folder / f"in{i}").exists():
                    spark.createDataFrame(part, "no long, key string, body string").coalesce(1).write.parquet(f"file://{tmp_path}/{folder}/in{i}")
            source = spark.readStream.schema("no long, key string, body string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/{folder}/in*")
            out = streams.drain(streams.receipts(source, "key", "no", "body"), "r", at=f"file://{tmp_path}/{folder}/out")
        return rows(out)

    expected = [(None, 5, 5, "accepted"), (None, 8, 5, "repeated"), ("k1", 1, 1, "accepted"), ("k1", 10, 1, "repeated"), ("k1", 2, 1, "repeated"), ("k1", 4, 1, "conflict"), ("k2", 3, 3, "accepted"), ("k2", 6, 3, "repeated"), ("k2", 7, 3, "conflict"), ("k3", 9, 9, "accepted")]
    assert run("whole", 4) == run("parts", 1, 3, 4) == sorted(expected, key=str)


def test_backlog_after_a_restart(spark, tmp_path):
    parts = [[("a", "append", 1), ("a", "append", 2), ("b", "append", 3)], [("a", "ack", 1), ("a", "append", 2)], [("b", "ack", 9), ("b", "append", 4), ("b", "append", 10)]]

    def run(folder, *stops):
        for upto in stops:
            for i, part in enumerate(parts[:upto]):
                if not (tmp_path / folder / f"in{i}").exists():
                    spark.createDataFrame(part, "ns string, kind string, generation long").coalesce(1).write.parquet(f"file://{tmp_path}/{folder}/in{i}")
            source = spark.readStream.schema("ns string, kind string, generation long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{folder}/in*")
            out = streams.drain_latest(streams.backlog(source, "ns"), "b", "ns", at=f"file://{tmp_path}/{folder}/out")
        return rows(out)

    assert run("whole", 3) == run("parts", 1, 2, 3) == [("a", 3, 2, 1, 1), ("b", 3, 10, 9, 1)]


def test_tables_with_errors():
    from tallyspark.operators.tables import html_cells, html_tables

    wide = "<table>\n<tr><td>é</td></tr>\n<tr><td rowspan='x'>b</td></tr></table>"
    assert html_tables(wide) == [(0, None, 0, len(wide) - 8, 2, 1, 2, "span", wide.index("<td rowspan"))]
    assert [t[7] for t in html_tables("<table><td>a<table><tr><td colspan=1001>b</table></td></table>")] == ["cell_outside_row", "span"]
    assert [t[7] for t in html_tables("<table><tr>" + "<td rowspan=1000 colspan=1000>x" * 2 + "</table>")] == ["too_large"]
    assert html_tables("") == html_tables(None) == html_tables("</table><td>x") == []
    assert html_tables("<table><caption>a<br> b</caption></table>")[0][1] == "a b"
    assert [c[5] for c in html_cells("<table><tr><td>1<tr><td>2")] == ["1", "2"]
    assert max(c[4] for c in html_cells("<table><tr><td colspan=99999999999999999999>a</table>")) == 1


def test_cursors_are_bound_to_filter_and_table(spark):
    from tallyspark.operators import paging

    data = [(i, i % 4 if i % 5 else None, f"k{i % 2}") for i in range(60)]
    df = spark.createDataFrame(data, "id int, p int, kind string")
    order = [paging.Order("p", descending=True), paging.Order("id")]
    walk = lambda df, filters, size: _walk(paging, df, filters, order, size)
    for filters in ({}, {"kind": "k1"}, {"p": None}, {"p": [1, 2]}):
        keep = [r for r in data if all((r[{"kind": 2, "p": 1}[k]] in v) if isinstance(v, list) else r[{"kind": 2, "p": 1}[k]] == v for k, v in filters.items())]
        expected = [r[0] for r in sorted(keep, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
        assert walk(df, filters, 7) == expected
    first = paging.page(df, {}, order, 5, b"s")
    for change, reason in ((dict(filters={"kind": "k1"}), "other_filter"), (dict(order=order[:1]), "other_filter"), (dict(secret=b"t"), "forged"), (dict(df=df.filter("id <> 59")), "changed"), (dict(cursor=first.cursor[:-1] + "~"), "forged"), (dict(cursor="nothing"), "malformed")):
        with pytest.raises(paging.CursorError) as e:
            paging.page(**({"df": df, "filters": {}, "order": order, "limit": 5, "secret": b"s", "cursor": first.cursor} | change))
        assert e.value.reason == reason
    with pytest.raises(ValueError):
        paging.page(df, {}, order, 0, b"s")
    assert paging.page(df.limit(0), {}, order, 5, b"s") == paging.Page([], None, "0:None")


def _walk(paging, df, filters, order, size):
    out, cursor = [], None
    while True:
        got = paging.page(df, filters, order, size, b"s", cursor)
        out += [r.id for r in got.rows]
        cursor = got.cursor
        if cursor is None:
            return out


def test_totals_of_odd_tables(spark):
    from decimal import Decimal

    from tallyspark.operators import stats

    lines = {1: [("head", None), ("a", "1.10"), ("b", "2.20"), (" Total : ", "3.30"), ("c", "5.00"), ("total", "5.01")], 2: [("total", "1.00")], 3: [("a", "1.00"), ("", None), ("b", "2.00"), ("TOTAL", "2.00")], 4: [("a", "1.00"), (None, "2.00"), ("total", None)], 5: [("a", "1.00")]}
    data = [(t, i, label, Decimal(a) if a else None, 2) for t, rows_ in lines.items() for i, (label, a) in enumerate(rows_)]
    df = spark.createDataFrame(data, "t int, row int, label string, amount decimal(18,2), places int")
    found = {(x.t, x.row): (x["first"], x["last"], x.status) for x in stats.contiguous_totals(df, ["t"], ["Total"]).collect()}
    assert found == {(1, 3): (0, 2, "uncertain"), (1, 5): (4, 4, "rounding_possible"), (2, 0): (None, None, "uncertain"), (3, 3): (2, 2, "equal"), (4, 2): (0, 1, "uncertain")}


def test_changed_lines():
    r = random.Random(12)
    for _ in range(400):
        a, b = ([r.choice(["a", "b", "", "c c"]) for _ in range(r.randint(1, 9))] for _ in range(2))
        found = alignment.changes("\n".join(a), "\n".join(b))
        out, at = [], 0
        for c in found:
            out += a[at : c["a0"]]
            assert len(out) == c["b0"] and (c["a1"] > c["a0"] or c["b1"] > c["b0"])
            assert c["before"] == ("\n".join(a[c["a0"] : c["a1"]]) if c["a1"] > c["a0"] else None)
            out += b[c["b0"] : c["b1"]]
            at = c["a1"]
        assert out + a[at:] == b
        assert sum(max(c["a1"] - c["a0"], c["b1"] - c["b0"]) for c in found) >= distance(a, b)
        assert not found if a == b else found
    assert [(c["op"], c["moved"]) for c in alignment.changes("x\nkeep\nstay", "keep\nstay\nx")] == [("delete", True), ("insert", True)]
    assert [(c["op"], c["moved"]) for c in alignment.changes("", "x")] == [("replace", False)]


def test_units_of_texts_put_each_source_together():
    r = random.Random(14)
    for _ in range(300):
        line = lambda: r.choice(["a", "b", "c", "", "d d"])
        base = [line() for _ in range(r.randint(1, 8))]
        others = {}
        for k in "xyz"[: r.randint(0, 3)]:
            other = [x for x in base if r.random() < 0.8] or [""]
            for _ in range(r.randint(0, 2)):
                other.insert(r.randint(0, len(other)), line())
            others[k] = "\n".join(other)
        units = fusion.text_units("\n".join(base), others, "base")
        for k in ("base", *others):
            # a source is what it has in the units and what is common between them
            out, at = [], 0
            for u in units:
                assert at <= u["a0"] <= u["a1"]
                value = next(v["value"] for v in u["values"] if v["source"] == k)
                out += base[at : u["a0"]] + ([] if value is None else value.split("\n"))
                at = u["a1"]
            assert "\n".join(out + base[at:]) == ("\n".join(base) if k == "base" else others[k])


def test_fused_texts(spark):
    base = "one\ntwo\nthree\nfour"
    cases = {
        1: (base, "one\n2\nthree\nfour", "one\n2\nthree\nfour", base, "numeric_protection"),
        2: (base, "one\nzwei\nthree\nfour", "one\nzwei\nthree\nfour", "one\nzwei\nthree\nfour", "evidence_rule_passed"),
        3: (base, "one\nthree\nfour", "one\nthree\nfour", "one\nthree\nfour", "evidence_rule_passed"),
        4: (base, "one\ntwo\nthree\nfour\nfive", "one\ntwo\nthree\nfour\nfive", "one\ntwo\nthree\nfour\nfive", "evidence_rule_passed"),
        5: (base, "one\nzwei\nthree\nfour", "one\ndeux\nthree\nfour", base, "tie"),
        6: (base, base, None, base, None),
        7: (base, "two\nthree\nfour\none", "two\nthree\nfour\none", base, "alignment_unreliable"),
        8: (None, "x", "x", "x", "evidence_rule_passed"),
    }
    source = lambda i: spark.createDataFrame([(k, v[i]) for k, v in cases.items()], "k int, text string")
    texts, units = fusion.fuse_texts({"a": source(0), "b": source(1), "c": source(2)}, "a", ["k"])
    assert {x.k: x.text for x in texts.collect()} == {k: v[3] for k, v in cases.items()}
    found = {}
    for u in units.collect():
        found.setdefault(u.k, set()).add(u.reason)
    assert found == {k: {v[4]} for k, v in cases.items() if v[4]}
