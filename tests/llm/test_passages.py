import random

import numpy as np
import pyarrow as pa

from tallyspark.llm import passages as P


def brute_windows(h, least):
    out = []

    def node(a, b):
        if b - a < least:
            return
        c = a + int(np.argmin(h[a:b]))
        out.append((int(h[c]), c, a, b - 1))
        node(a, c)
        node(c + 1, b)

    node(0, len(h))
    return sorted(out)


def test_compact_windows_are_the_wide_nodes_of_the_tree():
    rng = np.random.default_rng(2)
    sizes = [0, 3, 46, 47, 200, 1, 333]
    first = np.concatenate([[0], np.cumsum(sizes)])
    h = rng.integers(0, 2**63, first[-1]).astype(np.uint64)
    d, v, c, left, right = P.compact_windows(h, first)
    for i in range(len(sizes)):
        got = sorted((int(v[k]), int(c[k]), int(left[k]), int(right[k])) for k in np.flatnonzero(d == i))
        assert got == brute_windows(h[first[i] : first[i + 1]], P.LEAST)


def text(rng, n):
    return [f"t{rng.randrange(5000)}" for _ in range(n)]


def test_finds_repeated_passages_and_leaves_others_alone(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(text(rng, 200))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "short text"), (None, "null id " * 60)]
    shared = [text(rng, n) for n in (51, 55, 80, 120)]
    truth = set()
    for k, p in enumerate(shared):
        for i in range(3 + 10 * (k == 1)):
            rows.append((100 + 20 * k + i, " ".join(text(rng, 40) + p + text(rng, 30))))
            truth.add(100 + 20 * k + i)
    near = text(rng, 150)
    rows.append((300, " ".join(text(rng, 20) + near)))
    other = list(near)
    other[40] = other[100] = "changed"
    rows.append((301, " ".join(other + text(rng, 20))))
    below = text(rng, 44)
    rows += [(400, " ".join(text(rng, 60) + below + text(rng, 60))), (401, " ".join(below + text(rng, 90)))]
    looped = "\n".join(["the same line again and again with words"] * 20)
    rows += [(500, looped), (501, looped)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, start string")
    got = P.repeated_passages(df).collect()
    assert {r.doc_id for r in got} == truth | {300, 301, 500, 501}
    by_id = dict(r for r in rows if r[0] is not None)
    for r in got:
        if r.similarity == 1.0 and r.doc_id < 200:
            a, b = by_id[r.doc_id].split()[r.start : r.end], by_id[r.other_id].split()[r.other_start : r.other_end]
            assert a == b and len(a) >= 50


def test_empty_table(spark):
    assert P.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_common_passages_of_texts_that_repeat_themselves():
    line = "a b c d e f g h " * 20
    x = P.sequence(pa.array(["start " + line]))
    y = P.sequence(pa.array([line + "end"]))
    assert P.common_passages(x, y)


def scattered(rng, p):
    """All shingles of p, in pieces too short for a passage."""
    return [w for i in range(0, len(p), 12) for w in p[i : i + 16] + text(rng, 25)]


def test_small_groups_beside_a_large_one(spark):
    rng = random.Random(5)
    big = text(rng, 60)
    rows = [(1000 + i, " ".join(text(rng, 20) + big + text(rng, 20))) for i in range(600)]
    truth = set()
    for k in range(6):
        p = text(rng, 52)
        for i in range(8):
            rows += [(k * 10 + i, " ".join(scattered(rng, p))), (9000 + k * 10 + i, " ".join(scattered(rng, p)))]
        for i in range(2):
            rows.append((5000 + 10 * k + i, " ".join(text(rng, 30) + p + text(rng, 30))))
            truth.add(5000 + 10 * k + i)
    got = {r.doc_id for r in P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == truth | set(range(1000, 1600))


def test_near_copies_within_longer_or_repeating_texts():
    rng = random.Random(8)
    copy = text(rng, 90)
    near = list(copy)
    near[45] = "changed"
    loose = text(rng, 200)
    # a shared shingle every dozen words follows
    mine, theirs = list(loose), text(rng, 200)
    for i in range(5, 190, 12):
        theirs[i : i + 6] = mine[i : i + 6]
    x, y = (P.sequence(pa.array([" ".join(t)])) for t in (copy + mine, near + theirs))
    assert any(a <= 10 and b >= 70 and sim >= 0.75 for a, b, _, _, sim in P.common_passages(x, y))
    # lines of the copy stand in another place of q before it
    x, y = (P.sequence(pa.array([" ".join(t)])) for t in (copy, copy[10:22] + text(rng, 100) + copy[60:75] + text(rng, 60) + near))
    assert any(a <= 10 and b >= 70 and sim >= 0.75 for a, b, _, _, sim in P.common_passages(x, y))


def test_near_copies_whose_hubs_hold_only_pieces(spark):
    rng = random.Random(11)
    rows, truth = [], set()
    for k in range(15):
        p = text(rng, 70)
        for i in range(10):
            rows += [(k * 20 + i, " ".join(scattered(rng, p))), (9000 + k * 20 + i, " ".join(scattered(rng, p)))]
        near = list(p)
        near[rng.randrange(20, 50)] = "changed"
        for i, q in enumerate((p, near)):
            rows.append((5000 + 10 * k + i, " ".join(text(rng, 30) + q + text(rng, 30))))
            truth.add(5000 + 10 * k + i)
    got = P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == truth
    assert {(r.doc_id, r.other_id) for r in got} == {(i, i ^ 1) for i in truth}


def test_runs_that_repeat_in_the_second_text():
    x, y = (P.sequence(pa.array([" ".join(["word"] * n)])) for n in (60, 200))
    for p, q in ((x, y), (y, x)):
        got = P.common_passages(p, q)
        assert {i for a, b, *_ in got for i in range(a, b)} == set(range(len(p)))
        assert {i for _, _, c, d, _ in got for i in range(c, d)} == set(range(len(q)))


def test_equal_runs_have_a_seed_in_common():
    rng = random.Random(12)
    for _ in range(50):
        run = text(rng, P.RUN + 4) if rng.random() < 0.7 else ["a", "b", *["c"] * 12, *text(rng, 6)]
        sides = []
        for _ in range(2):
            h = P.sequence(pa.array([" ".join(text(rng, rng.randrange(40, 60)) + run + text(rng, 40))]))
            sides.append(set(P.seeds(h, np.array([0, len(h)]))[2].tolist()))
        assert sides[0] & sides[1]


def test_cells_leave_out_nothing_that_all_pairs_have():
    rng = random.Random(13)
    texts = []
    for _ in range(12):
        base = text(rng, 120)
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = f"new{rng.random()}"
            if rng.random() < 0.3:
                at = rng.randrange(len(t))
                t[at:at] = text(rng, 12)
            texts.append(" ".join(text(rng, rng.randrange(50)) + t))
    seq = [P.sequence(pa.array([t])) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j)]
    want = {x for i, j in pairs if P.common_passages(seq[i], seq[j]) for x in (i, j)}
    docs = pa.table({"id": list(range(len(texts))), "text": texts, "s": pa.array([None] * len(texts), pa.list_(pa.int32())), "e": pa.array([None] * len(texts), pa.list_(pa.int32()))})
    got = P.cell_passages(pa.table({"a": [i for i, _ in pairs], "b": [j for _, j in pairs]}), docs)
    places = {i: set() for i in range(len(texts))}
    for r in got.to_pylist():
        places[r["a"]].update(range(r["a_start"], r["a_end"]))
        places[r["b"]].update(range(r["b_start"], r["b_end"]))
    assert {i for i, x in places.items() if x} == want and want
    for i, j in pairs:
        for a, b, c, d, _ in P.common_passages(seq[i], seq[j]):
            assert set(range(a, b)) <= places[i] and set(range(c, d)) <= places[j]


def test_likely_places_hold_every_part_that_may_be_similar():
    rng = random.Random(14)
    for _ in range(60):
        n = rng.randrange(46, 200)
        bad = sorted(rng.sample(range(n), min(n, rng.choice([0, 3, 9, 15, 30]))))
        inside = np.zeros(n + 1, int)
        inside[bad] = 1
        total = np.concatenate([[0], np.cumsum(inside[:n])])
        c = np.array([x for x in range(n - P.SEED + 1) if not inside[x : x + P.SEED].any()], int)
        want = [any(4 * (total[j] - total[i]) <= j - i for i in range(x + 1) for j in range(max(x + P.SEED, i + P.LEAST), n + 1)) for x in c.tolist()]
        assert P.likely(np.array([*bad, n]), c).tolist() == want


def test_a_common_line_makes_no_pairs(spark):
    rng = random.Random(15)
    line = text(rng, 24)
    rows = [(i, " ".join([f"own{i}_{k}" for k in range(60)] + line + [f"more{i}_{k}" for k in range(60)])) for i in range(200)]
    near = text(rng, 70)
    other = [*near[:35], "changed", *near[36:]]
    rows += [(1000 + i, " ".join(text(rng, 30) + q + line)) for i, q in enumerate((near, other))]
    docs = spark.createDataFrame(rows, "id long, text string")
    _, seeds = P.missing_pairs(docs, spark.createDataFrame([], "id long, spans array<struct<s:int,e:int>>"), 8)
    assert {(r.a, r.b) for r in P.seed_pairs(seeds).collect()} == {(1000, 1001)}


def test_texts_are_hashed_together_and_verbatim_ones_not_aligned(monkeypatch):
    rng = random.Random(6)
    texts = [text(rng, 120), "", "a b", text(rng, 5), text(rng, 60) * 2, None]
    texts = [" ".join(t) if isinstance(t, list) else t for t in texts]
    for got, t in zip(P.sequences(pa.array(texts)), texts, strict=True):
        assert (got == P.sequence(pa.array([t], pa.string()))).all()
    x, y = P.sequences(pa.array([texts[0], texts[0] + " " + texts[4]]))
    monkeypatch.setattr(P, "nearest", None)  # only what isn't verbatim needs places
    assert P.common_passages(x, y) == [(0, len(x), 0, len(x), 1.0)]
    assert P.common_passages(y, x) == [(0, len(x), 0, len(x), 1.0)]


def test_nearest_smaller_values_of_long_runs():
    rng = np.random.default_rng(7)
    for x in (np.arange(500), np.arange(500)[::-1], np.append(np.arange(1, 500), 0), rng.permutation(500), np.zeros(0, np.int64)):
        doc = np.sort(rng.integers(0, 4, len(x)))
        want = [max((j for j in range(i) if doc[j] == doc[i] and x[j] < x[i]), default=-1) for i in range(len(x))]
        assert P.smaller_before(x, doc).tolist() == want
