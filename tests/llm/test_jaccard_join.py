import random
import re
from collections import Counter, defaultdict

import numpy as np

from tallyspark.llm import jaccard_join as J
from tallyspark.llm import words as W

SCHEMA = "doc_id long, text string, component_id string, n string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {}
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    seen = defaultdict(list)
    for i, (_, text) in enumerate(rows):
        sets[i] = shingles(text)
        n = Counter(j for s in sets[i] for j in seen[s])
        for j, k in n.items():
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                parent[find(i)] = find(j)
        for s in sets[i]:
            seen[s].append(i)
    by_doc = {}
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    for i, (d, _) in enumerate(rows):
        by_doc[i] = (d, len(sets[i]), least.get(find(i)) if sets[i] else d)
    return sorted(by_doc.values(), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(df).collect()), key=str)


def vary(words, rng, rate, vocab):
    return [rng.choice(vocab) if rng.random() < rate else w for w in words]


def test_matches_brute_force_with_groups_edges_and_odd_rows(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "  \t\n"), (3, "one"), (4, "ONE"), (5, "a b c d"), (6, "a b c d e"), (7, "A b c d e"), (8, "ΑΒΓ " * 30)]
    base = [[rng.choice(vocab) for _ in range(n)] for n in (6, 8, 20, 60, 150, 400, 900)]
    line = " ".join(rng.choice(vocab) for _ in range(14))
    for b in base:
        for rate in (0.0, 0.002, 0.01, 0.02, 0.03, 0.05, 0.1):
            for _ in range(4):
                rows.append((len(rows) + 2, " ".join(vary(b, rng, rate, vocab))))
        for cut in (0.74, 0.76, 0.8, 0.9):
            rows.append((len(rows) + 2, " ".join(b[: int(len(b) * cut)])))
    rows += [(len(rows) + 2 + i, line + " " + " ".join(rng.choice(vocab) for _ in range(rng.choice((3, 6, 10, 30))))) for i in range(120)]
    rows += [rows[20], (None, rows[30][1])]
    assert run(spark, rows) == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(300)]
    b = [rng.choice(vocab) for _ in range(120)]
    rows = [(i, " ".join(vary(b, rng, rng.choice((0.005, 0.02, 0.03)), vocab))) for i in range(250)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_deduplicate_keeps_columns_and_one_of_each_group(spark):
    df = spark.createDataFrame([(3, "a b c d e f", "z"), (1, "A b c d e f", "y"), (2, "other words", None)], "doc_id long, text string, component_id string")
    assert sorted(tuple(r) for r in J.deduplicate(df).collect()) == [(1, "A b c d e f", "y"), (2, "other words", None)]


def test_allotted_thresholds_cover_the_largest_difference():
    rng = np.random.default_rng(1)
    size = np.array([1, 2, 3, 7, 8, 40, 255, 300, 700])
    first = np.concatenate([[0], np.cumsum(size)])
    h = rng.integers(0, 2**63, first[-1]).astype(np.uint64)
    table = J.bands(int(size.max()))
    doc, sig, flag = J.entries(h, first, table, np.zeros(0, np.uint64))
    own = np.searchsorted(table[:, 0], size, "right") - 1
    for i, n in enumerate(size):
        mine = (doc == i) & (flag & J.FOREIGN == 0) & (flag & J.D == 0)
        got = ((flag[mine] >> 1) & 3).sum()
        assert got >= (n + table[own[i], 1]) // 7 + 1 or n <= J.SMALL


def test_words_hash_is_by_content():
    import pyarrow as pa

    sets = [set(h[f[i] : f[i + 1]].tolist()) for a, b, h, f in W.shingle_sets(pa.array(["x A b c d e", "y a B c D e f", None, "é"])) for i in range(b - a)]
    assert len(sets[0] & sets[1]) == 1 and len(sets[2]) == 0 and len(sets[3]) == 1


def test_bitmaps_differ_at_most_as_the_sets_and_fold():
    rng = np.random.default_rng(2)
    size = np.array([1, 5, 40, 45, 255, 300, 700, 900])
    base = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [np.concatenate([base[: n - n // 10], rng.integers(0, 2**63, n // 10).astype(np.uint64)]) for n in size]
    words, start, length = J.as_words(J.bitmaps(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])))
    i, j = np.triu_indices(len(size), 1)
    differ = np.array([len(set(sets[a].tolist()) ^ set(sets[b].tolist())) for a, b in zip(i, j, strict=True)])
    got = J.apart(words, start, length, i, j, differ)
    assert ((got >= 0) & (got <= differ)).all()
    assert (J.apart(words, start, length, i, j, got - 1) == -1).all()


def test_spanning_forest_is_minimal():
    rng = np.random.default_rng(4)
    a, b, cost = rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(0, 9, 300)
    parent, total, edges = list(range(40)), 0, 0

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for c, x, y in sorted(zip(cost.tolist(), a.tolist(), b.tolist(), strict=True)):
        if find(x) != find(y):
            parent[find(x)], total, edges = find(y), total + c, edges + 1
    got = J.spanning(a, b, cost)
    assert (len(got), cost[got].sum()) == (edges, total)
    assert len(J.spanning(a[:0], b[:0], cost[:0])) == 0
