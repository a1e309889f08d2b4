"""op11, op12 and op13 against brute force: odd rows, clashing columns, empty tables, the queries on whole tables, and SQL."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import filter_audit, license_scan, queries, ranked_search, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain_audit(docs, labels):
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, source in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))

    def fails(d, text):
        text, ws = text or "", WORD.findall(text or "")
        out = {"A"} if len(ws) < 50 else set()
        out |= {"B"} if 100 * len(set(ws)) < 65 * len(ws) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        out |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        return out | ({"E"} if d is not None and d > least[text] else set())

    rows = [(s or "", fails(d, t), d in good, d in toxic) for d, t, s in docs]
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                before = set(order[:s])
                gone = [r for r in mine if f in r[1] and not r[1] & before]
                shapley[part, f] += len(gone)
                out[part, "".join(order), s + 1] = [sum(not r[1] & (before | {f}) for r in mine), len(gone), sum(f in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found_audit(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:10] for r in df.collect()}


def test_audit_of_odd_rows(spark):
    r = random.Random(2)
    long = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \t\n", "X", long, long + " #", long.upper(), "a " * 70, "É" * 60, long + "  z", "w " * 33 + long, "A" * 5 + " b" * 50]
    docs = [(i, r.choice(texts), r.choice([None, "", "s1", "s2", "s1"])) for i in range(80)]
    docs += [(3, docs[3][1], "s1"), (3, docs[3][1], "s2"), (None, long, None), (None, None, "s9"), (None, long, "s1"), (-5, long, "only|part")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(d, t, s, 1, "x", 0) for d, t, s in docs], "doc_id long, text string, source string, quality int, part string, mask int")
    marks = spark.createDataFrame([(*x, "y", "z") for x in labels], "doc_id long, quality int, toxic int, text string, good string")
    found = found_audit(filter_audit.audit(df, marks))
    assert found == plain_audit(docs, labels) and len(found) == 600 * 5
    assert filter_audit.audit(df.limit(0), marks).count() == 0
    assert {x[4:6] for x in found_audit(filter_audit.audit(df, marks.limit(0))).values()} == {(0, 0)}


def test_incidence_matrices():
    m = filter_audit.incidence("ABCDE")
    assert {x.shape for x in m.values()} == {(32, 600)} and all(set(np.unique(x)) == {0, 1} for x in m.values())
    # each document is kept, removed or redundant, or passed on after an earlier filter has removed it
    assert (m["kept"] + m["removed"] + m["redundant"] <= 1).all()
    assert (m["removed"].reshape(32, 120, 5).sum(2) == (np.arange(32) > 0)[:, None]).all()
    assert filter_audit.incidence("AB")["unique"].tolist() == [[0] * 4, [1, 0, 0, 1], [0, 1, 1, 0], [0] * 4]


def plain_rank(docs, items, top=10):
    terms = [(d, Counter(lower(t) for t in TERM.findall(x or ""))) for d, x in docs]
    terms = [(d, c) for d, c in terms if c]
    n, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scored = []
        asked = {lower(t) for t in TERM.findall(text or "")}
        for d, c in terms:
            m = 10 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def ranked(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("first", [1, 3, 250])
def test_search_is_that_of_scoring_everything(spark, monkeypatch, first):
    monkeypatch.setattr(ranked_search, "FIRST", first)
    monkeypatch.setattr(ranked_search, "GROWTH", 4)
    r = random.Random(first)
    vocabulary = [f"t{i}" for i in range(60)] + ["Straße", "日本", "É"]
    text = lambda n: " ".join(r.choice(vocabulary[: r.randint(2, len(vocabulary))]) for _ in range(n))
    docs = [(i, text(r.randint(1, 30))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(60)] + [(700, None), (701, ""), (702, "  .,-!"), (7, docs[7][1]), (None, docs[8][1]), (None, docs[9][1] + " t1"), (800, "t0 " * 5000)]
    items = [(i, text(r.randint(1, 25))) for i in range(25)] + [(100, None), (101, "?!"), (102, "nowhere"), (103, "t0 nowhere T0 t0"), (3, "t5"), (None, "t6 t7"), (104, docs[7][1])]
    df = spark.createDataFrame([(d, x, 1, 2) for d, x in docs], "doc_id long, text string, cls int, term int")
    asked = spark.createDataFrame([(i, x, "q") for i, x in items], "item_id long, text string, q string")
    assert ranked(ranked_search.rank(df, asked)) == plain_rank(docs, items)
    if first == 3:
        index = ranked_search.build(df)  # of all terms
        assert {x.tier for x in index.postings.select("tier").distinct().collect()} >= {0, 1, 2}
        monkeypatch.setattr(ranked_search, "BLOCK", 40)  # items in several blocks
        monkeypatch.setattr(ranked_search, "ASKED", 5)  # more terms than are sent to tasks
        assert ranked(ranked_search.rank(df, asked)) == plain_rank(docs, items)
        assert ranked_search.rank(df.limit(0), asked).count() == ranked_search.rank(df, asked.limit(0)).count() == 0


def test_tiers_prove_some_items_and_pass_on_others(spark, sf, monkeypatch):
    monkeypatch.setattr(ranked_search, "FIRST", 12)
    monkeypatch.setattr(ranked_search, "GROWTH", 4)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    index = ranked_search.build(docs)
    terms = ranked_search.counted(items.select(F.col("item_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("q"), "terms")
    found, proved = ranked_search.search(index, terms)
    assert sum(proved) == items.count() and sum(n > 0 for n in proved) > 1
    plain = plain_rank([(d.doc_id, d.text) for d in docs.collect()], [(i.item_id, i.text) for i in items.collect()])
    assert sorted(map(tuple, found.select("q", "rank", "doc_id", "score").collect()), key=str) == plain


def test_terms_of_long_texts_are_those_of_short_pieces(monkeypatch):
    monkeypatch.setattr(words, "CHUNK", 16)
    texts = ["", "ab cd", "x" * 70 + " y " + "é" * 40, "a-b c_d " * 9, "ABC abc 12" * 5, "." * 50]
    hashes = {}
    for text, found in zip(texts, words.term_hashes([t or "" for t in texts]), strict=True):
        plain = [lower(t) for t in TERM.findall(text or "")]
        assert len(plain) == len(found)
        for t, h in zip(plain, found.tolist(), strict=True):
            assert hashes.setdefault(t, h) == h
    assert len(set(hashes.values())) == len(hashes)


def plain_licenses(text, templates=license_scan.TEMPLATES, least=license_scan.LEAST):
    terms = TERM.findall(lower(text))
    places, base = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(terms)) if terms[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 0.0
    for label, t in templates:
        own = TERM.findall(lower(t))
        step = license_scan.width_of(len(own)) // 2
        for start in range(0, max(len(terms), 1), step):
            share = len(set(own) & set(terms[start : start + 2 * step])) / len(set(own))
            if len(set(own) & set(terms[start : start + 2 * step])) >= license_scan.needed(len(set(own)), least):
                labels.add(label)
                score = max(score, share)
    return len(terms), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_licenses_of_odd_texts(spark):
    r = random.Random(4)
    pool = [w for _, t in license_scan.TEMPLATES for w in license_scan.plain_terms(t)]
    texts = [None, "", "mit license", "MIT\nLicense, mit-license", "mit  x license", "The Apache License and the GNU General Public License; general public license", "license mit license mit license"]
    for _, t in license_scan.TEMPLATES:
        own = t.split()
        texts += [t, "lead " * r.randint(0, 40) + t + " tail" * r.randint(0, 40), " ".join(w for w in own if r.random() < 0.9), " ".join(x for w in own for x in ([w, "filler"] if r.random() < 0.2 else [w]))]
    texts += [" ".join(r.choice(pool) for _ in range(r.randint(1, 300))) for _ in range(120)]
    texts.append("word " * 300_000 + license_scan.TEMPLATES[1][1] + " word" * 1000)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "mit license", "y", 2), (0, "mit license", "z", 3)], "doc_id long, text string, labels string, row int")
    found = license_scan.scan(df).collect()
    expected = Counter((i, *plain_licenses(t)) for i, t in [*enumerate(texts), (None, "mit license"), (0, "mit license")])
    assert Counter(map(tuple, found)) == expected
    assert {x for k in expected for x in k[6].split(",")} >= {label for label, _ in license_scan.TEMPLATES}
    assert license_scan.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_the_set_join_loses_and_invents_nothing(spark, least):
    r = random.Random(int(least * 10))
    size = 40
    sets = [(i, b, 16 << r.randrange(2), sorted(r.sample(range(size), r.randint(1, 12)))) for i in range(150) for b in range(3)]
    templates = [(i, f"l{i}", 16 << r.randrange(2), sorted(r.sample(range(size), r.randint(1, 8)))) for i in range(25)]
    found = license_scan.matches(spark.createDataFrame(sets, "row long, block int, width int, words array<int>"), spark.createDataFrame(templates, "template int, label string, width int, words array<int>"), least, size)
    expected = Counter((i, label, len(set(s) & set(t)) / len(t)) for i, _, w, s in sets for _, label, v, t in templates if w == v and len(set(s) & set(t)) >= license_scan.needed(len(t), least))
    assert Counter((x.row, x.label, x.containment) for x in found.collect()) == expected and expected


def test_queries_on_whole_tables(spark, sf):
    docs = [(d.doc_id, d.text, d.source) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [tuple(x) for x in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    items = [tuple(x) for x in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert found_audit(queries.op11_filter_audit(spark, sf)) == plain_audit(docs, labels)
    assert ranked(queries.op12_tiered_search(spark, sf)) == plain_rank([d[:2] for d in docs], items)
    assert sorted(map(tuple, queries.op13_license_scan(spark, sf).collect())) == sorted((d, *plain_licenses(t)) for d, t, _ in docs)


@pytest.mark.parametrize("name", ["op1_url_filter", "op7_mix_budgets", "op8_warc_revisits", "op11_filter_audit", "op12_tiered_search", "op13_license_scan"])
def test_sql_twins(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    rel = con.sql(queries.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    plain = lambda v: None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    pick = lambda cols, row: tuple(plain(row[cols.index(c)]) for c in names)
    assert Counter(pick(df.columns, tuple(r)) for r in df.collect()) == Counter(pick(rel.columns, r) for r in rel.fetchall())
