import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import langid, mixing


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def survivors(rows):
    """Least doc_id of each component of links, by comparing all that share a shingle."""
    parent = {r.doc_id: r.doc_id for r in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    sets, seen = {}, defaultdict(list)
    for r in rows:
        sets[r.doc_id] = shingles(r.text)
        for o, k in Counter(o for s in sets[r.doc_id] for o in seen[s]).items():
            if 100 * k >= 75 * (len(sets[r.doc_id]) + len(sets[o]) - k):
                a, b = find(r.doc_id), find(o)
                parent[max(a, b)] = min(a, b)
        for s in sets[r.doc_id]:
            seen[s].append(r.doc_id)
    return {d for d in parent if find(d) == d}


def words(text):
    return [w for w in (re.sub(r"^[^\w%]+|[^\w%]+$", "", x) for x in (text or "").lower().split()) if w]


def leaks(rows, bench):
    """Documents that hold half of an item's eight-word windows."""
    items = [{tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))} for w in (words(b.text) for b in bench)]
    out = set()
    for r in rows:
        w = words(r.text)
        own = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        out |= {r.doc_id for x in items if len(x & own) >= 0.6 * len(x)}
    return out


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "dedup", "decontaminate", "mix", "shard"]
    stages = dict(corpus_pipeline.STAGES)
    a = stages["language"](spark, docs, sf)
    assert a.columns == docs.columns
    a = a.cache()
    kept, all_rows = a.collect(), docs.collect()
    assert {r.doc_id for r in kept} >= {r.doc_id for r in all_rows if len(re.findall("[a-zà-ÿ]", (r.text or "").lower())) > 200}
    assert all(re.search(r"\w", r.text or "") for r in kept)
    b = stages["dedup"](spark, a, sf)
    assert b.columns == docs.columns
    rows = b.cache().collect()
    assert {r.doc_id for r in rows} == survivors(kept)
    c = stages["decontaminate"](spark, b, sf)
    clean = c.cache().collect()
    assert c.columns == docs.columns and {r.doc_id for r in rows} - {r.doc_id for r in clean} == leaks(rows, bench)
    m = stages["mix"](spark, c, sf)
    plan = mixing.plan(c, **corpus_pipeline.MIXED).collect()
    mixed = m.cache().collect()
    assert m.columns == docs.columns and {r.doc_id for r in mixed} == {r.doc_id for r in plan if r.copies} and 0 < len(mixed) <= len(clean)
    s = stages["shard"](spark, m, sf).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in s) == sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in mixed)


def test_run_gives_what_the_stages_give(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "shard", "slot"} <= set(got.columns) and got.count() == got.select("doc_id").distinct().count() > 50


def test_rejected_documents_go(spark, sf):
    df = spark.createDataFrame([(1, "12 !! 34", "en", "src0", 8), (2, "the thing is here", "en", "src0", 17), (3, None, "en", "src0", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in langid.keep_known(df, corpus_pipeline.LEAST_SCORE).collect()} == {2}


def test_undecided_documents_go_and_the_prediction_becomes_the_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = {x: " ".join(r.text for r in docs.filter(F.col("lang") == x).orderBy("doc_id").limit(12).collect())[:4000] for x in ("en", "de")}
    half = long["en"][:1500] + " " + long["de"][:1500]
    rows = [(-1, long["en"], "de", "s", 1), (-2, "zq " * 400, "en", "s", 1), (-3, half, "en", "s", 1), (-4, long["de"], None, "s", 1)]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = {r.doc_id: r.lang for r in langid.keep_known(both, corpus_pipeline.LEAST_SCORE, corpus_pipeline.LEAST_MARGIN).filter("doc_id < 0").collect()}
    assert got[-1] == "en" and got[-4] == "de" and -2 not in got


def test_stages_on_empty_repeated_and_odd_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    some = docs.filter("doc_id < 25")
    odd = spark.createDataFrame([(None, "a text without id", "en", "s", 1), (-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "word " * 60000, "en", "s", 1)], docs.schema)
    whole = some.unionByName(some.limit(5)).unionByName(odd)
    for c in ("size", "_bad", "score", "lang_pred", "n", "slot", "_keep", "m_lang", "a.b"):
        whole = whole.withColumn(c, whole.doc_id)
    for rows in (docs.limit(0), whole):
        at = rows
        for name, stage in corpus_pipeline.STAGES:
            before, at = at, stage(spark, at, str(tmp_path)).cache()
            n = at.count()
            assert n <= before.count() and (name == "shard" or at.columns == before.columns), name
        assert {"doc_id", "text", "lang", "shard", "slot"} <= set(at.columns)
        assert sorted((r.shard, r.slot) for r in at.collect()) == [(s, i) for s, k in sorted(Counter(r.shard for r in at.collect()).items()) for i in range(k)]
