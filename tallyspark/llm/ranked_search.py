"""Ranked lexical search over a tiered index, exact to the last place.

The index holds, for each text that occurs (copies of a text rank alike, so they share one entry, a class), how often each
asked term stands in it, and a posting (term, class, impact) for each such pair. A term's postings are split into tiers by
impact: the terms' saturations are counted in LEVELS levels, and a level is in tier t if fewer than FIRST * GROWTH^t postings
of the term lie above it. So no list is ever sorted or gathered, however common its term is. For each tier the greatest
impact that lies below it bounds what it leaves out of a term: the residual bound.

Tier 0 of an item's terms comes first. The classes that it puts first are scored exactly, from their own term counts:
the item's tenth document has their tenth score at least. An item is proven at a tier if what the tier leaves out, the sum of
the residual bounds, is less than that score: a class that was never met can't be among the ten. Items without that
proof fall through to the first tier that gives it; the last one leaves nothing out and needs none. There a class that
was met scores at most its sum so far and the residual bounds of the terms it wasn't met under. If that is below the
tenth score it goes, else it is scored exactly. Below tier 0 the most frequent terms, whose greatest impacts stay within half
of the tenth score together, needn't be read at all. Nothing is cut off: results are those of scoring every document.

Postings are never joined with each other: items come in blocks of at most BLOCK item terms, which are broadcast, and
all postings pass by them. Postings of a text stand together, so sums are made before the shuffle.

Terms are told apart by 64-bit hashes, texts by MD5.

Defined cases: rows that repeat a doc_id are documents of their own; a null doc_id counts in all statistics and ranks
after the others of the same score; a null or empty text has no term and is never found; an item without terms finds
nothing; items that repeat an item_id are answered one by one; equal scores rank by doc_id, rows equal in both in any
order; very long texts are hashed in pieces; empty tables give an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import words
from tallyspark.session import discard, written

TOP = 10
LEVELS = 64
#: postings of a term in tier 0, about, by how much each further tier is larger, and how many tiers there are
FIRST, GROWTH, TIERS = 250, 16, 4
#: item terms broadcast at once
BLOCK = 100_000
#: asked terms that are sent to all tasks; an index of more terms takes all terms of the texts
ASKED = 1_000_000
#: rows of the table of terms and levels that may be broadcast
BROADCAST_ROWS = 400_000
SCALE = 1_000_000_000


@dataclass
class Index:
    """texts: cls, n, m, terms, tfs. members: cls, doc_id (the TOP least of each class). levels: term, level, tier,
    weight. bounds: term, tier, bound. postings: cls, term, impact, tier."""

    texts: DataFrame
    members: DataFrame
    levels: DataFrame
    bounds: DataFrame
    postings: DataFrame


def _counted(batches: Iterator[pa.RecordBatch], asked: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """doc_id, digest, n, terms, tfs of each row: its terms' hashes and counts (only asked ones, if given)."""
    for batch in batches:
        for a, b, h, bounds in words.terms(batch.column("text")):
            doc = np.repeat(np.arange(b - a), np.diff(bounds))
            if asked is not None:
                at = np.minimum(np.searchsorted(asked, h), max(len(asked) - 1, 0))
                hit = asked[at] == h if len(asked) else np.zeros(len(h), bool)
                h, doc = h[hit], doc[hit]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            edge = np.ones(len(h), bool)
            edge[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            start = np.flatnonzero(edge)
            offsets = pa.array(np.searchsorted(doc[start], np.arange(b - a + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a),
                    batch.column("digest").slice(a, b - a),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(h[start].view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(start, len(h))).astype(np.int64))),
                ],
                ["doc_id", "digest", "n", "terms", "tfs"],
            )


def counted(df: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """df (doc_id, text) as doc_id, digest, n, terms, tfs."""
    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, digest string, n long, terms array<long>, tfs array<long>"
    return df.select("doc_id", F.md5("text").alias("digest"), "text").mapInArrow(lambda batches: _counted(batches, asked), schema)


def saturation(tf: str = "tf", m: str = "m") -> str:
    return f"(({SCALE}L * {tf}) div (1000L * {tf} + 8L * {m}))"


def build(docs: DataFrame, asked: np.ndarray | None = None) -> Index:
    """The index of docs (doc_id, text) for the asked terms (sorted hashes), or for all terms."""
    rows = written(counted(docs, asked).withColumn("row", F.monotonically_increasing_id()), "search-rows")
    full = rows.filter("n > 0")
    total = full.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(1)).alias("words")).first()
    copies = full.groupBy("digest").agg(F.min("row").alias("cls"), F.count(F.lit(1)).alias("copies"))
    # 90 * n * N may pass 64 bits for one very long text among very many: the product is made in decimals
    length = F.expr(f"cast(10 + ((cast(90 * n as decimal(19, 0)) * cast({total.docs} as decimal(18, 0))) div {total.words}) as long)")
    texts = written(copies.join(full.select(F.col("row").alias("cls"), "n", "terms", "tfs"), "cls").select("cls", "digest", "copies", "n", length.alias("m"), "terms", "tfs"), "search-texts")
    # Spark keeps the first TOP rows of each text in each task, so copies don't gather before the shuffle
    first = Window.partitionBy("digest").orderBy(F.asc_nulls_last("doc_id"))
    members = full.select("digest", "doc_id").withColumn("no", F.row_number().over(first)).filter(F.col("no") <= TOP)
    members = written(members.join(copies.select("digest", "cls"), "digest").select("cls", "doc_id"), "search-members")

    pairs = texts.select("cls", "copies", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("cls", "copies", F.col("x.terms").alias("term"), F.expr(saturation("x.tfs")).alias("sat"))
    pairs = pairs.withColumn("level", F.expr(f"cast((1000000 - sat) * {LEVELS} div 1000001 as int)"))
    levels = pairs.groupBy("term", "level").agg(F.count(F.lit(1)).alias("size"), F.sum("copies").alias("copies"), F.max("sat").alias("top"))
    above = Window.partitionBy("term").orderBy("level")  # at most LEVELS rows a term
    whole = Window.partitionBy("term")
    levels = levels.withColumns({"above": F.sum("size").over(above) - F.col("size"), "df": F.sum("copies").over(whole)})
    tier = sum(((F.col("above") >= FIRST * GROWTH**t).cast("int") for t in range(TIERS - 1)), F.lit(0))
    weight = F.floor(1000 * F.ln((2 * F.lit(total.docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    levels = written(levels.select("term", "level", tier.alias("tier"), weight.alias("weight"), "top"), "search-levels")
    bounds = levels.select("term", "weight", "top", F.explode(F.expr("filter(sequence(0, tier - 1), x -> tier > 0)")).alias("tier"))
    bounds = written(bounds.groupBy("term", "tier").agg((F.max("weight") * F.max("top")).alias("bound")), "search-bounds")
    own = levels.select("term", "level", "tier", "weight")
    own = F.broadcast(own) if levels.count() <= BROADCAST_ROWS else own
    postings = pairs.join(own, ["term", "level"]).select("cls", "term", (F.col("weight") * F.col("sat")).alias("impact"), "tier")
    postings = written(postings, "search-postings")
    discard(rows)
    return Index(texts.drop("digest"), members, levels, bounds, postings)


def _ranked(index: Index, scored: DataFrame) -> DataFrame:
    """q, rank, doc_id, score: the TOP documents of scored (q, cls, score)."""
    docs = scored.filter("score > 0").join(index.members, "cls")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return docs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TOP).select("q", "rank", "doc_id", "score")


def _sums(index: Index, terms: DataFrame, tier: int) -> DataFrame:
    """q, cls, low, high: what classes met in tiers up to `tier` score at least and at most. terms (q, term, bound,
    rest): what is read, the residual bound of each term, and all that the item leaves out."""
    met = index.postings.filter(F.col("tier") <= tier).join(F.broadcast(terms), "term")
    g = met.groupBy("q", "cls", "rest").agg(F.sum("impact").alias("low"), F.sum(F.col("impact") - F.col("bound")).alias("gain"))
    return g.select("q", "cls", "low", (F.col("gain") + F.col("rest")).alias("high"))


def _exact(index: Index, near: DataFrame, asked: DataFrame) -> DataFrame:
    """near (q, cls) with their scores, from the texts' own counts."""
    near = written(near, "search-near")
    few = near.count() <= BROADCAST_ROWS
    own = F.broadcast(asked.select("q", "term", "weight"))
    pairs = index.texts.join(F.broadcast(near) if few else near, "cls").select("q", "cls", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    pairs = pairs.select("q", "cls", F.col("x.terms").alias("term"), F.expr(saturation("x.tfs")).alias("sat"))
    return pairs.join(own, ["q", "term"]).groupBy("q", "cls").agg(F.sum(F.col("weight") * F.col("sat")).alias("score"))


def _tenths(index: Index, asked: DataFrame) -> DataFrame:
    """q, tenth: a score that the item's tenth document has at least (null: fewer than TOP were met), exact scores of
    the TOP classes that tier 0 puts first."""
    first = asked.withColumn("bound", F.lit(0)).withColumn("rest", F.lit(0)).select("q", "term", "bound", "rest")
    w = Window.partitionBy("q").orderBy(F.desc("low"), "cls")
    best = _sums(index, first, 0).withColumn("no", F.row_number().over(w)).filter(F.col("no") <= TOP).select("q", "cls")
    found = _ranked(index, _exact(index, best, asked)).filter(F.col("rank") == TOP).select("q", F.col("score").alias("tenth"))
    return asked.select("q").distinct().join(found, "q", "left")


def _planned(index: Index, asked: DataFrame, tenths: DataFrame) -> DataFrame:
    """q, term, tenth, tier, bound, rest: per item the first tier whose residual bounds leave less than its tenth score,
    and what is read there. Its most frequent terms, as far as their greatest impacts stay within half of the
    tenth score together, aren't read in tiers after the first: they leave out their greatest impact."""
    t = asked.join(F.broadcast(tenths), "q")
    frequent = Window.partitionBy("q").orderBy("weight", "term")  # terms of one item
    t = t.withColumn("spared", F.coalesce(F.sum("most").over(frequent) * 2 <= F.col("tenth"), F.lit(False)))
    tiers = t.select("*", F.explode(F.expr(f"sequence(0, {TIERS - 1})")).alias("tier"))
    left = F.when((F.col("tier") > 0) & F.col("spared"), F.col("most")).otherwise(F.coalesce("bound", F.lit(0)))
    tiers = tiers.join(index.bounds, ["term", "tier"], "left").withColumn("bound", left)
    rest = tiers.groupBy("q", "tier").agg(F.sum("bound").alias("rest"), F.first("tenth").alias("tenth"))
    proves = rest.filter((F.col("rest") == 0) | (F.col("rest") < F.col("tenth")))
    chosen = proves.groupBy("q").agg(F.min("tier").alias("tier")).join(rest.select("q", "tier", "rest"), ["q", "tier"])
    read = tiers.join(chosen, ["q", "tier"]).filter("not (tier > 0 and spared)")
    return read.select("q", "term", "weight", "tenth", "tier", "bound", "rest")


def search(index: Index, items: DataFrame) -> tuple[DataFrame, list[int]]:
    """q, rank, doc_id, score for items (q, terms), and how many items each tier proved."""
    spark = items.sparkSession
    weights = index.levels.groupBy("term").agg(F.first("weight").alias("weight"), (F.max("weight") * F.max("top")).alias("most"))
    asked = written(items.select("q", F.explode("terms").alias("term")).distinct().join(weights, "term"), "search-asked")
    block = F.floor((F.sum("n").over(Window.orderBy("q")) - 1) / BLOCK).cast("int")  # one row an item
    sizes = written(asked.groupBy("q").agg(F.count(F.lit(1)).alias("n")).select("q", block.alias("block")), "search-blocks")
    blocks = sizes.agg(F.max("block")).first()[0]
    out = spark.createDataFrame([], "q long, rank int, score long").withColumn("doc_id", F.lit(None).cast(index.members.schema["doc_id"].dataType))
    proved = [0] * TIERS
    for b in range(0 if blocks is None else blocks + 1):
        own = asked.join(F.broadcast(sizes.filter(F.col("block") == b).select("q")), "q", "left_semi")
        plan = written(_planned(index, own, written(_tenths(index, own), "search-tenths")), "search-plan")
        for tier, n in sorted((r.tier, r.n) for r in plan.groupBy("tier").agg(F.count_distinct("q").alias("n")).collect()):
            proved[tier] += n
            terms = plan.filter(F.col("tier") == tier)
            tenth = F.broadcast(terms.select("q", "tenth").distinct())
            near = _sums(index, terms.select("q", "term", "bound", "rest"), tier).join(tenth, "q").filter("tenth is null or high >= tenth")
            out = out.unionByName(written(_ranked(index, _exact(index, near.select("q", "cls"), own)), "search-found"))
    return out, proved


def rank(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP documents of docs (doc_id, text) for each of items (item_id, text)."""
    found = counted(items.select(F.col("item_id").alias("doc_id"), "text")).withColumn("q", F.monotonically_increasing_id())
    queries = written(found.select("q", F.col("doc_id").alias("item_id"), "terms"), "search-items")
    terms = queries.select(F.explode("terms").alias("term")).distinct()
    asked = None
    if terms.limit(ASKED + 1).count() <= ASKED:
        asked = np.sort(np.array([r.term for r in terms.collect()], np.int64).view(np.uint64))  # at most ASKED hashes
    hits, _ = search(build(docs, asked), queries.select("q", "terms"))
    return hits.join(queries.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
