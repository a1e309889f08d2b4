"""Joins by likeness: boxes on a grid, bands of bits, vectors against a query set, votes and unique anchors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: into how many parts a grid cell's left boxes are dealt; each meets all of its right boxes
SHARES = 16
BOX = ("id", "x0", "y0", "x1", "y1")


def box_pairs(left: DataFrame, right: DataFrame, cell: float, by: list[str] | None = None) -> DataFrame:
    """The columns of by, and of both sides with l_ and r_ before their names, and area, for boxes (id, x0, y0, x1, y1, more)
    that overlap, inside each group of `by`: boxes meet in the grid cells they touch, and a pair is kept only in the cell of
    its overlap's corner, so no distinct is needed.

    Without groups, boxes are few bytes but many pairs, so they are dealt to a fixed number of tasks by cell and share: by
    their size alone they would all go to a few."""
    by = by or []
    shares = 1 if by else SHARES
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cells(df: DataFrame, p: str, share: Column) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
        rest = [c for c in df.columns if c not in by]
        df = df.withColumn("gx", F.explode(span("x0", "x1"))).withColumn("gy", F.explode(span("y0", "y1"))).withColumn("share", share)
        df = df.select(*by, "gx", "gy", "share", *(F.col(c).alias(p + c) for c in rest))
        return df if by else df.repartition(tasks, "gx", "gy", "share")

    dealt = F.pmod(F.xxhash64("id", "gx", "gy"), F.lit(shares)).cast("int")
    if by:
        at = [*by, "gx", "gy", "share"]
        own = lambda df, p: F.struct(*(f"{p}_{c}" for c in df.columns if c not in by)).alias(p)
        sides = [cells(df, f"{p}_", F.lit(0)).select(*at, own(df, p)) for df, p in ((left, "l"), (right, "r"))]
        met = sides[0].unionByName(sides[1], allowMissingColumns=True).groupBy(*at).agg(F.collect_list("l").alias("l"), F.collect_list("r").alias("r"))
        df = met.select(*at, F.explode("l").alias("l"), "r").select(*at, "l", F.explode("r").alias("r")).select(*at, "l.*", "r.*")
    else:
        df = cells(left, "l_", dealt).join(cells(right, "r_", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))), ["gx", "gy", "share"])
    df = df.filter("l_x0 < r_x1 and r_x0 < l_x1 and l_y0 < r_y1 and r_y0 < l_y1")
    corner = (F.floor(F.greatest("l_x0", "r_x0") / cell) == F.col("gx")) & (F.floor(F.greatest("l_y0", "r_y0") / cell) == F.col("gy"))
    area = (F.least("l_x1", "r_x1") - F.greatest("l_x0", "r_x0")) * (F.least("l_y1", "r_y1") - F.greatest("l_y0", "r_y0"))
    return df.filter(corner).withColumn("area", area).drop("gx", "gy", "share")


def box_overlap_join(left: DataFrame, right: DataFrame, cell: float, by: list[str] | None = None) -> DataFrame:
    """l_id, r_id, area of the boxes that overlap (see box_pairs)."""
    by = by or []
    return box_pairs(left.select(*by, *BOX), right.select(*by, *BOX), cell, by).select(*by, "l_id", "r_id", "area")


def best_overlaps(left: DataFrame, right: DataFrame, cell: float, of: str = "l") -> DataFrame:
    """l_id, r_id, area, next: for each box of one side (of: l or r) the box of the other with which it shares most, the least id of those
    that share as much, and the second largest area (null without one).

    Pairs are made twice and never leave their task: first for the largest area of each box, which goes along with the box
    then, so that numbers of it are all that is kept of its pairs."""
    sides = {"l": left.select(*BOX), "r": right.select(*BOX)}
    other = "r" if of == "l" else "l"
    most = box_pairs(sides["l"], sides["r"], cell).groupBy(F.col(f"{of}_id").alias("id")).agg(F.max("area").alias("most"))
    sides[of] = sides[of].join(most, "id")
    top = F.col("area") == F.col(f"{of}_most")
    g = box_pairs(sides["l"], sides["r"], cell).groupBy(f"{of}_id").agg(
        F.max("area").alias("area"), F.min(F.when(top, F.col(f"{other}_id"))).alias(f"{other}_id"), F.count_if(top).alias("as_good"), F.max(F.when(~top, F.col("area"))).alias("less")
    )
    return g.select("l_id", "r_id", "area", F.when(F.col("as_good") > 1, F.col("area")).otherwise(F.col("less")).alias("next"))


def clear(best: DataFrame, least: float, margin: float) -> DataFrame:
    """Of best_overlaps those of at least `least` that beat the second by `margin`."""
    return best.filter((F.col("area") >= least) & (F.col("area") - F.coalesce("next", F.lit(0)) >= margin)).drop("next")


def mutual_overlaps(left: DataFrame, right: DataFrame, cell: float, margin: float) -> DataFrame:
    """Boxes that are each other's best overlap by a margin."""
    of = lambda side: clear(best_overlaps(left, right, cell, side), 0, margin)
    return of("l").join(of("r").select("l_id", "r_id"), ["l_id", "r_id"], "left_semi")


def best_with_margin(pairs: DataFrame, by: str, score: str, least: float, margin: float) -> DataFrame:
    """The best partner of each row, if its score is at least `least` and beats the second by `margin`."""
    w = Window.partitionBy(by).orderBy(F.desc(score), *[F.asc(c) for c in pairs.columns if c not in (by, score)])
    df = pairs.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w))
    return df.filter((F.col("_n") == 1) & (F.col(score) >= least) & (F.col(score) - F.coalesce("_next", F.lit(0)) >= margin)).drop("_n", "_next")


def mutual_best(pairs: DataFrame, a: str, b: str, score: str, margin: float) -> DataFrame:
    """Pairs that are each other's best by a margin."""
    return best_with_margin(pairs, a, score, 0, margin).join(best_with_margin(pairs, b, score, 0, margin).select(a, b), [a, b], "left_semi")


def unique_anchors(left: DataFrame, right: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """Rows whose value occurs once on both sides."""
    one = lambda df, i: df.groupBy(value).agg(F.min(i).alias(i), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return one(left, a).join(one(right, b), value)


def hamming_pairs(codes: DataFrame, bits: int, bands: int, most: int) -> DataFrame:
    """a < b, distance: codes (id, code) that differ in at most `most` bits. Then at most as many bands differ, and a pair
    agrees in all others at once; so the join by each choice of bands - most bands and their bits loses none. Equal codes count as one first: their ids are
    listed under the least of them, and pairs are between distinct codes and to that least id."""
    if most >= bands:
        raise ValueError("as many bands as bits may differ can miss pairs")
    width = bits // bands
    # the last band has the bits that are left over
    mask = lambda i: ((1 << (width if i + 1 < bands else bits - i * width)) - 1) << (i * width)
    chosen = [sum(mask(i) for i in some) for some in combinations(range(bands), bands - most)]
    chosen = [m - (1 << 64) if m >= 1 << 63 else m for m in chosen]
    reps = codes.groupBy("code").agg(F.min("id").alias("id"))
    same = codes.join(reps.withColumnRenamed("id", "a"), "code").filter("id <> a").select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    part = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col("code").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(chosen))))
    # few bytes but many pairs: a fixed number of tasks
    tasks = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = reps.select("id", "code", part.alias("x")).select("id", "code", "x.band", "x.key").repartition(tasks, "band", "key")
    other = e.select(F.col("id").alias("b"), F.col("code").alias("code_b"), "band", "key")
    near = e.withColumnRenamed("id", "a").join(other, ["band", "key"]).filter("a < b")
    near = near.withColumn("distance", F.bit_count(F.col("code").bitwiseXOR(F.col("code_b"))).cast("int")).filter(F.col("distance") <= most)
    return same.unionByName(near.select("a", "b", "distance").distinct())


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0, block: int = 1024) -> DataFrame:
    """query_id, vec_id, score: the k nearest of all vectors for each query (vec_id, embedding), itself left out.

    Queries go in blocks of a fixed size; each task multiplies its vectors with a block and keeps its own best k, so a
    query's rows are k a batch before the shuffle.
    """
    spark = vectors.sparkSession
    ids = [r[0] for r in queries.select("vec_id").orderBy("vec_id").collect()]
    out = None
    for at in range(0, max(1, len(ids)), block):
        some = queries.filter(F.col("vec_id").isin(ids[at : at + block])).collect()  # at most `block` vectors
        q_ids = np.array([r["vec_id"] for r in some], np.int64)
        q = np.array([r["embedding"] for r in some], np.float64)
        shared = spark.sparkContext.broadcast((q_ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12) if len(q) else q))

        def rows(batches: Iterator[pa.RecordBatch], shared=shared):
            q_ids, q = shared.value
            for batch in batches:
                ids = np.asarray(batch.column(0))
                if not len(q_ids) or not len(ids):
                    continue
                v = np.asarray(batch.column(1).flatten()).reshape(len(ids), -1).astype(np.float64)
                s = q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T
                s[q_ids[:, None] == ids[None, :]] = -2
                n = min(k, len(ids))
                best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                # ties at the edge come along
                edge = np.take_along_axis(s, best, 1).min(1)
                a, b = np.nonzero((s >= edge[:, None]) & (s >= least))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(ids[b].astype(np.int64)), pa.array(s[a, b])], names=["query_id", "vec_id", "score"])

        part = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(rows, "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return out.filter("score > -2").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def votes(df: DataFrame, unit: list[str], source: str, value: str, weight: str) -> DataFrame:
    """Per unit and candidate value: weight and sources."""
    return df.groupBy(*unit, value).agg(F.sum(weight).alias("weight"), F.count_distinct(source).alias("sources"))


def decide(tally: DataFrame, unit: list[str], value: str, least_share: float, least_sources: int) -> DataFrame:
    """Per unit the winning value and why: tie, few_sources, low_support or accepted."""
    best = tally.groupBy(*unit).agg(
        F.max(F.struct("weight", "sources", value)).alias("top"), F.sum("weight").alias("total"), F.sum("sources").alias("all_sources"), F.max("weight").alias("most")
    )
    ties = tally.join(best.select(*unit, "most"), unit).filter("weight = most").groupBy(*unit).agg(F.count(F.lit(1)).alias("tied"))
    df = best.join(ties, unit)
    reason = F.when(F.col("tied") > 1, "tie").when(F.col("top.sources") < least_sources, "few_sources").when(F.col("most") < F.col("total") * least_share, "low_support").otherwise("accepted")
    return df.select(*unit, F.when(reason == "accepted", F.col(f"top.{value}")).alias("winner"), reason.alias("reason"))


def multiset_overlap(a: DataFrame, b: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the shared part of two multisets, over the larger one."""
    n = lambda df, name: df.groupBy(*by, value).agg(F.count(F.lit(1)).alias(name))
    j = n(a, "n_a").join(n(b, "n_b"), [*by, value], "full_outer").fillna(0, ["n_a", "n_b"])
    g = j.groupBy(*by).agg(F.sum(F.least("n_a", "n_b")).alias("shared"), F.greatest(F.sum("n_a"), F.sum("n_b")).alias("larger"))
    return g.withColumn("ratio", F.col("shared") / F.col("larger"))
