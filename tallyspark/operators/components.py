"""Connected components: edges are contracted to forests part by part, then alternating stars join what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import discard, written

#: edges that a task contracts at once, and so the most that it holds
CONTRACT = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of the edges a - b, for nodes that aren't the least themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        for to in (before[x], before[y], x, y):
            np.minimum.at(label, to, low)
        label = label[label]
        if np.array_equal(label, before):
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[moved], nodes[label[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracts the edges of a task whenever it holds CONTRACT of them."""
    u, v, held = [], [], 0

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        u.append(np.asarray(batch.column(0)))
        v.append(np.asarray(batch.column(1)))
        held += batch.num_rows
        if held >= CONTRACT:
            u, v = ([x] for x in forest(np.concatenate(u), np.concatenate(v)))
            held = len(u[0])
            if 2 * held >= CONTRACT:
                yield out(u[0], v[0])
                u, v, held = [], [], 0
    if held:
        yield out(*forest(np.concatenate(u), np.concatenate(v)))


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, v, m) for the rows (u, v): m is the least of u and its neighbours.

    The second join key makes Spark deal out both sides for this join, so AQE can split a node with very many edges.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.xxhash64("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.withColumn("k", F.xxhash64("u")).join(least, ["u", "k"]).select("u", "v", "m")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """node, component for every node of edges; component is the least node that is reachable.

    Rows with a null end or equal ends add nothing. Edges of whole numbers are first contracted in parts of CONTRACT
    edges; where they fill one part that is all, else rounds of stars go on until the edges no longer change.
    """
    e = written(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v"), "edges")
    if e.dtypes == [("u", "bigint"), ("v", "bigint")]:
        parts = -(-e.count() // CONTRACT)
        first = e
        e = written(e.coalesce(max(1, parts)).mapInArrow(_forests, "u long, v long"), "edges")
        discard(first)
        if parts <= 1:
            return _labelled(e)
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _least_neighbour(large)
        last = e
        e = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        discard(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return _labelled(e)
        before = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _labelled(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
