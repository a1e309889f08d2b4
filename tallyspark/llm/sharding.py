"""Sharding by fixed virtual slots.

Each record is hashed by its doc_id into one of SLOTS virtual slots, which never changes. The bytes of each slot are
summed, and a slot-to-shard map of SLOTS entries says which shard holds which slot. The map is versioned: version 1
deals the slots out in turn, and rebalancing edits it, moving whole slots from the fullest to the emptiest shards until
no move helps; a new version is stored beside the old ones. Only the map (SLOTS rows, a constant) passes the driver.

Law: bytes. The sizes of the shards come near equal; a record larger than a shard's even part can't be split.

Defined cases: a null doc_id hashes by its text's checksum; a null text has size 1 and checksum 0; rows that repeat a
doc_id share a slot and are told apart by their place in it; ties (rows that are equal in doc_id, checksum and size)
are numbered in any order; a very long text is one record; an empty table gives an empty result; extra columns aren't
read, and with whole=True those that clash with a name of the result give way to it.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.session import shared_path, written

SLOTS = 4096
#: rows of a slot numbered in one task, about
PART_ROWS = 100_000
BROADCAST_ROWS = 200_000
PLACED = ["doc_id", "size", "text_crc32", "vslot", "shard", "slot"]


def sized(docs: DataFrame, slots: int = SLOTS, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, h (a second hash that spreads the rows of a slot), row (the columns keep)."""
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    row = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")] if keep else []
    df = docs.select("doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), *row)
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("crc:"), F.col("text_crc32").cast("string")))
    return df.withColumn("vslot", F.pmod(F.xxhash64(F.lit("slot"), key), F.lit(slots)).cast("int")).withColumn("h", F.xxhash64(F.lit("part"), key, "text_crc32"))


def slot_sizes(records: DataFrame) -> DataFrame:
    """Rows and bytes of each slot; at most SLOTS rows, summed on the map side first."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(slots: int, shards: int) -> dict[int, int]:
    return {s: s % shards for s in range(slots)}


def rebalanced(old: dict[int, int], size: dict[int, int], shards: int) -> dict[int, int]:
    """old with as few slots moved as bring the shards' bytes near equal.

    Slots leave the fullest shard for the emptiest while the spread gets smaller, the best fit for half the difference
    first; then pairs of slots are exchanged for the last bytes. old may name fewer or more shards than there are now.
    """
    new = {s: (t if t < shards else -1) for s, t in old.items()}
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for s, t in new.items():
        if t >= 0 and size.get(s, 0):
            load[t] += size[s]
            held[t].append((size[s], s))
    homeless = sorted(((size.get(s, 0), s) for s, t in new.items() if t < 0), reverse=True)
    heap = [(b, t) for t, b in enumerate(load)]
    heapq.heapify(heap)
    for b, s in homeless:
        n, t = heapq.heappop(heap)
        new[s] = t
        load[t] = n + b
        held[t].append((b, s))
        heapq.heappush(heap, (n + b, t))
    for h in held:
        h.sort()
    for _ in range(4 * len(new)):
        hi, lo = max(range(shards), key=lambda t: (load[t], t)), min(range(shards), key=lambda t: (load[t], t))
        gap = load[hi] - load[lo]
        best = _best(held[hi], held[lo], gap)
        if best is None:
            break
        out, back = best
        held[hi].remove(out)
        _insert(held[lo], out)
        new[out[1]] = lo
        delta = out[0]
        if back is not None:
            held[lo].remove(back)
            _insert(held[hi], back)
            new[back[1]] = hi
            delta -= back[0]
        load[hi] -= delta
        load[lo] += delta
    return new


def _insert(rows: list, x: tuple[int, int]) -> None:
    import bisect

    bisect.insort(rows, x)


def _best(hi: list, lo: list, gap: int):
    """The slot to move, or the two to exchange, whose difference is nearest to half the gap; None: nothing helps."""
    import bisect

    best, found = gap, None
    at = bisect.bisect(hi, (gap / 2, -1))
    for x in hi[max(0, at - 1) : at + 1]:
        if 0 < x[0] < gap and abs(gap - 2 * x[0]) < best:
            best, found = abs(gap - 2 * x[0]), (x, None)
    for y in lo:
        at = bisect.bisect(hi, (y[0] + gap / 2, -1))
        for x in hi[max(0, at - 1) : at + 1]:
            if 0 < x[0] - y[0] < gap and abs(gap - 2 * (x[0] - y[0])) < best:
                best, found = abs(gap - 2 * (x[0] - y[0])), (x, y)
    return found


def store_map(spark: SparkSession, path: str, version: int, slots: dict[int, int]) -> None:
    """Write one version of the map; older versions stay."""
    rows = spark.createDataFrame(sorted(slots.items()), "vslot int, shard int")
    rows.coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int").parquet(f"{path}/version={version}")


def shard(docs: DataFrame, shards: int, *, slots: int = SLOTS, map_path: str | None = None, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard and slot, the record's place in its shard (gapless from 0); with whole also
    the other columns of docs (texts then go through one exchange, by slots).

    Writes versions 1 and 2 of the map below map_path (a new folder in the shared one unless given).
    """
    spark = docs.sparkSession
    records = written(sized(docs, slots), "records")
    sizes = {r.vslot: (r.bytes, r.rows) for r in slot_sizes(records).collect()}  # at most `slots` rows
    path = map_path or shared_path(spark, "slot-map")
    old = first_map(slots, shards)
    store_map(spark, path, 1, old)
    new = rebalanced(old, {s: b for s, (b, _) in sizes.items()}, shards)
    store_map(spark, path, 2, new)

    # places: slots of a shard in order, in each slot parts by the second hash, in each part the rows in order
    parts = max(1, -(-max([n for _, n in sizes.values()], default=0) // PART_ROWS))
    part = F.pmod("h", F.lit(parts)).cast("int")
    records = records.withColumn("part", part)
    slot_map = load_map(spark, path, 2)
    counts = records.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(slot_map), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("vslot", "part", "shard", "first")
    own = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    keep = [c for c in docs.columns if c not in PLACED] if whole else None
    rows = sized(docs, slots, keep).withColumn("part", part) if keep else records
    # at most slots * parts counts: a broadcast while they are few keeps the texts where the window has put them
    few = slots * parts <= BROADCAST_ROWS
    placed = rows.withColumn("at", F.row_number().over(own) - 1).join(F.broadcast(first) if few else first, ["vslot", "part"])
    return placed.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"), *(F.col(f"row.`{c}`").alias(c) for c in keep or ()))
