"""Near-duplicate passages by compact windows.

A text is the sequence of its five-word shingles. For each of HASHES hash functions, position c's compact window is the
widest [l, r] around c in which c has the least hash: the node of c in the Cartesian tree of the hashes. All
subsequences that lie in it and hold c share their min-hash, so the tree's nodes at least LEAST shingles wide (a passage
of 50 words) group all long subsequences by signature, about 2n / LEAST of them for n shingles.

Windows with equal (function, min-hash) meet by hash, packed as bytes. Each entry is paired with two hubs of its key: the
first document, and the last if no passage holds its window yet. An interval join within a pair asks for windows of
ENOUGH different functions that overlap by LEAST shingles in both texts; such pairs are verified on their whole texts.

Hubs may miss a passage that they don't hold themselves. What is verbatim is made up for exactly: a run of LEAST shingles
has its min-hash in it, and HALF shingles beside that; so the places where HALF shingles beside a min-hash are the same
in two documents, of which one has no passage there, lead to all runs that could be missing. Their hashes meet, and each
open run is verified against the first document that has it.

Near copies that hubs miss are made up for exactly, too. A break of the alignment (words changed, put in, left out or
moved) costs at least eight shingles of the union, so a passage of n shingles has at most n / 28 breaks and a run of RUN
equal shingles; the SEED shingles in it with the least hash are the same in both texts. All pairs of documents that have
such a seed in common, which lies in no passage of one of them, meet in cells of two blocks of documents, if it lies in
both where a similar part may be: of a part's shingles at least three quarters stand elsewhere, too. There the
condition of a similar part is tried on the hits of all partners of a document at once, and the pairs that it leaves are
verified, as long as they have an open place. No partner, group or key is capped; the seeds' pairs grow with the square of
a group that stays open. Where a text repeats its own shingles a break may cost less; such a near copy is found if it has
a run as long, or by its min-hashes.

A verified passage is a run of LEAST equal shingles, or an aligned stretch or part of one of that length with
Jaccard at least 0.75.

Defined cases: null and empty texts, and those of fewer than 50 words, have no passages; rows that repeat a doc_id are
one document to themselves (no pair); rows with a null doc_id take no part; extra columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import words as W
from tallyspark.session import discard, release, written

U = np.uint64
HASHES = 4
ENOUGH = 2
WORDS = 50
LEAST = WORDS - W.SHINGLE + 1
SIMILAR = (3, 4)
#: windows of a part, about, and of a kilobyte of text at most
PART_ENTRIES = 300_000
#: a stretch ends where so many shingles in a row have no partner, or the alignment shifts by more
GAP, SHIFT = 15, 30
BROADCAST_IDS = 500_000
#: shingles beside a min-hash, of which any run of LEAST has so many on one side at least
HALF = LEAST // 2
#: equal shingles in a row that any near copy has, and those of them that are hashed together
RUN, SEED = 16, 8
#: documents and bytes of a block, about, and partners that are compared at once
BLOCK, BLOCK_BYTES, AT_ONCE = 2000, 16 << 20, 256


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each i, by block prefixes and suffixes."""
    n = len(x)
    m = -(-n // width) * width
    pad = np.full(m, ~U(0))
    pad[:n] = x
    rows = pad.reshape(-1, width)
    head = np.minimum.accumulate(rows, 1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def smaller_before(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The place of the nearest smaller value before each (all differ) in its document, or -1."""
    out = np.arange(-1, len(x) - 1)
    out[np.flatnonzero(doc[1:] != doc[:-1]) + 1] = -1
    # what lies between a value and its place so far is larger, so that place's own place comes next, for all at once
    todo = np.arange(len(x))
    for _ in range(8):
        at = out[todo]
        todo = todo[(at >= 0) & (x[at] > x[todo])]
        out[todo] = out[out[todo]]
    # the few that are left pass long rising runs; what one has passed stands behind it for the next
    keys, to = x.tolist(), out.tolist()
    for i in todo.tolist():
        key, j = keys[i], to[i]
        while j >= 0 and keys[j] > key:
            j = to[j]
        to[i] = j
    return np.array(to, np.int64)


def compact_windows(h: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(document, hash, c, l, r) of the nodes at least `least` wide of each document's Cartesian tree; r is inclusive.

    Nodes as wide are those that are the least of some window of `least`. All ancestors of such a node are as wide, and
    its nearest smaller neighbours are ancestors, so these nodes alone give every l and r.
    """
    size = np.diff(first)
    none = tuple(np.zeros(0, t) for t in (np.int64, U, np.int64, np.int64, np.int64))
    if len(h) < least:
        return none
    bits = U(max(24, len(h).bit_length()))
    packed = (h >> bits << bits) | np.arange(len(h), dtype=U)  # ties: the first one
    low = sliding_min(packed, least)
    doc = np.repeat(np.arange(len(size)), size)
    ok = doc[: len(low)] == doc[least - 1 :]
    low, d = low[ok], doc[: len(ok)][ok]
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    low, d = low[new], d[new]
    c = (low & ((U(1) << bits) - U(1))).astype(np.int64)
    before, after = smaller_before(low, d), len(c) - 1 - smaller_before(low[::-1], d[::-1])[::-1]
    left = np.where(before >= 0, c[before] + 1, first[d])
    right = np.where(after < len(c), c[np.minimum(after, len(c) - 1)], first[d + 1]) - 1
    return d, h[c], c - first[d], left - first[d], right - first[d]


def function(h: np.ndarray, f: int) -> np.ndarray:
    return W.mix(h + U((2 * f + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def windows(docs: DataFrame, parts: int) -> DataFrame:
    """part, blob: all compact windows, packed. docs: (id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            got = []
            for a, _, buf, starts in W.chunks(batch.column(1)):
                s, e, bounds = W.word_spans(buf, starts)
                h, first = W.shingles(W.word_hashes(buf, s, e), bounds)
                for f in range(HASHES):
                    d, v, c, left, right = compact_windows(function(h, f), first)
                    key = (W.mix(v) & U(0x3FFFFFFF)).astype(np.uint32) << np.uint32(2) | np.uint32(f)
                    got.append((((v >> U(20)) % U(parts)).astype(np.int64), ids[a + d], key, *(x.astype(np.uint32) for x in (c, left, right))))
            if not got:
                continue
            yield packed([np.concatenate([g[i] for g in got]) for i in range(6)], parts)

    return docs.mapInArrow(rows, "part int, blob binary")


def packed(cols: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """part, blob: the columns after the first, which is the part, one after the other."""
    order = np.argsort(cols[0], kind="stable")
    cols = [x[order] for x in cols]
    edges = np.searchsorted(cols[0], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(edges)).tolist()
    blobs = [b"".join(x[edges[p] : edges[p + 1]].tobytes() for x in cols[1:]) for p in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


SHARED = "id long, f int, c int, l int, r int, first long, first_l int, first_r int, last long, last_l int, last_r int"


def shared_windows(blobs: DataFrame) -> DataFrame:
    """The windows whose key (function and min-hash) another document has, too, with the first and the last of the key."""

    def part(table: pa.Table) -> pa.Table:
        cols = [[] for _ in range(5)]
        for b in table.column("blob").to_pylist():
            n = len(b) // 24
            cols[0].append(np.frombuffer(b, np.int64, n))
            for i in range(1, 5):
                cols[i].append(np.frombuffer(b, np.uint32, n, 8 * n + 4 * n * (i - 1)))
        ids, key, c, left, right = (np.concatenate(x) for x in cols)
        order = np.lexsort((c, ids, key))
        ids, key = ids[order], key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.concatenate([start, [len(key)]]))
        mixed = np.repeat(ids[start] != ids[start + n - 1], n)
        hubs = [np.repeat(x, n)[mixed] for x in (start, start + n - 1)]
        c, left, right = (x[order].astype(np.int32) for x in (c, left, right))
        out = [ids[mixed], (key[mixed] & 3).astype(np.int32), c[mixed], left[mixed], right[mixed]]
        for x in hubs:
            out += [ids[x], left[x], right[x]]
        return pa.table(dict(zip([x.split()[0] for x in SHARED.split(", ")], out, strict=True)))

    return blobs.groupBy("part").applyInArrow(part, SHARED)


def spans_of(found: DataFrame) -> DataFrame:
    """id, spans: the passages of each document in shingles, ends exclusive."""
    sides = [found.select(F.col(x).alias("id"), F.struct(F.col(f"{x}_start").alias("s"), (F.col(f"{x}_end") - W.SHINGLE + 1).alias("e")).alias("x")) for x in "ab"]
    return sides[0].unionByName(sides[1]).groupBy("id").agg(F.collect_set("x").alias("spans"))


def opened(first: np.ndarray, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """Whether the run of LEAST shingles that begins at each place lies in none of its document's passages."""
    out = np.ones(int(first[-1]), bool)
    for i, own in enumerate(spans):
        for s, e in own:
            out[first[i] + s : first[i] + max(s, e - LEAST + 1)] = False
    return out


def held(first: np.ndarray, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """Whether each shingle lies in a passage of its document."""
    out = np.zeros(int(first[-1]), bool)
    for i, own in enumerate(spans):
        for s, e in own:
            out[first[i] + s : first[i] + e] = True
    return out


def seeds(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, hash) of the SEED shingles with the least hash of each run of RUN, of texts of LEAST and more. One
    shingle over and over is no seed: a near copy has others, or it is verbatim."""
    n, size = len(h), np.diff(first)
    if n < RUN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    doc = np.repeat(np.arange(len(size)), size)
    v = run_hashes(h, SEED)
    changes = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
    same = changes[SEED - 1 :] == changes[: n - SEED + 1]
    bits = U(max(24, n.bit_length()))
    low = sliding_min(np.where(same, ~U(0), v) >> bits << bits | np.arange(len(v), dtype=U), RUN - SEED + 1)
    ok = (doc[: len(low)] == doc[RUN - 1 :]) & (size[doc[: len(low)]] >= LEAST)
    c = np.unique((low[ok] & ((U(1) << bits) - U(1))).astype(np.int64))
    c = c[~same[c]]
    return doc[c], c, W.mix(v[c] + U(3))


def min_places(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, place of the min-hash, its first run, its runs) for the runs of LEAST shingles with the same min-hash."""
    n = len(h)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[: n - LEAST + 1] == doc[LEAST - 1 :]) if n >= LEAST else np.zeros(0, np.int64)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    bits = U(max(24, n.bit_length()))
    low = sliding_min(function(h, 0) >> bits << bits | np.arange(n, dtype=U), LEAST)[at]
    new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return doc[at[new]], (low[new] & ((U(1) << bits) - U(1))).astype(np.int64), at[new], np.diff(np.concatenate([new, [len(at)]]))


def half_keys(h: np.ndarray, first: np.ndarray, doc: np.ndarray, c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which of the min-hashes, hash) of the HALF shingles from each on, and of those up to it."""
    runs = run_hashes(h, HALF)
    after, before = np.flatnonzero(c + HALF <= first[doc + 1]), np.flatnonzero(c - HALF + 1 >= first[doc])
    return [(after, W.mix(runs[c[after]] + U(1))), (before, W.mix(runs[c[before] - HALF + 1] + U(2)))]


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    return texts.join(spans, "id", "left").select("id", "text", F.col("spans.s").alias("s"), F.col("spans.e").alias("e"))


def likely(bad: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether each seed (at c) lies where a similar part may be. bad: the places of lonely shingles (those that stand once
    in all texts), sorted; the last one is the end of the text.

    A part has LEAST places, of which no more than a quarter are lonely: other texts' parts lack those."""
    b = np.concatenate([[-1], bad])
    f = b - 4 * np.arange(len(b))
    best = np.maximum.accumulate(f[::-1])[::-1]
    end = b[np.searchsorted(-best, 3 - f, "right") - 1]
    upto = np.maximum.accumulate(np.where(end - b > LEAST, end, -1))
    return upto[np.searchsorted(b, c, "left") - 1] >= c + SEED


def missing_pairs(texts: DataFrame, spans: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """a < b: each open run of LEAST shingles that another document has, too, with the first document that has it; and id,
    key, open: the seeds of several documents, of which one is open, where similar parts may be."""
    docs = with_spans(texts, spans)

    def sequences(batch: pa.RecordBatch):
        own = [list(zip(s or (), e or (), strict=True)) for s, e in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        ids = np.array(batch.column(0).to_pylist(), np.int64)
        for a, b, buf, starts in W.chunks(batch.column(1)):
            s, e, bounds = W.word_spans(buf, starts)
            h, first = W.shingles(W.word_hashes(buf, s, e), bounds)
            yield slice(a, b), ids[a:b], h, first, own[a:b]

    def dealt(got: list[tuple[np.ndarray, ...]], kind: int = 0):
        # kinds are dealt apart: 0 half runs or runs (id, hash), 1 places (id, place, hash)
        if got:
            ids, *more, v = (np.concatenate([g[i] for g in got]) for i in range(len(got[0])))
            yield packed([((v >> U(20)) % U(parts)).astype(np.int64) + kind * parts, ids, *more, v], (kind + 1) * parts)

    def places(batches: Iterator[pa.RecordBatch]):
        # the last bit of a hash says whether the place is open
        for batch in batches:
            got, seen = [], []
            for _, ids, h, first, own in sequences(batch):
                doc, c, at, runs = min_places(h, first)
                if len(doc):
                    total = np.concatenate([[0], np.cumsum(opened(first, own))])
                    some = total[at + runs] > total[at]
                    got += [(ids[doc[k]], v & ~U(1) | some[k].astype(U)) for k, v in half_keys(h, first, doc, c)]
                doc, c, v = seeds(h, first)
                if len(doc):
                    total = np.concatenate([[0], np.cumsum(held(first, own))])
                    seen.append((ids[doc], (c - first[doc]).astype(np.uint32), v & ~U(1) | (total[c + SEED] - total[c] < SEED).astype(U)))
            yield from dealt(got)
            yield from dealt(seen, 1)

    def open_runs(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            got, seen = [], []
            keys = np.unique(np.asarray(batch.column(4).flatten())).view(U)
            asked = np.asarray(batch.column(5).fill_null(False))
            for part, ids, h, first, own in sequences(batch):
                doc, c, at, runs = min_places(h, first)
                if len(doc) and len(keys):
                    pick = np.zeros(len(doc), bool)
                    for k, v in half_keys(h, first, doc, c):
                        pick[k] |= np.isin(v >> U(1), keys)
                    where = np.repeat(at[pick] - np.concatenate([[0], np.cumsum(runs[pick])[:-1]]), runs[pick]) + np.arange(runs[pick].sum()) if pick.any() else np.zeros(0, np.int64)
                    v = run_hashes(h)
                    got.append((np.repeat(ids[doc[pick]], runs[pick]), v[where] & ~U(1) | opened(first, own)[where].astype(U)))
                doc = np.repeat(np.arange(len(ids)), np.diff(first))
                mine = asked[part]
                some = np.flatnonzero(mine[doc])
                if len(some):
                    # the end of a text is a lonely place of its own
                    v = W.mix(np.concatenate([h[some] + U(4), W.mix(ids[mine].view(U)) + U(5)]))
                    seen.append((np.concatenate([ids[doc[some]], ids[mine]]), np.concatenate([some - first[doc[some]], np.diff(first)[mine]]).astype(np.uint32), v))
            yield from dealt(got)
            if seen:
                ids, c, v = (np.concatenate([x[i] for x in seen]) for i in range(3))
                yield packed([(v >> U(32)).astype(np.int64) % parts + parts, ids, c, v.astype(np.uint32)], 2 * parts)

    def columns(table: pa.Table, *types: type) -> list[np.ndarray]:
        size = [np.dtype(t).itemsize for t in types]
        out = [[] for _ in types]
        for b in table.column("blob").to_pylist():
            n, at = len(b) // sum(size), 0
            for i, t in enumerate(types):
                out[i].append(np.frombuffer(b, t, n, at))
                at += n * size[i]
        return [np.concatenate(x) for x in out]

    def groups(table: pa.Table) -> tuple[np.ndarray, ...]:
        """ids, hashes, open or not, sorted, a document once a hash (open if it is anywhere), and the starts of those groups
        of several documents of which one is open."""
        ids, v = columns(table, np.int64, U)
        order = np.lexsort((~v & U(1), ids, v >> U(1)))
        ids, v = ids[order], v[order]
        new = np.ones(len(v), bool)
        new[1:] = ((v[1:] ^ v[:-1]) > U(1)) | (ids[1:] != ids[:-1])
        ids, v = ids[new], v[new]
        start = np.flatnonzero(np.concatenate([[True], v[1:] >> U(1) != v[:-1] >> U(1)]))
        size = np.diff(np.append(start, len(v)))
        is_open = (v & U(1)).astype(bool)
        some = (size > 1) & np.maximum.reduceat(is_open, start)
        return ids, v >> U(1), is_open, start[some], size[some]

    def shared(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() >= parts:
            ids, c, v = columns(table, np.int64, np.uint32, U)
            order = np.lexsort((ids, v >> U(1)))
            ids, c, v = ids[order], c[order].astype(np.int32), v[order]
            start = np.flatnonzero(np.concatenate([[True], v[1:] >> U(1) != v[:-1] >> U(1)]))
            size = np.diff(np.append(start, len(v)))
            is_open = (v & U(1)).astype(bool)
            rows = np.flatnonzero(np.repeat((ids[start] != ids[start + size - 1]) & np.maximum.reduceat(is_open, start), size))
            v = v >> U(1)
        else:
            ids, v, is_open, start, size = groups(table)
            rows = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(start) else start
            c = np.full(len(ids), -1, np.int32)
        return pa.table({"id": pa.array(ids[rows], pa.int64()), "key": pa.array(v[rows].view(np.int64), pa.int64()), "c": pa.array(c[rows], pa.int32()), "open": pa.array(is_open[rows], pa.bool_())})

    def with_first(table: pa.Table) -> pa.Table:
        """a, b: runs with their first document; or a, bad: lonely places of a document."""
        if table.column("part")[0].as_py() >= parts:
            ids, c, v = columns(table, np.int64, np.uint32, np.uint32)
            order = np.argsort(v, kind="stable")
            new = np.concatenate([[True], np.diff(v[order]) != 0, [True]])
            alone = order[new[1:] & new[:-1]]
            alone = alone[np.argsort(ids[alone], kind="stable")]
            ids, c = ids[alone], c[alone].astype(np.int32)
            start = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), np.diff(ids) != 0]))
            bad = pa.ListArray.from_arrays(pa.array(np.append(start, len(ids)), pa.int32()), pa.array(c, pa.int32()))
            return pa.table({"a": pa.array(ids[start], pa.int64()), "b": pa.nulls(len(start), pa.int64()), "bad": bad})
        ids, _, is_open, start, size = groups(table)
        rows = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(start) else start
        hub, hub_open = np.repeat(ids[start], size), np.repeat(is_open[start], size)
        alone = np.repeat(np.add.reduceat(is_open[rows].astype(np.int64), np.cumsum(size) - size) == 1, size) if len(start) else np.zeros(0, bool)
        second = np.concatenate([[0], rows[:-1]]) == np.repeat(start, size) if len(start) else np.zeros(0, bool)
        # an open first document that is open alone needs one partner
        keep = (ids[rows] != hub) & (is_open[rows] | (hub_open & alone & second))
        pairs = np.unique(np.stack([hub[keep], ids[rows][keep]], 1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64()), "bad": pa.nulls(len(pairs), pa.list_(pa.int32()))})

    def where_likely(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            got = []
            for i, bad, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                key, c, is_open = (np.asarray(own.values.field(k)) for k in range(3))
                ok = likely(np.sort(np.asarray(bad.values)).astype(np.int64), c)
                got.append((np.full(ok.sum(), i), key[ok], is_open[ok]))
            if got:
                cols = [np.concatenate([g[k] for g in got]) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["id", "key", "open"])

    blob = "part int, blob binary"
    keys = written(docs.mapInArrow(places, blob).groupBy("part").applyInArrow(shared, "id long, key long, c int, open boolean"), "places")
    asked = keys.groupBy("id").agg(F.collect_set(F.when(F.col("c") < 0, F.col("key"))).alias("keys"), F.max(F.col("c") >= 0).alias("asked"))
    some = docs.join(asked, "id")
    found = written(some.mapInArrow(open_runs, blob).groupBy("part").applyInArrow(with_first, "a long, b long, bad array<int>"), "missing")
    runs = found.filter("b is not null").select("a", "b").distinct()
    bad = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.flatten(F.collect_list("bad")).alias("bad"))
    own = keys.filter("c >= 0").groupBy("id").agg(F.collect_list(F.struct("key", "c", F.col("open"))).alias("own"))
    near = written(bad.join(own, "id").mapInArrow(where_likely, "id long, key long, open boolean"), "seeds")
    runs = written(runs, "runs")
    discard(keys, found)
    return runs, near


def seed_pairs(seeds: DataFrame) -> DataFrame:
    """a < b: all documents that have a seed in common that is open in one of them."""
    seeds = seeds.groupBy("key", "id").agg(F.max("open").alias("open"))
    pairs = seeds.filter("open").select("key", F.col("id").alias("x")).join(seeds.select("key", "id"), "key").filter("x <> id")
    return pairs.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()


def hub_pairs(entries: DataFrame, hub: str) -> DataFrame:
    """a < b: entries and the hub of their key (first or last) with overlapping windows of ENOUGH functions in both texts."""
    e = entries.filter(F.col("id") != F.col(hub)).groupBy(F.col(hub).alias("a"), F.col("id").alias("b"))
    e = e.agg(F.bit_or(F.expr("shiftleft(1, f)")).alias("fs"), F.collect_list(F.struct("f", "l", "r", F.col(f"{hub}_l").alias("x"), F.col(f"{hub}_r").alias("y"))).alias("w"))
    e = e.filter(F.bit_count("fs") >= ENOUGH)

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            w = batch.column(2)
            offs = np.asarray(w.offsets)
            f, left, right, x, y = (np.asarray(w.values.field(i)) for i in range(5))
            keep = np.array([overlapping(*(v[s:t] for v in (f, left, right, x, y))) for s, t in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], bool)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in range(2)], names=["a", "b"])

    pairs = e.select("a", "b", "w").mapInArrow(rows, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_windows(entries: DataFrame, found: DataFrame) -> DataFrame:
    """The windows whose c no passage of their document holds."""
    inside = F.expr("exists(spans, x -> x.s <= c and c < x.e)")
    return entries.join(spans_of(found), "id", "left").filter(F.coalesce(~inside, F.lit(True))).select(*entries.columns)


def promising(k: np.ndarray, i: np.ndarray, here: np.ndarray, count: np.ndarray, there: np.ndarray, is_open: np.ndarray, n: int) -> np.ndarray:
    """Which of n partners may share a similar part with a document that is open somewhere in either. A hit: partner, no. of
    the document's shingle, its first place, how often it is there, place in the partner, open or not.

    The condition is that of similar_parts, on the hits in the document's order. Where a shingle that hits is repeated, so
    that its place isn't known, only the number of hits is asked for."""
    enough = LEAST * 3 // 4
    out = np.zeros(n, bool)
    some = np.flatnonzero((np.bincount(k, count[i], n) >= enough)[k])
    if not len(some):
        return out
    some = some[np.lexsort((here[i[some]], k[some]))]
    k, i, there, is_open = (x[some] for x in (k, i, there, is_open))
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
    many = np.bincount(k[new], count[i[new]], n) >= enough
    looped = np.zeros(n, bool)
    looped[k[~new | (count[i] > 1)]] = True
    out[looped & many] = True
    some = np.flatnonzero((many & ~looped)[k])
    if not len(some):
        return out
    k, there, is_open, at = k[some], there[some], is_open[some], here[i[some]]
    # a part from hit s to t is similar if 7 for each hit make up for 3 for each place of both texts
    step = np.zeros(len(k), np.int64)
    step[1:] = np.where(k[1:] == k[:-1], 7 - 3 * np.diff(at) - 3 * np.abs(np.diff(there)), 0)
    score = np.cumsum(step) - k * (2 * int(np.abs(step).sum()) + 8)  # each partner's scores lie above those of the next
    best = np.maximum.accumulate(score[::-1])[::-1]
    end = np.searchsorted(-best, -(score - 1), "right") - 1
    total = np.concatenate([[0], np.cumsum(is_open)])
    out[k[(at[end] - at >= LEAST - 1) & (total[end + 1] > total[: len(end)])]] = True
    return out


def cell_passages(pairs: pa.Table, docs: pa.Table) -> pa.Table:
    """FOUND: the passages of the pairs (a, b) that lie in none of docs (id, text, s, e) yet."""
    spans = [list(zip(s or (), e or (), strict=True)) for s, e in zip(docs["s"].to_pylist(), docs["e"].to_pylist(), strict=True)]
    got = []
    for a, b, buf, starts in W.chunks(docs["text"]):
        s, e, bounds = W.word_spans(buf, starts)
        h, first = W.shingles(W.word_hashes(buf, s, e), bounds)
        got.append((h, np.diff(first), held(first, spans[a:b])))
    if not got or not len(pairs):
        return passage_table([])
    h, size, closed = (np.concatenate([g[i] for g in got]) for i in range(3))
    first = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(size)), size)
    # shingles of several documents, numbered
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0])[: len(h)])
    n = np.diff(np.append(start, len(h)))
    mixed = np.repeat(doc[order[start]] != doc[order[start + n - 1]], n)
    code = np.empty(len(h), np.int64)
    code[order] = np.where(mixed, np.repeat(np.arange(len(start)), n), -1)
    at = np.flatnonzero(code >= 0)
    code, place, edge = code[at], at - first[doc[at]], np.searchsorted(at, first)
    where = np.full(len(start), -1)
    rows: dict[int, list[int]] = {}
    for r, i in enumerate(docs["id"].to_pylist()):
        rows.setdefault(i, []).append(r)
    a, b = np.asarray(pairs["a"]), np.asarray(pairs["b"])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    out = []
    for own in np.split(np.arange(len(a)), np.flatnonzero(a[1:] != a[:-1]) + 1):
        one = int(a[own[0]])
        others = [(i, r) for i in b[own].tolist() for r in rows.get(i, ())]
        for x in rows.get(one, ()):
            p, mine = h[first[x] : first[x + 1]], closed[first[x] : first[x + 1]]
            values, here, count = np.unique(code[edge[x] : edge[x + 1]], return_index=True, return_counts=True)
            here = place[edge[x] : edge[x + 1]][here]
            where[values] = np.arange(len(values))
            for t in range(0, len(others), AT_ONCE):
                some = others[t : t + AT_ONCE]
                shared = np.concatenate([np.arange(edge[r], edge[r + 1]) for _, r in some])
                k = np.repeat(np.arange(len(some)), [edge[r + 1] - edge[r] for _, r in some])
                i = where[code[shared]]
                hit = np.flatnonzero(i >= 0)
                k, i, shared = k[hit], i[hit], shared[hit]
                is_open = ~mine[here[i]] | ~closed[at[shared]]
                for y in np.flatnonzero(promising(k, i, here, count, place[shared], is_open, len(some))).tolist():
                    two, r = some[y]
                    theirs = closed[first[r] : first[r + 1]]
                    if mine.all() and theirs.all():
                        continue
                    new = common_passages(p, h[first[r] : first[r + 1]])
                    if any(not mine[s:e].all() or not theirs[u:v].all() for s, e, u, v, _ in new):
                        for s, e, u, v, sim in new:
                            mine[s:e] = theirs[u:v] = True
                            out.append((one, two, s, e + W.SHINGLE - 1, u, v + W.SHINGLE - 1, sim))
            where[values] = -1
    return passage_table(out)


def near_pairs(pairs: DataFrame, texts: DataFrame, spans: DataFrame) -> DataFrame:
    """FOUND: the passages with places open so far that the pairs (a, b) share, block of documents by block."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = written(with_spans(texts.join(ids, "id", "left_semi"), spans), "texts")
    n, size = own.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // BLOCK), -(-(size or 0) // BLOCK_BYTES))

    def block(x: str):
        return F.pmod(F.xxhash64(x), F.lit(blocks))

    dealt = pairs.withColumn("cell", F.least(block("a"), block("b")) * blocks + F.greatest(block("a"), block("b")))
    dealt = written(dealt, "cells")
    docs = dealt.select(F.col("cell").alias("block"), F.explode(F.array("a", "b")).alias("id")).distinct().join(own, "id")

    found = dealt.groupBy("cell").cogroup(docs.groupBy("block")).applyInArrow(cell_passages, FOUND)
    found = written(found, "near")
    discard(own, dealt)
    return found


def overlapping(f, left, right, x, y) -> bool:
    """Windows of ENOUGH (two) different functions overlap by LEAST shingles in both texts."""
    order = np.argsort(left, kind="stable")
    f, left, right, x, y = (v[order] for v in (f, left, right, x, y))
    for step in range(1, len(f)):
        near = left[step:] + LEAST - 1 <= right[:-step]
        if not near.any() and step > HASHES:
            return False
        both = near & (f[step:] != f[:-step]) & (np.minimum(right[step:], right[:-step]) - left[step:] + 1 >= LEAST)
        both &= np.minimum(y[step:], y[:-step]) - np.maximum(x[step:], x[:-step]) + 1 >= LEAST
        if both.any():
            return True
    return False


def run_hashes(h: np.ndarray, width: int = LEAST) -> np.ndarray:
    """A hash of each run of `width` shingles."""
    if len(h) < width:
        return np.zeros(0, U)
    power, inverse = W.powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * power[: len(h)], out=sums[1:])
    return W.mix((sums[width:] - sums[:-width]) * inverse[: len(h) - width + 1])


def common_passages(p: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start, end, Jaccard) in shingles, ends exclusive, of the passages that the sequences share."""
    if not len(p) or not len(q):
        return []
    out = []
    r, u = run_hashes(p), run_hashes(q)
    if len(r) and len(u):
        # verbatim: runs of LEAST shingles that the other text has, too, wherever it repeats itself
        values, where = np.unique(u, return_index=True)
        at = np.minimum(np.searchsorted(values, r), len(values) - 1)
        hit = np.flatnonzero(values[at] == r)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(hit) != 1) + 1, [len(hit)]])
        for s, t in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if t > s:
                there = where[at[hit[s:t]]]
                out.append((int(hit[s]), int(hit[t - 1]) + LEAST, int(there.min()), int(there.max()) + LEAST, 1.0))
        if len(hit) and len(values) < len(u):
            # those of the other text that stand for its first ones so far
            known, first = np.unique(r, return_index=True)
            at = np.minimum(np.searchsorted(known, u), len(known) - 1)
            hit = np.flatnonzero(known[at] == u)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(hit) != 1) + 1, [len(hit)]])
            for s, t in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                c, d, there = int(hit[s]), int(hit[t - 1]) + LEAST, first[at[hit[s:t]]]
                if not any(o[2] <= c and d <= o[3] for o in out):
                    out.append((int(there.min()), int(there.max()) + LEAST, c, d, 1.0))
    if any(o[0] == 0 and o[1] == len(p) for o in out):
        return out
    values, where = np.unique(q, return_index=True)
    at = np.minimum(np.searchsorted(values, p), len(values) - 1)
    hit = np.flatnonzero(values[at] == p)
    if len(hit) < LEAST * 3 // 4 or any(o[0] <= hit[0] and hit[-1] < o[1] for o in out):
        return out
    other = nearest(values, q, p, hit, where[at[hit]])
    diag = other - hit
    edge = np.concatenate([[0], np.flatnonzero((np.diff(hit) > GAP) | (np.abs(np.diff(diag)) > SHIFT)) + 1, [len(hit)]])
    for s, t in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        a, b = int(hit[s]), int(hit[t - 1]) + 1
        if b - a < LEAST or any(o[0] <= a and b <= o[1] for o in out):
            continue
        out += [x for x in similar_parts(p, q, hit[s:t], other[s:t]) if not any(o[0] <= x[0] and x[1] <= o[1] for o in out)]
    return out


def nearest(values: np.ndarray, q: np.ndarray, p: np.ndarray, hit: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The place in q of each hit: of several, the one nearest to the alignment of the hit before (at first, of the next
    that has one place)."""
    if len(values) == len(q):
        return where
    order = np.argsort(q, kind="stable")
    lo, hi = (np.searchsorted(q[order], p[hit], side) for side in ("left", "right"))
    single = np.flatnonzero(hi - lo == 1)
    diag = int((where - hit)[single[0]]) if len(single) else int(where[0] - hit[0])
    out, order = where.tolist(), order.tolist()
    for k, (h, x, y) in enumerate(zip(hit.tolist(), lo.tolist(), hi.tolist(), strict=True)):
        if y - x > 1:
            # the places of a shingle stand in order; the earlier one of two as near
            i = bisect_left(order, h + diag, x, y)
            out[k] = order[i] if i == x or i < y and order[i] - h - diag < h + diag - order[i - 1] else order[i - 1]
        diag = out[k] - h
    return np.array(out, np.int64)


def similar_parts(p: np.ndarray, q: np.ndarray, hit: np.ndarray, other: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """The aligned stretch if it is similar, else as few of its maximal similar parts as cover all of them."""

    def exact(i: int, j: int):
        a, b, c, d = int(hit[i]), int(hit[j]) + 1, int(other[i : j + 1].min()), int(other[i : j + 1].max()) + 1
        if b - a < LEAST or d - c < LEAST:
            return None
        x, y = np.unique(p[a:b]), np.unique(q[c:d])
        same = len(np.intersect1d(x, y, assume_unique=True))
        union = len(x) + len(y) - same
        return (a, b, c, d, same / union) if same * SIMILAR[1] >= union * SIMILAR[0] else None

    if whole := exact(0, len(hit) - 1):
        return [whole]
    # a part from hit i to j is similar if 7 for each hit make up for 3 for each place of both texts: a sum over steps
    score = 7 * np.arange(len(hit)) - 3 * (hit - hit[0]) - 3 * np.concatenate([[0], np.cumsum(np.abs(np.diff(other)))])
    best = np.maximum.accumulate(score[::-1])[::-1]
    end = np.searchsorted(-best, -(score - 1), "right") - 1
    new = np.ones(len(end), bool)
    new[1:] = end[1:] > np.maximum.accumulate(end)[:-1]
    parts = [x for i in np.flatnonzero(new & (hit[end] - hit >= LEAST - 1)).tolist() if (x := exact(i, int(end[i])))]
    out, k = [], 0
    while k < len(parts):
        # of the parts that begin in what is covered, the one that ends last
        upto = out[-1][1] if out else -1
        j = k
        while j + 1 < len(parts) and parts[j + 1][0] <= upto:
            j += 1
        out.append(parts[j])
        k = j + 1
    return out


FOUND = "a long, b long, a_start int, a_end int, b_start int, b_end int, similarity double"


def passage_table(rows: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64()]
    return pa.table({name.split()[0]: pa.array([r[k] for r in rows], t) for k, (name, t) in enumerate(zip(FOUND.split(", "), types, strict=True))})


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The passages that the texts of pairs (a, b) share, in words, ends exclusive. texts: (id, text)."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = written(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi"), "texts")
    discard(ids)
    both = pairs.join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def rows(batches: Iterator[pa.RecordBatch]):
        last, p = None, np.zeros(0, U)
        for batch in batches:
            out = []
            ids = batch.column(0).to_pylist()
            # each text of a is hashed once, the last one of the batch before is kept
            new = [i for i, a in enumerate(ids) if a != (ids[i - 1] if i else last)]
            firsts = iter(sequences(batch.column(2).take(pa.array(new, pa.int64()))))
            for a, b, q in zip(ids, batch.column(1).to_pylist(), sequences(batch.column(3)), strict=True):
                if a != last:
                    last, p = a, next(firsts)
                for x, y, c, d, sim in common_passages(p, q):
                    out.append((a, b, x, y + W.SHINGLE - 1, c, d + W.SHINGLE - 1, sim))
            yield from passage_table(out).to_batches()

    found = written(both.select("a", "b", "text_a", "text_b").mapInArrow(rows, FOUND), "passages")
    discard(own)
    return found


def sequences(texts: pa.Array) -> list[np.ndarray]:
    """The shingles of each text."""
    out = []
    for _, _, buf, starts in W.chunks(texts):
        s, e, bounds = W.word_spans(buf, starts)
        h, first = W.shingles(W.word_hashes(buf, s, e), bounds)
        out += np.split(h, first[1:-1])
    return out


def sequence(text: pa.Array) -> np.ndarray:
    return sequences(text)[0]


def passage_pairs(docs: DataFrame) -> DataFrame:
    """FOUND: verified passages between documents a and b (b shares them with its hub a)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, int(size / 6 / LEAST * 2 * HASHES) // PART_ENTRIES)
    shared = written(shared_windows(windows(texts, parts)), "shared-windows")
    tried = written(hub_pairs(shared, "first"), "pairs")
    found = verify(tried, texts)
    pairs = written(hub_pairs(open_windows(shared, found), "last").join(tried, ["a", "b"], "left_anti"), "pairs")
    discard(shared)
    release(docs.sparkSession)
    found, tried = found.unionByName(verify(pairs, texts)), tried.unionByName(pairs)
    spans = written(spans_of(found), "spans")
    runs, likely_seeds = missing_pairs(texts, spans, parts)
    pairs = written(runs.join(tried, ["a", "b"], "left_anti"), "pairs")
    found, tried = found.unionByName(verify(pairs, texts)), tried.unionByName(pairs)
    release(docs.sparkSession)
    pairs = written(seed_pairs(likely_seeds).join(tried, ["a", "b"], "left_anti"), "pairs")
    near = near_pairs(pairs, texts, spans)
    discard(spans, likely_seeds)
    return found.unionByName(near)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, other_id, start, end, other_start, other_end (words), similarity: passages of each document that another
    one repeats. Each document stands with the hubs it was verified against, a hub with its first partner."""
    f = written(passage_pairs(docs), "passages")
    mine = f.select(F.col("b").alias("doc_id"), F.col("a").alias("other_id"), F.col("b_start").alias("start"), F.col("b_end").alias("end"), F.col("a_start").alias("other_start"), F.col("a_end").alias("other_end"), "similarity")
    hub = f.groupBy(F.col("a").alias("doc_id"), F.col("a_start").alias("start"), F.col("a_end").alias("end")).agg(F.min(F.struct("b", "b_start", "b_end", "similarity")).alias("x"))
    hub = hub.select("doc_id", F.col("x.b").alias("other_id"), "start", "end", F.col("x.b_start").alias("other_start"), F.col("x.b_end").alias("other_end"), F.col("x.similarity").alias("similarity"))
    return mine.unionByName(hub)
