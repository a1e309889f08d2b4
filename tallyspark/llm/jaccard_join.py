"""Exact Jaccard join of shingle sets by universe partition and pigeonhole.

Two sets link when 100 * intersection >= 75 * union, that is when their symmetric difference has at most
(|r| + |s|) / 7 elements. Sets are put into size bands. Each band splits the universe of shingles into m segments by
hash, m one more than the largest difference any link into the band may have. A set's part in a segment is its segment
subset. If a set gives each segment a threshold 0, 1 or 2 with a sum above its largest difference H, then a partner
agrees in some segment of threshold 1, or differs there by one element at most in one of threshold 2.

Costs decide the thresholds: subsets with rare shingles first; empty subsets, and those with only common shingles
(counted over all texts), last. Where such costly ones would be needed, segments with one-deletion neighbourhoods in
the index go from 1 to 2 instead. As m > H, thresholds can always be met, so no link is lost. A set is indexed in its
own band; it probes that band and the lower bands whose sizes can link. A small set that would still need costly
segments, but has fewer common shingles than any overlap that links, must share a rare one: it probes by the first
quarter of its rare shingles in hash order (a prefix of both sides that must meet), which small sets also index.

Signatures go to parts by hash, packed as bytes, and meet in their part. Short lists give all their pairs, long ones a
star and a note of the list. Pairs must pass their sizes and bitmaps of the sets (below) before any text is read, then
they are verified on the whole texts' shingle sets. Lists that still hold several components afterwards give their other
pairs across components, in blocks of bounded size, which are verified too: so components are exact, while a group of
thousands of near copies costs about one comparison a copy.

Sets and shingles are compared by 64-bit hashes (a set by two and its size).

Defined cases: null, empty and blank texts have no shingles and link with nothing; equal sets (copies) are one class
with its least doc_id; rows that repeat a doc_id fall into the classes of their texts and may join two components;
a null doc_id is never the id of a component unless nothing else is there; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import words as W
from tallyspark.operators.components import connected_components, forest
from tallyspark.session import discard, release, written

U = np.uint64
#: a shingle is common when at least one in so many sets has it
COMMON_ONE_IN = 1000
COMMON_LEAST = 32
#: signatures of a part, about
PART_ENTRIES = 1_500_000
#: lists up to this length give all their pairs at once
SHORT_LIST = 8
#: shingles kept in a task's cache while it verifies pairs
CACHE = 4_000_000
#: pairs a document from which one pair each is verified first, then those that are still across components
FIRST_ONE = 4
#: shingles that a task counts before it passes the frequent ones on
COUNT_SHINGLES = 3_000_000
#: documents whose signatures are packed together
BATCH_DOCS = 3000
#: members of a block of a long list, and rows of blocks that a task compares
BLOCK, BLOCK_ROWS = 1000, 20_000
#: ids that may be broadcast to pick the texts to verify
BROADCAST_IDS = 500_000

#: sets up to this size may probe by rare shingles; their partners are up to 4/3 as large
SMALL = 256

D, FOREIGN, SIG_BITS = 1, 8, 28  # flags of an entry: a deletion, thresholds in bits 1-2, a probe from a higher band
#: steps of a doubling of the size in the low bits of a set's id, and by how many of them sets that link may differ
SIZE_BITS, SIZE_STEPS = 16, 2048
REACH = int(SIZE_STEPS * np.log2(4 / 3)) + 2


def bands(top: int) -> np.ndarray:
    """Rows (low, high, segments, segments with deletions) of the size bands up to size top."""
    out, low = [], 1
    while low <= top:
        high = max(low, low * 4 // 3)
        m = (high + high * 4 // 3) // 7 + 1
        out.append((low, high, m, m if m <= 16 else max(16, m // 12)))
        low = high + 1
    return np.array(out, np.int64).reshape(-1, 4)


def linked(common: int, a: int, b: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


SETS = "doc_id long, n_shingles long, lo long, hi long, common array<long>, common_n array<long>, bits binary"


def set_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set, its size in the low bits (on a scale of logarithms, so that sizes that can't link show)."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(W.mix(h ^ U(0x5851F42D4C957F2D)))])
    size = (np.log2(np.maximum(np.diff(first), 1)) * SIZE_STEPS).astype(U)
    return ((sums[first[1:]] - sums[first[:-1]]) >> U(SIZE_BITS) << U(SIZE_BITS) | size).view(np.int64)


def bitmaps(h: np.ndarray, first: np.ndarray) -> pa.Array:
    """A bitmap of 2 to 4 bits a shingle (a power of two, 64 at least) of each set. Bit i is the parity of its shingles
    that hash to i, so those of sets that link differ in at most (|r| + |s|) / 7 bits; a larger one folds to a smaller."""
    n = np.diff(first)
    size = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(size)])
    own = np.repeat(np.arange(len(n)), n)
    bit = start[own] + (W.mix(h + U(7)) & (size[own] - 1).astype(U)).astype(np.int64)
    data = np.packbits((np.bincount(bit, minlength=start[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((start // 8).astype(np.int32)), pa.py_buffer(data)])


def as_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of bitmaps, the first of each, and how many it has."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    words = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(U)
    offs = (offs - offs[0]) // 8
    return words, offs[:-1], np.diff(offs)


def apart(words: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps i and j differ, the larger one folded to the size of the smaller; -1 if in more than
    `most`. A quarter of them is compared first, which tells most unrelated sets apart."""
    swap = size[i] > size[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    out = np.full(len(i), -1, np.int64)
    kinds, kind = np.unique(size[i] << 32 | size[j], return_inverse=True)
    for k, x in enumerate(kinds.tolist()):
        m, n = x >> 32, x & 0xFFFFFFFF

        def differ(r, width, m=m, n=n):
            a = words[start[i[r]][:, None] + np.arange(width)]
            b = words[start[j[r]][:, None, None] + (np.arange(n // m)[:, None] * m + np.arange(width))]
            return np.bitwise_count(a ^ np.bitwise_xor.reduce(b, 1)).sum(1, dtype=np.int64)

        rows = np.flatnonzero(kind == k)
        step = max(1, (1 << 19) // n)
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            if m >= 8:
                r = r[differ(r, m // 4) <= most[r]]
            d = differ(r, m)
            out[r] = np.where(d <= most[r], d, -1)
    return out


def spanning(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The edges a - b of a minimum spanning forest: each tree takes its cheapest edge to another, again and again."""
    order = np.argsort(cost, kind="stable")
    nodes, at = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label, kept = np.arange(len(nodes)), []
    while len(live := np.flatnonzero(label[x] != label[y])):
        ends = np.concatenate([label[x[live]], label[y[live]]])
        tree, first = np.unique(ends[np.argsort(np.tile(np.arange(len(live)), 2), kind="stable")], return_index=True)
        chosen = np.unique(live[first // 2])
        kept.append(chosen)
        node, root = forest(label[x[chosen]], label[y[chosen]])
        to = np.arange(len(nodes))
        to[node] = root
        label = to[label]
    return order[np.concatenate(kept)] if kept else np.zeros(0, np.int64)


def summarise(docs: DataFrame) -> DataFrame:
    """A row per document with the size, the hash and the bitmap of its set, and per batch the shingles that many of its
    sets have."""

    def rows(batches: Iterator[pa.RecordBatch]):
        held, seen, tokens, count = None, set(), [], 0
        for batch in batches:
            if held is not None:
                full = count >= COUNT_SHINGLES
                yield _summary(*held, *(often(tokens, len(seen)) if full else NOTHING))
                if full:
                    seen, tokens, count = set(), [], 0
            got = [[] for _ in range(4)]
            for _, _, h, first in W.shingle_sets(batch.column(1)):
                n, lo = np.diff(first), set_ids(h, first)
                sums = np.concatenate([np.zeros(1, U), np.cumsum(W.mix(h ^ U(0x14057B7EF767814F)))])
                for x, y in zip(got, (n, lo, (sums[first[1:]] - sums[first[:-1]]).view(np.int64), bitmaps(h, first)), strict=True):
                    x.append(y)
                # copies count once
                new = np.array([x not in seen and not seen.add(x) for x in lo.tolist()], bool)
                tokens.append(h[np.repeat(new, n)])
                count += len(tokens[-1])
            held = (batch.column(0), *(np.concatenate(x) for x in got[:3]), pa.concat_arrays(got[3])) if got[0] else None
        if held is not None:
            yield _summary(*held, *often(tokens, len(seen)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, SETS)


NOTHING = (np.zeros(0, U), np.zeros(0, np.int64))


def often(tokens: list[np.ndarray], sets: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that many of these sets have, and in how many."""
    token, n = np.unique(np.concatenate(tokens) if tokens else NOTHING[0], return_counts=True)
    many = n >= max(4, sets // (2 * COMMON_ONE_IN))
    return token[many], n[many]


def _summary(ids: pa.Array, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: pa.Array, token: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A batch of SETS; the counts go with its last row."""
    none = len(lo) - 1
    cols = [ids, pa.array(size), pa.array(lo), pa.array(hi), _at_end(token.view(np.int64), none), _at_end(n, none), bits]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SETS.split(", ")])


def _at_end(values: np.ndarray, before: int) -> pa.Array:
    offsets = np.zeros(before + 2, np.int32)
    offsets[-1] = len(values)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def entries(h: np.ndarray, first: np.ndarray, table: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, signature, flags) of all index and probe entries of the sets of a chunk."""
    size = np.diff(first)
    own = np.searchsorted(table[:, 0], size, "right") - 1
    is_common = np.isin(h, common) if len(common) else np.zeros(len(h), bool)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    often = np.bincount(np.repeat(np.arange(len(size)), size)[is_common], minlength=len(size))
    small = (size <= SMALL) & (-(-3 * size // 4) > often)
    by_prefix = np.zeros(len(size), bool)
    for down in range(len(table)):
        band = own - down
        # a lower band is probed if its largest sets can link
        docs = np.flatnonzero((size > 0) & (band >= 0) & (4 * table[np.maximum(band, 0), 1] >= 3 * size if down else True))
        if not len(docs):
            break
        out.append(_entries(h, first, is_common, docs, band[docs], table, down > 0, small, by_prefix))
    t = np.flatnonzero(~is_common & np.repeat((size <= SMALL * 4 // 3), size))
    if len(t):
        doc = np.searchsorted(first, t, "right") - 1
        rank = np.arange(len(t)) - np.searchsorted(doc, doc)
        t, doc = t[rank <= size[doc] // 4], doc[rank <= size[doc] // 4]
        out.append((doc, W.mix(h[t] ^ U(0xE7037ED1A0B428DB)), by_prefix[doc].astype(np.uint32) << np.uint32(1)))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.uint32))


def _entries(h, first, is_common, docs, band, table, foreign, small, by_prefix):
    m, dele, high = table[band, 2], table[band, 3], table[band, 1]
    size = first[docs + 1] - first[docs]
    need = (size + (np.minimum(high, size) if foreign else high)) // 7 + 1  # thresholds must sum to this
    if not foreign:  # the partner is in this band or, as a prober, allots its own thresholds
        need = np.minimum(need, m)
    base = np.concatenate([[0], np.cumsum(m)])
    token = _ranges(first[docs], size)
    th, tg = h[token], np.repeat(np.arange(len(docs)), size)
    seg = (W.mix(th + U(1)) % m[tg].astype(U)).astype(np.int64)
    slot = base[tg] + seg
    q = np.bincount(slot, minlength=base[-1])
    rare = np.bincount(slot[~is_common[token]], minlength=base[-1])
    content = np.zeros(base[-1], U)
    tm = W.mix(th ^ U(0xA0761D6478BD642F))
    np.add.at(content, slot, tm)
    group = np.repeat(np.arange(len(docs)), m)
    number = np.arange(base[-1]) - base[group]
    # cheap segments first
    worth = np.where(rare > 0, 16 + np.minimum(rare, 15), np.minimum(q, 15))
    order = np.argsort(group * 64 + (63 - worth), kind="stable")
    rank = np.empty(base[-1], np.int64)
    rank[order] = np.arange(base[-1]) - base[group]
    chosen = rank < need[group]
    costly = np.bincount(group[chosen & (rare == 0)], minlength=len(docs))
    up = chosen & (rare >= 2) & (number < dele[group])
    upno = np.cumsum(up) - 1
    upno -= np.concatenate([[0], np.cumsum(np.bincount(group[up], minlength=len(docs)))])[group]
    up &= upno < costly[group]
    ups = np.bincount(group[up], minlength=len(docs))
    # a set of common shingles alone still avoids empty subsets, which all others have too
    empty = np.bincount(group[chosen & (q == 0)], minlength=len(docs))
    more = chosen & ~up & (q >= 2) & (number < dele[group])
    no = np.cumsum(more) - 1
    no -= np.concatenate([[0], np.cumsum(np.bincount(group[more], minlength=len(docs)))])[group]
    more &= no < (empty - ups)[group]
    up |= more
    ups = np.bincount(group[up], minlength=len(docs))
    chosen &= rank < (need - ups)[group]
    dear = chosen & (rare == 0) & small[docs][group]
    by_prefix[docs[np.unique(group[dear])]] = True
    chosen &= ~dear
    level = chosen.astype(np.uint32) + (up & chosen)
    tag = W.mix((band.astype(U) << U(40))[group] + number.astype(U) + U(1))
    far = np.uint32(FOREIGN if foreign else 0)
    pick = np.flatnonzero(chosen) if foreign else np.arange(base[-1])
    parts = [(docs[group[pick]], W.mix(content[pick] ^ tag[pick]), (level[pick] << 1) | far)]
    # one-deletion neighbourhoods: in the index where a segment has them, as probes where the threshold is 2
    some = (seg < dele[tg]) & (level[slot] == 2 if foreign else (q[slot] >= 2))
    t = np.flatnonzero(some)
    if len(t):
        s = slot[t]
        parts.append((docs[tg[t]], W.mix((content[s] - tm[t]) ^ tag[s]), (level[s] << 1) * (level[s] == 2) | far | np.uint32(D)))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... n[i] of them, one after the other."""
    before = np.concatenate([[0], np.cumsum(n)])
    return np.arange(before[-1]) - np.repeat(before[:-1] - start, n)


def pack(part: np.ndarray, ids: np.ndarray, entry: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Per part the entries as bytes: the number of ids, the ids, the entries of each, the entries."""
    order = np.lexsort((ids, part))
    part, ids, entry = part[order], ids[order], entry[order]
    edges = np.searchsorted(part, np.arange(parts + 1))
    for p in range(parts):
        a, b = edges[p], edges[p + 1]
        if a < b:
            own = ids[a:b]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            n = np.diff(np.concatenate([start, [b - a]])).astype(np.uint32)
            yield p, np.uint32(len(start)).tobytes() + own[start].tobytes() + n.tobytes() + entry[a:b].tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = int(np.frombuffer(blob, np.uint32, 1)[0])
    ids, n = np.frombuffer(blob, np.int64, k, 4), np.frombuffer(blob, np.uint32, k, 4 + 8 * k)
    return np.repeat(ids, n), np.frombuffer(blob, np.uint32, offset=4 + 12 * k)


def signatures(docs: DataFrame, parts: int, top: int, common) -> DataFrame:
    """part, blob: the entries of all sets, by parts. A set's id is its hash."""

    def rows(batches: Iterator[pa.RecordBatch]):
        table, often = bands(top), common.value
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_DOCS):
                got, seen = [], set()
                for _, _, h, first in W.shingle_sets(whole.column(0).slice(at, BATCH_DOCS)):
                    lo = set_ids(h, first)
                    # copies in a batch are packed once
                    new = np.array([x not in seen and not seen.add(x) for x in lo.tolist()], bool)
                    n = np.where(new, np.diff(first), 0)
                    h = h[np.repeat(new, np.diff(first))]
                    d, sig, flag = entries(h, np.concatenate([[0], np.cumsum(n)]), table, often)
                    got.append(((sig >> U(SIG_BITS + 4)) % U(parts), lo[d], (sig & U((1 << SIG_BITS) - 1)).astype(np.uint32) << np.uint32(4) | flag.astype(np.uint32)))
                if got:
                    found = list(pack(*(np.concatenate([g[i] for g in got]) for i in range(3)), parts))
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["part", "blob"])

    return docs.select("text").mapInArrow(rows, "part int, blob binary")


def meet(ids: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Candidate pairs (a < b) of a part, and its long lists."""
    order = np.lexsort((ids, entry >> np.uint32(4)))
    ids, entry = ids[order], entry[order]
    sig, flag, size = entry >> np.uint32(4), entry & np.uint32(15), ids & ((1 << SIZE_BITS) - 1)
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([start, [len(sig)]]))
    level = (flag >> np.uint32(1)) & np.uint32(3)
    use = (n > 1) & (np.maximum.reduceat(level, start) > 0 if len(start) else True)
    pairs = []

    def keep(i, j):
        di, dj = flag[i] & np.uint32(D), flag[j] & np.uint32(D)
        li, lj = level[i], level[j]
        ok = np.where(di + dj == 0, np.maximum(li, lj) >= 1, (di + dj == 1) & (np.maximum(li, lj) == 2))
        ok &= (ids[i] != ids[j]) & ((flag[i] & flag[j] & np.uint32(FOREIGN)) == 0) & (np.abs(size[i] - size[j]) <= REACH)
        i, j = i[ok], j[ok]
        pairs.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1))

    few = np.flatnonzero(use & (n <= SHORT_LIST))
    for step in range(1, SHORT_LIST):
        for shift in range(SHORT_LIST - step):
            s = few[n[few] > shift + step]
            keep(start[s] + shift, start[s] + shift + step)
    lists = []
    for r in np.flatnonzero(use & (n > SHORT_LIST)):
        a, b = start[r], start[r] + n[r]
        own = np.unique(ids[a:b])
        if len(own) > 1:
            # a partner that only shares this list is found through a star of sets as large or, after that, the list
            own = own[np.argsort(own & ((1 << SIZE_BITS) - 1), kind="stable")]
            at, scale = 0, own & ((1 << SIZE_BITS) - 1)
            while at < len(own):
                end = int(np.searchsorted(scale, scale[at] + REACH, "right"))
                pairs.append(np.sort(np.stack([np.full(end - at - 1, own[at]), own[at + 1 : end]], 1), 1))
                at = end
            if len(own) > 2:
                lists.append(own)
    found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    return found[:, 0], found[:, 1], lists


def candidates(blobs: DataFrame) -> DataFrame:
    """a, b: candidate pairs of set ids; members: the ids of a long list (then a and b are null)."""

    def part(table: pa.Table) -> pa.Table:
        got = [unpack(b) for b in table.column("blob").to_pylist()]
        ids, entry = (np.concatenate([g[i] for g in got]) for i in range(2))
        a, b, lists = meet(ids, entry)
        once = {x.tobytes(): x for x in lists}
        pad = [None] * len(once)
        return pa.table(
            {
                "a": pa.concat_arrays([pa.array(a, pa.int64()), pa.array(pad, pa.int64())]),
                "b": pa.concat_arrays([pa.array(b, pa.int64()), pa.array(pad, pa.int64())]),
                "members": pa.array([None] * len(a) + list(once.values()), pa.list_(pa.int64())),
            }
        )

    return blobs.groupBy("part").applyInArrow(part, "a long, b long, members array<long>")


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a < b (doc_ids): the pairs of set ids whose sizes and bitmaps allow a link."""
    side = lambda x: classes.select(F.col("lo").alias(x), F.col("rep").alias("r" + x), F.col("n").alias("n" + x), F.col("bits").alias("bits_" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("ra <> rb and 4 * least(na, nb) >= 3 * greatest(na, nb)")

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sides = [as_words(batch.column(k)) for k in (3, 4)]
            words, size = (np.concatenate([x[k] for x in sides]) for k in (0, 2))
            start = np.concatenate([sides[0][1], sides[1][1] + len(sides[0][0])])
            at = np.arange(batch.num_rows)
            keep = pa.array(apart(words, start, size, at, at + batch.num_rows, np.asarray(batch.column(2)) // 7) >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(2)], names=["a", "b"])

    return both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), (F.col("na") + F.col("nb")).alias("n"), "bits_a", "bits_b").mapInArrow(rows, "a long, b long").distinct()


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole texts link."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    texts = written(texts, "texts")
    discard(ids)
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def rows(batches: Iterator[pa.RecordBatch]):
        cache: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            kept: list[tuple[int, int]] = []
            ids = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
            for i, pair in enumerate(zip(*ids, strict=True)):
                found = []
                for side, x in enumerate(pair):
                    if x not in cache:
                        if held > CACHE:
                            cache.clear()
                            held = 0
                        cache[x] = np.concatenate([h for _, _, h, _ in W.shingle_sets(batch.column(2 + side).slice(i, 1))] or [np.zeros(0, U)])
                        held += len(cache[x])
                    found.append(cache[x])
                r, s = found
                if len(r) and len(s) and 4 * min(len(r), len(s)) >= 3 * max(len(r), len(s)) and linked(len(np.intersect1d(r, s, assume_unique=True)), len(r), len(s)):
                    kept.append(pair)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in range(2)], names=["a", "b"])

    links = written(both.select("a", "b", "text_a", "text_b").mapInArrow(rows, "a long, b long"), "links")
    discard(texts)
    return links


def classes_of(sets: DataFrame) -> DataFrame:
    """One row per distinct non-empty set: n, lo, hi, its least doc_id (rep) and its bitmap."""
    return sets.filter("n_shingles > 0").groupBy(F.col("n_shingles").alias("n"), "lo", "hi").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"))


def common_shingles(sets: DataFrame, n_sets: int) -> np.ndarray:
    """The common shingles: at most COMMON_ONE_IN times the mean size of a set."""
    often = sets.filter("size(common) > 0").select(F.explode(F.arrays_zip("common", "common_n")).alias("x")).groupBy(F.col("x.common").alias("token")).agg(F.sum("x.common_n").alias("n"))
    return np.array(sorted(r.token for r in often.filter(F.col("n") >= max(COMMON_LEAST, n_sets // COMMON_ONE_IN)).select("token").collect()), np.int64).view(U)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (verified links that the method needed), for every row of docs."""
    spark = docs.sparkSession
    sets = written(summarise(docs), "sets")
    whole = written(classes_of(sets), "classes")
    n_sets, top, shingles = whole.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    top, shingles = top or 1, shingles or 0
    common = spark.sparkContext.broadcast(common_shingles(sets, n_sets))
    found = written(candidates(signatures(docs, max(8, int(shingles * 0.7) // PART_ENTRIES), top, common)), "candidates")
    release(spark)
    classes = whole.filter("rep is not null").select("lo", "rep", "n", "bits")
    pairs = written(near(found.filter("a is not null").select("a", "b").distinct(), classes), "pairs")
    links, comp = settle(pairs, docs, None, None)
    discard(pairs)
    rows = written(mixed_lists(found, classes, comp), "mixed-lists")
    discard(found)
    links, comp = settle_lists(rows, classes, docs, links, comp)
    discard(rows)
    release(spark)

    n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    own = whole.select("n", "lo", "hi", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(n, "rep", "left")
    own = written(own.select(F.col("n").alias("n_shingles"), "lo", "hi", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "class-components")
    discard(whole, links)
    out = sets.select("doc_id", "n_shingles", "lo", "hi")
    some = out.filter("n_shingles > 0").join(own, ["n_shingles", "lo", "hi"], "left")
    none = out.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("n_links", F.lit(0).cast("long"))
    cols = ["doc_id", "n_shingles", "component_id", "n_links"]
    return some.select(*cols).unionByName(none.select(*cols))


def settle(pairs: DataFrame, docs: DataFrame, links: DataFrame | None, comp: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """links with those of pairs, and the components of all. Of many pairs a document, first one of each is verified,
    then those that are still across components."""
    n, docs_n = pairs.agg(F.count(F.lit(1)), F.count_distinct("b")).first()
    if n <= FIRST_ONE * docs_n:
        return linked_with(verify(pairs, docs), links, comp)
    first = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-pairs")
    links, comp = linked_with(verify(first, docs), links, comp)
    rest = written(across(pairs.join(first, ["a", "b"], "left_anti"), comp), "rest-pairs")
    links, comp = linked_with(verify(rest, docs), links, comp)
    discard(first, rest)
    return links, comp


def settle_lists(rows: DataFrame, classes: DataFrame, docs: DataFrame, links: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As settle(), for the blocks of long lists: first a spanning forest of the components that may link is verified,
    then the pairs of those blocks that are still across components."""
    got = written(across_lists(rows, classes, True), "list-forest")
    first = written(got.filter("g is null").select("a", "b").distinct(), "first-pairs")
    links, comp = linked_with(verify(first, docs), links, comp)
    some = rows.join(got.filter("g is not null").select("g").distinct(), "g", "left_semi")
    some = some.join(comp.toDF("component", "now"), "component", "left").withColumn("component", F.coalesce("now", "component"))
    again = written(some.select(*rows.columns), "open-lists")
    rest = written(across_lists(again, classes, False).filter("g is null").select("a", "b").distinct().join(first, ["a", "b"], "left_anti"), "rest-pairs")
    links, comp = linked_with(verify(rest, docs), links, comp)
    discard(got, first, again, rest)
    return links, comp


def linked_with(new: DataFrame, links: DataFrame | None, comp: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """links and the new ones, and the components with them."""
    edges = new if comp is None else new.unionByName(comp.toDF("b", "a"))
    now = written(connected_components(edges, "a", "b"), "components")
    both = new if links is None else written(links.unionByName(new), "links")
    if links is not None:
        discard(links, comp, new)
    return both, now


def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    df = pairs.join(comp.withColumnRenamed("node", "a").withColumnRenamed("component", "ca"), "a", "left").join(comp.withColumnRenamed("node", "b").withColumnRenamed("component", "cb"), "b", "left")
    return df.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def mixed_lists(found: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    """g, role, lo, component, outside: the members of the long lists that hold several components, in blocks g.

    Members outside of a list's largest component (role 0) meet all members (role 1), block by block, so a list of one
    large component and a few others costs its length. A list of one block has its members once (role 2).
    """
    lists = found.filter("members is not null").select(F.xxhash64("members").alias("list"), "members").dropDuplicates(["list"])
    own = classes.select("lo", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("lo", F.coalesce("component", "rep").alias("component"))
    m = lists.select("list", F.explode("members").alias("lo")).join(own, "lo")
    # the second key makes this join deal out both sides itself, so the rows of a very long list are split
    main = m.groupBy("list", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("list").agg(F.max(F.struct("k", "component")).alias("x"), F.sum("k").alias("all"))
    main = main.filter("x.k < all").select("list", F.xxhash64("list").alias("h"), F.col("x.component").alias("main"), F.ceil((F.col("all") - F.col("x.k")) / BLOCK).alias("outs"), F.ceil(F.col("all") / BLOCK).alias("alls"))
    m = m.withColumn("h", F.xxhash64("list")).join(main, ["list", "h"]).withColumn("outside", F.col("component") != F.col("main"))
    block = lambda n: F.pmod(F.xxhash64("lo"), F.col(n))
    cell = lambda o, a, role: F.struct(F.xxhash64("list", o, a).alias("g"), F.lit(role).alias("role"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    none = F.expr("cast(array() as array<struct<g:bigint,role:int>>)")
    split = F.concat(F.when(F.col("outside"), F.transform(upto("alls"), lambda a: cell(block("outs"), a, 0))).otherwise(none), F.transform(upto("outs"), lambda o: cell(o, block("alls"), 1)))
    cells = F.when(F.col("alls") == 1, F.array(cell(F.lit(0).cast("long"), F.lit(0).cast("long"), 2))).otherwise(split)
    return m.select(F.explode(cells).alias("c"), "lo", "component", "outside").select("c.g", "c.role", "lo", "component", "outside")


def across_lists(rows: DataFrame, classes: DataFrame, few: bool) -> DataFrame:
    """a < b (doc_ids), g: the pairs of members in different components whose sizes and bitmaps allow a link, or a
    spanning forest of those components; and a row for each block g that holds any such pair."""
    parts = max(8, rows.count() // BLOCK_ROWS)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("g").combine_chunks()
        g, role, component, outside, rep, n = (table.column(c).to_numpy() for c in ("g", "role", "component", "outside", "rep", "n"))
        bits = as_words(table.column("bits"))
        held, count, blocks = [], 0, [np.zeros(0, np.int64)]
        found = np.zeros((0, 5), np.int64)

        def keep():
            nonlocal held, count, found
            if count:
                i, j = (np.concatenate([x[k] for x in held]) for k in range(2))
                d = apart(*bits, i, j, (n[i] + n[j]) // 7)
                i, j, d = i[d >= 0], j[d >= 0], d[d >= 0]
                blocks.append(np.unique(g[i]))
                swap = rep[i] > rep[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                found = np.unique(np.concatenate([found, np.stack([rep[i], rep[j], component[i], component[j], d], 1)]), axis=0)
                if few:
                    found = found[spanning(found[:, 2], found[:, 3], found[:, 4])]
            held, count = [], 0

        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(g)], strict=True):
            mine = s + np.flatnonzero(outside[s:e] & (role[s:e] != 1))
            all_ = s + np.flatnonzero(role[s:e] != 0)
            for at in range(0, len(mine), 256):
                i = np.repeat(mine[at : at + 256], len(all_))
                j = np.tile(all_, len(mine[at : at + 256]))
                ok = (component[i] != component[j]) & (~outside[j] | (rep[i] < rep[j])) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j]))
                held.append((i[ok], j[ok]))
                count += len(held[-1][0])
                if count > 200_000:
                    keep()
        keep()
        own = np.unique(np.concatenate(blocks))
        pad = [[None] * len(own), [None] * len(found)]
        both = [pa.concat_arrays([pa.array(found[:, k], pa.int64()), pa.array(pad[0], pa.int64())]) for k in range(2)]
        return pa.table({"a": both[0], "b": both[1], "g": pa.concat_arrays([pa.array(pad[1], pa.int64()), pa.array(own, pa.int64())])})

    df = rows.join(classes, "lo").select(F.pmod("g", F.lit(parts)).alias("part"), "g", "role", "component", "outside", "rep", "n", "bits")
    return df.groupBy("part").applyInArrow(compare, "a long, b long, g long")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component; columns as they were.

    Rows that repeat a doc_id stay or go together (they stay if one of them is its component's least). A row without a
    doc_id can't stand for a group and can't be told from others, so it stays.
    """
    keep = join(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    keep = written(keep, "keep")
    few = keep.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    named = docs.join(F.broadcast(keep) if few else keep, docs.doc_id == keep._keep, "left_semi")
    return named.unionByName(docs.filter("doc_id is null"))
