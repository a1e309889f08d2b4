"""Which cell of one version of a table is which cell of the other, by support of rows and columns.

Cells whose text stands once in both versions anchor the rest. Anchors that cross each other (one above another here and
below it there, or in one row here and in two there) contradict each other and all go. What is left maps rows to rows and
columns to columns in order. Then the maps reinforce each other: a row without an anchor takes the counterpart for which
most of its cells have the same text in mapped columns, between the counterparts of its neighbours, if no other row has
as many votes on either side; columns likewise by mapped rows; until no line is added. Where two lines are as likely, neither
is taken and their cells are reported as ambiguous.

Spark brings the cells of both versions of a table together; tasks then match tables of CELLS cells or more at once, round by
round, so nothing is written or shuffled between rounds. Lines between the same counterparts with a text in
common meet pairwise, PAIRS at a time. Texts that many lines have on both sides make no pairs of lines: lines that have the
same of them count as one for their votes, which gives the same sums. So a table of any size is matched, in work that grows
with its cells unless its lines are told apart by combinations of frequent texts only; its cells must fit one task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: if set: tables of more cells (the mean of both versions) aren't matched but reported as too_large
MAX_CELLS: int | None = None
#: cells of whole tables that a task matches at once, at least, and pairs of them that it holds at once, about
CELLS = 100_000
PAIRS = 2_000_000
#: a text makes pairs of lines if these are at most so many times its cells
COMMON = 16
NONE, LAST = -1, 1 << 62
FOUND = T.ArrayType(T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("row", "col", "row_b", "col_b")), T.StructField("outcome", T.StringType())]))


def meet(a: np.ndarray, b: np.ndarray, outer: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with a[i] == b[j]; with outer, also (i, NONE) for what meets nothing."""
    order = np.argsort(b, kind="stable")
    lo, hi = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    n = np.maximum(hi - lo, 1) if outer else hi - lo
    i = np.repeat(np.arange(len(a)), n)
    at = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]
    j = np.full(len(i), NONE)
    hit = at < hi[i]
    j[hit] = order[at[hit]]
    return i, j


def _once(key: np.ndarray) -> np.ndarray:
    """Where values stand that occur once."""
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    return at[n == 1]


def _starts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: where each begins, and the number of the value at each place."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def crossing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a pair of lines contradicts the order of any other: exact, by running extremes instead of pairs. Lines are
    numbered table by table on both sides, so pairs of different tables never do."""
    bad = np.zeros(len(x), bool)
    if len(x):
        order = np.argsort(x, kind="stable")
        b = y[order]
        start, at = _starts(x[order])
        low, high = np.minimum.reduceat(b, start), np.maximum.reduceat(b, start)
        above = np.concatenate([[NONE], np.maximum.accumulate(high)[:-1]])
        below = np.concatenate([np.minimum.accumulate(low[::-1])[::-1][1:], [LAST]])
        bad[order] = (above[at] >= b) | (below[at] <= b) | (low != high)[at]
    return bad


class _Axis:
    """Rows or columns of the tables of a batch, numbered in order on each side, and the counterparts known so far."""

    def __init__(self, table_a: np.ndarray, line_a: np.ndarray, table_b: np.ndarray, line_b: np.ndarray):
        keys, (self.a, self.b) = zip(*(np.unique((t << 32) + line + (1 << 31), return_inverse=True) for t, line in ((table_a, line_a), (table_b, line_b))), strict=True)
        self.no_b = (keys[1] & 0xFFFFFFFF) - (1 << 31)
        self.to, self.taken = np.full(len(keys[0]), NONE), np.zeros(len(keys[1]), bool)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.to[x], self.taken[y] = y, True

    def added(self, across: _Axis, text_a: np.ndarray, text_b: np.ndarray, support: int) -> int:
        """Adds pairs of lines by the votes of cells in mapped lines of the other axis. Texts below 0 have no vote."""
        mine = np.flatnonzero((text_a >= 0) & (self.to[self.a] < 0) & (across.to[across.a] >= 0))
        theirs = np.flatnonzero((text_b >= 0) & ~self.taken[self.b] & across.taken[across.b])
        if not len(mine) or not len(theirs):
            return 0
        # counterparts stand in order, so lines may be each other's if as many of them stand before both
        gap = np.concatenate([np.cumsum(self.to >= 0)[self.a[mine]], np.cumsum(self.taken)[self.b[theirs]]])
        k = 1 + max(text_a.max(), text_b.max())
        key = np.unique(np.concatenate([across.to[across.a[mine]] * k + text_a[mine], across.b[theirs] * k + text_b[theirs]]), return_inverse=True)[1]
        key = np.unique(gap * (1 + key.max()) + key, return_inverse=True)[1]
        line, a = np.concatenate([self.a[mine], self.b[theirs]]), len(mine)
        n_a, n_b = np.bincount(key[:a], minlength=len(key)), np.bincount(key[a:], minlength=len(key))
        common = n_a * n_b > COMMON * (n_a + n_b)
        rare = (n_a > 0) & (n_b > 0) & ~common
        few, many = rare[key], common[key]
        side = [np.arange(len(key)) < a, np.arange(len(key)) >= a]
        groups = [_Groups(line[many & s], key[many & s], len(x)) for s, x in zip(side, (self.to, self.taken), strict=True)]
        best = [_Best(len(self.to)), _Best(len(self.taken))]
        found = []
        for x, y, n in _pairs(*(v[few & s] for s in side for v in (line, key)), groups):
            best[1].put(y, n, 1)
            alone = best[0].put(x, n, 1)
            found.append((x[alone], y[alone], n[alone]))
        # and the pairs that only common texts make: where a rare one is shared too, the sum above is the larger
        as_one = [_Best(len(g.first)) for g in groups]
        for p, q, n in _pairs(groups[0].of, groups[0].key, groups[1].of, groups[1].key):
            as_one[1].put(q, n, groups[0].size[p])
            alone = as_one[0].put(p, n, groups[1].size[q])
            found.append((groups[0].first[p[alone]], groups[1].first[q[alone]], n[alone]))
        if not found:
            return 0
        for b, one, g in zip(best, as_one, groups, strict=True):
            at = np.flatnonzero(g.no >= 0)
            b.put(at, one.most[g.no[at]], one.ties[g.no[at]])
        x, y, n = (np.concatenate(v) for v in zip(*found, strict=True))
        keep = (n >= support) & (best[0].most[x] == n) & (best[0].ties[x] == 1) & (best[1].most[y] == n) & (best[1].ties[y] == 1)
        x, y = x[keep], y[keep]
        good = ~crossing(x, y)
        self.add(x[good], y[good])
        return int(good.sum())


class _Groups:
    """Lines as one that have the same keys, each as often: the number of each line's group (or NONE), and of each group its
    first line, its size and its cells (of, key)."""

    def __init__(self, line: np.ndarray, key: np.ndarray, lines: int):
        order = np.lexsort((key, line))
        line, key = line[order], key[order]
        start, at = _starts(line)
        n = np.diff(np.append(start, len(line)))
        mark = np.random.default_rng(0).integers(0, 1 << 63, 1 + key.max(initial=0))
        total = np.add.reduceat(mark[key], start) if len(start) else n
        by = np.lexsort((total, n))
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(total[by]) != 0) | (np.diff(n[by]) != 0)
        like = np.empty(len(by), np.int64)
        like[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        # equal sums are no proof: a line whose keys aren't those of its group's first stands for itself
        other = np.bincount(at, key != key[np.minimum(start[like[at]] + np.arange(len(line)) - start[at], len(line) - 1)], len(start)) > 0
        like[other] = np.flatnonzero(other)
        first, no, self.size = np.unique(like, return_inverse=True, return_counts=True)
        self.first = line[start[first]]
        self.no = np.full(lines, NONE)
        self.no[line[start]] = no
        own = np.isin(at, first)
        self.of, self.key = no[at[own]], key[own]


class _Best:
    """The most votes that each of some lines has with another, and how many others have as many."""

    def __init__(self, lines: int):
        self.most, self.ties = np.zeros(lines, np.int64), np.zeros(lines, np.int64)

    def put(self, x: np.ndarray, n: np.ndarray, others: np.ndarray | int) -> np.ndarray:
        """Takes in votes n of lines x, each with so many others. Whether each is the most of its line and no other here is."""
        now, equal = np.zeros_like(self.most), np.zeros_like(self.ties)
        np.maximum.at(now, x, n)
        top = (n == now[x]) & (n > 0)
        np.add.at(equal, x[top], np.broadcast_to(others, len(x))[top])
        self.ties = np.where(now > self.most, equal, self.ties + np.where((now == self.most) & (now > 0), equal, 0))
        self.most = np.maximum(self.most, now)
        return top & (equal[x] == 1)


def _pairs(a: np.ndarray, key_a: np.ndarray, b: np.ndarray, key_b: np.ndarray, groups: list[_Groups] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, n) of the lines that share keys and how often, in pieces that hold all of an x. With groups, what the lines of a
    pair share there counts too."""
    if not len(a) or not len(b):
        return
    order = np.argsort(a, kind="stable")
    a, key_a = a[order], key_a[order]
    ordered = np.sort(key_b)
    work = np.searchsorted(ordered, key_a, "right") - np.searchsorted(ordered, key_a)
    if groups:
        # a group's cells stand together, a place for lines without one comes last
        cells = np.append(np.bincount(groups[0].of, minlength=len(groups[0].first)), 0)
        begin = np.cumsum(cells) - cells
        by = np.argsort(groups[0].of, kind="stable")
        k = 1 + max(groups[0].key.max(initial=0), groups[1].key.max(initial=0))
        theirs, times = np.unique(groups[1].of * k + groups[1].key, return_counts=True)
        theirs, times = np.append(theirs, LAST), np.append(times, 0)
        work *= 1 + cells[groups[0].no[a]]
    # whole lines together, about PAIRS pairs at once
    start, _ = _starts(a)
    ends = np.append(start[1:], len(a))
    part = np.cumsum(work)[ends - 1] // PAIRS
    cuts = np.append(ends[np.flatnonzero(part[1:] != part[:-1])], len(a))
    m = 1 + b.max()
    for s, e in zip(np.concatenate([[0], cuts[:-1]]).tolist(), cuts.tolist(), strict=True):
        i, j = meet(key_a[s:e], key_b)
        pair, n = np.unique(a[s:e][i] * m + b[j], return_counts=True)
        if not len(pair):
            continue
        x, y = pair // m, pair % m
        if groups and len(groups[0].first):
            p, q = groups[0].no[x], groups[1].no[y]
            both = np.flatnonzero((p >= 0) & (q >= 0))
            of = np.repeat(both, cells[p[both]])
            off = np.arange(len(of)) - np.repeat(np.cumsum(cells[p[both]]) - cells[p[both]], cells[p[both]])
            want = q[of] * k + groups[0].key[by[begin[p[of]] + off]]
            at = np.searchsorted(theirs, want)
            n = n + np.bincount(of, np.where(theirs[at] == want, times[at], 0), len(n)).astype(np.int64)
        yield x, y, n


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(table, row, col, text) of the cells in a column of lists."""
    table = np.repeat(np.arange(len(column)), np.asarray(pc.fill_null(pc.list_value_length(column), 0)))
    row, col, text = column.flatten().flatten()
    return table, np.asarray(row).astype(np.int64), np.asarray(col).astype(np.int64), text


def matched(a: pa.Array, b: pa.Array, large: np.ndarray, support: int, rounds: int | None, settle: bool) -> pa.Array:
    """A list a table of (row, col, row_b, col_b, outcome), from lists of (row, col, text) on both sides."""
    (table_a, row_a, col_a, text_a), (table_b, row_b, col_b, text_b) = _cells(a), _cells(b)
    texts = pa.concat_arrays([text_a, text_b])
    code = np.asarray(texts.dictionary_encode().indices).astype(np.int64)
    vote = np.where(np.asarray(pc.binary_length(texts)) > 0, code, NONE)
    code_a, code_b, vote_a, vote_b = code[: len(row_a)], code[len(row_a) :], vote[: len(row_a)].copy(), vote[len(row_a) :]
    vote_a[large[table_a]] = NONE
    rows, cols = _Axis(table_a, row_a, table_b, row_b), _Axis(table_a, col_a, table_b, col_b)
    k = 1 + code.max(initial=0)
    filled_a, filled_b = np.flatnonzero(vote_a >= 0), np.flatnonzero(vote_b >= 0)
    key_a, key_b = table_a[filled_a] * k + vote_a[filled_a], table_b[filled_b] * k + vote_b[filled_b]
    one_a, one_b = _once(key_a), _once(key_b)
    i, j = meet(key_a[one_a], key_b[one_b])
    i, j = filled_a[one_a[i]], filled_b[one_b[j]]
    bad = crossing(rows.a[i], rows.b[j]) | crossing(cols.a[i], cols.b[j])
    for axis in (rows, cols):
        axis.add(axis.a[i[~bad]], axis.b[j[~bad]])
    for _ in itertools.count() if rounds is None else range(rounds):
        n = rows.added(cols, vote_a, vote_b, support)
        if not n + cols.added(rows, vote_a, vote_b, support):
            break
    # the cell at the counterparts, and what the place is as an anchor: 0 none, 1 good, 2 crossing
    width, width_b = 1 + len(cols.to), 1 + len(cols.taken)
    y, x = rows.to[rows.a], cols.to[cols.a]
    placed = (y >= 0) & (x >= 0)
    at, other = meet(np.where(placed, y * width_b + x, NONE), rows.b * width_b + cols.b, outer=True)
    place = rows.a * width + cols.a
    again, anchor = meet(place[at], place[i], outer=True)
    at, other = at[again], other[again]
    state = np.append(np.where(bad, 2, 1), 0)[anchor]
    there = np.unique(key_b)
    stands = np.isin(table_a * k + vote_a, there) & (vote_a >= 0)
    lines = placed[at]
    same = (other >= 0) & (code_a[at] == np.append(code_b, NONE)[other])
    outcome = np.select(
        [large[table_a[at]], (state == 2) & ~lines if settle else state == 2, lines & (other < 0), lines & ~same, lines & (state == 1), lines, stands[at]],
        ["too_large", "conflict", "removed", "changed", "anchor", "supported", "ambiguous"],
        "unmatched",
    )
    gone = ~np.isin(outcome, ["anchor", "supported", "changed", "removed"])
    number = lambda v, line: pa.array(np.append(v, 0)[line], pa.int32(), mask=gone)
    found = pa.StructArray.from_arrays([pa.array(row_a[at], pa.int32()), pa.array(col_a[at], pa.int32()), number(rows.no_b, y[at]), number(cols.no_b, x[at]), pa.array(outcome, pa.string())], names=FOUND.elementType.names)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(table_a[at], np.arange(len(a) + 1)), pa.int32()), found)


def correspond(left: DataFrame, right: DataFrame, by: list[str], support: int = 1, rounds: int | None = None, settle: bool = False) -> DataFrame:
    """A row for each cell of left (by, row, col, text): row_b, col_b and the outcome.

    anchor, supported: its counterpart has the same text; changed: it has another text; removed: the lines' counterparts
    hold no cell there; conflict: an anchor that crosses others; ambiguous: the text stands in the other version, but nothing proves where;
    unmatched: it doesn't; too_large: not tried, only where MAX_CELLS is set. row_b and col_b are null for the last four.
    With settle, an anchor that crosses others is no conflict where other cells prove its row and its column: one false anchor
    crosses all true ones between its two places, and these still stand where the lines say.
    rounds: as many as there are that add a line, unless given.
    """
    most = MAX_CELLS
    cell = lambda df, side: df.select(*by, F.lit(side).alias("side"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.coalesce("text", F.lit("")).alias("text")).repartition(*by)
    # both versions of a table stand together, cell by cell, so Spark holds no table in a row
    both = cell(left, 0).unionByName(cell(right, 1)).withColumn("no", F.row_number().over(Window.partitionBy(*by).orderBy("side")))

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        *keys, side, row, col, text, no = (pa.concat_arrays([x.column(i) for x in held]) for i in range(len(names)))
        first = np.asarray(no) == 1
        table, sides = np.cumsum(first) - 1, np.asarray(side)
        n = int(first.sum())
        versions = []
        for i in (0, 1):
            at = np.flatnonzero(sides == i)
            cells = pa.StructArray.from_arrays([x.take(pa.array(at)) for x in (row, col, text)], names=["row", "col", "text"])
            versions.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(table[at], np.arange(n + 1)), pa.int32()), cells))
        large = np.bincount(table, minlength=n) > (len(table) if most is None else 2 * most)
        found = matched(*versions, large, support, rounds, settle)
        of = pa.array(np.flatnonzero(first)).take(pc.list_parent_indices(found))
        return pa.RecordBatch.from_arrays([*(k.take(of) for k in keys), *found.flatten().flatten()], names=schema.names)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            starts = np.flatnonzero(np.asarray(batch.column(len(names) - 1)) == 1)
            if n >= CELLS and len(starts):
                yield whole([*held, batch.slice(0, int(starts[-1]))])
                held, n, batch = [], 0, batch.slice(int(starts[-1]))
            held.append(batch)
            n += len(batch)
        if n:
            yield whole(held)

    names = both.columns
    schema = T.StructType([*(both.schema[c] for c in by), *FOUND.elementType.fields])
    return both.mapInArrow(tables, schema)
