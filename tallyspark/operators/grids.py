"""Structure edits of tables: local variants between two grids, and patches that apply only if they keep every value.

A grid is a set of cells (by, row, col, row_span, col_span, text, is_header). A variant is the smallest exchange that
turns one place of a grid into the other's: a rectangle that whole cells tile on both sides. Fewer cells make it a merge,
more a split, as many a change of header or of cut. Grids of unequal size differ by inserted rows or columns, if all old
bands are found again in order and the new ones stand together.

A patch is a variant as a row: by, kind, r0, c0, r1, c1, before, after, conserved. It says all that applying it needs, so
undoing it is the patch with before and after exchanged. Conserved: the texts of both sides in reading order are equal
but for blanks; what an insertion adds must be blank.

Both grids of a table meet in one row; tasks then compare all tables of an Arrow batch at once, SLOTS slots (unit squares)
of regions at a time. Patches are judged and applied by joins on places.
Defined cases: a null text counts as ''; a cell that stands twice overlaps itself, so no region that it touches is a variant.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.correspondence import meet
from tallyspark.session import written

CELL = ["row", "col", "row_span", "col_span", "text", "is_header"]
#: slots of regions that a task holds at once, about (a region whole)
SLOTS = 2_000_000
REGION = ["r0", "c0", "r1", "c1"]
CELLS_TYPE = "array<struct<row:int,col:int,row_span:int,col_span:int,text:string,is_header:boolean>>"
UNDONE = {"merge": "split", "split": "merge", "header": "header", "insert_rows": "delete_rows", "insert_cols": "delete_cols", "delete_rows": "insert_rows", "delete_cols": "insert_cols"}


def plain(cells: DataFrame, by: list[str]) -> DataFrame:
    """The columns of a grid, typed, without null texts."""
    ints = [F.col(c).cast("int").alias(c) for c in CELL[:4]]
    return cells.select(*by, *ints, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("is_header", F.lit(False)).alias("is_header"))


def sizes(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by).agg(F.max(F.col("row") + F.col("row_span")).alias("n_rows"), F.max(F.col("col") + F.col("col_span")).alias("n_cols"))


def _slots(df: DataFrame, r0: str, c0: str, r1: str, c1: str) -> DataFrame:
    """df with a row for each slot (y, x) of its rectangle."""
    df = df.withColumn("y", F.explode(F.expr(f"sequence({r0}, {r1} - 1)")))
    return df.withColumn("x", F.explode(F.expr(f"sequence({c0}, {c1} - 1)")))


def _number(*columns: np.ndarray) -> np.ndarray:
    """A number for each distinct row of the columns."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        low = int(c.min(initial=0))
        out = np.unique(out * (int(c.max(initial=0)) - low + 1) + (c - low), return_inverse=True)[1]
    return out


def _expanded(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place n times, and its count there from 0."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


class _Grids:
    """The cells of both grids of a batch's tables: the table, the side (0, 1) and the columns of each."""

    def __init__(self, a: pa.Array, b: pa.Array):
        n = [np.asarray(pc.list_value_length(x)) for x in (a, b)]
        self.tables, self.cells = len(a), pa.concat_arrays([a.flatten(), b.flatten()])
        self.table = np.concatenate([np.repeat(np.arange(len(x)), x) for x in n])
        self.side = np.repeat([0, 1], [x.sum() for x in n])
        *ints, text, header = self.cells.flatten()
        self.row, self.col, self.row_span, self.col_span = (np.asarray(x).astype(np.int64) for x in ints)
        text = text.dictionary_encode()
        rank = np.empty(len(text.dictionary), np.int64)
        rank[np.asarray(pc.sort_indices(text.dictionary))] = np.arange(len(rank))
        self.text, self.header = rank[np.asarray(text.indices)], np.asarray(header.cast(pa.int8())).astype(np.int64)

    def most(self, side: int, x: np.ndarray) -> np.ndarray:
        """The largest x of each table on a side."""
        out = np.zeros(self.tables, np.int64)
        np.maximum.at(out, self.table[self.side == side], x[self.side == side])
        return out

    def ordered(self, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The order of cells `at` by what they belong to, then as Spark sorts them."""
        return np.lexsort((*(x[at] for x in (self.header, self.text, self.col_span, self.row_span, self.col, self.row)), of))

    def lists(self, of: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
        order = self.ordered(of, at)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[order], np.arange(n + 1)), pa.int32()), self.cells.take(pa.array(at[order])))


def _regions(g: _Grids) -> Iterator[tuple[np.ndarray, list[np.ndarray], pa.Array, pa.Array]]:
    """(table, region, before, after) of the places that only one side has as a cell and cells of both tile, in pieces."""
    bottom, right, size = g.row + g.row_span, g.col + g.col_span, g.row_span * g.col_span
    same = (g.most(0, bottom) == g.most(1, bottom)) & (g.most(0, right) == g.most(1, right))
    form = _number(g.table, g.row, g.col, g.row_span, g.col_span, g.header)
    sides = [np.bincount(form[g.side == i], minlength=len(form)) > 0 for i in (0, 1)]
    alone = np.flatnonzero(same[g.table] & ~(sides[0] & sides[1])[form])
    alone = alone[np.unique(_number(*(x[alone] for x in (g.table, g.row, g.col, g.row_span, g.col_span))), return_index=True)[1]]
    touched = np.isin(g.table, g.table[alone])
    near = np.flatnonzero(touched)
    part = np.cumsum(size[alone]) // SLOTS
    for k in np.unique(part).tolist():
        area = alone[part == k]
        p, off = _expanded(size[area])
        y, x = g.row[area][p] + off // g.col_span[area][p], g.col[area][p] + off % g.col_span[area][p]
        place = _number(*(np.concatenate(v) for v in ((g.table[area][p], g.table[near]), (y, g.row[near]), (x, g.col[near]))))
        i, j = meet(place[: len(p)], place[len(p) :])
        at, cell = p[i], near[j]
        inside = (bottom[cell] <= bottom[area][at]) & (right[cell] <= right[area][at])
        at, cell = at[inside], cell[inside]
        of = 2 * at + g.side[cell]
        covered = np.bincount(of, size[cell], 2 * len(area)) == np.repeat(size[area], 2)
        good = covered[::2] & covered[1::2]
        at, cell, of = (v[good[at]] for v in (at, cell, of))
        # as many slots as the region has: all of them, unless one is covered twice
        q, off = _expanded(size[cell])
        slot = _number(of[q], g.row[cell][q] + off // g.col_span[cell][q], g.col[cell][q] + off % g.col_span[cell][q])
        good[at[q[np.bincount(slot, minlength=1)[slot] > 1]]] = False
        keep = good[at]
        at, cell = (np.cumsum(good) - 1)[at[keep]], cell[keep]
        area = area[good]
        lists = [g.lists(at[g.side[cell] == i], cell[g.side[cell] == i], len(area)) for i in (0, 1)]
        yield g.table[area], [g.row[area], g.col[area], bottom[area], right[area]], *lists


def _inserted(g: _Grids, axis: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(table, first, last, breadth, cells) of the bands by which the second side differs, where they stand together and
    all bands of the first are found again in order."""
    at, span, other, width = (g.row, g.row_span, g.col, g.col_span) if axis == "row" else (g.col, g.col_span, g.row, g.row_span)
    size, breadth = ([g.most(i, x) for i in (0, 1)] for x in (at + span, other + width))
    ok = (size[1] > size[0]) & (breadth[0] == breadth[1]) & (np.maximum(g.most(0, span), g.most(1, span)) == 1)
    use = np.flatnonzero(ok[g.table])
    band = _number(g.table[use], g.side[use], at[use])
    what = _number(other[use], width[use], g.text[use], g.header[use])
    order = np.lexsort((what, band))
    use, what, band = use[order], what[order], band[order]
    n = np.bincount(band)
    start = np.cumsum(n) - n
    same = n.copy()
    for k in range(int(n.max(initial=0))):
        more = np.flatnonzero(n > k)
        same[more] = _number(same[more], what[start[more] + k])
    table, side, at = g.table[use[start]], g.side[use[start]], at[use[start]]
    like = _number(table, n, same)
    times = [np.bincount(like[side == i], minlength=len(like)) for i in (0, 1)]
    pair = ((times[0] == 1) & (times[1] == 1))[like]
    there = np.zeros(len(like), np.int64)
    there[like[pair & (side == 1)]] = at[pair & (side == 1)]
    old = np.flatnonzero(pair & (side == 0))
    old = old[np.lexsort((at[old], table[old]))]
    found, to = table[old], there[like[old]]
    ok &= np.bincount(found, minlength=g.tables) == size[0]
    ok[found[1:][(found[1:] == found[:-1]) & (to[1:] < to[:-1])]] = False
    fresh = ~pair & (side == 1)
    first, last = np.full(g.tables, 1 << 62), np.zeros(g.tables, np.int64)
    np.minimum.at(first, table[fresh], at[fresh])
    np.maximum.at(last, table[fresh], at[fresh] + 1)
    ok &= (last - first == np.bincount(table[fresh], minlength=g.tables)) & (last > 0)
    good = np.flatnonzero(ok)
    own = np.flatnonzero((fresh & ok[table])[band])
    # band by band, within it as Spark sorts cells
    of = _number(g.table[use[own]], at[band[own]])
    order = g.ordered(of, use[own])
    cells = use[own][order]
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(g.table[cells], np.append(good, g.tables)), pa.int32()), g.cells.take(pa.array(cells)))
    return good, first[good], last[good], breadth[1][good], lists


def _by_table(current: DataFrame, proposed: DataFrame, by: list[str], columns: str, rows: Callable[[_Grids], Iterator[tuple]]) -> DataFrame:
    """by, columns: what rows() yields for the tables of a batch (their numbers, then the columns). Both grids of a table
    meet in one row."""
    whole = lambda df, name: plain(df, by).groupBy(*by).agg(F.collect_list(F.struct(*CELL)).alias(name))
    both = whole(current, "a").join(whole(proposed, "b").hint("merge"), by)
    fields = T.StructType.fromDDL(columns).fields
    schema = T.StructType([*(both.schema[c] for c in by), *fields])

    def tables(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            *keys, a, b = batch.columns
            for table, *found in rows(_Grids(a, b)):
                own = [k.take(pa.array(table)) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, *(x if isinstance(x, pa.Array) else pa.array(x, pa.int32()) for x in found)], names=[*by, *(f.name for f in fields)])

    return both.mapInArrow(tables, schema)


def _shape(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.struct(c["row"], c["col"], c["row_span"], c["col_span"], c["is_header"]))


def literal(cells: Column) -> Column:
    """The texts in reading order without blanks: what a change of structure must keep."""
    return F.regexp_replace(F.array_join(F.transform(cells, lambda c: c["text"]), ""), r"\s", "")


def variants(current: DataFrame, proposed: DataFrame, by: list[str]) -> DataFrame:
    """The merges, splits and header changes, as patches, that lead from current to proposed (grids of equal size)."""
    def rows(g: _Grids):
        for table, region, before, after in _regions(g):
            yield table, *region, before, after

    j = _by_table(current, proposed, by, f"r0 int, c0 int, r1 int, c1 int, before {CELLS_TYPE}, after {CELLS_TYPE}", rows)
    j = j.filter(_shape(F.col("before")) != _shape(F.col("after")))
    n, m = F.size("before"), F.size("after")
    kind = F.when(m < n, "merge").when(m > n, "split").otherwise("header")
    return j.select(*by, kind.alias("kind"), *REGION, "before", "after", (literal(F.col("before")) == literal(F.col("after"))).alias("conserved"))


def insertions(current: DataFrame, proposed: DataFrame, by: list[str], axis: str = "row") -> DataFrame:
    """The patch that inserts rows (or columns), for tables where one block of new bands explains all of the difference."""
    g = _by_table(current, proposed, by, f"first int, last int, breadth int, after {CELLS_TYPE}", lambda g: [_inserted(g, axis)])
    zero = F.lit(0)
    region = {"r0": F.col("first"), "c0": zero, "r1": F.col("last"), "c1": F.col("breadth")} if axis == "row" else {"r0": zero, "c0": F.col("first"), "r1": F.col("breadth"), "c1": F.col("last")}
    none = F.array().cast(CELLS_TYPE)
    return g.select(*by, F.lit(f"insert_{axis}s").alias("kind"), *(v.alias(k) for k, v in region.items()), none.alias("before"), "after", (literal(F.col("after")) == "").alias("conserved"))


def undo(patches: DataFrame) -> DataFrame:
    """The patches that take patches back."""
    kinds = F.create_map(*(F.lit(x) for pair in UNDONE.items() for x in pair))
    return patches.withColumns({"kind": kinds[F.col("kind")], "before": F.col("after"), "after": F.col("before")})


def judged(cells: DataFrame, patches: DataFrame, by: list[str]) -> DataFrame:
    """patches with their outcome: applied, not_conserved, overlapping (with another patch of the table, or beside one
    that shifts cells) or stale (the grid doesn't hold the patch's cells before it)."""
    cells = plain(cells, by)
    p = patches.withColumn("shifts", F.col("kind").rlike("^(insert|delete)"))
    whole = Window.partitionBy(*by)
    p = p.withColumns({"alone": F.count(F.lit(1)).over(whole) == 1, "shifted": F.max("shifts").over(whole)})
    twice = _slots(p.filter("not shifted").select(*by, *REGION), *REGION).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by, "y", "x")))
    crowded = twice.groupBy(*by, *REGION).agg((F.max("n") > 1).alias("crowded"))
    have = cells.withColumn("here", F.struct(*CELL)).select(*by, "row", "col", "here")
    wanted = p.select(*by, *REGION, F.explode("before").alias("c")).select(*by, *REGION, F.col("c.row").alias("row"), F.col("c.col").alias("col"), "c")
    fits = wanted.join(have.hint("merge"), [*by, "row", "col"], "left").groupBy(*by, *REGION).agg(F.count_if(~F.col("c").eqNullSafe(F.col("here"))).alias("missing"))
    out = p.join(crowded.hint("merge"), [*by, *REGION], "left").join(fits.hint("merge"), [*by, *REGION], "left")
    outcome = (
        F.when(~F.col("conserved"), "not_conserved")
        .when(F.coalesce("crowded", F.lit(False)) | (F.col("shifted") & ~F.col("alone")), "overlapping")
        .when(F.coalesce("missing", F.lit(0)) > 0, "stale")
        .otherwise("applied")
    )
    return out.withColumn("outcome", outcome).drop("shifts", "alone", "shifted", "crowded", "missing")


def apply(cells: DataFrame, patches: DataFrame, by: list[str]) -> DataFrame:
    """The grid after all patches whose outcome is applied."""
    cells = plain(cells, by)
    done = written(judged(cells, patches, by).filter("outcome = 'applied'"), "patches")
    gone = done.select(*by, F.explode("before").alias("c")).select(*by, F.col("c.row").alias("row"), F.col("c.col").alias("col"))
    moves = done.filter(F.col("kind").rlike("^(insert|delete)")).select(*by, "kind", F.col("r0").alias("_r0"), F.col("c0").alias("_c0"), (F.col("r1") - F.col("r0")).alias("_h"), (F.col("c1") - F.col("c0")).alias("_w"))
    # what lists hold is more than their files let Spark expect, so it would broadcast them
    kept = cells.join(moves.hint("merge"), by, "left").join(gone.hint("merge"), [*by, "row", "col"], "left_anti")
    for axis, at, by_how in (("row", "_r0", "_h"), ("col", "_c0", "_w")):
        step = F.when(F.col("kind") == f"insert_{axis}s", F.col(by_how)).when(F.col("kind") == f"delete_{axis}s", -F.col(by_how))
        kept = kept.withColumn(axis, F.col(axis) + F.when(F.col(axis) >= F.col(at), F.coalesce(step, F.lit(0))).otherwise(0))
    fresh = done.select(*by, F.explode("after").alias("c")).select(*by, "c.*")
    return kept.select(*by, *CELL).unionByName(fresh)
