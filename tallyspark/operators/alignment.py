"""Edit paths of two texts on Arrow batches, what a change of text corrects or spoils, and where an edited span went.

Costs are one for each substituted, deleted or inserted code point. A pair's common ends are cut off first. The rest is
solved row by row with whole rows of the cost table as bits of two long integers, so a text of 100,000 code points against another takes
seconds. A path needs the bits of all rows; where they pass LIMIT bytes, the first text is halved at the place of the
second where both halves' costs add up least, so memory is bounded for texts of any length.

Two middles of one length that share no code point among the places where they differ need no table: each of these
places costs at least one on any path, so the diagonal is cheapest, and time is linear. Results leave a task in pieces of
PIECE runs, so its memory doesn't grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: bytes of a pair's bits held at once
LIMIT = 64_000_000
#: runs of edit paths, or texts, that a task holds before it hands them on
PIECE = 50_000
STEPS = "array<struct<op:string,a:int,b:int,n:int,text:string>>"


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _rows(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """For each point of a the bits over b: where the cost equals the one diagonally before, where it is one more than
    the one before it in its row, where it is one less."""
    full = (1 << len(b)) - 1
    where = {int(c): int.from_bytes(np.packbits(b == c, bitorder="little").tobytes(), "little") for c in np.unique(b)}
    more, less = full, 0
    for c in a.tolist():
        here = where.get(c, 0)
        level = ((((here & more) + more) ^ more) | here | less) & full
        down_more, down_less = less | (full ^ ((level | more) & full)), level & more
        down_more, down_less = ((down_more << 1) | 1) & full, (down_less << 1) & full
        more, less = down_less | (full ^ (level | down_more)), down_more & level
        yield level, more, less


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cost of a against each beginning of b."""
    more, less = (1 << len(b)) - 1, 0
    for _, more, less in _rows(a, b):
        pass
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little").astype(np.int64)
    return len(a) + np.concatenate([[0], np.cumsum(bits(more) - bits(less))])


def _backwards(a: np.ndarray, b: np.ndarray) -> list[int]:
    """The ops (0 equal, 1 substituted, 2 deleted, 3 inserted) from a to b; of paths that cost the same the one that,
    seen from the end, goes on diagonally before it deletes, and deletes before it inserts."""
    size = len(b) // 8 + 1
    kept = [(level.to_bytes(size, "little"), less.to_bytes(size, "little")) for level, _, less in _rows(a, b)]
    a, b = a.tolist(), b.tolist()
    ops, i, j = [], len(a), len(b)
    while i and j:
        byte, bit = (j - 1) >> 3, (j - 1) & 7
        if a[i - 1] == b[j - 1]:
            op = 0
        elif not kept[i - 1][0][byte] >> bit & 1:
            op = 1
        elif i > 1 and kept[i - 2][1][byte] >> bit & 1:
            op = 2
        else:
            op = 3
        ops.append(op)
        i, j = i - (op != 3), j - (op != 2)
    return ([2] * i or [3] * j) + ops[::-1]


def _diagonal(a: np.ndarray, b: np.ndarray) -> list[int] | None:
    """The path that only substitutes, where counting code points proves that none is cheaper."""
    if len(a) != len(b):
        return None
    differ = a != b
    return None if np.isin(a[differ], b[differ]).any() else differ.astype(np.int8).tolist()


def distance(a: str, b: str) -> int:
    """The cost of the cheapest path, without its bits."""
    x, y = _points(a), _points(b)
    if len(x) < len(y):
        x, y = y, x
    if (straight := _diagonal(x, y)) is not None:
        return sum(straight)
    more, less = (1 << len(y)) - 1, 0
    for _, more, less in _rows(x, y):
        pass
    return len(x) + more.bit_count() - less.bit_count()


def path(a: np.ndarray, b: np.ndarray) -> list[int]:
    """A cheapest list of ops from a to b."""
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[len(a) - short + head :][::-1] != b[len(b) - short + head :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if (straight := _diagonal(x, y)) is not None:
        middle = straight
    elif len(x) * len(y) // 4 <= LIMIT:
        middle = _backwards(x, y) if len(x) and len(y) else [2] * len(x) + [3] * len(y)
    elif len(x) == 1:
        at = np.flatnonzero(y == x[0])
        middle = [3] * len(y)
        middle[int(at[0]) if len(at) else 0] = 0 if len(at) else 1
    else:
        half = len(x) // 2
        cut = int(np.argmin(_last_row(x[:half], y) + _last_row(x[half:][::-1], y[::-1])[::-1]))
        middle = path(x[:half], y[:cut]) + path(x[half:], y[cut:])
    return [0] * head + middle + [0] * tail


OPS = ("equal", "substitute", "delete", "insert")


def steps(a: str, b: str) -> list[dict]:
    """The path from a to b as runs: op, places in a and b, length, and the text it puts there (null where it is equal)."""
    ops = np.array(path(_points(a), _points(b)), np.int8)
    if not len(ops):
        return []
    edge = np.flatnonzero(np.concatenate([[True], ops[1:] != ops[:-1]]))
    size = np.diff(np.append(edge, len(ops)))
    out, i, j = [], 0, 0
    for op, n in zip(ops[edge].tolist(), size.tolist(), strict=True):
        out.append({"op": OPS[op], "a": i, "b": j, "n": n, "text": b[j : j + n] if op in (1, 3) else None})
        i += n if op != 3 else 0
        j += n if op != 2 else 0
    return out


def _per_pair(df: DataFrame, key: list[str], sides: dict[str, tuple[str, str]], make, kind: str) -> DataFrame:
    """key and, under each name of sides, what make gives for the texts of its two columns, on Arrow batches."""
    fields = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key), *(f"{name} {kind}" for name in sides)])
    result = to_arrow_type(StructType.fromDDL(f"x {kind}")["x"].dataType)
    size = lambda x: len(x) if isinstance(x, list) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, start, found = 0, 0, [[] for _ in sides]
            for row in range(batch.num_rows):
                for i, out in enumerate(found):
                    a, b = (batch.column(len(key) + 2 * i + side)[row].as_py() or "" for side in (0, 1))
                    out.append(make(a, b))
                    held += 1 + size(out[-1])
                if held >= PIECE or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, row + 1 - start) for i in range(len(key))), *(pa.array(x, result) for x in found)], [*key, *sides])
                    held, start, found = 0, row + 1, [[] for _ in sides]

    texts = [F.col(c).alias(f"_{i}{side}") for i, pair in enumerate(sides.values()) for side, c in enumerate(pair)]
    return df.select(*key, *texts).mapInArrow(run, fields)


def aligned(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """key, steps of the cheapest path from column a to column b; a null text counts as ''."""
    return _per_pair(df, key, {"steps": (a, b)}, steps, STEPS)


def costs(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """key, cost of the cheapest path from column a to column b, without the path; a null text counts as ''."""
    return _per_pair(df, key, {"cost": (a, b)}, distance, "int")


def total(steps_: Column, *ops: str) -> Column:
    """How many code points the steps of these ops have."""
    return F.aggregate(F.filter(steps_, lambda s: s["op"].isin(*ops)), F.lit(0), lambda n, s: n + s["n"])


def cost(steps_: Column) -> Column:
    return total(steps_, "substitute", "delete", "insert")


def _wrong(steps_: Column) -> Column:
    """The places of the truth that a text gets wrong."""
    bad = F.filter(steps_, lambda s: s["op"].isin("substitute", "delete"))
    return F.flatten(F.transform(bad, lambda s: F.sequence(s["a"], s["a"] + s["n"] - 1)))


def _surplus(steps_: Column) -> Column:
    """The gaps of the truth into which a text inserts, with how much."""
    return F.map_from_entries(F.transform(F.filter(steps_, lambda s: s["op"] == "insert"), lambda s: F.struct(s["a"], s["n"])))


def gains(df: DataFrame, key: list[str], truth: str, before: str, after: str) -> DataFrame:
    """key, corrected, introduced, net: the errors against the truth that a change from before to after takes away and
    brings in. A place of the truth is right or wrong; surplus is compared gap by gap, by its length."""
    j = _per_pair(df, key, {"was": (truth, before), "now": (truth, after)}, steps, STEPS)
    j = j.withColumns({"bad_was": _wrong(F.col("was")), "bad_now": _wrong(F.col("now")), "more_was": _surplus(F.col("was")), "more_now": _surplus(F.col("now"))})
    gaps = F.array_union(F.map_keys("more_was"), F.map_keys("more_now"))
    at = lambda m, g: F.coalesce(F.try_element_at(m, g), F.lit(0))
    fewer = F.aggregate(gaps, F.lit(0), lambda n, g: n + F.greatest(at(F.col("more_was"), g) - at(F.col("more_now"), g), F.lit(0)))
    more = F.aggregate(gaps, F.lit(0), lambda n, g: n + F.greatest(at(F.col("more_now"), g) - at(F.col("more_was"), g), F.lit(0)))
    j = j.select(*key, (F.size(F.array_except("bad_was", "bad_now")) + fewer).alias("corrected"), (F.size(F.array_except("bad_now", "bad_was")) + more).alias("introduced"))
    return j.withColumn("net", F.col("corrected") - F.col("introduced"))


CHANGES = "array<struct<op:string,a0:int,a1:int,b0:int,b1:int,before:string,after:string,moved:boolean>>"


def changes(a: str, b: str) -> list[dict]:
    """What a cheapest edit of lines changes from a to b, a block of lines each: replace, delete or insert, the lines' places on both
    sides (ends exclusive) and texts. moved: all that has a text in the block stands in other blocks of the other side,
    so only the reading order differs."""
    x, y = a.split("\n"), b.split("\n")
    number: dict[str, int] = {}
    p, q = (np.array([number.setdefault(line, len(number)) for line in lines], np.uint32) for lines in (x, y))
    out, i, j, open_ = [], 0, 0, False
    for op in path(p, q):
        if op and not open_:
            out.append([i, i, j, j])
        open_ = op > 0
        i, j = i + (op != 3), j + (op != 2)
        if op:
            out[-1][1], out[-1][3] = i, j
    gone, come = ([{line.strip() for line in side[c[k] : c[k + 1]]} - {""} for c in out] for side, k in ((x, 0), (y, 2)))
    found = []
    for n, (a0, a1, b0, b1) in enumerate(out):
        elsewhere = lambda sets: set().union(*(s for m, s in enumerate(sets) if m != n))  # noqa: E731, B023
        moved = bool(gone[n] | come[n]) and gone[n] <= elsewhere(come) and come[n] <= elsewhere(gone)
        op = "insert" if a0 == a1 else "delete" if b0 == b1 else "replace"
        before, after = "\n".join(x[a0:a1]) if a1 > a0 else None, "\n".join(y[b0:b1]) if b1 > b0 else None
        found.append({"op": op, "a0": a0, "a1": a1, "b0": b0, "b1": b1, "before": before, "after": after, "moved": moved})
    return found


def line_changes(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """key, and a row for each block of lines that changes from column a to column b (see changes); a null text counts as ''."""
    return _per_pair(df, key, {"changes": (a, b)}, changes, CHANGES).select(*key, F.explode("changes").alias("x")).select(*key, "x.*")


def relocate(old: Column, new: Column, start: Column, end: Column, context: int = 16) -> Column:
    """Where the span start to end (from 0, end exclusive) of old stands in new: struct<start, end>, or null.

    The span is taken with `context` code points on both sides, then with either side alone, then bare; the first of these that
    stands in new decides, and only if it stands there once: a place that can't be told from another is never guessed.
    An empty span needs context. Spans outside the text give null.
    """
    span = F.substring(old, start + 1, end - start)
    ahead = F.substring(old, F.greatest(start - context, F.lit(0)) + 1, F.least(start, F.lit(context)))
    behind = F.substring(old, end + 1, F.lit(context))
    tries = [(F.concat(ahead, span, behind), F.char_length(ahead)), (F.concat(ahead, span), F.char_length(ahead)), (F.concat(span, behind), F.lit(0)), (span, F.lit(0))]
    found = F.lit(None).cast("struct<start:int,end:int>")
    for pattern, skip in reversed(tries):
        first = F.instr(new, pattern)
        again = F.instr(F.substring(new, first + 1, F.char_length(new)), pattern)
        at = first - 1 + skip
        once = F.when(again == 0, F.struct(at.cast("int").alias("start"), (at + end - start).cast("int").alias("end")))
        found = F.when((first > 0) & (F.char_length(pattern) > 0), once).otherwise(found)
    inside = (start >= 0) & (end >= start) & (end <= F.char_length(old))
    return F.when(inside, F.when(old == new, F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))).otherwise(found))
