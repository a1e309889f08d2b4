"""Benchmark decontamination by template canonicalisation.

Words are stripped of punctuation at their ends and lower-cased; numbers, names and units become typed placeholders, so
a question whose values were changed has the same template. Windows of WINDOW template words of the documents meet those
of the benchmark by hash: a bitmap of the benchmark's windows (of a fixed size, so it may be sent to all tasks) drops
nearly all of a document's windows, an exact hash join the rest of the false ones.

The slots of a matched window are its placeholders' own words. Over all matched windows of a document and an item the
map from the item's values to the document's must be a function, and one to one; then windows with changed values
count, else only those with the same values do. A document is contaminated by an item if the windows that count make up
COVER of the item's windows.

The same is asked of each occurrence by itself, as a text may hold an item with several sets of values, or other windows
of its template: the matched windows of one alignment (place in the document minus place in the item), and those of
alignments in a row. There windows without any fixed word count only if their values are the same.

RUN words in a row that are the same, of an item of any length, contaminate as well: the cover alone would ask for longer
passages of longer items.

Defined cases: a null or empty text has no windows; an item shorter than WINDOW is one window of its whole sequence (met
anywhere in documents), an item without words matches nothing; repeated items and rows each give their own rows, a
repeated doc_id as one document; a null doc_id or item_id takes no part; an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import words as W
from tallyspark.session import written

U = np.uint64
WINDOW = 8
COVER = 0.3
#: words in a row that contaminate whatever the item's length
RUN = 13
MAP_BITS = 24
#: fixed values: units of measure, currency and time that follow a number
UNITS = (
    "% cm mm m km in inch inches ft foot feet yd mi mile miles meter meters metre metres g kg mg lb lbs oz ton tons l ml liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years c f k degrees percent "
    "usd eur gbp dollar dollars cent cents euro euros pound pounds hz khz mhz ghz kb mb gb tb w kw v a n j kj mol pa kpa bar mph kmh"
).split()
NUM, NAME, UNIT = U(0x4E554D), U(0x4E414D45), U(0x554E4954)
SEPARATOR = U(0x53)

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ALNUM[ord("%")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\"'("]] = True


def _unit_hashes() -> np.ndarray:
    buf = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    s, e, _ = W.word_spans(buf, np.array([0, len(buf)]))
    return np.unique(W.word_hashes(buf, s, e))


_UNIT_SET = _unit_hashes()


def template(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes, own hashes, whether a word is a slot, and the first word of each document."""
    s, e, bounds = W.word_spans(buf, starts)
    if not len(s):
        z = np.zeros(0, U)
        return z, z, np.zeros(0, bool), bounds
    # the first and last letter, digit or % of each word
    good = np.flatnonzero(_ALNUM[buf])
    lo, hi = np.searchsorted(good, s), np.searchsorted(good, e)
    has = hi > lo
    word = np.flatnonzero(has)
    a, b = good[lo[has]], good[hi[has] - 1] + 1
    bounds = np.searchsorted(word, bounds)
    own = W.word_hashes(buf, a, b)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    # letters, apart from percent signs
    marks = np.concatenate([[0], np.cumsum(_ALNUM[buf] & ~_DIGIT[buf] & (buf != 37))])
    n_digit, n_letter = digits[b] - digits[a], marks[b] - marks[a]
    number = (n_digit > 0) & (n_letter == 0)
    mixed = _DIGIT[buf[a]] & (n_letter > 0)  # 5km, 3rd
    prev = np.concatenate([[False], number[:-1] | mixed[:-1]])
    prev[bounds[:-1][bounds[:-1] < len(prev)]] = False
    unit = prev & np.isin(own, _UNIT_SET) & ~number
    # a name starts with a capital inside a sentence
    end = e[has]
    after_stop = np.ones(len(a), bool)
    after_stop[1:] = _STOP[buf[end[:-1] - 1]]
    line = np.concatenate([[0], np.cumsum(buf == 10)])
    after_stop[1:] |= line[a[1:]] > line[end[:-1] - 1]
    after_stop[bounds[:-1][bounds[:-1] < len(a)]] = True
    after_stop |= _STOP[buf[s[has]]] & (s[has] < a)
    name = _UPPER[buf[a]] & ~after_stop & ~number & ~mixed & ~unit
    form = own.copy()
    form[number] = W.mix(NUM + np.zeros(1, U))[0]
    form[mixed] = W.mix(NUM + U(1) + np.zeros(1, U))[0]
    form[name] = W.mix(NAME + np.zeros(1, U))[0]
    form[unit] = W.mix(UNIT + np.zeros(1, U))[0]
    return form, own, number | mixed | name | unit, bounds


def windows_of(form: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all runs of `width` words inside documents."""
    m = len(form) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = np.full(m, U(width) * SEPARATOR)
    for k in range(width):
        h = W.mix(h + form[k : k + m]) if k % 4 == 3 else (h + form[k : k + m]) * W._C[k]
    h = W.mix(h)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ok = np.flatnonzero(doc[:m] == doc[width - 1 :])
    return ok, h[ok]


WINDOWS = "id long, hash long, at int, slots array<long>, width int, windows int"


def windows(df: DataFrame, widths: list[int] | None = None, bitmap=None) -> DataFrame:
    """The template windows of (id, text). A window of placeholders only says nothing by its form, which all number tables
    share, so its hash is that of its values as well. Without widths each text has those of its own width (WINDOW, or its whole
    sequence if that is shorter); with a bitmap only the windows that it lets through."""

    def rows(batches: Iterator[pa.RecordBatch]):
        bits = None if bitmap is None else bitmap.value
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            for a, _, buf, starts in W.chunks(batch.column(1)):
                form, own, slot, bounds = template(buf, starts)
                size = np.diff(bounds)
                out = []
                for width in widths or sorted(set(np.minimum(size[size > 0], WINDOW).tolist())):
                    at, h = windows_of(form, bounds, width)
                    upto = np.concatenate([[0], np.cumsum(slot)])
                    bare = np.flatnonzero(upto[at + width] - upto[at] == width)
                    if len(bare):
                        h[bare] = W.mix(h[bare] + windows_of(own, bounds, width)[1][bare])
                    doc = np.searchsorted(bounds, at, "right") - 1
                    keep = np.minimum(size[doc], WINDOW) == width if widths is None else np.ones(len(at), bool)
                    if bits is not None:
                        x = (h >> U(64 - MAP_BITS)).astype(np.int64)
                        keep &= (bits[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)
                    for i in np.flatnonzero(keep).tolist():
                        w = np.arange(at[i], at[i] + width)
                        w = w[slot[w]]
                        out.append((int(ids[a + doc[i]]), int(h[i].view(np.int64)), int(at[i] - bounds[doc[i]]), own[w].view(np.int64).tolist(), width, int(size[doc[i]] - width + 1)))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=[x.split()[0] for x in WINDOWS.split(", ")])

    return df.mapInArrow(rows, WINDOWS)


def occurrences(m: DataFrame, key: list[str], cover: float) -> DataFrame:
    """key: those with an occurrence whose values map one to one and whose windows reach the cover."""
    m = m.filter((F.size("slots") < F.col("width")) | (F.col("slots") == F.col("item_slots"))).withColumn("diag", F.col("at") - F.col("item_at"))
    # alignments in a row shift by less than a window and an item
    order = Window.partitionBy(*key).orderBy("diag")
    step = F.col("diag") - F.lag("diag").over(order) > F.least(F.lit(WINDOW), F.col("windows") - 1)
    m = m.withColumn("step", F.coalesce(step.cast("int"), F.lit(0))).withColumn("row", F.sum("step").over(order).cast("int"))
    m = m.withColumn("occ", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("diag").alias("no")), F.struct(F.lit(1).alias("kind"), F.col("row").alias("no")))))
    key = [*key, "occ"]
    enough = m.groupBy(*key).agg(F.count_distinct("item_at").alias("n"), F.max("windows").alias("windows")).filter(F.col("n") >= F.col("windows") * F.lit(cover)).select(*key)
    pair = m.select(*key, F.explode(F.arrays_zip("item_slots", "slots")).alias("x")).select(*key, F.col("x.item_slots").alias("theirs"), F.col("x.slots").alias("mine"))
    # a value with two images, or two with one
    pair = pair.distinct()
    split = [pair.groupBy(*key, side).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key) for side in ("theirs", "mine")]
    return enough.join(split[0].unionByName(split[1]).distinct(), key, "left_anti").select(*key[:-1]).distinct()


def runs(m: DataFrame, key: list[str]) -> DataFrame:
    """key: those with RUN words in a row that are the same."""
    w = m.filter((F.col("slots") == F.col("item_slots")) & (F.col("width") == WINDOW)).select(*key, (F.col("at") - F.col("item_at")).alias("diag"), "at").distinct()
    w = w.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy(*key, "diag").orderBy("at")))
    return w.groupBy(*key, "diag", "run").count().filter(F.col("count") >= RUN - WINDOW + 1).select(*key).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, windows, matched, same (matched with equal values), changed_slots, consistent (over the document or
    an occurrence), kind: a row for each document and item that contaminates it. kind: 'verbatim' or 'reparameterised'."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").filter("id is not null")
    bench = written(windows(items), "benchmark-windows")
    # the bitmap has a fixed size; it is built from distinct prefixes of hashes, at most 1 << MAP_BITS of them
    prefix = bench.select(F.shiftrightunsigned("hash", 64 - MAP_BITS).cast("int").alias("x")).distinct()

    def as_bytes(batches: Iterator[pa.RecordBatch]):
        bits = np.zeros(1 << MAP_BITS >> 3, np.uint8)
        for batch in batches:
            x = np.asarray(batch.column(0))
            np.bitwise_or.at(bits, x >> 3, np.uint8(1) << (x & 7).astype(np.uint8))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bits[at].astype(np.int32))], names=["at", "bits"])

    bits = np.zeros(1 << MAP_BITS >> 3, np.uint8)
    for r in prefix.mapInArrow(as_bytes, "at int, bits int").toLocalIterator():
        bits[r["at"]] |= r["bits"]
    widths = [r["width"] for r in bench.select("width").distinct().collect()]  # 1 to WINDOW
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    hits = windows(texts, sorted(widths) or [WINDOW], spark.sparkContext.broadcast(bits)).select("id", "hash", "at", "slots", "width")
    b = bench.select("hash", "width", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "windows")
    m = written(hits.join(b, ["hash", "width"]).filter(F.size("slots") == F.size("item_slots")), "matches")
    m = m.withColumnRenamed("id", "doc_id")
    key = ["doc_id", "item_id"]
    count = m.groupBy(*key, "item_at").agg(F.max(F.col("slots") == F.col("item_slots")).alias("same"), F.max("windows").alias("windows"))
    count = count.groupBy(*key).agg(F.max("windows").alias("windows"), F.count(F.lit(1)).alias("matched"), F.count_if("same").alias("same"))
    pair = m.select(*key, F.explode(F.arrays_zip("item_slots", "slots")).alias("x")).select(*key, F.col("x.item_slots").alias("theirs"), F.col("x.slots").alias("mine")).distinct()
    there = pair.groupBy(*key, "theirs").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("theirs") != F.col("mine")).alias("changed")).groupBy(*key).agg(F.max("n").alias("most"), F.sum("changed").alias("changed_slots"))
    back = pair.groupBy(*key, "mine").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.max("n").alias("most_back"))
    out = count.join(there, key, "left").join(back, key, "left")
    out = out.withColumn("consistent", (F.coalesce("most", F.lit(1)) == 1) & (F.coalesce("most_back", F.lit(1)) == 1)).withColumn("changed_slots", F.coalesce("changed_slots", F.lit(0)))
    out = out.join(occurrences(m, key, cover).withColumn("occurs", F.lit(True)), key, "left")
    out = out.join(runs(m, key).withColumn("verbatim", F.lit(True)), key, "left").withColumn("verbatim", F.coalesce("verbatim", F.lit(False)))
    counted = F.when(F.col("consistent"), F.col("matched")).otherwise(F.col("same"))
    out = out.filter((counted >= F.col("windows") * F.lit(cover)) | F.col("occurs") | F.col("verbatim")).withColumn("consistent", F.col("consistent") | F.coalesce("occurs", F.lit(False)))
    kind = F.when((F.col("same") >= F.col("windows") * F.lit(cover)) | F.col("verbatim"), "verbatim").otherwise("reparameterised")
    return out.select(*key, "windows", "matched", "same", "changed_slots", "consistent", kind.alias("kind"))


def clean(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """The rows of docs that no item contaminates; columns as they were."""
    bad = written(contaminated(docs, benchmark, cover).select("doc_id").distinct(), "contaminated")
    few = bad.limit(500_001).count() <= 500_000
    bad = bad.withColumnRenamed("doc_id", "_bad")
    return docs.join(F.broadcast(bad) if few else bad, docs.doc_id == bad["_bad"], "left_anti")
