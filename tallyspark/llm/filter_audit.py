"""Filter interaction audit: what each filter of a chain removes, in every order of the chain, from one histogram.

Which filters a document fails is a mask of k bits, and all that a chain does to a document follows from its mask. So the
documents are reduced to a histogram of masks per part (and one each of the good and the toxic documents), at most 2^k
rows a part. Stacked as rows they form an integer matrix of 2^k columns, and products with four incidence matrices of
2^k by k! * k (for five filters 32 by 600) give, for each order and step, the documents kept, removed, redundant and
failing that filter only. The products run in tasks over batches of parts, so parts may be as many as they like.

Whether a text repeats one of a smaller doc_id is decided by a minimum per text (combined before the shuffle, so a text
that a third of all rows share is one row a task) that is joined back by text and doc_id together; no key of a join is hot.

Defined cases: a null text counts as empty, a null part as ''; a row without a doc_id is no copy, makes none and has no
label; rows that repeat a doc_id count as often as they stand there and are no copies of each other; labels that repeat a
doc_id count as one that has what any of them has; a null label is none. An empty table gives no parts. Columns other
than doc_id, text, source, quality and toxic aren't read, whatever their names. A text is held whole by its row's task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import written

FILTERS = "ABCDE"
#: parts whose products are made at once
PARTS = 64
KINDS = ("n", "good", "toxic")
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask: the filters that a text fails by itself, bit 0 for A, to bit 3 for D."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0).alias("words"))
    df = df.withColumns({"n": F.size("words"), "distinct": F.size(F.array_distinct("words")), "capitals": F.regexp_count("text", F.lit("[A-Z]"))})
    fails = [F.col("n") < 50, 100 * F.col("distinct").cast("long") < 65 * F.col("n").cast("long"), 100 * F.col("capitals").cast("long") > 5 * F.char_length("text").cast("long"), F.col("text").rlike("[#$%&*|]")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return df.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """rows with `bit` added to the mask of each whose digest a smaller doc_id has as well."""
    known = rows.filter("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = known.join(first, ["doc_id", "digest"], "left")
    known = known.withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(bit)).drop("first")
    return known.unionByName(rows.filter("doc_id is null"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic, 1 or 0."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    known = rows.filter("doc_id is not null").join(marks, "doc_id", "left")
    return known.unionByName(rows.filter("doc_id is null"), allowMissingColumns=True).fillna(0, ["good", "toxic"])


def histograms(rows: DataFrame) -> DataFrame:
    """part, cells: for each mask that occurs in the part the documents, good and toxic ones (2^k entries at most)."""
    cells = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", *KINDS)).alias("cells"))


def incidence(filters: str) -> dict[str, np.ndarray]:
    """kept, removed, redundant and unique: matrices of 0 and 1, a row a mask, a column an order and step."""
    k = len(filters)
    masks = np.arange(1 << k)[:, None]
    steps = [(1 << order[s], sum(1 << i for i in order[:s])) for order in permutations(range(k)) for s in range(k)]
    own, before = (np.array(x) for x in zip(*steps, strict=True))
    fails, earlier = (masks & own) > 0, (masks & before) > 0
    found = {"kept": ~fails & ~earlier, "removed": fails & ~earlier, "redundant": fails & earlier, "unique": masks == own}
    return {name: m.astype(np.int64) for name, m in found.items()}


def product(parts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The rows of RESULT, k! * k for each part: its stacked histograms times the incidence matrices."""
    k = len(filters)
    orders = ["".join(o) for o in permutations(filters)]
    size = len(orders) * k
    letter = np.array([filters.index(o[s]) for o in orders for s in range(k)])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = incidence(filters)
        alike = (letter[:, None] == letter[None, :]).astype(np.int64)
        names, steps = pa.array(orders).take(pa.array(np.repeat(np.arange(len(orders)), k))), np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))
        for whole in batches:
            for at in range(0, whole.num_rows, PARTS):
                batch = whole.slice(at, PARTS)
                cells = batch.column("cells")
                flat = cells.flatten()
                row = np.repeat(np.arange(batch.num_rows), cells.value_lengths().to_numpy(zero_copy_only=False))
                stack = {}
                for kind in KINDS:
                    h = np.zeros((batch.num_rows, 1 << k), np.int64)
                    h[row, flat.field("mask").to_numpy(zero_copy_only=False)] = flat.field(kind).to_numpy(zero_copy_only=False)
                    stack[kind] = h
                removed = stack["n"] @ m["removed"]
                columns = [
                    batch.column("part").take(pa.array(np.repeat(np.arange(batch.num_rows), size))),
                    pa.concat_arrays([names] * batch.num_rows),
                    pa.array(np.tile(steps, batch.num_rows)),
                    *(pa.array(x.ravel()) for x in (stack["n"] @ m["kept"], removed, stack["n"] @ m["redundant"], stack["n"] @ m["unique"], stack["good"] @ m["removed"], stack["toxic"] @ m["removed"], removed @ alike)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return parts.mapInArrow(multiply, RESULT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over documents (doc_id, text, source) and labels (doc_id, quality, toxic)."""
    rows = written(failures(docs), "fails")  # narrow: the texts are read once
    return product(histograms(with_labels(with_copies(rows, 1 << 4), labels)))
