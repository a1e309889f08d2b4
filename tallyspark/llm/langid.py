"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is bound by multiplying its letters' vectors, the first rotated
by two places and the second by one; its middle is a letter, its ends letters or the word's edge. A document is the
bundle (sum) of its trigrams' vectors, a language the bundle of its training documents. The language whose prototype has
the largest cosine with the document is predicted; the score is that cosine (0 if negative), the margin how far it lies
above the next language's.

Training uses at most about SAMPLE documents of each language, chosen by a hash of doc_id from those whose
crc32(doc_id) mod 5 isn't 0. All sums are integers, so prototypes don't depend on the order of rows.

Defined cases: a null text or one without letters gets 'und' and score 0; a null doc_id counts as the text '' (held
out); rows with a null language train nothing; without training rows, and in an empty table, all is 'und'; ties go to
the first language in order; repeated rows are predicted alike; a very long text is bundled in one array of its
characters, and all of it counts; extra columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import words as W

DIMS = 512
SEED = 20260101
#: training documents of a language, about
SAMPLE = 2000
UND = "und"
#: letters below DIRECT have their own vector, others share SLOTS - DIRECT by hash
DIRECT, SLOTS = 0x250, 2048
#: cells of a block's table of counts
CELLS = 4_000_000

_letters: np.ndarray | None = None
_vectors: np.ndarray | None = None


def letters() -> np.ndarray:
    """Per code point its slot; 0 for what isn't a letter. Slot 0 is the edge of a word."""
    global _letters
    if _letters is None:
        slot = np.zeros(0x110000, np.int32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                x = ord(low) if len(low) == 1 else cp
                slot[cp] = x if x < DIRECT else DIRECT + x * 2654435761 % (1 << 32) % (SLOTS - DIRECT)
        _letters = slot
    return _letters


def vectors() -> np.ndarray:
    """SLOTS random vectors of +1 and -1."""
    global _vectors
    if _vectors is None:
        _vectors = np.random.default_rng(SEED).integers(0, 2, (SLOTS, DIMS), np.int8) * 2 - 1
    return _vectors


def trigram_vectors(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    v = vectors()
    return (np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]).astype(np.float32)


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each text (float32 holding integers), and its number of letters."""
    joined = "\x00".join(t or "" for t in texts)
    size = np.array([len(t or "") + 1 for t in texts])
    slot = letters()[np.frombuffer((joined + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(texts)), size)
    mid = np.flatnonzero(slot)
    n = np.bincount(doc[mid], minlength=len(texts))
    out = np.zeros((len(texts), DIMS), np.float32)
    if not len(mid):
        return out, n
    before = np.where(mid > 0, slot[np.maximum(mid - 1, 0)], 0)
    used = np.flatnonzero(np.bincount(slot[mid], minlength=SLOTS))
    used = used if used[0] == 0 else np.concatenate([[0], used])
    small = np.zeros(SLOTS, np.int64)
    small[used] = np.arange(len(used))
    k = len(used)
    code = (small[before] * k + small[slot[mid]]) * k + small[slot[mid + 1]]
    if k**3 <= 1 << 22:
        seen = np.flatnonzero(np.bincount(code, minlength=k**3))
        no = np.zeros(k**3, np.int32)
        no[seen] = np.arange(len(seen))
        no = no[code]
    else:
        seen, no = np.unique(code, return_inverse=True)
    step = max(1, CELLS // max(1, len(texts)))
    d = doc[mid]
    for s in range(0, len(seen), step):
        e = min(len(seen), s + step)
        part = (no >= s) & (no < e) if (s, e) != (0, len(seen)) else slice(None)
        counts = np.bincount(d[part].astype(np.int64) * (e - s) + (no[part] - s), minlength=len(texts) * (e - s)).reshape(len(texts), e - s)
        some = seen[s:e]
        v = trigram_vectors(used[some // (k * k)], used[some // k % k], used[some % k])
        out += counts.astype(np.float32) @ v
    return out, n


def chunked(col: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    for a, b, _, _ in W.chunks(col):
        yield a, b, col.slice(a, b - a).to_pylist()


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The prototype of each language. A language is one row of counts and DIMS sums for the driver."""
    rows = docs.filter((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull())
    # the draw is uniform over each language's rows and needs no sort
    share = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(min(1.0, sample / r["count"]))) for r in rows.groupBy("lang").count().collect()), F.lit(0.0))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def sums(batches: Iterator[pa.RecordBatch]):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist())
            for a, b, texts in chunked(batch.column(1)):
                v, _ = bundles(texts)
                for name in np.unique(lang[a:b]):
                    total[name] = total.get(name, 0) + v[lang[a:b] == name].astype(np.float64).sum(0)
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([np.rint(total[n]).astype(np.int64) for n in names], pa.list_(pa.int64()))], names=["lang", "v"])

    out: dict[str, np.ndarray] = {}
    whole = drawn.mapInArrow(sums, "lang string, v array<long>").select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    for r in whole.collect():
        out.setdefault(r["lang"], np.zeros(DIMS))[r["at"]] = r["x"]
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """The columns keep, then lang_pred, score and margin, for every row."""
    names = sorted(n for n, v in prototypes.items() if v.any())
    p = np.array([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]).reshape(len(names), DIMS).T.astype(np.float32)
    kept = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias("_text"))
    at = kept.columns.index("text" if "text" in keep else "_text")
    n = len(keep)
    schema = kept.drop("_text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "margin": F.lit(0.0)}).schema

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            col = batch.column(at)
            lang, score, margin = [UND] * len(col), np.zeros(len(col)), np.zeros(len(col))
            for a, _, texts in chunked(col):
                v, letters_in = bundles(texts)
                if names:
                    cos = (v @ p) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
                    best = cos.argmax(1)
                    two = np.sort(np.maximum(cos, 0), 1)[:, -2:]
                    for i in np.flatnonzero(letters_in):
                        lang[a + i], score[a + i] = names[best[i]], min(1.0, max(0.0, round(float(cos[i, best[i]]), 6)))
                        margin[a + i] = round(float(two[i, -1] - (two[i, 0] if len(names) > 1 else 0)), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(lang, pa.string()), pa.array(score), pa.array(margin)], names=[*batch.schema.names[:n], "lang_pred", "score", "margin"])

    return kept.mapInArrow(rows, schema)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin for every row of docs (doc_id, text, lang)."""
    rows = docs.select("doc_id", "text", (fold(F.col("doc_id")) == 0).alias("held_out"))
    return predict(rows, train(docs, sample), ["doc_id", "held_out"])


def keep_known(docs: DataFrame, least: float, margin: float = 0.0, short: int = 200, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that aren't rejected; columns as they were, with the predicted language as lang.

    Rejected are texts without letters, and texts of `short` characters or more whose score is below `least` (unlike any
    language) or whose margin is below `margin` (undecided between two); shorter ones hold too few trigrams for that.
    """
    cols = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols if c != "text"), F.length("text").alias("_length")).alias("_row"), "text")
    known = (F.col("lang_pred") != UND) & ((F.col("_row._length") < short) | ((F.col("score") >= least) & (F.col("margin") >= margin)))
    kept = predict(rows, train(docs, sample), ["_row", "text"]).filter(known)
    own = {"text": F.col("text"), "lang": F.col("lang_pred").alias("lang")}
    return kept.select(*(own.get(c, F.col(f"_row.`{c}`").alias(c)) for c in cols))
