"""Words and word shingles of a column of texts, hashed by whole Arrow batches in numpy.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Each word gets a 64-bit polynomial hash
from prefix sums, so a batch costs a few vector operations and no Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: bytes of text hashed at once; a longer document is hashed alone
CHUNK = 1 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: bytes that end a term: all of ASCII but letters and digits
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False
_GAP[128:] = False
_POW = np.ones(1, U)
_INV = np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) <= n:
        size = 1 << max(16, n.bit_length())
        inv = pow(_BASE, -1, 1 << 64)
        p, q = np.full(size, U(_BASE)), np.full(size, U(inv))
        p[0] = q[0] = U(1)
        _POW, _INV = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _POW, _INV


def chunks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, starts) of ranges of documents of up to CHUNK bytes; starts has one more entry than documents."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0:
        return
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + CHUNK, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_spans(buf: np.ndarray, starts: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of each document (one more entry than documents)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(starts), np.int64)
    inside = ~gaps[buf]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, starts)


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word."""
    pw, inv = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum(((_LOWER[buf] if lower else buf).astype(U) + U(1)) * pw[: len(buf)], out=sums[1:])
    return mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(U))


_C = np.array([mix(np.array([k + 1], U))[0] | U(1) for k in range(64)], U)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside documents, in order, and the first of each document.

    A document with fewer words has one, of its whole sequence; one without words has none.
    """
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(first[-1]), U)
    m = len(words) - width + 1
    if m > 0:
        full = words[:m] * _C[0]
        for k in range(1, width):
            full += words[k : k + m] * _C[k]
        full = mix(full)
        doc = np.repeat(np.arange(len(n)), n)
        ok = np.flatnonzero(doc[:m] == doc[width - 1 :])
        d = doc[ok]
        out[first[d] + (ok - bounds[d])] = full[ok]
    for d in np.flatnonzero((n > 0) & (n < width)):
        w = words[bounds[d] : bounds[d + 1]]
        with np.errstate(over="ignore"):
            out[first[d]] = mix(np.array([(w * _C[: len(w)]).sum(dtype=U) + U(len(w)) * U(0xD6E8FEB86659FD93)], U))[0]
    return out, first


def distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's hashes sorted and without repeats."""
    h = hashes.copy()
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[first[:-1][np.diff(first) > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], kept[first]


def shingle_sets(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, bounds): the distinct shingles of the documents of a batch, by chunks."""
    for a, b, buf, starts in chunks(col):
        s, e, bounds = word_spans(buf, starts)
        h, first = distinct(*shingles(word_hashes(buf, s, e), bounds))
        yield a, b, h, first


def terms(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, bounds): the terms of the documents of a batch, in order, by chunks. A term is a run of
    ASCII letters, digits and characters outside ASCII; A-Z count as a-z. A document of more than CHUNK bytes is cut
    into pieces where a term has ended, so the memory needed beside its hashes doesn't grow with it."""
    for a, b, buf, starts in chunks(col):
        if len(buf) <= CHUNK:
            s, e, bounds = word_spans(buf, starts, _GAP)
            yield a, b, word_hashes(buf, s, e), bounds
            continue
        parts, at = [np.zeros(0, U)], 0
        while at < len(buf):
            end = min(at + CHUNK, len(buf))
            while end < len(buf) and not _GAP[buf[end]]:
                gap = np.flatnonzero(_GAP[buf[end : end + CHUNK]])
                end = end + int(gap[0]) if len(gap) else min(end + CHUNK, len(buf))
            s, e, _ = word_spans(buf[at:end], np.array([0, end - at]), _GAP)
            parts.append(word_hashes(buf[at:end], s, e))
            at = end
        h = np.concatenate(parts)
        yield a, b, h, np.array([0, len(h)])


def term_hashes(texts: list[str]) -> list[np.ndarray]:
    """The hashes of the terms of each text, in order."""
    out = []
    for _, _, h, bounds in terms(pa.array(texts, pa.string())):
        out += [h[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    return out
