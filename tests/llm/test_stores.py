import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyspark.llm import mixing, sharding, warc, webp
from tallyspark.llm.queries import MIX


def test_sharding_is_whole_balanced_and_gapless(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randrange(400), "s") for i in range(3000)] + [(None, None, "s"), (None, "x", "s"), (5, "again", "s"), (7, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard(df, 8, slots=512).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    load, places = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 8
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard(df.limit(0), 8).collect() == []


def test_rebalancing_moves_few_slots_and_versions_stay(spark, tmp_path):
    size = {s: 100 for s in range(800)}
    old = sharding.rebalanced(sharding.first_map(800, 8), size, 8)
    assert old == sharding.first_map(800, 8)
    new = sharding.rebalanced({s: t if s % 9 else -1 for s, t in old.items()}, size, 9)
    assert all(new[s] == old[s] for s in old if s % 9)
    path = f"file://{tmp_path}/map"
    sharding.store_map(spark, path, 1, old)
    sharding.store_map(spark, path, 2, new)
    assert {r.vslot: r.shard for r in sharding.load_map(spark, path, 1).collect()} == old


def budget(children, total):
    """Shares by repeated filling: a child that can't use its share is filled and leaves."""
    out, left = {}, dict(children)
    while left:
        w = sum(x[0] for x in left.values())
        full = [k for k, (weight, cap) in left.items() if cap * w <= total * weight]
        if not full:
            return out | {k: total * weight // w for k, (weight, _) in left.items()}
        k = min(full, key=lambda k: (left[k][1] / left[k][0], k))
        out[k] = left[k][1]
        total -= left.pop(k)[1]
    return out


def test_mixing_against_plain_python(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * 1 for _ in range(rng.randrange(40))), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src0", "src1", "src2", "src9", None]), i) for i in range(1500)]
    rows += [(2000, None, "en", "src0", 1), (3, "again a b", "en", "src0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies long")
    got = mixing.plan(df, **MIX).collect()
    assert len(got) == len(rows)
    leaves = defaultdict(list)
    for d, t, lang, src, _ in rows:
        s = src or "(none)"
        leaves[MIX["domains"][zlib.crc32(s.encode()) % 4], lang or "(none)", s].append((d, len((t or "").split())))
    cap = {k: 2 * sum(n for _, n in v) for k, v in leaves.items()}
    total = sum(cap.values()) // 2 * 9 // 10
    wd, wl = MIX["weights"]["domain"], MIX["weights"]["lang"]
    doms = budget({d: (wd[d], sum(c for k, c in cap.items() if k[0] == d)) for d in {k[0] for k in cap}}, total)
    want = {}
    for d, b in doms.items():
        for g, b2 in budget({g: (wl.get(g, 1), sum(c for k, c in cap.items() if k[:2] == (d, g))) for g in {k[1] for k in cap if k[0] == d}}, b).items():
            for s, b3 in budget({k[2]: (1, c) for k, c in cap.items() if k[:2] == (d, g)}, b2).items():
                docs = leaves[d, g, s]
                tokens = sum(n for _, n in docs)
                whole = b3 // tokens if tokens else 2
                left = b3 - whole * tokens
                key = lambda doc: int(hashlib.md5(f"mix-1:{whole}:{doc}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
                for doc, n in docs:
                    upto = sum(m for o, m in docs if key(o) <= key(doc))
                    want.setdefault((str(doc), n), []).append((s, b3, whole + (left > 0 and upto <= left)))
    for r in got:
        assert (r.source, r.leaf_budget, r.copies) in want[str(r.doc_id), r.tokens]
    taken = mixing.apply(df, **MIX)
    assert taken.columns == df.columns and taken.count() == sum(r.copies for r in got)
    assert mixing.plan(df.limit(0), **MIX).count() == 0


def test_warc_round_trip(spark, tmp_path):
    odd = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "http://c/", ""), (5, "http://d/", odd), (6, "http://e/", odd), (7, "http://f/", "ünï" * 5000), (6, "http://e/", odd), (8, "u", "once")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    path = f"file://{tmp_path}/w"
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(df, path).collect())
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        kept = max(q for q, _, g in rows if (g or "").encode() == raw)
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == kept else "revisit", None if p == kept else kept))
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in sorted(want, key=lambda x: x[:4])]
    full = {(r.page_id, bytes(r.payload)) for r in warc.with_payload(warc.read(spark, path)).collect()}
    assert full == {(p, (h or "").encode()) for p, _, h in rows}
    assert warc.archive(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nshort"))


class Stream(webp.Writer):
    """Bits of hand-made images, to reach what encode() doesn't write."""

    def simple(self, *symbols):
        self.put(1, 1)
        self.put(len(symbols) - 1, 1)
        self.put(1, 1)
        for s in symbols:
            self.put(s, 8)

    def file(self):
        raw = self.value.to_bytes(-(-self.n // 8), "little")
        chunk = b"VP8L" + len(raw).to_bytes(4, "little") + raw + b"\0" * (len(raw) & 1)
        return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk


def head(w, h):
    s = Stream()
    for v, k in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (0, 1), (0, 3)):
        s.put(v, k)
    return s


def single(s, argb, main=True):
    """An image of one colour: no cache, codes of one symbol."""
    s.put(0, 1)
    if main:
        s.put(0, 1)
    for v in (argb >> 8 & 255, argb >> 16 & 255, argb & 255, argb >> 24):
        s.simple(v)
    s.simple(0)


def test_known_files():
    one = base64.b64decode("UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=")
    assert webp.decode(one).tolist() == [[[255, 255, 255, 255]]]


def test_back_reference_and_colour_cache():
    s = head(6, 1)
    s.put(0, 1)
    s.put(1, 1)
    s.put(2, 4)  # a cache of 4 colours
    s.put(0, 1)
    colour = 255 << 24 | 10 << 16 | 20 << 8 | 30
    slot = (colour * 0x1E35A7BD & 0xFFFFFFFF) >> 30
    size = 256 + 24 + 4
    lengths = [0] * size
    for x in (20, 256 + 1, 280 + slot, 21):
        lengths[x] = 2
    order = webp.LENGTH_ORDER
    s.put(0, 1)
    s.put(order.index(2) + 1 - 4, 4)
    for x in order[: order.index(2) + 1]:
        s.put(1 if x in (0, 2) else 0, 3)
    s.put(0, 1)
    for n in lengths:
        s.put(1 if n else 0, 1)
    codes = {x: webp.reverse(i, 2) for i, x in enumerate(sorted((20, 21, 257, 280 + slot)))}
    for v in (10, 30, 255):
        s.simple(v)
    s.simple(1)  # distance symbol 1: code 2, the pixel on the left
    for x in (20, 280 + slot, 21, 257):
        s.put(codes[x], 2)
    # a pixel, the same from the cache, another, then two copies of that; one more to fill the row
    s.put(codes[20], 2)
    got = webp.decode(s.file())[0, :, :3].tolist()
    assert got == [[10, 20, 30], [10, 20, 30], [10, 21, 30], [10, 21, 30], [10, 21, 30], [10, 20, 30]]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    s = head(5, 4)
    s.put(1, 1), s.put(0, 2), s.put(0, 3)
    single(s, mode << 8, main=False)
    s.put(0, 1)
    single(s, 0x01020304)
    got = webp.decode(s.file())[:, :, [3, 0, 1, 2]].astype(int)
    want = np.zeros((4, 5, 4), int)
    for y in range(4):
        for x in range(5):
            at = lambda b, a: want[b, a]  # noqa: B023, E731
            if y == 0:
                p = np.array([255, 0, 0, 0]) if x == 0 else at(0, x - 1)
            elif x == 0:
                p = at(y - 1, 0)
            else:
                left, top, tl = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
                tr = at(y - 1, x + 1) if x < 4 else at(y, 0)
                avg = lambda a, b: (a + b) // 2
                pick = left if np.abs(top - tl).sum() < np.abs(left - tl).sum() else top
                half = avg(left, top)
                p = [np.array([255, 0, 0, 0]), left, top, tr, tl, avg(avg(left, tr), top), avg(left, tl), avg(left, top), avg(tl, top), avg(top, tr), avg(avg(left, tl), avg(top, tr)), pick, np.clip(left + top - tl, 0, 255), np.clip(half + ((half - tl) / 2).astype(int), 0, 255)][mode]
            want[y, x] = (p + [1, 2, 3, 4]) & 255
    assert (got == want).all()


def test_green_cross_colour_and_palette():
    s = head(3, 2)
    s.put(1, 1), s.put(2, 2)  # subtract green
    s.put(1, 1), s.put(1, 2), s.put(0, 3)  # cross-colour with green to red -16, green to blue 32, red to blue 8
    single(s, 8 << 16 | 32 << 8 | 240, main=False)
    s.put(0, 1)
    single(s, 255 << 24 | 5 << 16 | 40 << 8 | 7)
    red = (5 + ((-16 * 40) >> 5)) & 255
    blue = (7 + ((32 * 40) >> 5) + ((8 * (red - 256 if red > 127 else red)) >> 5)) & 255
    assert webp.decode(s.file())[1, 2].tolist() == [(red + 40) & 255, 40, (blue + 40) & 255, 255]
    s = head(5, 1)
    s.put(1, 1), s.put(3, 2), s.put(1, 8)  # two colours, eight pixels a byte
    s.put(0, 1)
    s.simple(9), s.simple(1), s.simple(2), s.simple(255), s.simple(0)  # both entries add (1, 9, 2, 255)
    s.put(0, 1)
    single(s, 0b01101 << 8)
    first, second = [1, 9, 2, 255], [2, 18, 4, 254]
    assert webp.decode(s.file())[0].tolist() == [second, first, second, second, first]


def test_media_round_trip(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", "x", "a" * 192, "é" * 97, "".join(map(chr, rng.integers(32, 1000, 5000))), "line\n" * 300, "x"]
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in webp.read(webp.store(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b" " * (192 - len(raw) if len(raw) < 192 else -len(raw) % 192)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[2].media_sha256 == got[7].media_sha256 and got[2].feature == got[7].feature
    for n in (1, 2, 5, 64, 200, 256):
        a = rng.integers(0, n, (3, 64, 3)).astype(np.uint8)
        assert (webp.decode(webp.encode(a))[:, :, :3] == a).all()
    tall = rng.integers(0, 3, 192 * 16385).astype(np.uint8).tobytes()
    assert webp.from_media(webp.to_media(tall), len(tall))[0] == tall
    with pytest.raises(ValueError):
        webp.decode(b"RIFF\0\0\0\0WEBPVP8 ")
