"""The encoder uses what the decoder reads: codes by frequency, copies, colour cache and transforms."""

from random import Random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyspark.llm import webp


def used(monkeypatch, texts):
    """How often each part of the decoder ran while the texts went to media and back."""
    seen = {}
    for name in ("undo_predictor", "undo_green", "undo_palette", "with_cache", "taken", "read_tokens", "static_codes", "read_code"):

        def counted(*a, f=getattr(webp, name), name=name):
            out = f(*a)
            seen[name] = seen.get(name, 0) + (out is not None)
            return out

        monkeypatch.setattr(webp, name, counted)
    for t in texts:
        payload = webp.payload_of(t)
        assert webp.from_media(webp.to_media(payload), len(payload))[0] == payload
    return seen


def test_documents_use_codes_copies_and_cache(monkeypatch, sf):
    texts = [(x or "").encode() for x in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()]
    seen = used(monkeypatch, texts)
    assert seen["read_tokens"] > 0.9 * len(texts)
    assert all(seen.get(k, 0) > 0 for k in ("taken", "with_cache", "static_codes", "read_code")), seen


@pytest.mark.parametrize("part", ["undo_palette", "undo_predictor", "undo_green"])
def test_transforms_where_they_pay(monkeypatch, part):
    rng = Random(2)
    column = [rng.randrange(256) for _ in range(192)]
    texts = {
        "undo_palette": bytes(x for _ in range(4000) for x in rng.choice([(1, 2, 3), (7, 7, 7), (0, 9, 200)])),
        "undo_predictor": b"".join(bytes((v + (rng.random() < 0.3)) % 256 for v in column) for _ in range(60)),
        "undo_green": bytes(x for _ in range(5000) for x in [rng.randrange(256)] * 3),
    }
    assert used(monkeypatch, [texts[part]]).get(part, 0) == 1


@pytest.mark.parametrize("seed", range(6))
def test_any_bytes_come_back(monkeypatch, seed):
    rng = Random(seed)
    alphabet = rng.choice([bytes(range(256)), b"ab", b"the quick brown fox ", bytes(range(20))])
    texts = []
    for n in (0, 1, 191, 192, 193, 5000, 60_000):
        raw = bytes(rng.choice(alphabet) for _ in range(n))
        at = rng.randrange(n + 1)
        texts.append(raw + raw[at : at + 1000] * 3)
    used(monkeypatch, texts)


def test_codes_are_complete_and_of_bounded_depth():
    rng = np.random.default_rng(4)
    for n in (2, 3, 17, 280, 536):
        count = (rng.random(n) ** 9 * 1e6).astype(np.int64) + 1
        k = webp.code_lengths(count, webp.DEEPEST)
        assert k.max() <= webp.DEEPEST and sum(2.0 ** -int(x) for x in k) == 1
        assert k[count.argmax()] == k.min()
