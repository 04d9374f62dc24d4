"""Repeated strings against a count of all strings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import repeats

from .conftest import make, prose


def brute(texts, length):
    count = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if count[t[p:p + length]] > 1:
                gone[p:p + length] = True
        yield gone


def corpus(rng):
    a, b = prose(rng, 400), prose(rng, 300)
    texts = [a, a, a[:500] + "X" + a[501:], prose(rng, 100) + a[200:900] + prose(rng, 50), b + prose(rng, 20) + b, a[300:699], a[300:700] + b[:390]]
    texts += [b[i * 30:i * 30 + 600] + prose(rng, 40) for i in range(8)]                 # shifted overlaps
    texts += ["z" * 1500, "z" * 399, "z" * 400, "ab" * 500, "é" * 450, "", None, prose(rng, 300)]
    texts += [prose(rng, 30) + b[:420] + prose(rng, 30) for _ in range(12)]              # a passage in other contexts
    texts += ["".join(rng.choice("ab") for _ in range(2000)), prose(rng, 4000)]
    return texts


@pytest.mark.parametrize("length,every,cut", [(400, 64, 1 << 20), (400, 64, 700), (300, 4, 1 << 20), (400, 1 << 40, 1 << 20)])
def test_removed_bytes(spark, monkeypatch, length, every, cut):
    rng = random.Random(length + cut)
    texts = corpus(rng)
    spans = list(brute([(t or "").encode() for t in texts], length))
    # The parse of every text covers each position once, whatever the triggers and slices.
    monkeypatch.setattr(repeats, "EVERY", every)
    monkeypatch.setattr(repeats, "SLICE", cut)
    for t in texts:
        data = (t or "").encode()
        _, _, at, lo, hi = repeats.units(np.frombuffer(data, np.uint8), length)
        seen = Counter(p for x, a, b in zip(at, lo, hi) for p in range(x - b, x - a + 1))
        assert seen == Counter(range(len(data) - length + 1))
    monkeypatch.undo()
    if every != 64:
        return
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in repeats.remove_repeats(make(spark, rows), length).collect()}
    assert len(out) == len(rows)
    for (i, t, _), gone in zip(rows, spans):
        data, r = np.frombuffer((t or "").encode(), np.uint8), out[i]
        n_spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), int(gone.sum()), n_spans)
        assert r.kept_sha256 == hashlib.sha256(data[~gone].tobytes()).hexdigest()


def test_odd_rows(spark, odd_rows):
    long = "q" * 399 + "r" * 200
    rows = odd_rows + [(80, long, "s"), (80, long, "s"), (None, long, None), (81, long[:-1], "s")]
    out = repeats.remove_repeats(make(spark, rows)).collect()
    assert len(out) == len(rows)
    assert sorted(r.n_removed for r in out if r.n_bytes in (598, 599)) == [598, 599, 599, 599]
    assert repeats.remove_repeats(make(spark, [])).count() == 0
