"""Operators 12 and 13 against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.llm import resample, vectorcode

from .conftest import make

VECTORS = "vec_id long, embedding array<float>, label int"


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.integers(1, 20), st.integers(1, 12), st.randoms())
def test_equal_average_search_is_exact(dim, k, n, rnd):
    entries = np.array([[rnd.randint(-4, 4) for _ in range(dim)] for _ in range(k)])
    x = np.array([[rnd.randint(-6, 6) for _ in range(dim)] for _ in range(n)])
    arg, dist = vectorcode.EqualAverage(entries).nearest(x)
    all_ = ((x[:, None] - entries[None]) ** 2).sum(-1)
    assert (dist == all_.min(1)).all() and (arg == all_.argmin(1)).all()


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(v, [math.floor(256 * float(np.float32(x))) for x in e], lab) for v, e, lab in rows
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dim = len(kept[0][1]) // parts
    m = np.array([r[1] for r in kept]).reshape(len(kept), parts, dim)
    books = m[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((m[:, :, None] - books[None]) ** 2).sum(-1)
        return d.argmin(-1), d.min(-1)
    for _ in range(rounds):
        a, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                x = m[a[:, p] == e, p]
                if len(x):
                    books[p, e] = [int(s) // len(x) for s in x.sum(0)]
    a, d = assign()
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    error, by_label = d.sum(1), Counter()
    for r, e in zip(kept, error.tolist()):
        by_label[r[2]] += e
    return sorted([(r[0], bytes(c.astype(np.uint8).tolist()).hex(), int(e), by_label[r[2]], digest) for r, c, e in zip(kept, a, error)], key=str)


def run_codes(spark, tmp_path, rows, monkeypatch):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    for c in ("v", "n", "code", "error", "label_error", "_hot", "part"):
        df = df.withColumn(c, F.lit("x"))
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    return sorted(map(tuple, vectorcode.query(spark, str(tmp_path)).collect()), key=str)


def test_codes(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)], rng.choice([0, 1, 1, None])) for i in range(150)]
    rows += [rows[5], rows[5], (None, rows[9][1], 1), (900, rows[9][1], None), (901, None, 0), (902, [float("nan")] * 32, 0),
             (903, [float("inf")] + [0.0] * 31, 0), (-3, [None] + [0.0] * 31, 0), (904, [0.0] * 32, 7), (-1, [-0.001] * 32, 7)]
    assert run_codes(spark, tmp_path, rows, monkeypatch) == brute_codes(rows)


@pytest.mark.parametrize("n", [0, 3])
def test_few_vectors(spark, tmp_path, monkeypatch, n):
    rows = [(i, [float(i)] * 16, None) for i in range(n)]
    assert run_codes(spark, tmp_path, rows, monkeypatch) == brute_codes(rows)


def test_other_lengths_have_no_code(spark):
    rows = [(1, [0.5] * 16, 1), (2, [0.5] * 8, 1), (3, [], None)]
    got, _ = vectorcode.compress(spark.createDataFrame(rows, VECTORS))
    assert sorted((r.vec_id, r.code is None, r.error) for r in got.collect()) == [(1, False, 0), (2, True, None), (3, True, None)]


def features(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    runs = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute_resample(docs, target, percent=5):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000)))) for b in range(10000)]
    out = []
    for d, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted([r for r in out if r[1] >= 20], key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[:percent * len(fit) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=str)


def test_resample(spark, odd_rows):
    target = [odd_rows[2][1], "Zürich ÉTÉ naïve — 42nd   Street", None, "", "the the the " * 700]
    rows = odd_rows + [(40, "The the THE " * 3000, "s1"), (41, "a-b_c'd\x7f9 x y", "s1")]
    docs = make(spark, rows).repartition(3)
    for c in ("weight", "score", "rank", "place", "fit", "n_features"):
        docs = docs.withColumn(c, F.lit("x"))
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for percent in (5, 40):
        got = resample.resample(docs, items, percent=percent)
        assert sorted(map(tuple, got.collect()), key=str) == brute_resample([(d, t) for d, t, _ in rows], target, percent)


def test_resample_empty_tables(spark, odd_rows):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some text here")], "item_id long, text string")
    assert resample.resample(none, items).count() == 0
    docs = [(d, t) for d, t, _ in odd_rows]
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), items.filter("false"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(docs, [])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 5), st.randoms())
def test_planes_give_the_dot_product(buckets, n, rnd):
    gain = np.array([rnd.choice([0, 1, -1, rnd.randint(-20000, 20000)]) for _ in range(buckets)])
    counts = np.array([[rnd.choice([0, 0, 1, rnd.randint(0, 70000)]) for _ in range(buckets)] for _ in range(n)])
    assert (resample.GainPlanes(gain).weights(counts) == counts @ gain).all()
