"""Operator 13, target-distribution importance resampling by bit-sliced aggregation.

Hashed n-gram features; a bucket's gain says how much likelier the target (the benchmark) is to
use it than the corpus.  A document's weight is the sum of its buckets' counts times their gains.
Counts and gains are held bit by bit, as planes of one bit a bucket: for count bit i and gain bit j
the ones common to both planes, counted and times 2 ** (i + j), add up to the exact weight."""

from __future__ import annotations

import math
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, running_totals, stash

BUCKETS = 10_000
#: Bytes of a word, A-Z lower-cased; all other ASCII bytes part words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_STEP = 64  # documents whose counts are in memory at once


def feature_buckets(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Words of a text, and the bucket of each run of one to three words: the crc32 of a run goes on
    from that of the run without its last word."""
    words = text.translate(_WORD_BYTES).split()
    tails = [b" " + w for w in words]
    ones = list(map(crc32, words))
    twos = list(map(crc32, tails[1:], ones))
    threes = list(map(crc32, tails[2:], twos))
    n = len(ones) + len(twos) + len(threes)
    return len(words), np.fromiter(chain(ones, twos, threes), np.int64, n) % buckets


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    column = batch.column(batch.schema.names.index("text")).cast(pa.binary())
    return [b"" if t is None else t for t in column.to_pylist()]


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts of `rows` each bucket holds (a row a bucket and task moves)."""
    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for b in batches:
            for text in _texts(b):
                counts += np.bincount(feature_buckets(text, buckets)[1], minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n  # bounded by the parameter: one row a bucket
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed odds of the target against the corpus."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def planes(values: np.ndarray) -> np.ndarray:
    """The bits of non-negative `values` [..., bucket], lowest plane first: [plane, ..., word]."""
    n = max(1, int(values.max(initial=0)).bit_length())
    pad = -values.shape[-1] % 64
    values = np.concatenate([values, np.zeros((*values.shape[:-1], pad), values.dtype)], axis=-1)
    return np.stack([np.packbits((values >> i & 1).astype(np.uint8), axis=-1).view(np.uint64) for i in range(n)])


class GainPlanes:
    """Signed gains as bit planes: those of the positive gains, and of the negative ones' size."""

    def __init__(self, gain: np.ndarray):
        signed = [(1, planes(np.maximum(gain, 0))), (-1, planes(np.maximum(-gain, 0)))]
        self.bits = np.concatenate([p for _, p in signed])
        self.worth = np.concatenate([sign * (1 << np.arange(len(p), dtype=np.int64)) for sign, p in signed])

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """The weight of each row of `counts` [document, bucket]."""
        out = np.zeros(len(counts), np.int64)
        most = counts.max(axis=1, initial=0)
        for i in range(int(most.max(initial=0)).bit_length()):
            rows = np.flatnonzero(most >> i)  # the others have no such plane
            plane = planes(counts[rows] >> i & 1)[0]
            ones = np.stack([np.bitwise_count(plane & bits).sum(axis=-1, dtype=np.int64) for bits in self.bits], axis=-1)
            out[rows] += (ones @ self.worth) << i
        return out


def document_weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of docs (doc_id, text)."""
    def run(batches):
        sliced = GainPlanes(gain)
        k = len(gain)
        for b in batches:
            ids, texts = b.column(0), _texts(b)
            for s in range(0, len(texts), _STEP):
                found = [feature_buckets(t, k) for t in texts[s:s + _STEP]]
                at = np.concatenate([f + i * k for i, (_, f) in enumerate(found)])
                counts = np.bincount(at, minlength=len(found) * k).reshape(len(found), k)
                yield pa.RecordBatch.from_arrays([ids.slice(s, len(found)), pa.array([n for n, _ in found], pa.int64()), pa.array([len(f) for _, f in found], pa.int64()),
                                                  pa.array(sliced.weights(counts))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """floor(1000 times) a Gumbel draw that the doc_id decides (a null one as an empty text)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of docs (doc_id, text): rank is
    the place among the drawn, null for the others.

    Drawn are the floor(percent * N / 100) highest scores of the N documents with `least_words` words
    or more, without replacement (weight plus Gumbel noise); ties go to the smaller doc_id (nulls
    last), then to more features.  Repeated rows are documents of their own.  A null text is
    empty; extra columns are ignored; with an empty target the gains are those of no target."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = stash(document_weights(docs, gain).withColumn("score", F.col("weight") + gumbel(seed)), "resample-weights")
    rows = rows.withColumn("fit", (F.col("n_words") >= least_words).cast("long"))
    n = rows.agg(F.sum("fit")).first()[0] or 0
    placed = running_totals(rows, [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.desc("n_features"), F.desc("n_words")], "fit", "place", name="resample-order")
    drawn = (F.col("fit") == 1) & (F.col("place") <= percent * n // 100)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("place")).alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
