"""Operator 10, SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint has eight positional bytes.  Two fingerprints that differ in at most two bits
differ in at most two of those bytes, so they share at least six positional bytes: the
guaranteed minimum.  The index posts each distinct fingerprint under each of the 28 choices of
six positional bytes, so meeting under a key is reaching that minimum.  The bit distance is then
verified among the fingerprints of a key, which differ in two bytes only: there are never more
than 65,536 of them, however many documents are alike."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stash
from .components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included; zero for a text without words.
    A-Z are lower-cased; a bit is set if it is in over half of the shingles' XXH64 (seed 42)."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), 42)]
    else:
        # One join; a shingle is then a slice of it.
        line = b" ".join(words)
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
        starts, ends = at[:-shingle].tolist(), (at[shingle:] - 1).tolist()
        hashes = [digest(line[s:e], 42) for s, e in zip(starts, ends)]
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):  # long texts in slices
        h = np.array(hashes[i:i + (1 << 14)], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _forest(fps: np.ndarray, pair: tuple[int, int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within `bits` bits among distinct fingerprints that differ
    only in the two bytes of `pair`: each 16-bit value looks up its 136 neighbours."""
    u = fps.view(np.uint64)
    value = ((u >> np.uint64(8 * pair[0])) & np.uint64(255)) | (((u >> np.uint64(8 * pair[1])) & np.uint64(255)) << np.uint64(8))
    value = value.astype(np.int64)
    flips = [0] + [sum(1 << i for i in c) for k in range(1, bits + 1) for c in combinations(range(16), k)]
    place = np.full(1 << 16, -1, np.int64)
    place[value] = np.arange(len(fps))
    root = np.arange(len(fps))
    a_out, b_out = [], []
    for f in flips[1:]:
        j = place[value ^ f]
        i = np.flatnonzero((j >= 0) & (j < np.arange(len(fps))))
        for x, y in zip(i.tolist(), j[i].tolist()):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                a_out.append(max(x, y))
                b_out.append(min(x, y))
    return fps[a_out], fps[b_out]


PAIRS = list(combinations(range(8), 2))


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) within `bits` (at most 2) bits, a
    spanning forest of those under each index key."""
    keep = np.array([~((255 << (8 * i)) | (255 << (8 * j))) & (1 << 64) - 1 for i, j in PAIRS], np.uint64).view(np.int64).tolist()
    postings = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(k)) for k in keep])).alias("k", "part"))
    dealt = postings.repartition(F.col("k"), F.col("part")).sortWithinPartitions("k", "part", "fp")

    def verify(batches):
        held = None
        for b in batches:
            fp, k, part = (np.asarray(b.column(i)) for i in range(3))
            if held is not None:
                fp, k, part = np.concatenate([held[0], fp]), np.concatenate([held[1], k]), np.concatenate([held[2], part])
            if not len(fp):
                continue
            # The last key may go on in the next batch; it holds 65,536 rows at most.
            same = (k[1:] == k[:-1]) & (part[1:] == part[:-1])
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            cut = starts[-1]
            held = (fp[cut:], k[cut:], part[cut:])
            yield from found(fp[:cut], k[:cut], starts[:-1], cut)
        if held is not None and len(held[0]):
            yield from found(held[0], held[1], np.zeros(1, np.int64), len(held[0]))

    def found(fp, k, starts, end):
        ends = np.append(starts[1:], end)
        a, b = [], []
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            if e - s == 2:
                if ((int(fp[s]) ^ int(fp[s + 1])) & ((1 << 64) - 1)).bit_count() <= bits:
                    a.append(fp[s:s + 1])
                    b.append(fp[s + 1:e])
            else:
                x, y = _forest(fp[s:e], PAIRS[int(k[s])], bits)
                a.append(x)
                b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return dealt.mapInArrow(verify, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, bits: int = 2, name: str = "simhash") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, itself included.  Null and empty texts
    have fingerprint zero and link as any other.  Equal fingerprints meet as one index entry, so
    copies never form pairs.  Repeated rows are kept; null doc_ids are kept and take the
    component of their fingerprint (null if it holds no doc_id)."""
    fps = stash(fingerprints(docs, shingle), f"{name}-fps")
    out = fps.join(fingerprint_classes(fps, bits, name), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_classes(fps: DataFrame, bits: int = 2, name: str = "simhash") -> DataFrame:
    """(fp, root, component_id) for every fingerprint of fps (doc_id, fp): a fingerprint of its
    component, which all of the component share, and the smallest doc_id there, null without any."""
    distinct = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), f"{name}-distinct", fps.count())
    n = distinct.count()
    met = stash(links(distinct, bits), f"{name}-links", len(PAIRS) * n)  # by what it reads: it verifies as it writes
    star = stash(components(met, f"{name}-cc"), f"{name}-star", n)
    rooted = stash(distinct.join(star, distinct["fp"] == star["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), f"{name}-rooted", n)
    smallest = stash(rooted.groupBy("root").agg(F.min("first").alias("component_id")), f"{name}-smallest", n)
    return stash(rooted.join(smallest, "root").select("fp", "root", "component_id"), f"{name}-classes", n)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"))
