"""Operator 12, vector code compression: product codes found by equal-average search.

A vector is cut into parts; a part's code is its nearest entry in the codebook of its position.
Entries are sorted by the sum of their components.  From a part's own sum the search goes
outward, nearer sums first: by Cauchy-Schwarz the squared gap of the sums over the dimension is at
most the squared distance, so once it strictly exceeds the best distance no other entry can be
nearer or tie."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, spread_join, stash

#: Components beyond this (in quantised units) could overflow 64-bit distances.
MAX_COMPONENT = 1 << 26


class EqualAverage:
    """Nearest entries (squared Euclidean distance, ties to the lower index) of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64)
        sums = self.entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums = sums[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance for each row of `parts`."""
        k, dim = self.entries.shape
        far = np.iinfo(np.int64).max
        best, arg = np.full(len(parts), far), np.full(len(parts), k)
        sums = parts.sum(axis=1)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        rows = np.arange(len(parts))  # those whose search goes on
        while len(rows):
            s, lo, hi = sums[rows], left[rows], right[rows]
            down = np.where(lo >= 0, s - self.sums[lo], far)
            up = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - s, far)
            gap = np.minimum(down, up)
            # gap ** 2 / dim > best, without squaring what stands for "no entry left".
            go = (gap != far) & (np.minimum(gap, 1 << 31) ** 2 <= np.minimum(best[rows], far // dim) * dim)
            rows, lo, hi, use_left = rows[go], lo[go], hi[go], (down <= up)[go]
            entry = self.order[np.where(use_left, lo, hi)]
            off = parts[rows] - self.entries[entry]
            dist = np.einsum("ij,ij->i", off, off)
            won = (dist < best[rows]) | (dist == best[rows]) & (entry < arg[rows])
            best[rows[won]], arg[rows[won]] = dist[won], entry[won]
            left[rows] -= use_left
            right[rows] += ~use_left
        return arg, best


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label, v: floor(scale * x) of the vectors whose components are all finite; null
    vectors and those with null or non-finite components go."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    return vectors.filter(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `batch` whose v has `width` components, and these as a matrix."""
    v = batch.column(batch.schema.names.index("v"))
    sizes = v.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    flat = v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and np.abs(flat).max() > MAX_COMPONENT:
        raise ValueError(f"a component is beyond {MAX_COMPONENT}, its distances don't fit 64 bits")
    return rows, flat.reshape(len(rows), width)


def _improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floored means of the parts nearest to them; entries without
    parts stay.  Each task sums its parts by entry, so a row an entry and task is all that moves."""
    parts, k, dim = books.shape

    def run(batches):
        totals, counts = np.zeros((parts, k, dim), np.int64), np.zeros((parts, k), np.int64)
        search = [EqualAverage(b) for b in books]
        for b in batches:
            _, m = _matrix(b, parts * dim)
            for p in range(parts if len(m) else 0):
                x = m[:, p * dim:(p + 1) * dim]
                arg, _ = search[p].nearest(x)
                np.add.at(totals[p], arg, x)
                counts[p] += np.bincount(arg, minlength=k)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]),
                                          pa.FixedSizeListArray.from_arrays(pa.array(totals[p, e].ravel()), dim).cast(pa.list_(pa.int64()))],
                                         names=["part", "entry", "n", "sums"])

    sums = rows.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    # Bounded by the parameters: one row for each entry of each codebook.
    got = sums.groupBy("part", "entry").agg(F.sum("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(dim)])).collect()
    out = books.copy()
    for part, entry, n, total in got:
        out[part, entry] = [t // n for t in total]
    return out


def codebooks(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray | None:
    """The codebooks [part, entry, component] of quantised rows: those of the `entries` smallest
    vec_ids (ascending, nulls last, ties by the vector), improved `rounds` times over all rows.

    Fewer rows make fewer entries; None without any.  Vectors are as long as that of the
    smallest vec_id, and `parts` has to divide that."""
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not least:
        return None
    width = len(least[0].v)
    if not width or width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    first = np.array([r.v for r in least if len(r.v) == width], np.int64)
    books = np.ascontiguousarray(first.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _improved(rows, books)
    return books


def books_digest(books: np.ndarray | None) -> str:
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of vectors (vec_id, embedding, label) and the codebooks.

    code: two hex digits a part; error: the part distances' sum.  Repeated rows and null
    vec_ids or labels are kept.  A vector of another length than the first has no such parts: its
    code and error are null.  Components beyond MAX_COMPONENT are an error.  Extra columns
    are ignored; an empty table gives no rows."""
    rows = stash(quantised(vectors, scale), "vectors")
    books = codebooks(rows, parts, entries, rounds)
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")

    def run(batches):
        search = [EqualAverage(b) for b in books]
        dim = books.shape[2]
        for b in batches:
            at, m = _matrix(b, parts * dim)
            code, error = np.zeros((len(m), parts), np.uint8), np.zeros(len(m), np.int64)
            for p in range(parts if len(m) else 0):
                arg, dist = search[p].nearest(m[:, p * dim:(p + 1) * dim])
                code[:, p] = arg
                error += dist
            codes, errors = [None] * b.num_rows, [None] * b.num_rows
            for i, c, e in zip(at.tolist(), code, error.tolist()):
                codes[i], errors[i] = c.tobytes().hex(), e
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                                             names=["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    out = rows.select("vec_id", "label", "v")
    if books is None:
        return out.selectExpr("vec_id", "label", "cast(null as string) AS code", "cast(null as long) AS error"), None
    return out.mapInArrow(run, f"vec_id long, label {label}, code string, error long"), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    found = stash(found, "vector-codes")
    sums = stash(found.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return spread_join(found, sums, "label", "vec_id").select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    def assign(name: str, books: str) -> str:
        return f"""
{name} AS (SELECT rn, part, x, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := entry)) AS m
  FROM p JOIN {books} USING (part) GROUP BY rn, part, x)"""

    def improve(name: str, found: str, books: str) -> str:
        return f"""
{name} AS (SELECT b.part, b.entry, coalesce(s.c, b.c) AS c FROM {books} b LEFT JOIN (
    SELECT part, entry, list(v ORDER BY j) AS c FROM (
      SELECT part, m.e AS entry, j, CAST(floor(sum(x[j])::DOUBLE / count(*)) AS BIGINT) AS v FROM {found}, range(1, 5) t(j) GROUP BY part, m.e, j)
    GROUP BY part, entry) s ON b.part = s.part AND b.entry = s.entry)"""

    return f"""
WITH q AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rn FROM q),
p AS MATERIALIZED (SELECT rn, part, v[4 * part + 1:4 * part + 4] AS x FROM k, range(16) t(part)),
b0 AS (SELECT part, rn - 1 AS entry, x AS c FROM p WHERE rn <= 64),{assign("a1", "b0")},{improve("b1", "a1", "b0")},{assign("a2", "b1")},{improve("b2", "a2", "b1")},{assign("a3", "b2")},
r AS (SELECT rn, string_agg(lower(printf('%02x', CAST(m.e AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a3 GROUP BY rn)
SELECT k.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM k JOIN r USING (rn)
"""


ORACLE = _oracle()
