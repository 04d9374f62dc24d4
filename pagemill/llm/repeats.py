"""Operator 4, suffix-array dedup by prefix-free parsing: remove each byte covered by a string
of `length` bytes that also starts anywhere else.

A rolling hash over each text marks triggers; the text from one trigger to the next is a phrase.
Whether a position's string of `length` bytes occurs elsewhere is decided by its neighbours in
the order of all such suffixes.  As in prefix-free parsing, that order comes from two parts:

* the parse: the positions between two triggers share one phrase and the text that follows.  Units
  (a trigger with the positions before it) are sorted by a hash of a core that all their strings
  hold, then by a hash of their whole context.  Equal neighbours repeat as a whole: all their
  positions are settled by one row, however long the repeated text and however many its copies.
  A core that stands alone settles its positions as unique.
* the dictionary: only units whose core has neighbours with another context are expanded to
  single positions, which are sorted by a hash of their string.  Of equal units the first and
  the last stand for the rest.

Order by hash replaces lexicographic order, since only equality of prefixes matters here.  All
sorts are Spark's; no text is compared on one machine, and matches never cross documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stash

#: Bytes of the trigger window, and one in how many windows is a trigger (a power of two).
TRIGGER, EVERY = 16, 64
#: Positions of a unit reach this far before its trigger; farther ones are units of their own.
TIER = 128
#: Bytes of a text that are parsed at once.
SLICE = 1 << 20

_M1, _M2, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_B, pow(_B, -1, 2**64))]
    return _POWERS[0], _POWERS[1]


class Rolling:
    """Rolling hash of a byte string: any part of 8 bytes or more in two lookups.  The terms are
    mixed 8-byte grams, so that patterns of a polynomial hash modulo 2**64 can't line up."""

    def __init__(self, data: np.ndarray):
        n = max(0, len(data) - 7)
        self.n = n
        if not n:
            self.sums = np.zeros(1, np.uint64)
            return
        grams = np.ndarray((n,), "<u8", np.ascontiguousarray(data).data, strides=(1,)) * np.uint64(_M1)
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(_M2)
        grams ^= grams >> np.uint64(29)
        power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(grams * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end - 7] - self.sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_M1)
        return h ^ (h >> np.uint64(29))


def units(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(core, context, trigger, least, most) of each unit of a text: its positions are trigger - o
    for o from least to most.  Where a position's string holds no trigger, triggers of a second,
    eight times as frequent kind serve; positions without any are units alone."""
    n = len(data)
    out: list[tuple] = []
    reach = length - TRIGGER
    for s in range(0, n - length + 1, SLICE):
        left = max(0, s - length)
        part = data[left:min(n, s + SLICE + 2 * length)]
        roll = Rolling(part)
        last = len(part) - length  # the last position, in the slice
        final = n - length - left  # in the text
        starts = np.arange(len(part) - TRIGGER + 1)
        mark = roll.of(starts, starts + TRIGGER)
        first, stop = s - left, min(s + SLICE, n) - left
        whole = s + SLICE > n - length  # the last slice has the triggers to the end
        at = np.arange(first, min(stop, final + 1))
        never, edge = 1 << 60, -1 - left if left == 0 else -(1 << 40)
        outer = np.zeros(0, np.int64)
        for every in (EVERY, max(1, EVERY // 8)):  # the second where the first leaves a string without
            marked = np.flatnonzero(mark <= np.uint64((2**64 - 1) // every))
            mine = (marked >= first) & (whole | (marked < stop))
            t = marked[mine]
            b = np.concatenate([[edge], marked])[:-1][mine]
            # A position belongs to the second kind where the next trigger of the first is out of its reach.
            i = np.searchsorted(outer, t)
            b = np.maximum(b, np.concatenate([[edge], outer])[i])
            latest = np.minimum(final, np.append(outer, never)[i] - reach - 1) if every != EVERY else np.full(len(t), final)
            far = np.minimum(np.minimum(t - b - 1, reach), t + left)
            near = np.maximum(0, t - latest)
            for j in range(reach // TIER + 1):
                lo, hi = np.maximum(near, j * TIER), np.minimum(far, (j + 1) * TIER - 1)
                ok = lo <= hi
                x, lo, hi = t[ok], lo[ok], hi[ok]
                core = x - j * TIER
                out.append((roll.of(core, core + length - TIER), roll.of(x - hi, x - lo + length), x + left, lo, hi, np.full(len(x), j + (16 if every != EVERY else 0))))
            at = at[np.append(marked, never)[np.searchsorted(marked, at)] > at + reach]
            outer = marked
        # Positions whose string holds no trigger of either kind.
        out.append((roll.of(at, at + length), roll.of(at, at + length // 2), at + left, np.zeros_like(at), np.zeros_like(at), np.full(len(at), 99)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    core, context, t, lo, hi, tier = (np.concatenate(c) for c in zip(*out))
    core = (core ^ (tier.astype(np.uint64) * np.uint64(_M2))).view(np.int64)
    context = (context ^ ((lo * 1024 + hi).astype(np.uint64) * np.uint64(_M2))).view(np.int64)
    return core, context, t, lo, hi


def _place(t, lo, hi):
    return (t << 20) | (lo << 10) | hi


def _bytes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)


def _neighbours(rows: DataFrame, key: list[str], then: str) -> DataFrame:
    """Rows with same_before, same_after (a neighbour equal in `key` and `then`) and other_before,
    other_after (equal in `key` alone), in the order of `key`, `then`.  Only one row is looked at
    on either side, so a hot key is streamed."""
    w = Window.partitionBy(*key).orderBy(then, "doc_id", "text_id", "place")
    before, after, own = F.lag(then).over(w), F.lead(then).over(w), F.col(then)
    no = F.lit(False)
    return rows.withColumns({"same_before": F.coalesce(before == own, no), "same_after": F.coalesce(after == own, no),
                             "other_before": F.coalesce(before != own, no), "other_after": F.coalesce(after != own, no)})


class KeyFilter:
    """A Bloom filter of (doc_id, text_id) keys, to leave texts out of a shuffle that joins them
    with those keys.  It has 16 MB whatever the number of keys (up to some ten million keys it lets
    few others through, beyond them more), so it is safe to send to every task; the join decides.
    Tasks set their bits locally; the parts that have any are united in Spark."""

    BITS, PART = 27, 19  # of the filter and of one part, as powers of two

    def __init__(self, keys: DataFrame):
        bits, part = self.BITS, self.PART

        def local(batches):
            field = np.zeros(1 << (bits - 3), np.uint8)
            for b in batches:
                at = KeyFilter.places(np.asarray(b.column(0))).ravel()
                np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
            parts = field.reshape(-1, 1 << (part - 3))
            used = np.flatnonzero(parts.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["part", "field"])

        def unite(batches):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for i, f in zip(b.column(0).to_pylist(), b.column(1)):
                    x = np.frombuffer(f.as_buffer(), np.uint8)
                    held[i] = held[i] | x if i in held else x
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "field"])

        schema = "part int, field binary"
        parts = keys.select(F.xxhash64("doc_id", "text_id").alias("key")).mapInArrow(local, schema).repartition(16, "part").mapInArrow(unite, schema)
        field = np.zeros((1 << (bits - part), 1 << (part - 3)), np.uint8)
        for r in parts.collect():  # 16 MB
            field[r["part"]] = np.frombuffer(r["field"], np.uint8)
        self.field = keys.sparkSession.sparkContext.broadcast(field.ravel())

    @staticmethod
    def places(keys: np.ndarray) -> np.ndarray:
        """Four bit places a key."""
        k = keys.astype(np.int64).view(np.uint64)
        step = (k >> np.uint64(32)) | np.uint64(1)
        return np.stack([((k + np.uint64(i) * step) * np.uint64(_M1)) >> np.uint64(64 - KeyFilter.BITS) for i in range(4)]).astype(np.int64)

    def keep(self, texts: DataFrame) -> DataFrame:
        field = self.field

        @F.pandas_udf("boolean")
        def there(keys: pd.Series) -> pd.Series:
            at = KeyFilter.places(keys.to_numpy())
            return pd.Series(((field.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0))

        return texts.filter(there(F.xxhash64("doc_id", "text_id")))


def repeated_spans(docs: DataFrame, length: int = 400, name: str = "repeats") -> DataFrame:
    """(doc_id, text_id, spans) for the texts with bytes to remove; text_id: xxhash64 of the text;
    spans: (start, end) in UTF-8 bytes, unsorted, they may overlap."""
    if length < 2 * TIER + TRIGGER or length > 1000:
        raise ValueError("length: 272 to 1000")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), F.encode("text", "UTF-8").alias("data"))

    def parse(batches):
        for b in batches:
            found = [(r, units(_bytes(t), length)) for r, t in enumerate(b.column(2)) if t.is_valid]
            found = [(r, u) for r, u in found if len(u[0])]
            rows = np.repeat([r for r, _ in found], [len(u[0]) for _, u in found]).astype(np.int64)
            core, context, t, lo, hi = (np.concatenate([u[i] for _, u in found]) if found else np.zeros(0, np.int64) for i in range(5))
            # Equal units of one text go as one row, which has the places of the others.
            order = np.lexsort((t, context, core, rows))
            rows, core, context, place = rows[order], core[order], context[order], _place(t, lo, hi)[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (core[1:] != core[:-1]) | (context[1:] != context[:-1])
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(rows))) - 1
            offsets = pa.array(np.append(np.cumsum(sizes) - sizes, sizes.sum()), pa.int32(), mask=np.append(sizes == 0, False))
            more = pa.ListArray.from_arrays(offsets, pa.array(place[~new]))
            who = pa.array(rows[first])
            yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(1).take(who), pa.array(core[first]), pa.array(context[first]), pa.array(place[first]), more],
                                             names=["doc_id", "text_id", "core", "context", "place", "more"])

    parsed = src.mapInArrow(parse, "doc_id long, text_id long, core long, context long, place long, more array<long>")
    near = _neighbours(parsed, ["core"], "context")
    settled = F.col("same_before") | F.col("same_after") | F.col("more").isNotNull()
    # The first and the last of equal units stand for them where other contexts meet the core.
    expand = F.col("other_before") | F.col("other_after")
    marked = stash(near.filter(settled | expand).select("doc_id", "text_id", "place", "more", settled.alias("settled"), expand.alias("expand")), f"{name}-units")

    lists = stash(marked.filter("expand").groupBy("doc_id", "text_id").agg(F.collect_list("place").alias("places")), f"{name}-open")

    def positions(batches):
        for b in batches:
            rows, h1, h2, place = [], [], [], []
            for r, (t, places) in enumerate(zip(b.column(2), b.column(3))):
                data, p = _bytes(t), places.values.to_numpy()
                x, lo, hi = p >> 20, (p >> 10) & 1023, p & 1023
                sizes = hi - lo + 1
                o = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = np.unique(np.repeat(x - hi, sizes) + o)
                for s in range(0, len(data) - length + 1, SLICE):
                    a = at[(at >= s) & (at < s + SLICE)] - s
                    if len(a):
                        roll = Rolling(data[s:s + SLICE + length])
                        h1.append(roll.of(a, a + length))
                        h2.append(roll.of(a, a + length // 2))
                        place.append(a + s)
                        rows.append(np.full(len(a), r))
            half = [h & np.uint64(0xFFFFFFFF) for h in h2]  # 96 bits tell strings apart
            cat = lambda v, kind: np.concatenate(v) if v else np.zeros(0, kind)
            rows = pa.array(cat(rows, np.int64).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(cat(h1, np.uint64).view(np.int64)),
                                              pa.array(cat(half, np.uint64).astype(np.uint32).view(np.int32)), pa.array(cat(place, np.int64))], names=["doc_id", "text_id", "h1", "h2", "place"])

    open_texts = KeyFilter(lists).keep(src).join(lists, (src["doc_id"].eqNullSafe(lists["doc_id"])) & (src["text_id"] == lists["text_id"])).select(src["doc_id"], src["text_id"], "data", "places")
    single = open_texts.mapInArrow(positions, "doc_id long, text_id long, h1 long, h2 int, place long")
    equal = _neighbours(single, ["h1"], "h2").filter("same_before or same_after").select("doc_id", "text_id", "place")
    t, lo, hi = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(F.lit(1023)), F.col("place").bitwiseAND(F.lit(1023))
    everywhere = F.explode(F.concat(F.array("place"), F.coalesce("more", F.array().cast("array<bigint>"))))
    spans = marked.filter("settled").select("doc_id", "text_id", everywhere.alias("place")).select("doc_id", "text_id", (t - hi).alias("start"), (t - lo + length).alias("end"))
    spans = spans.unionByName(equal.select("doc_id", "text_id", F.col("place").alias("start"), (F.col("place") + length).alias("end")))
    return spans.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 400, name: str = "repeats") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text).

    Null and empty texts have no bytes.  Texts under `length` bytes keep all.  Repeated rows
    are copies of one another: both lose what they share.  Null doc_ids are kept."""
    spans = stash(repeated_spans(docs, length, name), f"{name}-spans")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), F.encode("text", "UTF-8").alias("data"))
    # Texts with nothing to remove don't move: their digest is taken where they are read.
    whole = src.select("doc_id", "text_id", F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("n_bytes"),
                       F.sha2(F.coalesce("data", F.lit(b"")), 256).alias("whole_sha256"))

    def cut(batches):
        for b in batches:
            out = []
            for t, s in zip(b.column(2), b.column(3)):
                data, edges = _bytes(t), s.values
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, edges.field("start").to_numpy(), 1)
                np.add.at(change, edges.field("end").to_numpy(), -1)
                gone = np.cumsum(change[:-1]) > 0
                out.append((int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                                             names=["doc_id", "text_id", "n_removed", "n_spans", "cut_sha256"])

    met = KeyFilter(spans).keep(src).join(spans, src["doc_id"].eqNullSafe(spans["doc_id"]) & (src["text_id"] == spans["text_id"])).select(src["doc_id"], src["text_id"], "data", "spans")
    done = met.mapInArrow(cut, "doc_id long, text_id long, n_removed long, n_spans long, cut_sha256 string")
    done = stash(done, f"{name}-cut").dropDuplicates(["doc_id", "text_id"])
    out = whole.join(done.select(F.col("doc_id").alias("d"), F.col("text_id").alias("t"), "n_removed", "n_spans", "cut_sha256"),
                     F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_id") == F.col("t")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
                      F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
