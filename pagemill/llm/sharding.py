"""Operator 1, sharding: minimax contiguous partition.

Rows with equal keys form one atomic group; groups are ordered by key.  The smallest capacity
for which a greedy left-to-right filling needs no more than the wanted number of shards is
found by search, and the ordered groups are cut within it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, running_totals, stash, unused

#: Capacities tested at once in a round of the search.
WIDTH = 4096


def _containing(groups: DataFrame, xs: np.ndarray, total: int) -> list[tuple[int, int, int | None]]:
    """(start, end, key) of the group that holds each offset x: start <= x < end.  An offset at
    the total gives (total, total, None).  One row an offset, from the groups near them."""
    xs = np.asarray(xs, np.int64)

    def find(batches):
        for b in batches:
            start, end, key = (np.asarray(b.column(i)) for i in range(3))
            if len(start):
                order = np.argsort(start)
                start, end, key = start[order], end[order], key[order]
                i = np.searchsorted(start, xs, "right") - 1
                m = np.flatnonzero((i >= 0) & (xs < end[i]))
                i = i[m]
                yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(start[i]), pa.array(end[i]), pa.array(key[i])], names=["m", "start", "end", "key"])

    near = groups.filter((F.col("end") > int(xs.min())) & (F.col("start") <= int(xs.max())))
    found = near.select("start", "end", "key").mapInArrow(find, "m int, start long, end long, key long")
    out: list[tuple[int, int, int | None]] = [(total, total, None)] * len(xs)
    for r in found.collect():
        out[r["m"]] = (r["start"], r["end"], r["key"])
    return out


def _floor(groups: DataFrame, xs: np.ndarray, total: int) -> np.ndarray:
    """The last place at or below each offset where groups can be cut."""
    return np.array([e[0] for e in _containing(groups, xs, total)], np.int64)


def minimax_cuts(groups: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int | None]]:
    """(smallest capacity, the first key of each shard but the first; None: no group is left for
    it).  groups: start, end, key - the running totals before and after each group, in key
    order; total and largest: of the sizes.

    A round tests WIDTH capacities at once: the greedy filling of all of them advances by one
    shard with each lookup job.  Within the capacity found, each cut goes to the place nearest
    to an even split of what is left; forward and backward greedy fillings bound where it may
    be, so no shard exceeds the capacity."""
    if total == 0 or shards == 1:
        return total, [None] * (shards - 1)
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    while low < high:
        caps = np.unique(np.linspace(low, high - 1, min(WIDTH, high - low)).astype(np.int64))
        at = np.zeros(len(caps), np.int64)
        for _ in range(shards - 1):
            at = _floor(groups, np.minimum(at + caps, total), total)
        good = np.flatnonzero(total - at <= caps)
        if len(good):
            high = int(caps[good[0]])
            low = int(caps[good[0] - 1]) + 1 if good[0] else low
        else:
            low = int(caps[-1]) + 1
    cap = high
    latest, earliest = [0], [total]
    for _ in range(shards - 1):
        x = max(earliest[-1] - cap, 0)
        forward, back = _containing(groups, np.array([min(latest[-1] + cap, total), x]), total)
        latest.append(forward[0])
        earliest.append(x if back[0] == x else back[1])
    earliest = [0, *earliest[::-1]]
    cuts: list[int | None] = []
    at = 0
    for k in range(1, shards):
        first, last = max(earliest[k], at), min(latest[k], at + cap)
        x = min(max(at + (total - at) // (shards - k + 1), first), last)
        start, end, key = _containing(groups, np.array([x]), total)[0]
        if start < first or end <= last and end - x < x - start:
            start, _, key = _containing(groups, np.array([end]), total)[0]
        at = start
        cuts.append(key)
    return cap, cuts


def minimax_shards(df: DataFrame, key: str, size: str, shards: int, order: list[str], name: str = "shards") -> DataFrame:
    """Add `shard` (0 to shards - 1) and `slot` (from 0, without gaps, in `order` in each shard).

    key: a long column; rows with equal keys stay together, and shards are ranges of it.
    size: a positive long column.  Hot keys are summed before the shuffle; rows never meet by
    key, since a shard is a range of keys.  An empty table gives an empty table; null keys form
    one group, which comes first.  Columns named shard or slot are replaced; others, of whatever
    names, are kept."""
    base = stash(df, f"{name}-rows")
    sums = base.groupBy(F.coalesce(F.col(key), F.lit(-(1 << 63))).alias("key")).agg(F.sum(size).cast("long").alias("_sum"))
    groups = running_totals(sums, ["key"], "_sum", "end", name=f"{name}-groups").withColumn("start", F.col("end") - F.col("_sum"))
    groups = stash(groups.sortWithinPartitions("end"), f"{name}-ends")
    r = groups.agg(F.sum("_sum"), F.max("_sum")).first()
    _, cuts = minimax_cuts(groups, r[0] or 0, r[1] or 0, shards)
    shard = F.lit(0)
    for c in cuts:
        if c is not None:
            shard = shard + (F.coalesce(F.col(key), F.lit(-(1 << 63))) >= F.lit(c)).cast("int")
    one, = unused(base.columns, "one")
    placed = base.withColumn("shard", shard.cast("int")).withColumn(one, F.lit(1).cast("long"))
    return running_totals(placed, order, one, "slot", group="shard", name=f"{name}-slots").withColumn("slot", F.col("slot") - 1).drop(one)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs`.

    Equal texts form a group; groups come in the order of a 64-bit hash of the text (a collision
    would only keep two texts together).  A null text has size 1 and a null text_crc32, and all
    null texts form one group; an empty text has size 1.  Repeated rows each get a slot.  A null
    doc_id is kept and comes first in its shard."""
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), F.xxhash64("text").alias("_key"))
    out = minimax_shards(rows, "_key", "size", shards, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))
