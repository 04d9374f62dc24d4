"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.session import scratch_dir

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Narrow rows in a file of a table whose size is known.
FILE_ROWS = 200_000


def stash(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write `df` below the shared scratch folder and read it back: lineage ends here, and a
    lost executor costs no recomputation beyond the files.

    `rows`: about how many narrow rows it has, at most.  They go to a file for each FILE_ROWS, so a
    small table isn't one file a shuffle partition (a task, and on local disks a process that sets
    the file's mode, each); a large one keeps its partitions."""
    path = scratch_dir(df.sparkSession, f"llm-{name}")
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Hadoop's names of stores, by which pyarrow knows them.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path below the shared scratch folder, and the path in it."""
    scheme, sep, rest = uri.partition("://")
    if not sep:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    try:
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"spark.checkpoint.dir is in a store ({scheme}) that pyarrow can't open: {e}") from e


def documents(df: DataFrame) -> DataFrame:
    """The columns of `documents`, whatever else a caller's table carries."""
    return df.select("doc_id", "text", "lang", "source", "n_chars")


def row_key(df: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row of `df`, nulls told from other values: repeated
    rows share it, rows that share a doc_id or have none don't."""
    return F.xxhash64(*df.columns, F.array(*[F.col(c).isNull() for c in df.columns]))


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """The names with underscores in front until none is among `columns` (whatever the
    case), for columns of our own beside a caller's."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def salted_join(big: DataFrame, small: DataFrame, key: str, salt_by: Column, salts: int = 64, how: str = "inner") -> DataFrame:
    """Null-safe join of `big` to `small` (unique on `key`), with every key of `big` spread over
    `salts` tasks by `salt_by`, so that a key with a third of all rows lands in no single task.
    `small` is repeated `salts` times."""
    salt, small_salt, small_key = unused([*big.columns, *small.columns], "salt", "small_salt", "small_key")
    b = big.withColumn(salt, F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    s = small.withColumnRenamed(key, small_key).withColumn(small_salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cond = F.col(key).eqNullSafe(F.col(small_key)) & (F.col(salt) == F.col(small_salt))
    return b.join(s, cond, how).drop(small_key, salt, small_salt)


def running_totals(df: DataFrame, order: Sequence[str | Column], value: str, out: str, group: str | None = None,
                   name: str = "totals") -> DataFrame:
    """Add `out` (in place of a column of that name): the inclusive running total of the non-negative
    long column `value`, in `order`, within each `group` (all rows without one).  Other columns, of
    whatever names, are kept.

    Rows are range-partitioned by (group, order), so a hot group spans many partitions.  Each
    task totals its own rows as a stream; a group can continue from one partition into the next,
    so the driver gets one summary row a partition and hands each partition the total it starts
    from.  Both tables there are bounded by the number of partitions."""
    spark = df.sparkSession
    keys = ([F.col(group).asc_nulls_last()] if group else []) + [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    pid_, seq_, lead_, local_, start_ = own = unused([*df.columns, out], "pid", "seq", "lead", "local", "start")
    schema = T.StructType([*df.schema.fields, T.StructField(pid_, T.IntegerType()), T.StructField(seq_, T.LongType()),
                           T.StructField(lead_, T.BooleanType()), T.StructField(local_, T.LongType())])

    def total(batches):
        pid, seq, carry, lead, last = TaskContext.get().partitionId(), 0, 0, True, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = b.column(b.schema.names.index(value)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            cum = np.cumsum(v)
            starts = np.zeros(1, np.int64)
            if group:
                g = b.column(b.schema.names.index(group))
                runs = pc.run_end_encode(g)
                ends = np.asarray(runs.run_ends)
                starts = np.concatenate([[0], ends[:-1]])
                first = g[0].as_py()
                if seq and first != last:
                    lead, carry = False, 0
                last = g[n - 1].as_py()
            before = np.where(starts > 0, cum[starts - 1], 0)
            run = np.searchsorted(starts, np.arange(n), "right") - 1
            local = cum - before[run] + np.where(run == 0, carry, 0)
            leads = (run == 0) & lead
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(n, pid, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array(leads),
                 pa.array(local)], names=[*b.schema.names, *own[:4]])
            seq += n
            carry, lead = int(local[-1]), bool(leads[-1])

    done = stash(ranged.mapInArrow(total, schema), name)
    g = F.col(group) if group else F.lit(0)
    ends = (done.groupBy(F.col(pid_).alias("pid")).agg(F.min_by(F.struct(g), seq_).alias("first"), F.max_by(F.struct(g, local_, lead_), seq_).alias("last"))
            .orderBy("pid").collect())  # a row a partition
    offsets, run_group, run_total = [], None, 0
    for r in ends:
        start = run_total if run_group is not None and run_group == (r["first"][0],) else 0
        offsets.append((r["pid"], start))
        run_group, run_total = (r["last"][0],), r["last"][1] + (start if r["last"][2] else 0)
    table = F.broadcast(spark.createDataFrame(offsets, f"{pid_} int, {start_} long"))  # a row a partition
    return (done.join(table, pid_).withColumn(out, F.col(local_) + F.when(F.col(lead_), F.col(start_)).otherwise(0))
            .drop(*own))


def spread_join(big: DataFrame, small: DataFrame, key: str, spread: str, count: str = "n", most: int = 1000) -> DataFrame:
    """Left, null-safe join of `big` to `small` (unique on `key`, a written table), where `count` is
    how many rows of `big` a key has at most.

    Keys with over 1/`most` of all counted rows, so less than `most` of them, are broadcast; rows
    that meet one are dealt by `spread` afterwards.  The other keys are joined as Spark chooses:
    none is large enough to fill a task.  Columns of `small` but `key` and `count` are added."""
    total = small.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * most > total
    add = [c for c in small.columns if c not in (key, count)]
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null"))
    side = small.select(name.alias("_small_key"), heavy.alias("_heavy"), F.struct(*add).alias("_added"))
    hot, rest = (side.filter(c).select("_small_key", "_added") for c in ("_heavy", "not _heavy"))
    b = big.withColumn("_big_key", name)
    b = b.join(F.broadcast(hot.withColumnRenamed("_added", "_hot")), F.col("_big_key") == F.col("_small_key"), "left").drop("_small_key")
    dealt = F.when(F.col("_hot").isNull(), F.col("_big_key")).otherwise(F.concat(F.lit("~"), F.xxhash64(spread).cast("string")))
    b = b.withColumn("_big_key", dealt).join(rest, F.col("_big_key") == F.col("_small_key"), "left")
    got = F.coalesce("_hot", "_added")
    return b.select(*big.columns, *[got[c].alias(c) for c in add])
