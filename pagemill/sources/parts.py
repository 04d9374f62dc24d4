"""Tables of files partitioned by whole numbers (site, hash bucket), changed part by part: a change
reads, writes and removes the folders of the parts it touches, and no others."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Fixed value: the folder name of a null partition value.
NULL_PART = "__HIVE_DEFAULT_PARTITION__"
#: Hash buckets of a table; a large one sets more, for some hundred MB a bucket.
BUCKETS = 32

Part = tuple[int | None, ...]


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _folder(path: str, by: Sequence[str], part: Part) -> str:
    return "/".join([path.rstrip("/"), *(f"{c}={NULL_PART if v is None else v}" for c, v in zip(by, part))])


def _files(spark: SparkSession, path: str):
    """The store that holds `path`, as Spark itself reaches it, and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def drop_parts(spark: SparkSession, path: str, by: Sequence[str], parts: Iterable[Part]) -> None:
    """Remove the folders of `parts` (values of the first columns of `by`): no file is read."""
    for part in parts:
        fs, p = _files(spark, _folder(path, by, part))
        fs.delete(p, True)


def write_parts(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_parts(spark: SparkSession, path: str, schema, by: Sequence[str], parts: Iterable[Part] | None = None) -> DataFrame:
    """The whole table, or the rows of some parts, whose folders alone are listed and read."""
    reader = spark.read.schema(schema)
    if parts is None:
        return reader.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    there = [f for f in (_folder(path, by, p) for p in parts) if exists(spark, f)]
    return reader.option("basePath", path).parquet(*there) if there else spark.createDataFrame([], schema)


def touched(rows: DataFrame, by: Sequence[str]) -> list[Part]:
    """The parts that rows are in: at most as many as the folders the driver lists for any read."""
    return [tuple(r) for r in rows.select(*by).distinct().collect()]


def replace_parts(rows: DataFrame, path: str, by: Sequence[str], parts: Sequence[Part]) -> None:
    """Put `rows` in place of what `parts` hold; `rows` may come from the table itself.  They are
    written to the scratch folder first, so a job that fails before the end has changed nothing; the last
    step moves finished files."""
    spark = rows.sparkSession
    aside = scratch_dir(spark, "parts")
    # A file or a few a part, not one from every task.
    rows.repartition(*by).write.parquet(aside)
    new = spark.read.schema(rows.schema).parquet(aside)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    left = set(touched(new, by))
    drop_parts(spark, path, by, [p for p in parts if p not in left])
