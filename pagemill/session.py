"""Session helpers.  On a cluster the session comes from the caller; these settings
only fill gaps (local tests, bench)."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Union children can disagree on partition counts after AQE coalescing; with
    # this on, Spark 4.1 zips them and fails.  Off: a union is re-partitioned if a
    # later aggregate needs it (only block rows, never tokens, are unioned).
    "spark.sql.unionOutputPartitioning": "false",
    # Collections are gathered from sorted rows, group by group: the hash aggregate holds 128 groups, then
    # sorts all the same, once for every partial and final step.
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    # The JVM never compiles a method over 8,000 bytes, so such a stage runs as separate operators.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "pagemill") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.driver.memory", "16g")
               # Off: each Column call otherwise tells the JVM its line of Python, which doubles
               # the time it takes to build the conversion plan.
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               # The conversion plan generates several hundred classes; with the
               # default cache (100 entries) every run recompiles them.
               .config("spark.sql.codegen.cache.maxEntries", "4000"))
    for k, v in SQL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Settings every job relies on (UTC timestamps for ISO-8601 output)."""
    for k, v in SQL_CONF.items():
        spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared `spark.checkpoint.dir`; set a scratch one only where
    none is configured (local tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="pagemill-ckpt-", dir=os.environ.get("PAGEMILL_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint folder (never a machine-local one
    on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    import uuid
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, as --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_pagemill_shipped", False):
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="pagemill-")) / "pagemill.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    context._pagemill_shipped = True
