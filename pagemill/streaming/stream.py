"""Structured Streaming: the same conversion over arriving page files, and decisions on arriving requests.

Pages: `readStream` (parquet, explicit schema) -> `foreachBatch`.  Row windows are not allowed on
streaming DataFrames, so each micro-batch is converted as a batch DataFrame: of a page that
arrives more than once in it the last row by url and HTML counts; metadata and terms are cut to the
batch's pages first.  Each batch writes its own version of its pages (overwriting that batch's
folder when it is replayed).

What is known of each page (fingerprint, batch of its newest version, time) is a compact state table
by hash bucket, one row a page however many batches there were.  A batch reads the buckets of its
own pages, leaves unchanged pages alone until their TTL has passed, and replaces those buckets; rows that
a batch itself wrote before it was replayed count as unknown, so a replay gives the same again.

Requests: a stream-static join with the stored routes, row by row, without state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import requests as RQ
from ..operators import store as ST
from ..plans.pipeline import BROADCAST_IDS, convert_pages
from ..session import scratch_dir
from ..sources import fixtures as FX
from ..sources import parts as PT
from ..sources.pages import PAGES_SCHEMA, read_table


STATE_SCHEMA = "page_id long, fingerprint string, batch long, converted_at timestamp, bucket int"
STATE_PARTS = ("bucket",)


def _state_dir(out_dir: str) -> str:
    return f"{out_dir.rstrip('/')}/_state"


def current_documents(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row a page: its newest version, with its failure if that failed."""
    state = PT.read_parts(spark, _state_dir(out_dir), STATE_SCHEMA, STATE_PARTS).select("page_id", "batch")
    # Folders whose names begin with '_' are no data to Spark.
    return spark.read.parquet(out_dir).join(state, ["page_id", "batch"], "left_semi").drop("batch")


def _convert_batch(batch: DataFrame, meta: DataFrame, cfg: Config, terms: DataFrame | None, out_dir: str, batch_id: int, as_of: Column | None) -> None:
    spark = batch.sparkSession
    now = as_of if as_of is not None else F.current_timestamp()
    pages = batch.groupBy("page_id").agg(F.max_by(F.struct("url", "html"), F.struct("url", "html")).alias("p")).select("page_id", "p.*")
    path = scratch_dir(spark, "stream-batch")
    pages.write.parquet(path)
    pages = spark.read.schema(pages.schema).parquet(path)
    ids = pages.select("page_id")
    parts = PT.touched(ids.select(PT.bucket(F.col("page_id")).alias("bucket")), STATE_PARTS)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    meta, terms = (None if t is None else t.join(ids, "page_id", "left_semi") for t in (meta, terms))
    state = PT.read_parts(spark, _state_dir(out_dir), STATE_SCHEMA, STATE_PARTS, parts).filter(F.col("batch") < batch_id)
    # What is live counts as the store's rule says; a failure has no fingerprint and never does.
    done = ST.live_documents(state.withColumn("document", F.col("fingerprint")), now, cfg).select("page_id", F.col("fingerprint").alias("done"))
    hashed = pages.select("page_id", F.md5("html").alias("html_md5"))
    fingerprint = ST.fingerprint_of_hash(F.col("site_id"), F.col("page_id"), F.col("modified_at"), F.col("html_md5"), cfg)
    same = (hashed.join(meta.select("page_id", "site_id", "modified_at"), "page_id", "left").join(done, "page_id")
            .filter(fingerprint == F.col("done")).select("page_id"))
    docs = convert_pages(pages.join(same, "page_id", "left_anti"), meta, cfg, terms, as_of)
    docs.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch={batch_id}")
    written = spark.read.schema(docs.schema).parquet(f"{out_dir.rstrip('/')}/batch={batch_id}")
    new = written.select("page_id", F.when(F.col("fail_reason").isNull(), F.col("fingerprint")).alias("fingerprint"),
                         F.lit(batch_id).cast("long").alias("batch"), "converted_at", PT.bucket(F.col("page_id")).alias("bucket"))
    # Last, so that a batch which fails before is done again whole.
    PT.replace_parts(state.join(new.select("page_id"), "page_id", "left_anti").select(*new.columns).unionByName(new),
                     _state_dir(out_dir), STATE_PARTS, parts)


def convert_stream(pages_stream: DataFrame, meta: DataFrame, cfg: Config, out_dir: str, checkpoint: str,
                   terms: DataFrame | None = None, available_now: bool = True, as_of: Column | None = None):
    """Start the streaming conversion; returns the StreamingQuery.  as_of: the time that counts (default: now)."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        _convert_batch(batch, meta, cfg, terms, out_dir, batch_id, as_of)

    w = pages_stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


#: Batches in which staged files arrive.  Each has a fixed cost (planning, state, commits), so their
#: number doesn't grow with the files.
BATCHES = 4


def _files_a_batch(spark: SparkSession, path: str) -> int:
    return max(1, -(-len(spark.read.parquet(path).inputFiles()) // BATCHES))


def stream_pages(spark: SparkSession, sf_dir: str, cfg: Config) -> DataFrame:
    """Stream the pages to completion (availableNow) and return the current documents.  The
    pages are staged as files in the shared scratch folder, as many as the table's partitions
    and two at least, so that they arrive in several batches, BATCHES about; one page in ten arrives
    twice."""
    src, out, ckpt = (scratch_dir(spark, n) for n in ("pages-in", "docs-out", "ckpt"))
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    pages.write.parquet(src)
    pages.filter(F.col("page_id") % 10 == 0).write.mode("append").parquet(src)
    stream = spark.readStream.schema(PAGES_SCHEMA).option("maxFilesPerTrigger", _files_a_batch(spark, src)).parquet(src)
    q = convert_stream(stream, FX.pages_meta(spark, sf_dir), cfg, out, ckpt, FX.terms(spark, sf_dir))
    q.awaitTermination()
    return current_documents(spark, out).filter(F.col("fail_reason").isNull())


def classify_stream(requests: DataFrame, index: str, cfg: Config, out_dir: str, checkpoint: str, available_now: bool = True):
    """Start decisions on a stream of requests (classify_requests' columns), with the routes and page
    states that write_route_index() stored in `index`; returns the StreamingQuery."""
    w = (RQ.classify_rows(requests, *RQ.read_route_index(requests.sparkSession, index), cfg)
         .writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def stream_requests(requests: DataFrame, pages: DataFrame, servable: DataFrame, documents: DataFrame, cfg: Config) -> DataFrame:
    """The decisions on `requests` made as a stream of files, several batches at least."""
    spark = requests.sparkSession
    src, out, ckpt, index = (scratch_dir(spark, n) for n in ("requests-in", "requests-out", "requests-ckpt", "routes"))
    requests.write.parquet(src)
    RQ.write_route_index(pages, servable, documents, index)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", _files_a_batch(spark, src)).parquet(src)
    classify_stream(stream, index, cfg, out, ckpt).awaitTermination()
    return spark.read.parquet(out)
