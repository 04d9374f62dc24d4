"""Sources and sinks for pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES_SCHEMA = "page_id long, url string, html string"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Crawl output -> pages(page_id, url, html[, http_status, content_type]), read with an
    explicit schema.  parquet: page_id, url, html.  json: those, http_status and content_type.
    text: a page a file; its url is the file's path and its page_id a hash of that."""
    if fmt == "parquet":
        return spark.read.schema(PAGES_SCHEMA).parquet(path)
    if fmt == "json":
        return spark.read.schema(PAGES_SCHEMA + ", http_status int, content_type string").json(path)
    if fmt == "text":
        url = F.col("_metadata.file_path")
        return spark.read.text(path, wholetext=True).select(F.xxhash64(url).alias("page_id"), url.alias("url"), F.col("value").alias("html"))
    raise ValueError(f"unsupported format {fmt!r}")


def admit_pages(pages: DataFrame, max_html_bytes: int | None = None) -> DataFrame:
    """Adds `reject_reason` (NULL = admitted): non-2xx status, a content type that
    is set and does not contain text/html (any case), blank HTML, or HTML over a size
    limit, if the caller sets one."""
    cols = set(pages.columns)
    status = F.col("http_status") if "http_status" in cols else F.lit(200)
    ctype = F.coalesce(F.col("content_type"), F.lit("")) if "content_type" in cols else F.lit("")
    blank = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"[ \t\n\r\x00\x0B]", "") == ""
    reason = (F.when((status < 200) | (status >= 300), F.lit("http_status"))
              .when((ctype != "") & ~F.lower(ctype).contains("text/html"), F.lit("content_type"))
              .when(blank, F.lit("empty_html")))
    if max_html_bytes:
        reason = reason.when(F.octet_length("html") > max_html_bytes, F.lit("too_large"))
    return pages.withColumn("reject_reason", reason)


def write_documents(docs: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Documents partitioned by site (partition pruning for per-site purge and
    reads).  No repartition on site_id: one site may hold most pages."""
    if fmt == "text":
        docs.select("document").write.mode(mode).text(path)
        return
    docs.write.mode(mode).partitionBy("site_id").parquet(path)
