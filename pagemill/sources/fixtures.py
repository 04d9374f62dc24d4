"""Derived inputs built from the driver's tables (see FIXTURES.md): page metadata,
taxonomy terms, noindex flags, requests, a document store and synthetic HTML pages
whose expected Markdown follows from base rows.  Everything is a Spark job over the
given tables, so it grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_host, url_path
from .pages import read_table

AS_OF = "2024-06-01 00:00:00"
# Request Accept headers by event_id modulo their number (FIXTURES.md).
ACCEPT_HEADERS = [
    "text/markdown",
    "text/html,application/xhtml+xml,*/*;q=0.8",
    "text/*",
    "text/markdown;q=0.5, text/html;q=0.9",
    "text/markdown;q=0.9, text/html;q=0.9",
    "*/*",
    "text/markdown;q=0, text/*",
    "text/markdown;q=1.5, text/html;q=0.1",
    "",
    "TEXT/Markdown ; Q=0.7, text/html;q=0.2",
    "text/markdown;level=1;q=0.4, text/*;q=0.3",
    "text/markdown;q=high, text/html;q=0.1",
]
# Method by event type.
METHODS = {"click": "GET", "view": "HEAD", "purchase": "POST", "error": "GET", "signup": "GET"}


def pages_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages_meta(page_id, site_id, type, slug, title, excerpt, content, published_at,
    modified_at, status, password_protected)."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("content"))
    pid = F.col("page_id")
    path = url_path(F.col("url"))
    pub = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_interval(hours=pid.cast("int"))
    m = pages.select(
        pid, (pid % 4).alias("site_id"),
        F.element_at(F.array(F.lit("post"), F.lit("page"), F.lit("product")), (pid % 3 + 1).cast("int")).alias("any_type"),
        F.regexp_extract(path, r"([^/]+)/*$", 1).alias("slug"),
        F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"),
        F.when(pid % 7 == 0, F.concat(F.lit("Short <em>excerpt</em> &amp; more for page "), pid.cast("string")))
        .otherwise(F.lit("")).alias("excerpt"),
        pub.alias("published_at"),
        (pub + F.make_interval(hours=(pid % 48).cast("int"))).alias("modified_at"),
        F.when(pid % 11 == 0, F.lit("draft")).otherwise(F.lit("publish")).alias("status"),
        (pid % 13 == 0).alias("password_protected"))
    # A type is missing here and there.
    m = m.withColumn("type", F.when(F.col("page_id") % 29 != 0, F.col("any_type"))).drop("any_type")
    return m.join(docs, "page_id", "left")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """terms(page_id, taxonomy, is_public, ord, name): language, host (twice: a
    duplicate name) and a non-public taxonomy."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    lang = F.regexp_extract("html", r"<html[^>]*\blang=\"([^\"]*)\"", 1)
    host = url_host(F.col("url"))
    rows = F.array(
        F.struct(F.lit("Content Lang").alias("taxonomy"), F.lit(True).alias("is_public"), F.lit(0).alias("ord"), lang.alias("name")),
        F.struct(F.lit("host").alias("taxonomy"), F.lit(True).alias("is_public"), F.lit(0).alias("ord"), host.alias("name")),
        F.struct(F.lit("host").alias("taxonomy"), F.lit(True).alias("is_public"), F.lit(1).alias("ord"), host.alias("name")),
        F.struct(F.lit("internal").alias("taxonomy"), F.lit(False).alias("is_public"), F.lit(0).alias("ord"), F.lit("x").alias("name")))
    return (pages.select("page_id", F.explode(rows).alias("t")).select("page_id", "t.*")
            .filter(F.col("name") != ""))


def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_flags(page_id, key, value): robots noindex flag for toxic labels."""
    lab = read_table(spark, sf_dir, "labels")
    return (lab.filter(F.col("toxic") == 1)
            .select(F.col("doc_id").alias("page_id"), F.lit("robots_noindex").alias("key"),
                    F.when(F.col("doc_id") % 2 == 1, F.lit("NoIndex")).otherwise(F.lit("1")).alias("value")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests(req_id, ts, host, path, method, accept) from events; the page is
    event_id mod (number of pages) (a scalar subquery, no driver round trip).  Some ask for
    the root of their host, some for pages that don't exist."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    n = pages.agg(F.count("*")).scalar()
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    ev = ev.withColumn("page_id", F.pmod(F.col("event_id"), n))
    j = ev.join(pages, "page_id", "left")
    path = F.regexp_replace(url_path(F.col("url")), r"/+$", "")
    path = F.when(path == "", F.lit("/index")).otherwise(path)
    plain = F.when(url_path(F.col("url")) == "", F.lit("/")).otherwise(url_path(F.col("url")))
    p = (F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("/no-such-page-"), F.col("event_id").cast("string")))
         .otherwise(plain))
    p = F.when(F.col("event_id") % 19 == 0, F.lit("/")).otherwise(p)
    p = F.when((F.col("event_id") % 2 == 0) & (F.col("event_id") % 19 != 0), F.concat(F.when(F.col("event_id") % 17 == 0, p).otherwise(path), F.lit(".md"))).otherwise(p)
    method = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv]), F.col("event_type")),
                        F.lit("GET"))
    accept = F.element_at(F.array(*[F.lit(a) for a in ACCEPT_HEADERS]), (F.pmod("event_id", F.lit(len(ACCEPT_HEADERS))) + 1).cast("int"))
    return j.select(F.col("event_id").alias("req_id"), "ts", url_host(F.col("url")).alias("host"), p.alias("path"), method.alias("method"), accept.alias("accept"))
