"""Composed jobs: convert_pages (flagship) and refresh_documents (incremental)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import metadata as MD
from ..operators import store as ST
from ..operators import tokens as K
from ..session import scratch_dir
from ..sources import parts as PT
from ..sources.pages import admit_pages
from .convert import html_to_markdown


def convert_pages(pages: DataFrame, meta: DataFrame, cfg: Config, terms: DataFrame | None = None,
                  as_of: Column | None = None, front_matter_fn=None, include_taxonomy: Column | None = None,
                  document_fn=None) -> DataFrame:
    """One row per page: (page_id, site_id, url, markdown_url, front_matter, body,
    document, fingerprint, generation, converted_at, fail_reason).  A rejected page
    or a blank extraction is a failure (document NULL), never an empty document.

    Admission and the HTML hash are computed where the pages are read.  The token branch alone
    moves HTML; it needs no metadata.  The other branch joins narrow page columns, metadata and
    terms.  All sides are hash-partitioned by page_id into the same number of partitions, so the
    last joins move nothing.

    Hooks: front_matter_fn (DataFrame -> DataFrame, over the front matter rows), include_taxonomy
    (Column over terms), document_fn (Column -> Column, over the finished document)."""
    as_of = as_of if as_of is not None else F.current_timestamp()
    extra = [c for c in ("http_status", "content_type") if c in pages.columns]
    n = K.page_partitions(pages, cfg.page_partitions)
    admitted = admit_pages(pages.select("page_id", "url", "html", *extra), cfg.max_html_bytes)
    pm = admitted.select("page_id", "url", "reject_reason", F.md5("html").alias("html_md5")).repartition(n, "page_id")
    pm = pm.join(meta.withColumn("has_meta", F.lit(True)).repartition(n, "page_id"), "page_id", "left")
    pm = pm.withColumn("fingerprint", ST.fingerprint_of_hash(F.col("site_id"), F.col("page_id"), F.col("modified_at"),
                                                             F.col("html_md5"), cfg))
    md = html_to_markdown(admitted.filter(F.col("reject_reason").isNull()).select("page_id", "html"), cfg, partitions=n)
    fm = MD.front_matter_rows(pm.filter("has_meta"), terms, include_taxonomy, partitions=n)
    if front_matter_fn is not None:
        fm = front_matter_fn(fm)
    out = (pm.select("page_id", "reject_reason", "fingerprint", "has_meta").join(md, "page_id", "left")
           .join(fm, "page_id", "left"))
    fail = (F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
            .when(F.col("has_meta").isNull(), F.lit("no_metadata"))
            .when(~F.coalesce(F.col("extracted"), F.lit(False)), F.lit("no_content")))
    yaml = MD.yaml_block(F.col("fm"))
    document = MD.assemble_document(yaml, F.col("body"))
    if document_fn is not None:
        document = document_fn(document)
    return out.select("page_id", "site_id", "url", "markdown_url", yaml.alias("front_matter"),
                      F.when(fail.isNull(), F.col("body")).alias("body"),
                      F.when(fail.isNull(), document).alias("document"),
                      "fingerprint", F.lit(cfg.generation).alias("generation"),
                      as_of.cast("timestamp").alias("converted_at"), fail.alias("fail_reason"))


#: Stale page ids (8 bytes each) up to which they are sent to every task.
BROADCAST_IDS = 1_000_000


def refresh_documents(pages: DataFrame, meta: DataFrame, store: DataFrame, cfg: Config, as_of: Column,
                      terms: DataFrame | None = None, ttl: Column | None = None, **hooks) -> DataFrame:
    """New store snapshot: live entries whose fingerprint still matches are kept; only
    stale pages are converted; failures are not stored.

    One scan hashes the HTML; the fingerprints, a narrow table, are written to the shared scratch
    folder with a stale flag.  Stale pages are then picked from the pages as these are read, before
    any exchange, so only their HTML moves; beyond BROADCAST_IDS stale pages Spark's own join
    picks them.  With nothing stale no page is read again.  ttl: seconds, a Column over the
    store (default: the job's)."""
    live = ST.live_documents(store, as_of, cfg, ttl)
    state = _page_state(pages, meta, live, cfg)
    kept = live.join(state.filter("not stale").select("page_id", "fingerprint"), ["page_id", "fingerprint"], "left_semi").select(*store.columns)
    fresh = _fresh_documents(state, pages, meta, cfg, as_of, terms, hooks)
    return kept if fresh is None else kept.select(*fresh.columns).unionByName(fresh)


def _page_state(pages: DataFrame, meta: DataFrame, live: DataFrame, cfg: Config) -> DataFrame:
    """page_id, fingerprint, stale (no live document has that fingerprint) of each page, a narrow
    table written to the scratch folder."""
    spark = pages.sparkSession
    hashed = pages.select("page_id", F.md5("html").alias("html_md5"))
    fp = meta.join(hashed, "page_id").select(
        "page_id", ST.fingerprint_of_hash(F.col("site_id"), F.col("page_id"), F.col("modified_at"),
                                          F.col("html_md5"), cfg).alias("fingerprint"))
    known = live.select("page_id", "fingerprint").distinct().withColumn("live", F.lit(True))
    state = fp.join(known, ["page_id", "fingerprint"], "left").withColumn("stale", F.col("live").isNull()).drop("live")
    path = scratch_dir(spark, "fingerprints")
    state.write.parquet(path)
    return spark.read.schema(state.schema).parquet(path)


def _fresh_documents(state: DataFrame, pages: DataFrame, meta: DataFrame, cfg: Config, as_of: Column, terms: DataFrame | None, hooks: dict) -> DataFrame | None:
    """The stale pages' documents; None if no page is stale."""
    stale = state.filter("stale").select("page_id")
    n_stale = stale.count()
    if not n_stale:
        return None
    ids = F.broadcast(stale) if n_stale <= BROADCAST_IDS else stale
    pick = lambda df: df.join(ids, "page_id", "left_semi")
    return convert_pages(pick(pages), pick(meta), cfg, None if terms is None else pick(terms), as_of, **hooks) \
        .filter(F.col("fail_reason").isNull()).drop("fail_reason")


def refresh_store(pages: DataFrame, meta: DataFrame, path: str, cfg: Config, as_of: Column, terms: DataFrame | None = None,
                  ttl: Column | None = None, buckets: int = PT.BUCKETS, **hooks) -> list[PT.Part]:
    """refresh_documents() on a written store, in place; returns the parts (site_id, bucket) changed.

    Only the narrow columns of the store are scanned to find what is stale or to be dropped (lapsed,
    changed, of pages that are gone).  The parts those pages are in are read whole, and written anew with
    the fresh documents; all other folders stay as they are."""
    spark = pages.sparkSession
    # Whatever is stored has a document (store_rows), so that column needn't be read for this.
    narrow = ST.read_store(spark, path).drop("document", "body", "front_matter").withColumn("document", F.lit("-"))
    state = _page_state(pages, meta, ST.live_documents(narrow, as_of, cfg, ttl), cfg)
    current = state.filter("not stale").select("page_id", "fingerprint")

    def keep(rows: DataFrame) -> DataFrame:
        return ST.live_documents(rows, as_of, cfg, ttl).join(current, ["page_id", "fingerprint"], "left_semi")

    # A stored row counts as dropped by what keep() keeps: row by row, as a key can be stored twice.
    marked = narrow.withColumn("live", ST.is_live(as_of, cfg, ttl)).join(
        current.withColumn("same", F.lit(True)), ["page_id", "fingerprint"], "left")
    parts = set(PT.touched(marked.filter("not live or same is null"), ST.STORE_PARTS))
    fresh = _fresh_documents(state, pages, meta, cfg, as_of, terms, hooks)
    if fresh is not None:
        aside = scratch_dir(spark, "fresh")
        rows = ST.store_rows(fresh, buckets)
        rows.write.parquet(aside)
        fresh = spark.read.schema(rows.schema).parquet(aside)
        parts |= set(PT.touched(fresh, ST.STORE_PARTS))
    if parts:
        old = ST.read_store(spark, path, sorted(parts, key=str))
        rows = keep(old).select(*old.columns)
        PT.replace_parts(rows if fresh is None else rows.unionByName(fresh), path, ST.STORE_PARTS, list(parts))
    return sorted(parts, key=str)
