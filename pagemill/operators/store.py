"""Incremental document store: fingerprints, staleness, expiry, refresh, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..sources import parts as PT


def fingerprint(site_id: Column, page_id: Column, modified_at: Column, html: Column, cfg: Config) -> Column:
    """md5 over site, generation, id, modified time, locale and options hash joined
    by '|' (NULLs as '' so fields cannot shift), plus md5 of the page HTML so a
    changed page is re-converted even when its modified time is not bumped."""
    return fingerprint_of_hash(site_id, page_id, modified_at, F.md5(html), cfg)


def fingerprint_of_hash(site_id: Column, page_id: Column, modified_at: Column, html_md5: Column,
                        cfg: Config) -> Column:
    """`fingerprint` from a precomputed md5 of the HTML (hash before joining, so only
    32 characters per page cross a shuffle)."""
    parts = [F.coalesce(site_id.cast("string"), F.lit("")), F.lit(str(cfg.generation)),
             F.coalesce(page_id.cast("string"), F.lit("")),
             F.coalesce(F.date_format(modified_at, "yyyy-MM-dd HH:mm:ss"), F.lit("")),
             F.lit(cfg.locale), F.lit(cfg.options_hash), F.coalesce(html_md5, F.lit(""))]
    return F.md5(F.concat_ws("|", *parts))


def is_live(as_of: Column, cfg: Config, ttl: Column | None = None) -> Column:
    """Over rows of a store: a non-empty document converted less than TTL ago at `as_of`; never null.
    A TTL <= 0 disables the store (nothing is live)."""
    ttl_s = ttl if ttl is not None else F.lit(cfg.cache_ttl_seconds)
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.col("converted_at"))
    live = (ttl_s > 0) & (age < ttl_s) & (age >= 0) & F.col("document").isNotNull() & (F.col("document") != "")
    return F.coalesce(live, F.lit(False))


def live_documents(store: DataFrame, as_of: Column, cfg: Config, ttl: Column | None = None) -> DataFrame:
    """Entries still valid at `as_of`."""
    return store.filter(is_live(as_of, cfg, ttl))


def expire_documents(store: DataFrame, as_of: Column, cfg: Config, ttl: Column | None = None) -> DataFrame:
    """Entries that have lapsed at `as_of` (the rows that live_documents leaves out)."""
    return store.filter(~is_live(as_of, cfg, ttl))


def stale_pages(pages_fp: DataFrame, store: DataFrame, as_of: Column, cfg: Config, ttl: Column | None = None) -> DataFrame:
    """Pages (with `fingerprint`) that need converting: no live entry with the same
    page_id and fingerprint."""
    live = live_documents(store, as_of, cfg, ttl).select("page_id", "fingerprint")
    return pages_fp.join(live, ["page_id", "fingerprint"], "left_anti")


def purge_site(store: DataFrame, site_ids: list[int]) -> DataFrame:
    """Store without the given sites; entries of no site stay.  (A written store drops the sites'
    folders: purge_store.)"""
    return store.filter(~F.coalesce(F.col("site_id").isin(site_ids), F.lit(False)))


def retired_documents(store: DataFrame, servable: DataFrame) -> DataFrame:
    """Stored documents whose page is no longer servable (or no longer exists)."""
    ok = servable.filter(F.col("deny_reason").isNull()).select("page_id")
    return store.join(ok, "page_id", "left_anti")


# ---------------------------------------------------------------------------
# The store as files, by site and hash bucket of the page.

STORE_PARTS = ("site_id", "bucket")
STORE_SCHEMA = ("page_id long, url string, markdown_url string, front_matter string, body string, document string, fingerprint string, "
                "generation int, converted_at timestamp, site_id long, bucket int")


def store_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """Documents as the store has them: rows without a document are left out."""
    columns = [c.split() for c in STORE_SCHEMA.split(", ")[:-2]]
    return docs.filter("document is not null and document <> ''").select(
        *[F.col(n).cast(t).alias(n) for n, t in columns], F.col("site_id").cast("long").alias("site_id"), PT.bucket(F.col("page_id").cast("long"), buckets).alias("bucket"))


def write_store(docs: DataFrame, path: str, buckets: int = PT.BUCKETS) -> None:
    PT.write_parts(store_rows(docs, buckets), path, STORE_PARTS)


def read_store(spark: SparkSession, path: str, parts=None) -> DataFrame:
    return PT.read_parts(spark, path, STORE_SCHEMA, STORE_PARTS, parts)


def purge_store(spark: SparkSession, path: str, site_ids: list[int]) -> None:
    """Remove sites from a written store: their folders go, other sites' files are neither read nor
    written."""
    PT.drop_parts(spark, path, STORE_PARTS, [(s,) for s in site_ids])
