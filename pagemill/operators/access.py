"""Access rules: which pages may be served, with the first failing rule as reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config

NOINDEX_KEY = "robots_noindex"


def noindex_pages(flags: DataFrame, extra_noindex: Column | None = None) -> DataFrame:
    """(page_id, noindex): flag value '1' or 'noindex' (any case)."""
    hit = (F.col("value") == "1") | (F.lower(F.col("value")) == "noindex")
    if extra_noindex is not None:
        hit = hit | extra_noindex
    return (flags.filter((F.col("key") == NOINDEX_KEY) & hit)
            .groupBy("page_id").agg(F.lit(True).alias("noindex")))


def enabled_types(meta: DataFrame, cfg: Config) -> DataFrame:
    """Pages whose type is enabled (configured, existing, public, not attachment);
    an empty list disables every page.  The list is configuration (bounded), so it
    is an IN predicate rather than a join."""
    types = list(cfg.enabled_types)
    return meta.filter(F.col("type").isin(types)) if types else meta.limit(0)


def not_protected(meta: DataFrame) -> DataFrame:
    return meta.filter(~F.coalesce(F.col("password_protected"), F.lit(False))
                       & (F.col("status") == "publish"))


def not_noindex(meta: DataFrame, flags: DataFrame, cfg: Config) -> DataFrame:
    if not cfg.respect_noindex:
        return meta
    return meta.join(noindex_pages(flags), "page_id", "left_anti")


def servable_pages(meta: DataFrame, flags: DataFrame, cfg: Config, extra_rule: Column | None = None,
                   extra_noindex: Column | None = None) -> DataFrame:
    """meta + deny_reason (NULL = servable; a NULL type is refused): type, password, visibility, noindex,
    extra rule — checked in that order, the first failing one is the reason."""
    m = meta.join(noindex_pages(flags, extra_noindex), "page_id", "left") if cfg.respect_noindex else \
        meta.withColumn("noindex", F.lit(None).cast("boolean"))
    types = list(cfg.enabled_types)
    enabled = F.coalesce(F.col("type").isin(types), F.lit(False)) if types else F.lit(False)
    reason = (F.when(~enabled, F.lit("type_disabled"))
              .when(F.coalesce(F.col("password_protected"), F.lit(False)), F.lit("password_protected"))
              .when(F.coalesce(F.col("status"), F.lit("")) != "publish", F.lit("not_public"))
              .when(F.coalesce(F.col("noindex"), F.lit(False)), F.lit("noindex")))
    if extra_rule is not None:
        reason = reason.when(~F.coalesce(extra_rule, F.lit(False)), F.lit("rule"))
    return m.withColumn("deny_reason", reason).drop("noindex")
