"""Accept-header negotiation as array expressions (no shuffle, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of a media type, a q parameter and a valid q.
MEDIA_RX = r"^([a-z0-9!#$&^_.+*\-]+)/([a-z0-9!#$&^_.+*\-]+)$"
Q_PARAM_RX = r"(?i)^q\s*=\s*(.+)$"
Q_VALUE_RX = r"^(?:0(?:\.\d{0,3})?|1(?:\.0{0,3})?)$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$", "")


def accept_ranges(accept: Column) -> Column:
    """ARRAY<STRUCT<type, subtype, quality>>: split on ',' then ';'; media lower-cased
    and validated; a q outside 0..1 with up to 3 decimals drops the range; default
    quality 1.0.  The last q parameter wins."""
    def parse(v):
        parts = F.transform(F.split(v, ";"), lambda p: _trim(p))
        media = F.lower(F.try_element_at(parts, F.lit(1)))
        params = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        qvals = F.transform(F.filter(params, lambda p: p.rlike(Q_PARAM_RX)),
                            lambda p: _trim(F.regexp_extract(p, Q_PARAM_RX, 1)))
        valid = F.forall(qvals, lambda q: q.rlike(Q_VALUE_RX))
        quality = F.coalesce(F.try_element_at(qvals, F.lit(-1)).try_cast("double"), F.lit(1.0))
        return F.struct(F.regexp_extract(media, MEDIA_RX, 1).alias("type"),
                        F.regexp_extract(media, MEDIA_RX, 2).alias("subtype"),
                        quality.alias("quality"), (media.rlike(MEDIA_RX) & valid).alias("ok"))
    parsed = F.transform(F.split(F.coalesce(accept, F.lit("")), ","), parse)
    return F.transform(F.filter(parsed, lambda r: r["ok"]),
                       lambda r: F.struct(r["type"].alias("type"), r["subtype"].alias("subtype"),
                                          r["quality"].alias("quality")))


def media_quality(ranges: Column, mtype: str, subtype: str) -> Column:
    """STRUCT<specificity INT, quality DOUBLE> of the best range for a media type:
    exact 2, type/* 1, */* 0; higher specificity wins, then higher quality;
    (-1, -1.0) when none applies."""
    def spec(r):
        return (F.when((r["type"] == mtype) & (r["subtype"] == subtype), 2)
                .when((r["type"] == mtype) & (r["subtype"] == "*"), 1)
                .when((r["type"] == "*") & (r["subtype"] == "*"), 0).otherwise(-1))
    scored = F.filter(F.transform(ranges, lambda r: F.struct(spec(r).alias("specificity"), r["quality"].alias("quality"))),
                      lambda s: s["specificity"] >= 0)
    none = F.struct(F.lit(-1).alias("specificity"), F.lit(-1.0).alias("quality"))
    return F.coalesce(F.array_max(scored), none)


def prefers_markdown(accept: Column, wildcards: bool = False) -> Column:
    """Markdown preferred: specificity >= 2 (>= 1 with wildcards), quality > 0 and
    >= max(0, quality of text/html).  Empty header -> False."""
    return markdown_preferred(accept_ranges(accept), wildcards)


def markdown_preferred(r: Column, wildcards: bool = False) -> Column:
    """prefers_markdown over parsed ranges."""
    md = media_quality(r, "text", "markdown")
    html = media_quality(r, "text", "html")
    need = 1 if wildcards else 2
    return F.coalesce((md["specificity"] >= need) & (md["quality"] > 0)
                      & (md["quality"] >= F.greatest(F.lit(0.0), html["quality"])), F.lit(False))
