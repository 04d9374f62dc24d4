"""Operator 8, mixing sources to target weights: capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, read_table, running_totals, salted_join, stash, unused

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Add `target` to (source, source_size, weight): the targets share `share` times all sizes by
    weight; none exceeds `max_epochs` times its source's size, and the excess is shared again by
    weight until none is above.  Each round is one aggregate over the sources; only the level
    and the number of clamped sources reach the driver."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total, weight, n = sources.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    budget, level, clamped = share * (total or 0), 0.0, -1
    level = budget / weight if weight else 0.0
    while n:
        above = cap < F.col("weight") * F.lit(level)
        k, used, left = sources.agg(F.count(F.when(above, 1)), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if k == clamped or not left:
            break
        clamped, level = k, max(level, (budget - (used or 0.0)) / left)
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix(rows: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 8) -> DataFrame:
    """Add source_size, target and `repeats` to rows with doc_id, source, size (non-negative).

    A source's rows are all taken floor(target / size) times; the rest of its target is filled
    with whole rows in a seeded order (md5 of seed and doc_id), up to the row whose middle passes
    the rest.  So a source's taken words are within half a row of its target, no row is
    repeated more than max_epochs times, and reruns agree.  Ties in the order (one doc_id
    more than once) fall back to the size.  Null sources form a source of their own, the last;
    null doc_ids come last in their source.  Sources without words get target 0.  Columns named
    source_size, target or repeats are replaced; others, of whatever names, are kept."""
    rows = rows.drop("source_size", "target", "repeats")
    order, total = unused(rows.columns, "order", "total")
    base = stash(rows.withColumn(order, F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"))), "mix-rows")
    sums = base.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.lit(1).cast("long").alias("_one"))
    ranked = running_totals(sums, [F.col("source").asc_nulls_last()], "_one", "_rank", name="mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1)
    sources = stash(ranked.select("source", "source_size", weight.alias("weight")), "mix-weights")
    targets = water_fill(sources, share, max_epochs).select("source", "source_size", "target")
    placed = running_totals(base, [F.col(order).asc_nulls_last(), "doc_id", "size"], "size", total, group="source", name="mix-order")
    out = salted_join(placed, targets, "source", F.col(total))
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rest = F.col("target") - whole * F.col("source_size")
    extra = (F.col(total) - F.col("size") / 2.0 <= rest).cast("int")
    return (out.withColumn("repeats", F.when(F.col("size") > 0, whole + extra).otherwise(whole).cast("int"))
            .drop(order, total))


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = mix(docs.select("doc_id", "source", word_count().alias("size")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('8:' || CAST(doc_id AS VARCHAR)) AS ord
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (r - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
             sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS UNBOUNDED PRECEDING) - 2.0::DOUBLE * source_size AS caps_before,
             sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left,
             1.5::DOUBLE * sum(source_size) OVER () AS budget
      FROM w),
l AS (SELECT arg_min((budget - caps_before) / weights_left, cap / weight) FILTER ((budget - caps_before) / weights_left <= cap / weight) AS level FROM o),
t AS (SELECT source, source_size, least(cap, weight * coalesce(level, 1e300)) AS target FROM o, l),
c AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY ord NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM d)
SELECT c.doc_id, c.size, t.source_size, t.target,
       CAST(CASE WHEN c.size > 0 THEN c.size * (floor(t.target / t.source_size)
            + CASE WHEN c.total - c.size / 2.0::DOUBLE <= t.target - floor(t.target / t.source_size) * t.source_size THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
"""
