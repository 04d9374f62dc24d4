"""From raw documents to shards, each stage written and read again before the next.

Stages: quality rules, SimHash near-dedup, benchmark decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import documents, read_table, row_key, stash
from pagemill.llm.decontam import leaks
from pagemill.llm.mixing import mix, word_count
from pagemill.llm.queries import ship
from pagemill.llm.quality import clean_documents
from pagemill.llm.sharding import minimax_shards
from pagemill.llm.simhash import fingerprint_classes, fingerprints


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line-frequency rule keep, without the frequent lines.

    A null text has no words and goes; a null source is a host of its own; null doc_ids are kept, and
    repeated rows are kept or go together."""
    ship(spark)
    return documents(clean_documents(documents(docs)))


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key, _row, by which a stage carries them: doc_ids can be null or repeat."""
    docs = documents(docs)
    return docs.withColumn("_row", row_key(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that with the smallest doc_id (nulls last), then the
    smallest row key.  So a repeated row is kept once, a component without doc_ids keeps a row,
    and different texts that share a doc_id are told apart."""
    ship(spark)
    rows = keyed(docs)
    # fingerprints() hands the row key on as the id; the doc_id joins by it afterwards.
    fps = stash(fingerprints(rows.select(F.col("_row").alias("doc_id"), "text")), "dedup-fps")
    ids = rows.select("_row", "doc_id").distinct().withColumnRenamed("_row", "_id_row")
    classes = fingerprint_classes(fps, name="dedup").select("fp", "root")
    found = fps.select(F.col("doc_id").alias("_row"), "fp").join(classes, "fp").join(ids, F.col("_row") == F.col("_id_row"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).getField("_row").alias("_row"))
    return documents(rows.join(first.select("_row"), "_row", "left_semi").dropDuplicates(["_row"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark question, verbatim or re-parameterised.

    Rows are told apart by all their columns, so null and repeated doc_ids do no harm; repeated rows
    are kept or go together, and a null text holds no question."""
    ship(spark)
    rows = keyed(docs)
    found = leaks(rows.select(F.col("_row").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    bad = found.select(F.col("doc_id").alias("_row")).distinct()
    return documents(rows.join(bad, "_row", "left_anti"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated so that each source's words come near its target.

    Null sources are a source of their own; null doc_ids come last in theirs; rows that tie in the
    seeded order (one doc_id more than once) follow their size.  A null text has no words and is taken
    as its source's whole repetitions say."""
    ship(spark)
    rows = keyed(docs)
    plan = mix(rows.select("doc_id", "source", word_count().alias("size"), "_row")).filter("repeats > 0")
    # The rows that share a key are equal: the first of them stands for the repetitions of all.
    plan = plan.groupBy("_row").agg(F.sum("repeats").cast("int").alias("repeats"))
    many = rows.join(plan, "_row").dropDuplicates(["_row"])
    return documents(many.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with shard (0 to 7) and slot; equal texts share a shard, null texts too;
    a null doc_id comes first in its shard, and repeated rows each have a slot."""
    rows = documents(docs).withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")).withColumn("_key", F.xxhash64("text"))
    return minimax_shards(rows, "_key", "size", 8, ["doc_id"], name="mixed").drop("_key")


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", simhash_dedup), ("benchmark decontamination", decontaminate),
          ("mixing sources to target weights", mix_sources), ("sharding", shard)]

#: SimHash needs XXH64, which SQL lacks; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs
