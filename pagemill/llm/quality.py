"""Operator 2, quality rules: cross-document line frequency."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, read_table, salted_join, stash

SYMBOLS = "#*$%&|<>"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes split at exactly the six ASCII white-space characters
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        twice = bytearray(len(windows))
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                twice[i] = twice[j] = 1
        end = 0  # words before `end` are counted
        for i in range(len(windows)):
            if twice[i]:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, dup, repeated


def with_base_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    src = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + [f"{n} long" for n in names])

    def run(batches):
        for b in batches:
            counts = [base_counts(t.as_py()) for t in b.column(len(keep))]
            columns = list(zip(*counts)) if counts else [()] * 5
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, pa.int64()) for c in columns]], names=[*keep, *names])

    return src.mapInArrow(run, schema)


def normal_line(line: Column) -> Column:
    """A line as it is compared: A-Z lower-cased, digit runs as one 0, blanks collapsed, trimmed."""
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.btrim(F.regexp_replace(F.regexp_replace(low, "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))


def row_id() -> Column:
    """A hash of a row of documents; repeated rows share it."""
    return F.xxhash64("doc_id", "source", "text")


def line_rules(docs: DataFrame, least_docs: int = 5, host_share: float = 0.05, always_docs: int = 20, depleted: float = 0.5, name: str = "quality") -> DataFrame:
    """doc_id, row_id, the base counts, base_failed, n_line_words (words in lines above the limit),
    kept, and removed_lines: the places (from 0) of the lines above the limit, null without any.

    Lines are normalised and hashed (xxhash64), once a document.  A line is above the limit of a
    host (column source) if it is in at least `least_docs` distinct documents of the host and in
    more than `host_share` of them, or in at least `always_docs`, however large the host is;
    documents with equal texts count once, so a group of copies
    doesn't make its own lines frequent.  Those lines are removed, and a document that keeps
    under `depleted` of its words is rejected, as is one that the base rules fail.  Counts per
    line combine before the shuffle; a line in most documents is joined back over many tasks.

    A null text has no words and is rejected by the base rules; a null source is a host of
    its own; repeated rows each get a row; null doc_ids are kept."""
    rows = (docs.select("doc_id", "source", "text")
            .withColumn("_text_id", F.xxhash64("text"))
            .withColumn("row_id", row_id()))
    base = stash(with_base_counts(rows, "doc_id", "source", "row_id").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), f"{name}-base")
    line = F.col("line")
    lines = (rows.filter("text is not null")
             .select("source", "row_id", "_text_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
             .withColumn("n", F.regexp_count(line, F.lit(WORD))).filter("n > 0")
             .select("source", "row_id", "_text_id", F.xxhash64(normal_line(line)).alias("h"), "n", "pos"))
    lines = stash(lines, f"{name}-lines")
    hosts = lines.select("source", "_text_id").distinct().groupBy("source").agg(F.count("*").alias("host_docs"))
    counts = lines.select("source", "h", "_text_id").distinct().groupBy("source", "h").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min(least_docs, always_docs))
    n = lines.count()
    hosts, counts = stash(hosts, f"{name}-hosts", n), stash(counts, f"{name}-counts", n)
    share = (F.col("docs") >= least_docs) & (F.col("docs") > host_share * F.col("host_docs"))
    frequent = stash(salted_join(counts, hosts, "source", F.col("h"), 8).filter(share | (F.col("docs") >= always_docs)).select(F.xxhash64("source", "h").alias("key")).distinct(), f"{name}-frequent", n)
    hit = salted_join(lines.select("row_id", "n", "pos", F.xxhash64("source", "h").alias("key")), frequent, "key", F.col("row_id"), 32)
    removed = stash(hit.groupBy("row_id").agg(F.sum("n").cast("long").alias("all_line_words"), F.collect_set("pos").alias("removed_lines")), f"{name}-removed", n)
    copies = base.groupBy("row_id").agg(F.count("*").alias("copies"))
    removed = removed.join(copies, "row_id").select("row_id", (F.col("all_line_words") / F.col("copies")).cast("long").alias("n_line_words"), "removed_lines")
    out = base.join(removed, "row_id", "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("n_line_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= depleted * F.col("n_words"))).drop("source")


def without_lines(text: Column, places: Column) -> Column:
    """`text` without the lines at `places` (from 0): the others, in order.  Linear in its lines."""
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")


def clean_documents(docs: DataFrame, name: str = "quality") -> DataFrame:
    """The kept rows of docs (doc_id, source, text, n_chars and others), repeated rows included,
    without their lines above the limit; n_chars counts what is left of such a text."""
    rules = line_rules(docs, name=name).filter("kept").groupBy("row_id").agg(F.first("removed_lines").alias("_places"))
    rows = docs.withColumn("_row_id", row_id()).join(rules.withColumnRenamed("row_id", "_rule_id"), F.col("_row_id") == F.col("_rule_id"))
    cut = F.col("_places").isNotNull()
    return (rows.withColumn("text", F.when(cut, without_lines(F.col("text"), F.col("_places"))).otherwise(F.col("text")))
            .withColumn("n_chars", F.when(cut, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
            .drop("_row_id", "_rule_id", "_places"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "kept")


ORACLE = """
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (
  SELECT doc_id, source, text, pos, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n,
         trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM w)),
dup AS (SELECT doc_id, CAST(sum(c - 1) AS BIGINT) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS c FROM l WHERE n > 0 GROUP BY doc_id, line) GROUP BY doc_id),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
gr AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, CAST(count(DISTINCT i + o) AS BIGINT) AS n_repeat_words FROM gr, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT text) AS host_docs FROM l WHERE n > 0 GROUP BY source),
fr AS (SELECT l.source, norm, count(DISTINCT text) AS docs, any_value(host_docs) AS host_docs FROM l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE n > 0 GROUP BY l.source, norm),
rem AS (SELECT l.doc_id, CAST(sum(l.n) AS BIGINT) AS n_line_words FROM l JOIN fr ON l.source IS NOT DISTINCT FROM fr.source AND l.norm = fr.norm
        WHERE l.n > 0 AND (fr.docs >= 5 AND fr.docs > 0.05 * fr.host_docs OR fr.docs >= 20) GROUP BY l.doc_id),
b AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_line_words, 0) AS n_line_words
  FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN rem ON w.doc_id = rem.doc_id)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (n_words - n_line_words) >= 0.5 * n_words AS kept
FROM b
"""
