from __future__ import annotations

import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, extra=True):
    """documents from (doc_id, text, source) rows, with extra columns of clashing names."""
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOC_SCHEMA)
    from pyspark.sql import functions as F
    if extra:
        for c in ("size", "shard", "slot", "_key", "_row", "key", "line", "fp", "_total", "target", "block", "n_words", "row_id", "_salt"):
            df = df.withColumn(c, F.lit("x"))
    return df


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, equal texts."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 90)), f"s{i % 3}") for i in range(30)]
    rows += [(30, None, "s0"), (31, "", "s1"), (None, "lost words here", None), (32, " \t\n", None)]
    rows += [(33, rows[0][1], "s2"), (34, rows[0][1], None), (0, rows[0][1], "s0"), (35, prose(rng, 6000), "s1")]
    return rows
