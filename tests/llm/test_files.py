"""What small tables and caches take, however many partitions and words there are."""

from __future__ import annotations

from pathlib import Path
from uuid import uuid4

from pagemill.llm import decontam
from pagemill.llm.common import FILE_ROWS, stash
from pagemill.llm.components import components
from pagemill.session import ensure_checkpoint_dir


#: The scratch folder can be shared by sessions.
OWN = f"files{uuid4().hex[:8]}"


def _files(spark, prefix: str) -> dict[str, int]:
    base = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    return {d.name: len(list(d.glob("*.parquet"))) for d in base.glob(f"llm-{prefix}-*")}


def test_small_tables_are_not_a_file_a_partition(spark):
    names = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("20", "false")):
            spark.conf.set(n, v)
        links = spark.range(1, 60).selectExpr("id AS a", "id - 1 AS b")
        out = components(links, f"{OWN}cc").collect()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert sorted(map(tuple, out)) == [(i, 0) for i in range(60)]
    found = _files(spark, f"{OWN}cc")
    assert len(found) > 4 and max(found.values()) == 1


def test_large_tables_keep_their_partitions(spark):
    df = spark.range(0, 40, 1, 8)
    assert stash(df, f"{OWN}large", 8 * FILE_ROWS).count() == 40
    assert list(_files(spark, f"{OWN}large").values()) == [8]
    assert stash(df, f"{OWN}half", 3 * FILE_ROWS + 1).count() == 40
    assert list(_files(spark, f"{OWN}half").values()) == [4]


def test_word_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(decontam.Tokens, "FULL", 8)
    words = [b"Lisbon", b"plain", b"12", b"5km", b"km", b"Plain"]
    cache = decontam.Tokens()
    fresh = [a.tolist() for a in decontam.Tokens().templates(words)]
    for i in range(9):
        cache.templates([b"w%d" % i])
        assert [a.tolist() for a in cache.templates(words)] == fresh
        assert len(cache) <= 8 + len(words)
    typed, folded = fresh
    # A name is a placeholder as typed, and the word in lower case when folded.
    assert typed[0] == typed[5] != typed[1] == folded[1] == folded[5]
