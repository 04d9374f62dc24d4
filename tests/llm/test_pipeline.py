"""run() of the pipeline against a brute-force version, and the registration of the queries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

from .conftest import make, prose
from .test_rows import WORDS, brute_counts, brute_fp, water


def corpus(rng):
    items = [prose(rng, 40) for _ in range(3)]
    rows = [(i, prose(rng, rng.randint(60, 200)), f"s{i % 4}") for i in range(80)]
    rows += [(100 + i, rows[0][1], f"s{i % 4}") for i in range(12)]                                      # exact copies
    rows += [(120 + i, rows[1][1].replace(" ", "  ", 1) + " end", "s1") for i in range(3)]                # near copies
    rows += [(140 + i, prose(rng, 40) + " " + items[i] + " " + prose(rng, 40), "s2") for i in range(3)]   # benchmark passages
    rows += [(150, "short text", "s0"), (151, None, "s1"), (152, "", None), (153, "same " * 80, "s3"), (154, prose(rng, 90), None)]
    line = prose(rng, 60)
    rows += [(160 + i, line + "\n" + prose(rng, 30), "s3") for i in range(20)]                            # depleted
    return rows, items


def brute(rows, items):
    """Quality, near-dedup, decontamination and mixing; the words that each document is taken with."""
    by_host = defaultdict(set)
    norm = lambda x: " ".join(WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)))
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if WORDS.search(x):
                by_host[s, norm(x)].add(t)
    frequent = {k for k, v in by_host.items() if len(v) >= 20}
    kept = []
    for i, t, s in rows:
        n, _, _, _, rep = brute_counts(t)
        cut = sum(len(WORDS.findall(x)) for x in (t or "").split("\n") if (s, norm(x)) in frequent)
        if n >= 50 and 2 * rep <= n and n - cut >= 0.5 * n:
            kept.append((i, t, s))
    fps, root = {i: brute_fp(t) for i, t, _ in kept}, {i: i for i, _, _ in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = [r for r in kept if find(r[0]) == r[0]]
    kept = [r for r in kept if not any(x in r[1] for x in items)]
    sources = sorted({s for _, _, s in kept if s is not None}) + [None] * any(s is None for _, _, s in kept)
    out = Counter()
    sizes = [sum(len(WORDS.findall(t)) for _, t, s in kept if s == x) for x in sources]
    for x, size, target in zip(sources, sizes, water(sizes, [(3.0, 1.0, 2.0)[k % 3] for k in range(len(sources))], 1.5)):
        whole, total = int(target / size), 0
        rest = target - whole * size
        for i, t, _ in sorted((r for r in kept if r[2] == x), key=lambda r: hashlib.md5(f"8:{r[0]}".encode()).hexdigest()):
            n = len(WORDS.findall(t))
            total += n
            out[i] += whole + (total - n / 2 <= rest)
    return +out


def test_run(spark, tmp_path):
    import corpus_pipeline
    rows, items = corpus(random.Random(11))
    make(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES][:2] == ["quality rules", "SimHash near-dedup"] and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == brute(rows, items)
    texts = {i: t for i, t, _ in rows}
    assert all(r.text == texts[r.doc_id] for r in out)
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(len(v) == 1 for v in _shards(out).values())


def test_null_and_repeated_ids(spark, tmp_path):
    """Rows without a doc_id, and different rows with one doc_id, go through every stage."""
    import corpus_pipeline as c
    rng = random.Random(14)
    item = prose(rng, 40)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(None, prose(rng, 90), "s0") for _ in range(6)] + [(7, prose(rng, 90), "s1") for _ in range(4)] + [(8, prose(rng, 90), None)]
    copies = [(None, clean[0][1], "s1"), clean[1], clean[6], (9, clean[2][1], "s0")]    # of null ids, rows that repeat, one with an id
    bad = [(None, prose(rng, 30) + " " + item, "s0"), (7, item + " " + prose(rng, 30), "s1")]
    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    count = lambda rows: Counter((i, t) for i, t, _ in rows)
    rows = clean + copies + bad
    docs, path = make(spark, rows), str(tmp_path)
    assert pairs(c.quality_rules(spark, docs, path)) == count(rows)
    once = Counter({(9 if t == clean[2][1] else i, t): 1 for i, t, _ in clean + bad})
    assert pairs(c.simhash_dedup(spark, docs, path)) == once
    assert pairs(c.decontaminate(spark, docs, path)) == count(clean + copies)
    got, size = pairs(c.mix_sources(spark, docs, path)), sum(len(t.split()) for _, t, _ in rows)
    assert abs(sum(len(t.split()) * n for (_, t), n in got.items()) - 1.5 * size) <= 3 * 90   # half a row a source at most
    assert all(n <= 2 * count(rows)[k] for k, n in got.items()) and {t for i, t in got if i is None}
    assert pairs(c.shard(spark, docs, path)) == count(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {(r.doc_id, r.text) for r in c.run(spark, path).collect()}
    assert out <= {k for k in once if item not in k[1]} and sum(i is None for i, _ in out) >= 3


def _shards(out):
    by = defaultdict(set)
    for r in out:
        by[r.text].add(r.shard)
    return by


def test_empty_table(spark, tmp_path):
    import corpus_pipeline
    make(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry
    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert {"op2_quality", "op6_chat", "op8_mixing", "op11_warc", "op12_vectorcode"} <= set(entry.oracle_sql())
