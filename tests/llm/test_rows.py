"""Sharding, mixing, quality rules and SimHash against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from pagemill.llm import mixing, quality, sharding, simhash

from .conftest import make, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards_are_minimax(spark, odd_rows):
    out = sharding.shard_documents(make(spark, odd_rows)).collect()
    assert len(out) == len(odd_rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert set(by) <= set(range(8))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    place = defaultdict(set)
    for r in out:
        place[(r.text_crc32, r.size)].add(r.shard)
    assert all(len(s) == 1 for s in place.values())
    sizes = Counter(len((t or "").encode()) + 1 for _, t, _ in odd_rows)
    assert Counter(r.size for r in out) == sizes
    assert {r.text_crc32 for r in out} == {None if t is None else zlib.crc32(t.encode()) for _, t, _ in odd_rows}


def brute_capacity(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                n, at = n + 1, 0
            at += s
        low, high = (low, mid) if n <= k else (mid + 1, high)
    return low


def test_capacity_is_the_smallest(spark):
    rng = random.Random(5)
    for k, sizes in ((3, [rng.randint(1, 50) for _ in range(40)]), (8, [rng.randint(1, 9) for _ in range(30)] + [400]), (5, [7, 7])):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k long, size long")
        out = sharding.minimax_shards(df, "k", "size", k, ["k"]).orderBy("k").collect()
        sums = Counter()
        for r in out:
            sums[r.shard] += r.size
        assert [r.shard for r in out] == sorted(r.shard for r in out)
        assert max(sums.values()) == brute_capacity(sizes, k)
        if len(sizes) >= 2 * k and max(sizes) < 51:
            assert len(sums) == k


def test_empty_tables(spark):
    empty = make(spark, []).filter("false")
    assert sharding.shard_documents(empty).count() == 0
    assert quality.line_rules(empty).count() == 0
    assert simhash.simhash_groups(empty).count() == 0
    assert mixing.mix(empty.select("doc_id", "source", mixing.word_count().alias("size"))).count() == 0


def water(sizes, weights, share):
    budget, caps, done = share * sum(sizes), [2.0 * s for s in sizes], set()
    while True:
        level = (budget - sum(caps[i] for i in done)) / max(1e-9, sum(w for i, w in enumerate(weights) if i not in done))
        more = {i for i, w in enumerate(weights) if i not in done and w * level > caps[i]}
        if not more:
            return [caps[i] if i in done else w * level for i, w in enumerate(weights)]
        done |= more


def test_mix(spark, odd_rows):
    docs = make(spark, odd_rows).select("doc_id", "source", mixing.word_count().alias("size"), "slot")
    out = mixing.mix(docs).collect()
    assert len(out) == len(odd_rows) and "slot" in out[0].asDict()
    sources = sorted({s for _, _, s in odd_rows if s is not None}) + [None]
    sizes = [sum(len(WORDS.findall(t or "")) for _, t, s in odd_rows if s == x) for x in sources]
    targets = water(sizes, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sources))], 1.5)
    for x, size, target in zip(sources, sizes, targets):
        rows = [r for r in out if r.source == x]
        assert all(r.source_size == size and abs(r.target - target) < 1e-6 and 0 <= r.repeats <= 2 for r in rows)
        assert abs(sum(r.size * r.repeats for r in rows) - target) <= max(r.size for r in rows)
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda rs: Counter((r.doc_id, r.source, r.size, r.repeats) for r in rs)
    assert key(out) == key(again)


def brute_counts(text):
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    c = Counter(wins)
    hit = {i + o for i, w in enumerate(wins) if c[w] > 1 for o in range(3)}
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, odd_rows):
    rows = odd_rows + [(50, "a b c a b c a\nx #$\nx #$\n\n", "s0"), (51, "the the the the", "s1"), (52, "a\x0bb\x1cc d", "s1")]
    out = quality.line_rules(make(spark, rows)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == Counter((i, *brute_counts(t)) for i, t, _ in rows)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in out)


def test_frequent_lines_deplete(spark):
    rng = random.Random(9)
    line = " ".join(prose(rng, 1) for _ in range(40))
    rows = [(i, line.upper() + "  \n" + prose(rng, 30), "h") for i in range(22)]          # 40 of 70 words are the line
    rows += [(100 + i, line + "\n" + prose(rng, 100), "h") for i in range(20)]              # kept, mostly their own
    rows += [(200 + i, prose(rng, 60), "h") for i in range(100)]                           # clean
    rows += [(300 + i, rows[-1][1], "h") for i in range(60)]                               # copies count once
    rows += [(400, rows[0][1], "other"), (None, rows[0][1], "h"), rows[3]]                 # another host; null id; repeated row
    out = {}
    for r in quality.line_rules(make(spark, rows)).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert all(not r.kept and r.n_line_words == 40 for i in range(22) for r in out[i]) and len(out[3]) == 2
    assert all(out[100 + i][0].kept and out[100 + i][0].n_line_words == 40 for i in range(20))
    assert all(out[i][0].kept for i in [*range(200, 300), *range(300, 360), 400]) and not out[None][0].kept


def test_frequent_lines_are_removed(spark):
    rng = random.Random(10)
    line = "  Share this PAGE with 12 friends "
    bodies = [prose(rng, 60) + "\n\n" + prose(rng, 60) for _ in range(19)]
    rows = [(i, f"{line}\n{b}\n\n{line.strip().lower()}\n", "h") for i, b in enumerate(bodies)]
    rows += [(20, rows[0][1], "other"), (None, rows[1][1], "h"), rows[2], (21, prose(rng, 70) + "\n\n x ", "h"), (22, line, "h"), (23, None, "h"), (24, "", "h")]
    want = Counter((i, f"{b}\n\n") for i, b in enumerate(bodies))
    want += Counter([(20, rows[0][1]), (None, bodies[1] + "\n\n"), (2, bodies[2] + "\n\n"), (21, next(t for i, t, _ in rows if i == 21))])
    out = quality.clean_documents(make(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == want
    assert all(r.n_chars == len(r.text) for r in out)


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(spark, odd_rows):
    out = simhash.simhash_groups(make(spark, odd_rows)).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((i, f"{brute_fp(t):016x}") for i, t, _ in odd_rows)
    one = spark.createDataFrame([("a b c",)], "t string").selectExpr("xxhash64(t) as h").first().h
    assert xxhash.xxh64_intdigest(b"a b c", 42) == one % 2**64


def test_links_and_components(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 25)):  # chains and balls
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            fps.add(x)
    base = rng.getrandbits(64)
    fps |= {base ^ v for v in range(300)}  # a large group under one key
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    want = defaultdict(set)
    for f in fps:
        want[find(f)].add(f)
    signed = lambda f: f - 2**64 if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    from pagemill.llm.components import components
    got = defaultdict(set)
    for r in components(simhash.links(df)).collect():
        got[r.root].add(r.node)
        assert r.root <= r.node
    assert {frozenset(map(signed, s)) for s in want.values() if len(s) > 1} == {frozenset(s) for s in got.values()}


def test_callers_columns_of_our_names(spark):
    """Columns that a caller names as the operators name theirs are kept, with their values."""
    names = ["_pid", "_seq", "_lead", "_local", "_start", "_one", "_order", "_total", "_salt", "_small_salt", "_key", "_SEQ2", "__pid", "_small_key"]
    rows = [(i % 7 if i % 5 else None, f"s{i % 2}" if i % 3 else None, i % 4 + 1, i) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, no int")
    plain = {"mix": mixing.mix(df.select("doc_id", "source", "size", "no")), "shard": sharding.minimax_shards(df, "doc_id", "size", 3, ["no"])}
    for n in names:
        df = df.withColumn(n, F.concat(F.lit(n), F.col("no").cast("string")))
    odd = df.withColumns({c: F.lit("old") for c in ("source_size", "target", "repeats", "shard", "slot")})
    got = {"mix": mixing.mix(odd), "shard": sharding.minimax_shards(odd, "doc_id", "size", 3, ["no"])}
    for k, new in (("mix", ["source_size", "target", "repeats"]), ("shard", ["shard", "slot"])):
        out = got[k].collect()
        assert all(r[n] == f"{n}{r.no}" for r in out for n in names)
        want = Counter((r.no, *[r[c] for c in new]) for r in plain[k].collect())
        assert Counter((r.no, *[r[c] for c in new]) for r in out) == want
