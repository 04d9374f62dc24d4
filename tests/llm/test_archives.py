"""Operator 11: archives written and read back."""

from __future__ import annotations

import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from pagemill.llm import warc

SCHEMA = "page_id long, url string, html string"


def inner() -> str:
    """A payload that holds whole records, plain and as a gzip member's bytes would read."""
    fake = warc.record(999, "http://in.side/", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), 200, None, "2000-01-01T00:00:00Z", "0")
    return "pad\r\n\r\n" + fake.decode() + fake.decode() + "WARC/1.1\r\nContent-Length: 5\r\n\r\nfive!\r\n\r\n"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    body = ["<p>" + "é" * rng.randint(0, 900) + str(i) for i in range(40)]
    rows = [(i, f"http://h/{i}?q=a b\r\nX: y", b) for i, b in enumerate(body)]
    rows += [(100 + i, "http://copy/", body[3]) for i in range(30)] + [(2, "http://earlier/", body[7]), (7, "http://again/", body[7])]
    rows += [(200, None, None), (201, "", ""), (202, "u", "short"), (203, "u", "short"), (None, "http://none/", body[3]), (None, None, "z" * 300), (None, None, "z" * 300)]
    rows += [(300, "http://magic/", inner()), (301, "http://magic/2", inner()), (302, "http://long/", "".join(rng.choice("ab<>& ") for _ in range(200_000)))]
    rows += [rows[4], rows[4]]  # repeated rows: both responses, as both have the smallest page_id
    return rows


def expected(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h] = min(p, first.get(h, p))
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and h in first and (p is None or p > first[h])
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("compress,level,split", [(True, 1, 32 << 20), (True, 0, 700), (False, 1, 900)])
def test_round_trip(spark, rows, compress, level, split):
    """Splits far smaller than records: most are entered by pointer jumping alone; with level 0 and
    plain records the payloads' own magic stands in the file."""
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("digest", "size", "payload", "first", "n", "_hot", "file", "at"):
        pages = pages.withColumn(c, F.lit("x"))
    files = warc.write_warc(pages, compress=compress, level=level, file_bytes=20_000)
    assert files.count() >= 3
    got = warc.read_warc(files, split_bytes=split)
    found = got.collect()
    assert sorted([tuple(r[c] for c in COLUMNS) for r in found], key=str) == expected(rows)
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in found if r.record_type == "response")
    if not (compress and level):
        inside = warc.candidates(files, split).count()
        assert inside > len(rows)  # the payloads' records were candidates


def test_frequent_copies_are_spread(spark):
    """Keys with over a thousandth of the copies are broadcast, the others joined: both give the same."""
    rows = [(i, "u", "a" * 150) for i in range(50)] + [(1000 + i, "u", f"{i % 400}" + "b" * 150) for i in range(1200)]
    plan = warc.record_plan(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.page_id, r.refers_to) for r in plan.collect()) == sorted(
        (p, {True: 0, False: 1000 + (p - 1000) % 400}[p < 1000] if p >= 1400 or 0 < p < 1000 else None) for p, _, _ in rows)


def test_empty_table(spark):
    files = warc.write_warc(spark.createDataFrame([], SCHEMA))
    assert files.count() == 0 and warc.read_warc(files).count() == 0


def test_damage_and_foreign_archives(spark, tmp_path):
    """Members without a stated length are read by inflating them; a cut file fails, or keeps what
    comes before the cut."""
    def rec(i):
        body = f"{i}".encode() * 500
        return warc.record(i, f"http://f/{i}", body, hashlib.sha256(body).hexdigest(), len(body), None, "2000-01-01T00:00:00Z", str(i))
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    data = gzip.compress(info) + b"".join(gzip.compress(rec(i)) for i in range(9))
    whole, cut = tmp_path / "a.warc.gz", tmp_path / "b.warc.gz"
    whole.write_bytes(data)
    cut.write_bytes(data[:-20])

    def files(p):
        return spark.createDataFrame([(str(p), os.path.getsize(p))], "file string, bytes long")
    assert sorted(r.page_id for r in warc.read_warc(files(whole), split_bytes=256).collect()) == list(range(9))
    with pytest.raises(ValueError, match="end where the file does"):
        warc.read_warc(files(cut), split_bytes=256).collect()
    assert sorted(r.page_id for r in warc.read_warc(files(cut), split_bytes=256, damaged="keep").collect()) == list(range(8))


def test_standard_reader_sees_the_records(spark, rows):
    """Any gzip reader gives the records one after another."""
    files = warc.write_warc(spark.createDataFrame(rows[:5], SCHEMA).coalesce(1)).collect()
    text = gzip.open(files[0].file.removeprefix("file:")).read()
    assert text.count(b"WARC-Type: response") == 5 and b"\r\nX: y" not in text and b"q=a%20b%0D%0AX:%20y" in text
