"""Operator 11, WARC: archives of pages, read back by boundary-chain verification.

A record is a gzip member of its own, as archives of crawls have it, whose header tells the
member's length in an extra field; plain archives and members without that field are read as well.

A reader's task sees a part of a file and cannot know whether the magic it meets begins a record or
stands in a payload.  So each task emits what could be a record with the place of its successor;
pointer jumping from the start of each file then keeps what the chain reaches, and only that
is read."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import scratch_dir

from .common import open_folder, read_table, spread_join, stash

# The format's version line, the profile of a revisit, the magic of a gzip member.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
_EXTRA = 4  # the gzip flag of an extra field
_FIELD = b"WL"  # ours: the bytes of the whole member, 64 bits
_MEMBER = struct.Struct("<3sBIBBH2sHQ")
_STARTS = re.compile(rb"\x1f\x8b\x08|(?:\A|(?<=\r\n\r\n))WARC/1\.[01]\r\n")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def member(data: bytes, level: int) -> bytes:
    """A gzip member that states its own length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(data) + deflate.flush()
    size = _MEMBER.size + len(body) + 8
    return (_MEMBER.pack(GZIP, _EXTRA, 0, 0, 255, 12, _FIELD, 8, size) + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str, record_id: str) -> bytes:
    """The bytes of a response record or, without a payload, of a revisit record.  Control
    characters and blanks of the URL are percent-encoded."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    head = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: quote(m[0]), url)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if payload is None:
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    head += [("X-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def record_plan(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload (null for a revisit), digest, size, refers_to of each row of pages
    (page_id, url, html).

    A payload of `least` bytes or more that a smaller page_id has as well becomes a revisit of
    the smallest.  Rows that tie on the smallest page_id are all responses; null page_ids come after
    all others, and if no row with that payload has a page_id, all are responses.  Null html is
    an empty payload."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    copies = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = stash(copies.filter("n > 1 and first is not null"), "warc-copies")
    out = spread_join(rows, first, "digest", "page_id")
    # Smaller rows met no group: their digest is in none, as equal payloads are of equal size.
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return out.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "size", F.when(again, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, date: str = "2000-01-01T00:00:00Z", level: int = 1, compress: bool = True, file_bytes: int = 1 << 30,
               least: int = 100, name: str = "warc") -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) and return the manifest: file, bytes,
    records.  record_plan() says which are revisits.  Extra columns are ignored; a table
    without rows gives no file.

    A task writes files of about `file_bytes`.  Their names are the attempt's own, and the manifest,
    which Spark commits, names those that count, so a lost executor leaves only files nobody
    reads.  Records are written as they come, one in memory."""
    folder = scratch_dir(pages.sparkSession, name)
    suffix = ".warc.gz" if compress else ".warc"

    def run(batches):
        where, base = open_folder(folder)
        out, path, at, n = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([at]), pa.array([n])], names=["file", "bytes", "records"])

        for b in batches:
            for row in zip(*b.columns):
                page_id, url, payload, digest, size, refers = (v.as_py() for v in row)
                if out is None:
                    where.create_dir(base, recursive=True)
                    path, at, n = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{suffix}", 0, 0
                    out = where.open_output_stream(f"{base}/{path}", compression=None)
                data = record(page_id, url, payload, digest, size, refers, date, uuid.uuid5(uuid.NAMESPACE_URL, f"{path}#{n}"))
                data = member(data, level) if compress else data
                out.write(data)
                at, n = at + len(data), n + 1
                if at >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    plan = record_plan(pages, least).select("page_id", "url", "payload", "digest", "size", "refers_to")
    return stash(plan.mapInArrow(run, "file string, bytes long, records long"), f"{name}-manifest")


class Reach:
    """Bytes of a file by place: a part kept in memory, the rest read as asked for."""

    def __init__(self, uri: str, start: int, end: int):
        where, path = open_folder(uri)
        self.file = where.open_input_file(path)
        self.size = self.file.size()
        self.start = max(0, start)
        self.part = self.file.read_at(max(0, min(end, self.size) - self.start), self.start)

    def get(self, at: int, n: int) -> bytes:
        i = at - self.start
        if 0 <= i and i + n <= len(self.part):
            return self.part[i:i + n]
        return self.file.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""

    def chunks(self, at: int, step: int = 1 << 14) -> Iterator[bytes]:
        while at < self.size:
            data = self.get(at, step)
            yield data
            at, step = at + len(data), min(2 * step, 1 << 24)


def _headers(head: bytes) -> dict[str, str] | None:
    """The named fields of a record's head; None for what is no head."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = [line.partition(":") for line in lines[1:] if line]
    if not lines[0].startswith("WARC/") or not all(sep and name.strip() for name, sep, _ in fields):
        return None
    return {name.strip().lower(): value.strip() for name, _, value in fields}


def _plain(file: Reach, at: int) -> tuple[dict[str, str], int, int] | None:
    """Fields, place of the block and its length, of the plain record at `at`."""
    head = b""
    for data in file.chunks(at):
        # A blank line comes before each magic, so no head is looked for past the next magic.
        seen = max(0, len(head) - 3)
        head += data
        if (end := head.find(b"\r\n\r\n", seen)) >= 0:
            fields = _headers(head[:end])
            length = (fields or {}).get("content-length", "")
            return (fields, at + end + 4, int(length)) if length.isascii() and length.isdigit() else None
    return None


def _stated_length(file: Reach, at: int) -> int:
    """The length a gzip member states in its extra field, 0 if it states none."""
    head = file.get(at, 12)
    if len(head) < 12 or not head[3] & _EXTRA:
        return 0
    extra = file.get(at + 12, struct.unpack_from("<H", head, 10)[0])
    while len(extra) >= 4:
        name, n = struct.unpack_from("<2sH", extra)
        if name == _FIELD and n == 8 and len(extra) >= 12:
            return struct.unpack_from("<Q", extra, 4)[0]
        extra = extra[4 + n:]
    return 0


def _inflate(file: Reach, at: int, most: int | None = None) -> tuple[bytes, int]:
    """The first `most` bytes (default: all) of the gzip member at `at`, and where it ends (-1: it doesn't)."""
    stream, out = zlib.decompressobj(31), b""
    parts = []
    for data in file.chunks(at):
        try:
            out = stream.decompress(data, 0 if most is None else most - sum(map(len, parts)))
        except zlib.error:
            return b"", -1
        parts.append(out)
        at += len(data) - len(stream.unused_data)
        if stream.eof:
            return b"".join(parts), at
        if most is not None and sum(map(len, parts)) >= most:
            break
    return b"".join(parts), -1


def successor(file: Reach, at: int) -> int | None:
    """Where the record that may begin at `at` says its successor begins; None if nothing there
    looks like a record."""
    if file.get(at, 3) != GZIP:
        found = _plain(file, at)
        after = found[1] + found[2] + 4 if found else None
    elif not _inflate(file, at, 5)[0].startswith(b"WARC/"):
        return None
    else:
        stated = _stated_length(file, at)
        after = at + stated if stated else _inflate(file, at)[1]
    return after if after is not None and at < after <= file.size else None


def _splits(manifest: DataFrame, split_bytes: int) -> DataFrame:
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    n = manifest.agg(F.sum(F.ceil(F.greatest(F.col("bytes"), F.lit(1)) / split_bytes))).first()[0] or 1
    return manifest.select("file", begin.alias("start")).repartition(int(n), "file", "start")


def candidates(manifest: DataFrame, split_bytes: int) -> DataFrame:
    """file, at, successor, leaves: what could be a record, where its successor would begin, and
    where the chain from it first leaves the split (the task knows the way within it)."""
    def run(batches):
        for b in batches:
            for uri, start in zip(*(c.to_pylist() for c in b.columns)):
                file = Reach(uri, start - 4, start + split_bytes + 16)
                end, found = start + split_bytes, {}
                # Bytes before the split serve the look-behind alone.
                for m in _STARTS.finditer(file.part, min(start, start - file.start)):
                    at = file.start + m.start()
                    if start <= at < end and (after := successor(file, at)) is not None:
                        found[at] = after
                leaves: dict[int, int] = {}
                for at in sorted(found, reverse=True):
                    leaves[at] = leaves.get(found[at], found[at])
                file.file.close()
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(found), pa.string()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64()),
                                                  pa.array([leaves[a] for a in found], pa.int64())], names=["file", "at", "successor", "leaves"])

    return _splits(manifest, split_bytes).mapInArrow(run, "file string, at long, successor long, leaves long")


def chain_entries(manifest: DataFrame, split_bytes: int, damaged: str = "fail") -> DataFrame:
    """file, at: the first record of the chain in each split that the chain from the file's start enters.

    Pointer jumping over the candidates that another one's chain leads to: a round doubles how far
    pointers go, so the rounds are the logarithm of a file's splits.  The chain has to
    end where the file does; with `damaged` = "keep" the records before the damage are kept instead of
    failing."""
    found = stash(candidates(manifest, split_bytes), "warc-candidates")
    aims = found.select("file", F.col("leaves").alias("at")).distinct()
    # Which candidates can be entered: a file's start, and where chains out of other splits lead.
    nodes = stash(found.filter("at = 0").unionByName(found.filter("at > 0").join(aims, ["file", "at"], "left_semi"))
                  .select("file", "at", F.col("leaves").alias("to")), "warc-nodes")
    most = manifest.agg(F.max("bytes")).first()[0] or 1
    reached, jumps = nodes.filter("at = 0").select("file", "at"), nodes
    for i in range(math.ceil(math.log2(max(2, -(-most // split_bytes))))):
        step = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        # Only what is a candidate itself goes on; the end of a file is none.
        reached = stash(reached.unionByName(step.join(nodes.select("file", "at"), ["file", "at"], "left_semi")).distinct(), f"warc-reached-{i}")
        far = jumps.select("file", F.col("to").alias("mid"), F.col("at").alias("from"))
        jumps = stash(far.join(jumps.withColumnRenamed("at", "mid"), ["file", "mid"]).select("file", F.col("from").alias("at"), "to"), f"warc-jumps-{i}")
    if damaged == "fail":
        ends = reached.join(nodes, ["file", "at"]).join(manifest.select("file", "bytes"), "file").filter("to = bytes").select("file")
        broken = manifest.filter("bytes > 0").join(ends, "file", "left_anti").limit(1).collect()
        if broken:
            raise ValueError(f"the records of {broken[0]['file']} don't end where the file does")
    return reached


RECORD = "file string, at long, record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_warc(manifest: DataFrame, split_bytes: int = 32 << 20, payload: bool = True, damaged: str = "fail") -> DataFrame:
    """The records of the archives in manifest (file, bytes), RECORD's columns: those that the
    chain from each file's start reaches, whatever their payloads hold.

    Of a response, payload (the HTTP body) with its length and SHA-256, which have to equal what
    the record says; of a revisit, what it says of them.  payload=False leaves the bytes out."""
    entries = chain_entries(manifest, split_bytes, damaged)
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def parse(file: Reach, uri: str, at: int) -> tuple | None:
        if file.get(at, 3) == GZIP:
            data, _ = _inflate(file, at)
            cut = data.find(b"\r\n\r\n")
            fields = _headers(data[:cut])
            block = data[cut + 4:cut + 4 + int(fields["content-length"])]
        else:
            fields, place, n = _plain(file, at)
            block = file.get(place, n)
        kind = fields.get("warc-type")
        if kind not in ("response", "revisit"):
            return None
        said = fields.get("warc-payload-digest", "").partition(":")[2]
        body = block.partition(b"\r\n\r\n")[2]
        size, digest = number(fields.get("x-payload-length")), said
        if kind == "response":
            digest = hashlib.sha256(body).hexdigest()
            if said and "x-payload-length" in fields and (said, size) != (digest, len(body)):
                raise ValueError(f"{uri}, record at {at}: the payload isn't what its digest says")
            size = len(body)
        return (uri, at, kind, fields.get("warc-target-uri"), number(fields.get("x-page-id")), number(fields.get("x-refers-to-page")), size, digest,
                body if payload and kind == "response" else None)

    def run(batches):
        for b in batches:
            for uri, at in zip(*(c.to_pylist() for c in b.columns)):
                end = at - at % split_bytes + split_bytes
                file, rows, held = Reach(uri, at, end), [], 0
                while at is not None and at < min(end, file.size):
                    after = successor(file, at)
                    row = parse(file, uri, at) if after is not None else None
                    if row:
                        rows.append(row)
                        held += len(row[-1] or b"") + 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
                    at = after
                file.file.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    n = manifest.agg(F.sum(F.ceil(F.greatest(F.col("bytes"), F.lit(1)) / split_bytes))).first()[0] or 1
    return entries.repartition(int(n), "file", "at").mapInArrow(run, RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from archives of all pages."""
    out = read_warc(write_warc(read_table(spark, sf_dir, "pages")), payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
m AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
             min(page_id) OVER (PARTITION BY payload) AS first
      FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN first END AS refers_to
FROM m
"""
