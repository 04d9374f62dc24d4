"""Operator 3, token-ID output: files of concatenated ids with Elias-Fano document boundaries.

File format: the ids as little-endian unsigned 16-bit integers (32-bit where a vocabulary needs
it); the Elias-Fano code of the end of each document; that of the doc_ids, in ascending order;
then a footer (magic, id width, number of leading null doc_ids, bytes of each part)."""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import scratch_dir

from .common import open_folder, read_table, stash
from .eliasfano import EliasFano, encode

_FOOT = "<8sBIQQQ"
_MAGIC = b"EFTOKEN1"


class ChunkEncoder:
    """Token ids of texts as bytes, for a byte-level BPE whose pre-tokens begin at single blanks.

    A text is cut before each blank or line feed that stands between two other characters.  No
    pre-token goes over such a place, so the ids of the chunks, one after another, are the ids of
    the text.  Each distinct chunk is encoded once, many in a call.  Texts in which some chunk
    begins or ends with white space (runs of blanks, tabs), or that hold the string of an added
    token (which the library finds before it cuts words), are encoded whole."""

    def __init__(self, path: str, max_kept: int = 3 << 19):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.max_kept = max_kept
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.opens = np.array([n.startswith(("Ġ", "Ċ")) for n in names])  # a blank or a line feed
        self.known: dict[str, bytes | None] = {}  # by chunk, without its blank
        self.marks = dict(zip(".,;:!?", self._plain(list(".,;:!?"))))

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: set[str]) -> None:
        stems, marked = set(), []
        for c in chunks:
            body = c[1:] if c[:1] == "\n" else c
            if not body or body[0].isspace() or body[-1].isspace():
                self.known[c] = None  # not safe to cut here
            elif len(c) > 1 and c[-1] in self.marks and c[-2].isalpha():  # a run of letters ends at the mark
                marked.append(c)
                if c[:-1] not in self.known:
                    stems.add(c[:-1])
            else:
                stems.add(c)
        new = list(stems)
        for s in range(0, len(new), 1024):
            self._learn_joined(new[s:s + 1024])
        for c in marked:
            stem = self.known[c[:-1]]
            self.known[c] = None if stem is None else stem + self.marks[c[-1]]

    def _learn_joined(self, part: list[str]) -> None:
        texts = [c if c[0] == "\n" else " " + c for c in part]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self.opens[ids]) * self.dtype.itemsize
        if len(cuts) == len(part) and cuts[0] == 0:
            raw, cuts = ids.tobytes(), cuts.tolist()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, cuts, [*cuts[1:], len(raw)]))))
        else:  # a chunk holds an opening id of its own
            self.known.update(zip(part, self._plain(texts)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.max_kept:
            self.known.clear()
        rows = [t.replace("\n", " \n").split(" ") for t in texts]
        heads = [r.pop(0) for r in rows]
        self._learn(set(chain.from_iterable(rows)).difference(self.known))
        known = self.known.__getitem__
        out: list[bytes] = []
        for t, head, rest, first in zip(texts, heads, rows, self._plain(heads)):
            parts = list(map(known, rest))
            if rest and (not head or head[-1].isspace()) or None in parts or any(map(t.__contains__, self.added)):
                out.extend(self._plain([t]))
            else:
                out.append(first + b"".join(parts))
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder that a Python worker keeps from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 0, name: str = "token-files") -> DataFrame:
    """Write the ids of every text and return the manifest: file, first (place of its first
    document in doc_id order), n_docs, n_ids, in the order of the files' ranges.

    Documents are range-partitioned by doc_id, a file a task.  A file's name is the attempt's
    own, and the manifest, which Spark commits, names the files that count: a lost executor or a
    second attempt leaves only files that nobody reads.  ids go to the file as they come."""
    folder = scratch_dir(docs.sparkSession, name)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = src.repartitionByRange("doc_id", F.crc32(F.encode("text", "UTF-8"))).sortWithinPartitions("doc_id", "text")

    def run(batches):
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        out, ends, keys, nulls, at, path = None, [], [], 0, 0, ""
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                where, base = open_folder(folder)
                where.create_dir(base, recursive=True)
                path = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
                out = where.open_output_stream(f"{base}/{path}")
            texts = [t.as_py() or "" for t in b.column(1)]
            for s in range(0, len(texts), 2000):
                done = enc.encode(texts[s:s + 2000])
                sizes = np.array([len(x) // enc.dtype.itemsize + 1 for x in done], np.int64)
                out.write(end.join([*done, b""]))
                ends.append(at + np.cumsum(sizes))
                at = int(ends[-1][-1])
            nulls += b.column(0).null_count
            keys.append(b.column(0).drop_null().to_numpy())
        if out is None:
            return
        ends_all, keys_all = np.concatenate(ends), np.concatenate(keys)
        parts = encode(ends_all), encode(keys_all)
        for p in parts:
            out.write(p)
        out.write(struct.pack(_FOOT, _MAGIC, enc.dtype.itemsize, nulls, at * enc.dtype.itemsize, len(parts[0]), len(parts[1])))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([TaskContext.get().partitionId()]), pa.array([len(ends_all)]), pa.array([at])],
                                         schema=pa.schema([("file", pa.string()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return stash(ranged.mapInArrow(run, "file string, part long, n_docs long, n_ids long"), f"{name}-manifest")


class TokenFile:
    """A file of write_token_files(): documents by their place in it."""

    def __init__(self, uri: str):
        where, path = open_folder(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        magic, self.width, self.nulls, self.ids_size, ends, keys = struct.unpack(_FOOT, self.file.read_at(struct.calcsize(_FOOT), size - struct.calcsize(_FOOT)))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.ends = EliasFano(self.file.read_at(ends, self.ids_size))
        self.keys = EliasFano(self.file.read_at(keys, self.ids_size + ends))

    def bounds(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and end of the documents at `places`."""
        ends = self.ends.select(places)
        starts = np.zeros(len(places), np.int64)
        later = places > 0
        starts[later] = self.ends.select(places[later] - 1)
        return starts, ends

    def doc_ids(self, places: np.ndarray) -> list[int | None]:
        there = places >= self.nulls
        found = iter(self.keys.select(places[there] - self.nulls).tolist())
        return [next(found) if t else None for t in there.tolist()]

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


def read_token_files(manifest: DataFrame, step: int = 4096) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.  `start` adds
    the ids of all earlier files; their running totals are a row a file."""
    spark = manifest.sparkSession
    starts, total = [], 0
    for r in manifest.select("file", "part", "n_docs", "n_ids").orderBy("part").toLocalIterator():  # a row a file
        starts.append((r["file"], total, r["n_docs"]))
        total += r["n_ids"]
    files = spark.createDataFrame(starts, "file string, start long, n_docs long").repartition(max(1, len(starts)), "file")

    def run(batches):
        for b in batches:
            for uri, base, n in zip(*(c.to_pylist() for c in b.columns)):
                f = TokenFile(uri)
                for s in range(0, n, step):
                    places = np.arange(s, min(n, s + step))
                    begin, end = f.bounds(places)
                    crc = np.zeros(len(places), np.int64)
                    for i, (x, y) in enumerate(zip(begin.tolist(), end.tolist())):
                        crc[i] = zlib.crc32(f.ids(x, y).astype("<u4"))
                    yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids(places), pa.int64()), pa.array(begin + base), pa.array(end - begin), pa.array(crc)],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])
                f.close()

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is empty (its only id is the end); null doc_ids come first; repeated rows are
    written again."""
    import public_tokenizers
    return read_token_files(write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
