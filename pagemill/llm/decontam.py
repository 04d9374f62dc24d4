"""Operator 9, benchmark decontamination by template canonicalisation.

Numbers, units and capitalised words (names) become typed placeholders, so a question whose
parameters were changed keeps its template.  Windows of five template tokens are hash-joined
with those of the benchmark; for what meets, the values in the placeholders must map one to
one from the question to the document.  Which words are names depends on their case, so windows
of a second template, in which names are case-folded words as all others, are joined as well: a
question in capitals or lower case meets there."""

from __future__ import annotations

from collections import defaultdict
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

# Units that become a placeholder.
UNITS = frozenset("""
% kg g mg lb lbs oz ton tons tonne tonnes km m cm mm mile miles yard yards foot feet ft inch inches
l ml liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours
day days week weeks month months year years mph kph kmh degree degrees dollar dollars cent cents euro euros
pound pounds usd eur gbp percent
""".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*\Z")
_NUMBER_UNIT = re.compile(r"[+-]?\d[\d.,]*([^\W\d_]+|%)\Z")
_EDGES = ".,;:!?\"'()[]{}«»“”‘’…*_`~"
LITERAL, NUMBER, UNIT, QUANTITY, NAME = range(5)
#: Hashes are Python's own, which agree within a process; both sides are hashed in the same task.
_PLACEHOLDER = [0, *(hash(p) for p in ("<num>", "<unit>", "<qty>", "<name>"))]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def kind_and_value(word: bytes) -> tuple[int, int]:
    raw = word.decode()
    text = raw.strip(_EDGES) or raw
    low = text.casefold()
    first = text[0]
    if low in UNITS:
        kind = UNIT
    elif first.isalpha():
        kind = NAME if first.isupper() else LITERAL
    elif _NUMBER.match(text):
        kind = NUMBER
    elif (m := _NUMBER_UNIT.match(text)) and m[1].casefold() in UNITS:
        kind = QUANTITY
    else:
        kind = LITERAL
    return kind, hash(low)


class Tokens(dict):
    """Number by word, and by number the template hashes: as typed, and with names as words.  A cache,
    emptied when it is full."""

    FULL = 1 << 19

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros((2, 1 << 12), np.int64)

    def __missing__(self, word: bytes) -> int:
        kind, value = kind_and_value(word)
        n = len(self)
        if n == self.hashes.shape[1]:
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)], axis=1)
        self.hashes[0, n] = value if kind == LITERAL else _PLACEHOLDER[kind]
        self.hashes[1, n] = value if kind in (LITERAL, NAME) else _PLACEHOLDER[kind]
        self[word] = n
        return n

    def templates(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words, typed and folded."""
        if len(self) >= self.FULL:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        typed, folded = self.hashes.view(np.uint64)
        return typed[at], folded[at]


_TOKENS = Tokens()


def template(words: list[bytes], folded: bool = False) -> np.ndarray:
    return _TOKENS.templates(words)[folded]


def values(words: list[bytes]) -> np.ndarray:
    """Two rows: kind and value hash of each word."""
    return np.array([kind_and_value(w) for w in words], np.int64).reshape(-1, 2).T


def windows(template: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of `width` tokens."""
    n = len(template) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        out = out * _BASE + (template[j:j + n] ^ (template[j:j + n] >> np.uint64(29)))
    return out


class Block:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.width = width
        #: id, kinds and values, which windows are strong by (template, folded template), width
        self.items: list[tuple[int, np.ndarray, tuple[np.ndarray, np.ndarray], int]] = []
        entries: dict[tuple[int, bool], dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            words = text.encode().split()
            k = min(width, len(words))
            if not k:
                continue
            t, strong = values(words), []
            for folded in (False, True):
                plain = (t[0] == LITERAL) | (t[0] == NAME) & folded
                strong.append(np.convolve(plain.astype(np.int64), np.ones(k, np.int64), "valid") >= min(2, k))
                for i, h in enumerate(windows(template(words, folded), k).tolist()):
                    entries[k, folded][h].append((len(self.items), i))
            self.items.append((item, t, (strong[0], strong[1]), k))
        self.tables = []
        for (k, folded), found in entries.items():
            maybe = np.zeros(1 << 20, bool)
            keys = np.array(sorted(found), np.uint64)
            maybe[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((k, folded, keys, maybe, found))

    def match(self, text: str, similarity: float) -> list[tuple[int, int, int, float, int, bool]]:
        """(item_id, item windows, matched windows, similarity, slots, verbatim) of the items in `text`."""
        words = text.encode().split()
        t = _TOKENS.templates(words)
        pairs: dict[int, tuple[set[tuple[int, int]], set[tuple[int, int]]]] = defaultdict(lambda: (set(), set()))
        for k, folded, keys, maybe, found in self.tables:
            w = windows(t[folded], k)
            at = np.flatnonzero(maybe[(w >> np.uint64(44)).astype(np.int64)])
            if len(at):
                j = np.searchsorted(keys, w[at]).clip(max=len(keys) - 1)
                for p in at[keys[j] == w[at]].tolist():
                    for no, i in found[int(w[p])]:
                        pairs[no][folded].add((p, i))
        out = []
        pairs = {no: met for no, met in pairs.items() if len({i for m in met for _, i in m}) >= similarity * len(self.items[no][2][0])}
        if pairs:
            t = values(words)
        for no, (typed, folded) in pairs.items():
            item, it, strong, k = self.items[no]
            n = len(strong[0])
            # Each template alone, and both: a window that meets by one can complete the other's.
            ways = [typed, folded, typed | folded] if folded - typed else [typed]
            best = max((self._occurrence(t, it, strong, folded, k, occ) for met in ways for occ in _occurrences(met, n)), key=lambda x: (x[0], x[2]))
            if best[0] >= similarity * n:
                out.append((item, n, best[0], best[0] / n, best[1], best[2]))
        return out

    @staticmethod
    def _occurrence(t, it, strong, folded, k, met) -> tuple[int, int, bool]:
        """(consistent windows, slots, verbatim) of one occurrence of an item in a document."""
        votes: dict[tuple[int, int], dict[int, int]] = defaultdict(lambda: defaultdict(int))
        slots = [j for j in range(it.shape[1]) if it[0][j] != LITERAL]
        slot_set = set(slots)
        for p, i in met:
            for o in range(k):
                if i + o in slot_set:
                    votes[int(it[0][i + o]), int(it[1][i + o])][int(t[1][p + o])] += 1
        chosen: dict[tuple[int, int], int] = {}
        taken: set[tuple[int, int]] = set()
        # The value that most windows give; a document's value serves one value of the question.
        for (kind, value), seen in sorted(votes.items(), key=lambda x: -max(x[1].values())):
            for doc_value, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0] != value, x[0])):
                if (kind, doc_value) not in taken:
                    chosen[kind, value] = doc_value
                    taken.add((kind, doc_value))
                    break
        verbatim = all(v == d for (_, v), d in chosen.items())
        good, weak = set(), set()
        for p, i in met:
            if all(chosen.get((int(it[0][i + o]), int(it[1][i + o]))) == int(t[1][p + o]) for o in range(k) if i + o in slot_set):
                (good if verbatim or strong[(p, i) in folded][i] else weak).add(i)
        # Windows with too few plain words prove nothing alone: they count beside strong ones.
        if good:
            good |= weak
        return len(good), len(slots), verbatim


def _occurrences(met: set[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """Matched windows (document place, item place) by the place where the item would begin."""
    out: list[list[tuple[int, int]]] = []
    last = None
    slack = max(2, n // 4)
    for p, i in sorted(met, key=lambda x: (x[0] - x[1], x)):
        if last is None or p - i - last > slack:
            out.append([])
        out[-1].append((p, i))
        last = p - i
    return out


SCHEMA = "doc_id long, item_id long, n_windows int, n_matched int, similarity double, n_slots int, verbatim boolean"


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, ...) for each row of docs (doc_id, text) and each item of benchmark
    (item_id, text) whose template is in it: at least `similarity` of the item's windows of
    `width` tokens, with consistent slots, in one place of the document.  A window is met by its
    placeholders or, whatever the case of its words, by its case-folded words.

    The benchmark is the stated query set: it goes to the tasks in blocks of at most
    `block_chars` characters (one item more at most), each block a map-side hash join over all
    documents, without any shuffle.  Items shorter than a window are one window.  Null texts
    and items without words match nothing; a repeated row gives its result again; a null
    doc_id or item_id is kept."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    block: list[tuple[int, str]] = []
    chars = 0
    rows = benchmark.filter("text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        block.append((r[0], r[1]))
        chars += len(r[1])
        if chars >= block_chars:
            out = out.unionByName(_block_leaks(docs, block, width, similarity))
            block, chars = [], 0
    return out.unionByName(_block_leaks(docs, block, width, similarity)) if block else out


def _block_leaks(docs: DataFrame, items: list[tuple[int, str]], width: int, similarity: float) -> DataFrame:
    def run(batches):
        block = Block(items, width)
        for b in batches:
            got: list[list] = [[] for _ in range(7)]
            for d, t in zip(b.column(0), b.column(1)):
                for m in block.match(t.as_py(), similarity) if t.is_valid else ():
                    for c, v in zip(got, (d.as_py(), *m)):
                        c.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
