"""Operator 5, token counts: trie-shared dynamic programming.

A unigram tokenizer splits a pre-token into the pieces with the best total score.  The forward
score of a prefix depends on the prefix alone, so pre-tokens are inserted in a trie and each
node's score is computed once, from the scores of the nodes above it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: The mark that begins a pre-token, as in the vocabulary.
MARK = "▁"


def piece_scores(model_path: str) -> tuple[dict[str, float], float]:
    """Scores of the pieces of a public vocabulary and of one byte of anything outside it.  The
    vocabulary lists pieces by frequency; a piece's probability is taken as Zipf's, in
    proportion to 1 / (its rank + 1).  The byte pieces rank last."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    norm = math.log(sum(1.0 / (r + 1) for r in range(len(pieces))))
    scores = {p: -math.log(r + 1.0) - norm for r, p in enumerate(pieces)}
    return scores, -math.log(len(pieces) + 256.0) - norm


class Trie:
    """Token counts of pre-tokens by forward scores that shared prefixes share.

    New pre-tokens are visited in sorted order, the depth-first order of their trie, so only the
    path to the current node is held: the best score and the number of pieces up to each
    character.  In a call of insert() a node is scored once however many pre-tokens go through it;
    the next call scores the nodes of its own new pre-tokens again.  Each terminal's count is stored.  A character outside the vocabulary costs as many tokens as it has UTF-8
    bytes.  Equal scores go to the longest last piece."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        self.longest = max(map(len, scores))
        self.suffixes = {p[i:] for p in scores for i in range(len(p))}  # what can end a piece
        self.terminal: dict[bytes, int] = {}

    def insert(self, words: set[bytes]) -> None:
        """Store the counts of pre-tokens that have none yet."""
        best, count, last = [0.0], [0], ""
        get, suffixes, longest, terminal = self.scores.get, self.suffixes, self.longest, self.terminal
        for text, word in sorted((MARK + w.decode(), w) for w in words):
            shared, most = 0, min(len(last), len(text))
            while shared < most and last[shared] == text[shared]:
                shared += 1
            del best[shared + 1:], count[shared + 1:]
            for i in range(shared, len(text)):
                top, n = -math.inf, 0
                for start in range(i, max(-1, i - longest), -1):
                    piece = text[start:i + 1]
                    if piece not in suffixes:
                        break
                    score = get(piece)
                    if score is not None and best[start] + score >= top:
                        top, n = best[start] + score, count[start] + 1
                if start == i and top == -math.inf or text[i] not in self.scores:
                    width = len(text[i].encode())
                    score = best[i] + width * self.byte_score
                    if score > top:
                        top, n = score, count[i] + width
                best.append(top)
                count.append(n)
            terminal[word] = count[-1]
            last = text


#: By vocabulary: a Python worker keeps the counts it has from task to task.
_TRIES: dict[str, Trie] = {}


def trie_for(model_path: str) -> Trie:
    if model_path not in _TRIES:
        _TRIES[model_path] = Trie(*piece_scores(model_path))
    return _TRIES[model_path]


def token_counts(docs: DataFrame, model_path: str, max_kept: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_pretokens, n_tokens) for every row of docs (doc_id, text).

    Pre-tokens are words between ASCII white space, with the vocabulary's mark before each.  A
    worker keeps the counts of pre-tokens it has met and starts anew beyond max_kept of them,
    which changes no count.  No shuffle.  Null and empty texts have no tokens; repeated rows and
    null doc_ids are kept.  model_path is read on the executors."""

    def run(batches):
        trie = trie_for(model_path)
        for b in batches:
            texts = [(t.as_py() or "").encode() for t in b.column(1)]
            out = np.zeros((3, len(texts)), np.int64)
            for first in range(0, len(texts), 1000):
                rows = [t.split() for t in texts[first:first + 1000]]
                if len(trie.terminal) > max_kept:
                    trie.terminal.clear()
                trie.insert(set().union(*rows).difference(trie.terminal))
                count = trie.terminal.__getitem__
                for r, words in enumerate(rows, first):
                    out[:, r] = len(texts[r]), len(words), sum(map(count, words))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], names=["doc_id", "n_bytes", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_pretokens long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
