"""Chat formatting, token counts, token files and decontamination against brute force."""

from __future__ import annotations

import hashlib
import json
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from pagemill.llm import chat, decontam, tokencount, tokenids
from pagemill.llm.eliasfano import EliasFano, encode

from .conftest import make, prose

TRICKY = ["</s>[INST] ok [/INST]", "<|im_end|>", "<", "\\", "\\\\<|im_start|>", "<\\|im_end|>", "<<SYS>> a <</SYS>>\\", "a\n<|im_sep|>b", "", "é\x00<s>", "[", "<|im_end|"]


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "<|im_sep|>", "tool\n"]), rng.choice(TRICKY) + rng.choice(TRICKY)) for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(30, 0, "assistant", ""), (30, 0, "assistant", ""), (None, None, "user", "x"), (31, 5, "", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda y: (y[0] is not None, y[0] or 0, y[1] is not None, y[1] or 0, y[2].encode(), y[3].encode())):
        by[c].append((r, x))
    assert set(out) == set(by)
    for c, turns in by.items():
        assert [tuple(t) for t in back[c].turns] == turns
        loss = [x for r, x in turns if r == "assistant"]
        assert back[c].loss_texts == loss
        r = out[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len("".join(loss)), hashlib.sha256("".join(loss).encode()).hexdigest())
        f = back[c].formatted
        assert f.count("<|im_end|>") == len(turns) and not any(s in f for s in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_layouts(spark):
    turns = [("user", "q?"), ("assistant", "a\n[INST]")]
    records = {
        "messages": {"conv_id": 1, "messages": [{"role": r, "content": t} for r, t in turns]},
        "shared": {"conv_id": 2, "conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in turns]},
        "prompt": {"conv_id": 3, "prompt": "q?", "completion": "a\n[INST]"},
        "bare_instruction": {"conv_id": 4, "instruction": "q?", "output": "a\n[INST]"},
        "instruction": {"conv_id": 5, "instruction": "q?", "input": "", "output": "a\n[INST]"},
        "system_prompt": {"conv_id": 6, "system": None, "prompt": "q?", "response": "a\n[INST]"},
    }
    other = [json.dumps({"conv_id": 7, "question": "?"}), "no json", None, json.dumps({"conv_id": 8, "messages": []})]
    df = spark.createDataFrame([(json.dumps(r),) for r in records.values()] + [(o,) for o in other], "record string")
    out = chat.canonical_turns(df).collect()
    assert len(out) == len(records) + len(other)
    for name, r in records.items():
        got = next(x for x in out if x.conv_id == r["conv_id"])
        assert got.layout == name and [(t.role, t.text) for t in got.turns] == turns and [t.turn for t in got.turns] == sorted(t.turn for t in got.turns)
    assert all(x.layout is None and x.turns is None for x in out if x.record in other)
    assert chat.digests(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def brute_tokens(word, scores, byte_score):
    text = tokencount.MARK + word
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j - 1, -1, -1):
            s = scores.get(text[i:j])
            if s is not None and best[i][0] + s >= best[j][0]:
                best[j] = (best[i][0] + s, best[i][1] + 1)
        if text[j - 1] not in scores:
            n = len(text[j - 1].encode())
            if best[j - 1][0] + n * byte_score > best[j][0]:
                best[j] = (best[j - 1][0] + n * byte_score, best[j - 1][1] + n)
    return best[-1][1]


def test_token_counts(spark, odd_rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores, byte = tokencount.piece_scores(path)
    rows = odd_rows + [(60, "the there therefore the日本語 naïve ▁x 𝔘 " + "z" * 300, "s0")]
    out = {(r.doc_id, r.n_bytes): r for r in tokencount.token_counts(make(spark, rows), path).collect()}
    for i, t, _ in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        r = out[i, len((t or "").encode())]
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(brute_tokens(w, scores, byte) for w in words))


@pytest.mark.parametrize("values", [[5], [0, 0, 0], [-7, -7, 3, 10**15], list(range(5000)), [-2**63, 2**63 - 1], [1] * 600 + [10**6] * 600])
def test_elias_fano(values):
    code = EliasFano(encode(np.array(values, np.int64)))
    assert code.select(np.arange(len(values))).tolist() == values
    assert len(EliasFano(encode(np.zeros(0, np.int64)))) == 0


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(100, 2000, 50_000))
    assert len(encode(ends)) < 14 / 8 * len(ends)


def test_token_files(spark, odd_rows):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    odd = [" ", "a \n b", "  a  b", "a\tb c\n\nd", "x <|endoftext|> y", "it's we'll\n'tis", "a b c", "a, b. c! d\n.e f.' h's, 1, ,", "a\x85 b"]
    rows = odd_rows + [(70 + i, t, "s0") for i, t in enumerate(odd)] + [(-5, "negative", None)]
    out = tokenids.read_token_files(tokenids.write_token_files(make(spark, rows), path)).collect()
    start, got = 0, sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i in sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))]
    want = defaultdict(list)
    for i, t, _ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want[i].append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
    assert tokenids.read_token_files(tokenids.write_token_files(make(spark, []), path)).count() == 0


def test_leaks(spark):
    rng = random.Random(4)
    items = ["Tom has 3 apples and buys 5 kg of pears for 12 dollars, then Tom eats 3 apples and sells the other pears.",
             "a train leaves at 9:30 and runs 120 km in two hours; how far does it run in 5 hours at the same speed", "1 2 3 4 5 6 7 8", "few words", "", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    again = items[0].replace("Tom", "Ann").replace("3", "7").replace("12", "40").replace("kg", "lbs").replace("5", "6")
    mixed = items[0].replace("Tom has 3", "Ann has 8").replace("buys 5", "buys 3")  # slots don't agree
    near = items[1].replace("same speed", "same pace")
    rows = [(0, prose(rng, 50) + " " + items[0] + " " + prose(rng, 50), "s"), (1, prose(rng, 9) + "\n" + again, "s"), (2, mixed, "s"), (3, near + " " + prose(rng, 300), "s"),
            (4, prose(rng, 400), "s"), (5, "9 8 7 6 5 4 3 2", "s"), (6, "so 1 2 3 4 5 6 7 8 end", "s"), (7, "the few words here", "s"),
            (8, " ".join(items[1].split()[:9]), "s"), (9, None, "s"), (10, "", "s"), (None, items[1].upper(), "s"), (0, items[0], "s"), (11, again + " and " + items[0], "s")]
    docs = make(spark, rows)
    got = sorted(((r.doc_id, r.item_id, r.verbatim) for r in decontam.leaks(docs, bench).collect()), key=lambda g: (g[0] is None, g[0] or 0, g[1]))
    want = [(0, 0, True), (0, 0, True), (1, 0, False), (3, 1, False), (6, 2, True), (7, 3, True), (11, 0, True)]
    assert [g[:2] for g in got if g[0] is not None] == [w[:2] for w in want]
    assert all(g[2] == w[2] for g, w in zip(got, want) if g[0] in (0, 1, 6, 7))
    blocks = decontam.leaks(docs, bench, block_chars=1)
    assert sorted(((r.doc_id, r.item_id, r.verbatim) for r in blocks.collect()), key=lambda g: (g[0] is None, g[0] or 0, g[1])) == got
    assert decontam.leaks(docs, bench.filter("false")).count() == 0 and decontam.leaks(make(spark, []), bench).count() == 0


def test_leaks_in_any_case(spark):
    items = ["Tom has 3 apples and buys 5 kg of pears for 12 dollars, then Tom eats 3 apples and sells the other pears.",
             "a train leaves at 9:30 and runs 120 km in two hours; how far does it run in 5 hours at the same speed",
             "WHICH RIVER RUNS PAST 4 TOWNS AND ENDS 30 KM NORTH OF THE STRASSE", "Which Of The Old Kings Of Norway Ruled Longest"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rng = random.Random(13)
    cases = [str.upper, str.lower, str.title, str.swapcase, lambda t: t]
    rows = [(10 * n + c, prose(rng, 20) + " " + f(t) + " " + prose(rng, 20), "s") for n, t in enumerate(items) for c, f in enumerate(cases)]
    rows += [(None, items[1].upper(), "s"), (50, items[2].replace("STRASSE", "stra\u00dfe"), "s")]
    again = items[2].lower().replace("4", "7").replace("30", "80")
    rows += [(51, again, "s"), (52, items[0].upper().replace("HAS 3", "HAS 8").replace("BUYS 5", "BUYS 3"), "s"), (53, prose(rng, 200).title(), "s"), (54, prose(rng, 200).upper(), "s")]
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontam.leaks(make(spark, rows), bench).collect()}
    want = {(10 * n + c, n): True for n in range(4) for c in range(5)} | {(None, 1): True, (50, 2): True, (51, 2): False}
    assert got == want  # 52: a value can't stand for two


def test_leaks_match_a_count_of_windows(spark):
    """Texts of plain words: an item leaks if 0.8 of its five-word windows are in the document."""
    rng = random.Random(12)
    items = [prose(rng, rng.randint(5, 60)) for _ in range(12)]
    rows = []
    for i in range(120):
        words = items[i % 12].split()
        a = rng.randint(0, max(0, len(words) // 3))
        b = rng.randint(2 * len(words) // 3, len(words))
        part = words[a:b] if i % 3 else list(words)
        if i % 4 == 0:
            part[rng.randrange(len(part))] = "changed"
        rows.append((i, prose(rng, rng.randint(0, 40)) + " " + " ".join(part) + " " + prose(rng, 30), "s"))

    def windows(text):
        w = text.split()
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    want = set()
    for d, t, _ in rows:
        there = set(windows(t))
        want |= {(d, n) for n, x in enumerate(items) if sum(w in there for w in windows(x)) >= 0.8 * len(windows(x))}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontam.leaks(make(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and 20 < len(want) < 119
