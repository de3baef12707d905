import os
import random

import pytest

from folioscope.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no public vocabulary")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary_bytes(bpe.DEFAULT_VOCABULARY))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(bpe.DEFAULT_VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_equals_library(encoder, library):
    rng = random.Random(3)
    alphabets = ["ab", "a ", "etaoin shrdlu\n", "aé中 \t\r\n\x0b\x0c\x1c\x85　", "0123abc-_=/+", "'sdmtlvr "]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (1, 2, 7, 60, 900)]
    texts += ["<|endoftext|>", "  <|endoftext|> x", "﻿using A;\r\n\r\n", "日本語のテキスト。", "It's we'll  you've   ", "a" * 5000, " " * 300, "\n" * 70, "𝒟ata ❤️"]
    assert encoder.encode_batch(texts) == library(texts)


def test_round_trip(encoder):
    back = {v: k for k, v in encoder.ranks.items()}
    text = "Grüße, 世界!\n\tfor (int i = 0; i < 10; i++) {}" * 50
    assert b"".join(back[i] for i in encoder.encode_batch([text])[0]).decode() == text


def test_counts_and_small_memo(encoder, monkeypatch):
    texts = ["alpha beta gamma", None, "", "alpha alpha", "x" * 200]
    expected = [len(x) for x in encoder.encode_batch(texts)]
    assert encoder.count_batch(texts) == expected and expected[1:3] == [0, 0]
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 2)
    small = bpe.Encoder(bpe.vocabulary_bytes(bpe.DEFAULT_VOCABULARY))
    assert [small.count_batch([t])[0] for t in texts] == expected
    assert small.subwords("alpha") == encoder.count_batch(["alpha"])[0]


def test_rank_queue_orders_ranks():
    import numpy as np

    q = bpe.RankQueue()
    q.push(np.array([5000, 3, 70_000, 3]), np.array([1, 2, 3, 4]))
    q.push(np.array([4]), np.array([9]))
    rank, at = q.pop()
    assert rank == 3 and at.tolist() == [2, 4]
    q.push(np.array([4, 6]), np.array([7, 8]))
    assert [(r, p.tolist()) for r, p in iter(q.pop, None)] == [(4, [9, 7]), (6, [8]), (5000, [1]), (70_000, [3])] and not q.leaves and not q.middle


def test_long_pretokens_are_linear(encoder, library):
    """One pre-token of 400,000 letters, equal to the library and not much dearer than short ones."""
    import time

    rng = random.Random(3)
    letters = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000)]
    texts = ["".join(letters), " ".join("".join(letters[i : i + 8]) for i in range(0, len(letters), 8)), "a" * 100_001]
    spent = []
    for text in texts:
        started = time.perf_counter()
        got = bpe.Encoder.encode_batch(encoder, [text])[0]
        spent.append(time.perf_counter() - started)
        assert got == library([text])[0]
    assert spent[0] < 5 * spent[1] + 1


def test_table(spark, encoder):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", None), (4, "   ", "x"), (5, "hello world", "x"), (5, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_documents(df).collect())
    assert [k for k, _ in got] == [1, 2, 3, 4, 5, 5]
    assert got[1][1] == [] and got[2][1] == [] and got[3][1] and got[0][1] == got[4][1] == encoder.encode_batch(["hello world"])[0]
    assert bpe.encode_documents(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()}[2] == 0
