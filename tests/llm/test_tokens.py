"""Encoding, counting and packing against the tokenizers library and against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pointweave.llm.bpe import ByteBPE, load, pretoken_counts, vocabulary
from pointweave.llm.codec import decode_documents, encode_documents, round_trip
from pointweave.llm.packing import WordEncoder, pack_documents, plan
from pointweave.llm.token_counts import count_tokens

from .conftest import EDGES

BYTES, WORDS = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def ids(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def fuzz(n=1500, seed=1):
    rng = random.Random(seed)
    parts = list(" \n\t\x1c\x85　\xa0abXYéßΣςİ'’,.!?1½中😀́<|>_-") + ["<|endoftext|>", "<|startoftext|>", " the", "'ll", "  ", " \n", "Hello, "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_encoder_equals_the_library():
    bpe = load(vocabulary("byte_bpe_50k.json"))
    for t in fuzz():
        want = ids(BYTES, t)
        got = bpe.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert bpe.decode(got) == BYTES.decode(want, skip_special_tokens=False) == t
        counts, special = pretoken_counts(bpe, t)
        assert sum(len(bpe.merge(p.encode())) * k for p, k in counts.items()) + special == len(want)


def test_word_encoder_equals_the_library():
    texts = fuzz(seed=2)
    for t, got in zip(texts, WordEncoder(vocabulary("word_bpe_49k.json")).encode_batch(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids(WORDS, t), t


def test_memos_are_bounded(monkeypatch):
    """Small memos change nothing in the ids, hold what they may, and keep what is asked for."""
    from pointweave.llm import bpe as B
    from pointweave.llm import packing as P

    for module in (B, P):
        monkeypatch.setattr(module, "MEMO", 4000)
    byte, word = B.ByteBPE(vocabulary("byte_bpe_50k.json")), WordEncoder(vocabulary("word_bpe_49k.json"))
    texts = [f"the word{k} is Not{k % 7}, so x{k}x" for k in range(300)]
    for t in texts:
        assert np.frombuffer(byte.encode(t), "<u4").tolist() == ids(BYTES, t)
    for start in range(0, 300, 10):
        for t, got in zip(texts[start : start + 10], word.encode_batch(texts[start : start + 10]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids(WORDS, t)
    for memo in (byte._after, byte._at):
        assert len(memo.young) + len(memo.old) <= 4000 // 200 + 4
    assert "the" in word.memo.young


def test_round_trip(docs_of):
    got = round_trip(docs_of(EDGES)).collect()
    want = []
    for i, t in EDGES:
        x = ids(BYTES, t)
        want.append((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_encode_then_decode(docs_of):
    got = {r["doc_id"]: r["text"] for r in decode_documents(encode_documents(docs_of(EDGES[6:11]))).collect()}
    assert got == {i: t for i, t in EDGES[6:11]}


@pytest.mark.parametrize("hot", [3, 1 << 18])
def test_counts(docs_of, hot):
    got = count_tokens(docs_of(EDGES), hot=hot).collect()
    want = [(i, len((t or "").encode()), n := len(ids(BYTES, t)), n > 512) for i, t in EDGES]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def check_packing(rows, texts):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    want = sorted(((i, s, min(2048, len(x) - s), zlib.crc32(np.array(x[s : s + 2048], "<u4").tobytes()), len(x)) for i, t in texts for x in [ids(WORDS, t) + [1]] for s in range(0, len(x), 2048)), key=repr)
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows), key=repr) == want
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing(docs_of):
    rng = random.Random(4)
    more = [(100 + k, "word " * rng.choice([3, 40, 700, 700, 1500, 2500])) for k in range(120)]
    rows = pack_documents(docs_of([*EDGES, *more])).collect()
    check_packing(rows, [*EDGES, *more])
    used = sum(r["length"] for r in rows)
    assert (max(r["sequence_id"] for r in rows) + 1) * 2048 < used * 1.2


@pytest.mark.parametrize("histogram", [{1: 5000}, {500: 1000}, {2048: 3}, {1025: 10, 1023: 10}, {}])
def test_plan(histogram):
    got = plan(histogram)
    placed: dict[int, int] = {}
    for count, pattern in got:
        assert sum(n * k for n, k in pattern) <= 2048
        for n, k in pattern:
            placed[n] = placed.get(n, 0) + count * k
    assert placed == histogram
    assert sum(c for c, _ in got) <= -(-sum(n * k for n, k in histogram.items()) // 2048) * 1.05 + 1


def test_empty(docs_of):
    empty = docs_of([])
    assert round_trip(empty).count() == count_tokens(empty).count() == pack_documents(empty).count() == 0


def test_memo_holds_the_chunks_of_a_task(monkeypatch):
    """Chunks that come again after 150,000 others are not merged anew."""
    bpe = ByteBPE(vocabulary("byte_bpe_50k.json"))
    texts = [" ".join(f"x{k}" for k in range(begin, begin + 1000)) for begin in range(0, 150_000, 1000)]
    first = [bpe.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "merge", lambda piece: pytest.fail("merged anew"))
    assert [bpe.encode(t) for t in texts] == first


def test_word_memo_holds_the_chunks_of_a_task(monkeypatch):
    """The same for packing, after 230,000 others."""
    encoder = WordEncoder(vocabulary("word_bpe_49k.json"))
    texts = [" ".join(f"x{k}" for k in range(begin, begin + 1000)) for begin in range(0, 230_000, 1000)]
    first = [encoder.encode_batch([t]) for t in texts]
    monkeypatch.setattr(encoder, "_encode", lambda texts: pytest.fail("encoded anew"))
    assert [encoder.encode_batch([t]) for t in texts] == first


def test_packing_remembers_a_word_once(monkeypatch):
    """A worker's memos hold ``MEMO`` bytes in all, and a plain word that is a chunk of its own takes one entry."""
    from pointweave.llm import packing as P
    from pointweave.llm.text import Memo

    monkeypatch.setattr(P, "MEMO", 1 << 20)
    word = WordEncoder(vocabulary("word_bpe_49k.json"))
    memos = [m for m in vars(word).values() if isinstance(m, Memo)]
    assert sum(m.most for m in memos) == P.MEMO
    texts = ["some plain words in one line", "Words, words ... line? and\x1cwords 中文 中文!", ""]
    for k, t in enumerate(texts):
        assert np.frombuffer(word.encode_batch([t])[0], "<u4").tolist() == ids(WORDS, t)
        if not k:
            assert sum(len(m.young) for m in memos) == 6
