"""Byte-level BPE: pre-tokenisation, a heap-driven encoder and the decoder, over a public vocabulary file.

A text is cut at its special strings, then into pre-tokens by the vocabulary's pattern; no merge crosses a pre-token.
Within one, candidate merges wait in a priority queue ordered by (rank, position) over a doubly linked list of symbols;
entries whose symbols have meanwhile changed are skipped when they surface.  Encoded chunks are kept in memos bounded in bytes.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter
from heapq import heapify, heappop, heappush

import regex

from pointweave.llm.text import Memo

#: The pre-token pattern of the public byte-level vocabulary.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A space before white space or the end: only then may a run of white space reach over a cut before a space.
_RUNS = re.compile(r" (?:\s|\Z)")
#: Bytes that a worker's memo of chunks, and its memo of pre-tokens, may hold.
MEMO = 192 << 20
_BITS = 20
_MASK = (1 << _BITS) - 1


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files, reversed."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBPE:
    """Encoder and decoder of one vocabulary file (byte-level, no normaliser)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        byte_of = printable_bytes()
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.strings[i] = content.encode()
        self.first = [0] * 256
        for c, b in byte_of.items():
            self.first[b] = vocab[c]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << _BITS | vocab[b], rank << _BITS | vocab[a + b])
        self._special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._after = Memo(MEMO)  # chunks that follow a space
        self._at = Memo(MEMO)  # pre-tokens

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        sym = [self.first[b] for b in piece]
        n = len(sym)
        if n < 2:
            return sym
        found = self.merges.get
        heap = []
        for i in range(n - 1):
            m = found(sym[i] << _BITS | sym[i + 1])
            if m is not None:
                heap.append((m >> _BITS, i))
        if not heap:
            return sym
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = heappop(heap)
            left = sym[i]
            j = after[i]
            if left < 0 or j >= n:
                continue
            m = found(left << _BITS | sym[j])
            if m is None or m >> _BITS != rank:
                continue  # stale: one of the two has been merged since
            sym[i], sym[j] = m & _MASK, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = found(sym[i] << _BITS | sym[k])
                if m is not None:
                    heappush(heap, (m >> _BITS, i))
            k = before[i]
            if k >= 0:
                m = found(sym[k] << _BITS | sym[i])
                if m is not None:
                    heappush(heap, (m >> _BITS, k))
        return [s for s in sym if s >= 0]

    def _packed(self, pretokens: list[str]) -> bytes:
        memo, out = self._at, []
        memo.turn()
        for p in pretokens:
            ids = memo.young.get(p) or memo.again(p)
            if ids is None:
                ids = array("I", self.merge(p.encode())).tobytes()
                if len(p) < 64:
                    memo.put(p, ids)
            out.append(ids)
        return b"".join(out)

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings; True marks one."""
        if self._special is None or not any(s in text for s in self.special):
            return [(text, False)]
        return [(x, x in self.special) for x in self._special.split(text) if x]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for part, special in self.parts(text):
            if special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif _RUNS.search(part):
                out.append(self._packed(PRETOKEN.findall(part)))
            else:  # every cut before a space is a cut between pre-tokens
                head, *rest = part.split(" ")
                out.append(self._packed(PRETOKEN.findall(head)))
                memo = self._after
                memo.turn()
                found = list(map(memo.young.get, rest))
                if None in found:
                    for k, ids in enumerate(found):
                        if ids is None:
                            found[k] = ids = memo.young.get(rest[k]) or memo.again(rest[k])
                        if ids is None:
                            found[k] = ids = self._packed(PRETOKEN.findall(" " + rest[k]))
                            if len(rest[k]) < 64:
                                memo.put(rest[k], ids)
                out.extend(found)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids: vocabulary strings put together; invalid UTF-8 becomes U+FFFD."""
        strings = self.strings
        return b"".join([strings[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


def chunk_counts(bpe: ByteBPE, text: str) -> tuple[Counter, Counter, int]:
    """How often each chunk that follows a space occurs in a text, and each pre-token outside such chunks; special tokens."""
    chunks, others, specials = Counter(), Counter(), 0
    for part, special in bpe.parts(text):
        if special:
            specials += 1
        elif _RUNS.search(part):
            others.update(PRETOKEN.findall(part))
        else:  # every cut before a space is a cut between pre-tokens
            head, *rest = part.split(" ")
            others.update(PRETOKEN.findall(head))
            chunks.update(rest)
    return chunks, others, specials


def cut_chunk(chunk: str) -> list[str]:
    """The pre-tokens of a chunk and the space before it."""
    return PRETOKEN.findall(" " + chunk)


def pretoken_counts(bpe: ByteBPE, text: str) -> tuple[Counter, int]:
    """How often each pre-token occurs in a text, and the number of special tokens in it."""
    chunks, counts, specials = chunk_counts(bpe, text)
    for c, k in chunks.items():
        for p in cut_chunk(c):
            counts[p] += k
    return counts, specials


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """One encoder for each vocabulary and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def vocabulary(name: str) -> str:
    """A public vocabulary's place on this machine (the package is installed on every machine)."""
    import public_tokenizers

    return public_tokenizers.path(name)
