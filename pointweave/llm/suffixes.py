"""Sorted suffix runs: front coding, and merging with a loser tree that never compares a known common prefix again."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

_HEAD = struct.Struct("<HHI")


def common(x: bytes, y: bytes, at: int) -> int:
    """The length of the common prefix, of which the first ``at`` bytes are known to agree."""
    n = min(len(x), len(y))
    while at < n:
        step = min(16, n - at)
        if x[at : at + step] == y[at : at + step]:
            at += step
        elif step > 1 and x[at : at + step // 2] == y[at : at + step // 2]:
            at += step // 2
        else:
            while at < n and x[at] == y[at]:
                at += 1
            break
    return at


def front_code(sorted_items: Iterable[tuple[bytes, bytes]]) -> bytes:
    """A sorted run of (suffix, payload): each suffix without the prefix that it shares with the one before."""
    out, before = [], b""
    for s, payload in sorted_items:
        shared = common(before, s, 0)
        out += [_HEAD.pack(shared, len(s) - shared, len(payload)), s[shared:], payload]
        before = s
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(length shared with the one before, suffix, payload) of each entry of a front-coded run."""
    at, before = 0, b""
    while at < len(run):
        shared, rest, size = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        before = before[:shared] + run[at : at + rest]
        yield shared, before, run[at + rest : at + rest + size]
        at += rest + size


def merge(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """All entries of the runs in suffix order, each with the length that it shares with the entry before.

    A stream's current suffix is kept with its common prefix with the last output.  Of two streams the one that shares
    more is the smaller; only if they share as much are bytes compared, from there on.
    """
    sources = [read_run(r) for r in runs]
    k = len(sources)
    if not k:
        return
    size = 1 << (k - 1).bit_length()
    now: list[tuple[int, bytes, bytes] | None] = [next(s, None) for s in sources] + [None] * (size - k)
    shared = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's shared length."""
        x, y = now[a], now[b]
        if x is None:
            return b, a
        if y is None or shared[a] > shared[b]:
            return a, b
        if shared[a] < shared[b]:
            return b, a
        h = common(x[1], y[1], shared[a])
        if x[1][h:] <= y[1][h:] if h == len(x[1]) or h == len(y[1]) else x[1][h] < y[1][h]:
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    losers = [0] * size
    level = list(range(size))
    at = size
    while len(level) > 1:  # the first round fills the tree bottom-up
        at //= 2
        winners = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            losers[at + i // 2] = lost
            winners.append(w)
        level = winners
    top = level[0]
    while now[top] is not None:
        _, suffix, payload = now[top]
        yield shared[top], suffix, payload
        now[top] = next(sources[top], None) if top < k else None
        shared[top] = now[top][0] if now[top] else 0
        node, winner = (size + top) // 2, top
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
        top = winner
