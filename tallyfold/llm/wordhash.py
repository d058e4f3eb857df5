"""Hashes of all words of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes that one pass of numpy works on; a longer text is cut between words.
BLOCK_BYTES = 1 << 20

_BASE = 0x100000001B3
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(0, dtype=np.uint64)
_INVERSES = np.ones(0, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 1 to n of the base and of its inverse modulo 2^64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, BLOCK_BYTES + 4096)
        _POWERS = np.cumprod(np.full(size, _BASE, dtype=np.uint64))
        _INVERSES = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
    return _POWERS[:n], _INVERSES[:n]


def in_block(b: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a block of bytes; space marks the bytes between words.

    The hash is a polynomial modulo 2^64 of the word's bytes plus one, the first byte with the highest power.
    """
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    powers, inverses = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    # b0 * B^-0 + b1 * B^-1 + ... from running sums, made comparable by a power of the word's end.
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * inverses[: len(b)], out=sums[1:])
    return starts, ends, (sums[ends] - sums[starts]) * powers[ends - 1] if len(starts) else sums[:0]


def mix(h: np.ndarray) -> np.ndarray:
    h = h * _MULTIPLY
    h = h ^ (h >> np.uint64(29))
    h = h * _MULTIPLY
    return h ^ (h >> np.uint64(32))


def of_texts(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words of texts (bytes with words between spaces): number of the text, start, end in it, mixed hash."""
    out: list[tuple[np.ndarray, ...]] = []
    pending: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal pending, size
        if pending:
            b = np.frombuffer(b" ".join(x for _, _, x in pending) + b" ", dtype=np.uint8)
            lengths = np.array([len(x) + 1 for _, _, x in pending])
            borders = np.concatenate([[0], np.cumsum(lengths)])
            starts, ends, hashes = in_block(b, b == 0x20)
            part = np.searchsorted(borders, starts, side="right") - 1
            owner, shift = np.array([i for i, _, _ in pending])[part], np.array([s for _, s, _ in pending])[part] - borders[part]
            out.append((owner, starts + shift, ends + shift, mix(hashes)))
        pending, size = [], 0

    for i, raw in enumerate(raws):
        at = 0
        while at < len(raw):
            end = len(raw)
            if end - at > BLOCK_BYTES:
                end = raw.rfind(b" ", at, at + BLOCK_BYTES)
                end = end if end > at else raw.find(b" ", at + BLOCK_BYTES)
                end = end if end > at else len(raw)
            pending.append((i, at, raw[at:end]))
            size += end - at
            at = end + 1
            if size >= BLOCK_BYTES:
                flush()
    flush()
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none, none.astype(np.uint64))


def runs(owner: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in the arrays) and hashes of all runs of k words within a text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(_BASE) + hashes[j : j + n]
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return at, mix(h[at])
