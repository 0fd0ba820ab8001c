"""Vectorised 64-bit hashes of words and byte strings, for use inside tasks."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        full = np.full(size, BASE, np.uint64)
        full[0] = 1
        back = np.full(size, _INVERSE, np.uint64)
        back[0] = 1
        _powers, _inverses = np.cumprod(full), np.cumprod(back)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences hash any substring: see `spans`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * powers(len(data))[0], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair, the same wherever the bytes stand."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start])


def word_shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the `size`-word shingles of each text.

    A-Z are lower-cased; words are what stands between space, tab, LF, VT, FF and CR.  A text of fewer words, but not
    none, has its whole sequence as one shingle; a text without words has an empty array.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = spans(prefix(data), start, end)
    limits = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    n = len(words)
    full = np.zeros(max(n - size + 1, 0), np.uint64)
    for j in range(size):
        full += words[j : n - size + 1 + j] * PLACES[j] if n >= size else np.uint64(0)
    full = mix(full + np.uint64(size))
    out = []
    for a, b in zip(limits[:-1].tolist(), limits[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.array([sum(int(w) * int(p) for w, p in zip(words[a:b], PLACES)) + b - a & _MASK], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def batches_of(texts: list[bytes], size: int = 1 << 20):
    """Index ranges of neighbouring texts of about so many bytes together; a longer text stands alone."""
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= size):
            total += len(texts[j])
            j += 1
        yield i, j
        i = j
