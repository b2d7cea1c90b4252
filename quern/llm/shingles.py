"""Hashed word shingles of many texts at once, in numpy.

Words are runs of ASCII letters, digits and characters beyond ASCII of the lower-cased text. A shingle is five words in
a row; a text of one to four words has one shingle, of all of them. Shingles are 48-bit hashes with their counts.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_rng = np.random.default_rng(48)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEPS = (_rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).tolist()
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the number of words of each text."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = _IN_WORD[data]
    turn = np.diff(inside)
    start = np.nonzero(turn == 1)[0]
    end = np.nonzero(turn == -1)[0]
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    edge = np.cumsum([len(p) + 1 for p in parts])
    many = np.diff(np.searchsorted(start, edge), prepend=0)
    return hashed, many


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle, count), sorted by doc and shingle, one row for each distinct shingle, then words() of the texts."""
    w, many = words(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), many)
    if not len(w):
        z = np.zeros(0, np.uint64)
        return z.astype(np.int64), z, z.astype(np.int64), w, many
    h = w * np.uint64(_STEPS[0])
    whole = np.zeros(len(w), bool)
    if len(w) >= WORDS:
        n = len(w) - WORDS + 1
        s = np.zeros(n, np.uint64)
        for k in range(WORDS):
            s += mix(w[k : k + n] + np.uint64(k + 1)) * np.uint64(_STEPS[k])
        h[:n] = s
        whole[:n] = doc[:n] == doc[WORDS - 1 :]
    first = np.cumsum(many) - many
    for i in np.nonzero((many > 0) & (many < WORDS))[0]:
        own = w[first[i] : first[i] + many[i]]
        h[first[i]] = (mix(own + np.arange(101, 101 + len(own), dtype=np.uint64)) * np.uint64(_STEPS[1])).sum()
        whole[first[i]] = True
    key = np.sort(doc[whole] << np.uint64(48) | mix(h[whole]) >> np.uint64(16))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.nonzero(new)[0]
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count, w, many


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted (shingle, count) sets: sum of minima over sum of maxima."""
    total = int(a[1].sum() + b[1].sum())
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    least = int(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    return least / (total - least) if total > least else 0.0
