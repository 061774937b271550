"""Vectorised words, shingles and hashes over batches of UTF-8 texts, for use inside Arrow tasks.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes fold A-Z to a-z
unless told otherwise. All arithmetic is modulo 2**64 and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20  # bytes hashed at once: bounds memory whatever the length of a text
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, key: str, n: int) -> np.ndarray:
    have = _tables.get(key)
    if have is None or len(have) < n:
        x = np.full(max(n, CHUNK + 1024), base, np.uint64)
        x[0] = 1
        have = _tables[key] = np.multiply.accumulate(x)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_chunk(data: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    word = np.zeros(n + 2, np.int8)
    word[1:-1] = ~SPACE[data]
    step = np.diff(word)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    vals = (LOWER[data] if fold else data).astype(np.uint64) + np.uint64(1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(vals * _powers(_P, "p", n)[:n], out=total[1:])
    h = (total[end] - total[start]) * _powers(_PINV, "q", n)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start, end


def hash_words(data: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of a byte array, which is cut at white space into chunks."""
    if len(data) <= CHUNK:
        return _hash_chunk(data, fold)
    parts, at = [], 0
    while at < len(data):
        to = min(len(data), at + CHUNK)
        if to < len(data):
            gap = np.flatnonzero(SPACE[data[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:  # one word longer than a chunk
                gap = np.flatnonzero(SPACE[data[to:]])
                to = to + int(gap[0]) + 1 if len(gap) else len(data)
        h, s, e = _hash_chunk(data[at:to], fold)
        parts.append((h, s + at, e + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def blocks(texts: list[bytes | None], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together, one text at least."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > at and total + n > size:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)


def words_of(texts: list[bytes | None], fold: bool = True):
    """(hashes, bounds, starts, ends, data): words of text i are hashes[bounds[i]:bounds[i+1]]; null counts as empty."""
    joined = b"\n".join(t or b"" for t in texts)
    data = np.frombuffer(joined, np.uint8)
    h, s, e = hash_words(data, fold)
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(sizes)])
    return h, np.searchsorted(s, at), s, e, data


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on (places near the end of h are left out)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ h[j : len(h) - k + 1 + j]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return mix(out + np.uint64(k))


def shingle_sets(h: np.ndarray, bounds: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; with fewer words, the whole sequence as one; none without words."""
    s, out = windows(h, k), []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            x = np.sort(s[a : b - k + 1])
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        else:
            out.append(windows(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out
