"""Words of many texts at once, as 64-bit hashes in numpy.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters, with A-Z lower-cased: on UTF-8 bytes this needs only a table.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_WORD = np.zeros(256, np.bool_)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[ord("A") : ord("Z") + 1] = _WORD[128:] = True
_VALUE = _RNG.integers(1, 2**64, size=256, dtype=U64)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BASE = int(_RNG.integers(2**62, 2**63)) * 2 + 1
_POWERS = [np.ones(1, U64), np.ones(1, U64)]  # of the base, and of its inverse modulo 2**64
#: Bytes hashed in one go; bounds the working memory for texts of any length.
CHUNK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _hash_chunk(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of b."""
    edge = np.diff(_WORD[b].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, U64)
    np.cumsum(_VALUE[b] * power[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the n + 1 bounds of each text's words."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and _WORD[data[end - 1]] and _WORD[data[end]]:  # never cut a word
            more = np.flatnonzero(~_WORD[data[end : end + CHUNK]])
            end += int(more[0]) if len(more) else min(CHUNK, len(data) - end)
        h, s = _hash_chunk(data[at:end])
        hashes.append(h)
        places.append(s + at)
        at = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    p = np.concatenate(places) if places else np.zeros(0, np.int64)
    return h, np.searchsorted(p, begins)


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of each k consecutive words; callers drop those that cross texts."""
    if len(h) < k:
        return np.zeros(0, U64)
    n, base = len(h) - k + 1, U64(0x9E3779B97F4A7C15)
    out = h[:n].copy()
    for j in range(1, k):
        out *= base
        out += h[j : j + n]
    return mix(out)


def winnow(h: np.ndarray, bounds: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions kept by winnowing: of each window of `width`
    successive k-grams within one text the minimum, the rightmost on ties."""
    g = grams(h, k)
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    least, place = g[:n].copy(), np.arange(n)
    for j in range(1, width):
        nxt = g[j : j + n]
        place = np.where(nxt <= least, np.arange(j, j + n), place)
        np.minimum(least, nxt, out=least)
    own = owners(bounds)
    place = np.unique(place[own[:n] == own[k + width - 2 : k + width - 2 + n]])
    return g[place], place
