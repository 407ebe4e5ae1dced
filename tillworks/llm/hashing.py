"""Words of UTF-8 texts and 64-bit hashes of words and word shingles, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_MOST_WORDS = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15


def word_bytes() -> bytes:
    """Translation of bytes that lower-cases A-Z and blanks what is in no word of
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    lower = bytes(range(256)).lower()
    keep = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 256))
    return bytes(b if b in keep else 0x20 for b in lower)


class WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits, so that all of them depend on all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_LONG = 1 << 16  # words up to which powers are kept


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2^64."""
    found = np.ones(1, np.uint64)
    while len(found) < n:
        found = np.concatenate([found, found * np.uint64(pow(base, len(found), 1 << 64))])
    return found[:n]


_UP = _powers(_MULTIPLIER, _LONG)
_DOWN = _powers(pow(_MULTIPLIER, -1, 1 << 64), _LONG)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, from the hashes of the words.

    It is k and the words' hashes times the powers of an odd number from the first on, added up: a
    difference of running sums, with the power of the place it begins at taken off.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    step = _LONG - k
    if n > step:
        return np.concatenate([shingles(hashes[i: i + step + k - 1], k) for i in range(0, n, step)])
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _UP[1: len(hashes) + 1], out=sums[1:])
    total = sums[k:] - sums[:n]
    total *= _DOWN[:n]
    total += np.uint64(k)
    return mix(total)


#: for each byte, in lower case, a number of 64 bits; 0 for white space
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))[
    np.frombuffer(bytes(range(256)).lower(), np.uint8)]
_CODES[np.frombuffer(b" \t\n\r\x0b\f", np.uint8)] = 0
_IN_WORD = _CODES != 0
_SHORT = 64  # bytes of words that are hashed together


def spaced_words(text: bytes) -> np.ndarray:
    """Hash of each word between white space, A-Z lower-cased, all words of a piece at once."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IN_WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums, low = np.zeros(len(starts), np.uint64), 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _LONG, "right")))
        if ends[high - 1] - starts[low] <= _LONG:
            at = starts[low:high] - starts[low]
            codes = _CODES[raw[starts[low]: ends[high - 1]]]
            sums[low:high] = np.add.reduceat(codes * _UP[: len(codes)], at) * _DOWN[at]
        low = high
    sizes = ends - starts
    found = mix(sums + sizes.astype(np.uint64))
    for i in np.flatnonzero(sizes > _SHORT).tolist():
        found[i] = xxhash.xxh3_64_intdigest(text[starts[i]: ends[i]].lower())
    return found


def word_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingles in order of their hashes; fewer than k words: the whole run as one."""
    if len(hashes) == 0:
        return np.empty(0, np.uint64)
    every = np.sort(shingles(hashes, min(k, len(hashes))))
    return every[np.append(True, every[1:] != every[:-1])]


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 by byte, so that bytes that are mostly zero pack well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes, at: int, count: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8, 4 * count, at).reshape(4, count)
    return np.ascontiguousarray(rows.T).view("<u4").ravel().astype(np.int64)
