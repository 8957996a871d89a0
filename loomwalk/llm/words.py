"""Vectorised words of UTF-8 bytes: boundaries and 64-bit hashes, without a Python loop per word."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: An odd multiplier, its inverse modulo 2**64, and a random value for each byte.
_M = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words for the two definitions in use: runs without white space; runs of letters, digits and non-ASCII.
WORD_BYTES = ~_SPACE
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[0x30:0x3A] = ALNUM_BYTES[0x61:0x7B] = ALNUM_BYTES[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; uint64 in and out."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        a, b = np.full(size, _M), np.full(size, _INV)
        a[0] = b[0] = 1
        with np.errstate(over="ignore"):
            _powers[size] = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _powers[size]


def split_words(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes."""
    w = np.zeros(len(data) + 2, np.int8)
    w[1:-1] = is_word[data]
    d = np.diff(w)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span of bytes; sorted spans, taken ``step`` bytes at a time."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + step, "right")))
        s, e, part = starts[i:j] - base, ends[i:j] - base, data[base : ends[j - 1]]
        up, down = _power(len(part) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
            out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def words_of(data: bytes | memoryview, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, hashes) of one text."""
    low = LOWER[np.frombuffer(data, np.uint8)]
    s, e = split_words(low, is_word)
    return low, s, e, hash_spans(low, s, e)


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive hashes; none if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix(out + hashes[j : j + n] * _U(2 * j + 0x632BE59BD9B4E019))
    return out


def shingle_set(data: bytes | memoryview, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text as sorted hashes; a text of fewer words, but not none, is one shingle."""
    h = words_of(data, WORD_BYTES)[3]
    if not len(h):
        return h
    return np.unique(combine(h, min(k, len(h))))
