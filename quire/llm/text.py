"""Words of whole texts as 64-bit hashes, computed on Arrow's UTF-8 buffers with numpy.

A text never becomes Python strings: one table says which bytes belong to words, another
gives each byte a random 64-bit value (A-Z like a-z), and a word's hash is a polynomial
over these values that prefix sums yield for all words at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; bounds the memory of the 8-byte arrays.
STEP = 1 << 18
#: Text bytes of the rows that a kernel sees at once (one longer text comes alone).
SLICE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUES = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_VALUES[65:91] = _VALUES[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Everything but the six ASCII white-space characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: ASCII letters and digits, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: ASCII letters and all beyond ASCII.
LETTERS = ALNUM.copy()
LETTERS[0x30:0x3A] = False


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64, n + 1, 8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            x = np.full(max(n, STEP + 1), base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS


def _pieces(data: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts that fall behind a byte outside words."""
    lo, n, look = 0, len(data), 1 << 16
    while lo < n:
        hi = min(lo + STEP, n)
        while hi < n:
            outside = np.flatnonzero(~is_word[data[max(lo, hi - look) : hi]])
            if len(outside):
                hi = max(lo, hi - look) + int(outside[-1]) + 1
                break
            hi = min(hi + look, n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of every word, and each row's first word number.

    A word is a longest run of ``is_word`` bytes within one row; A-Z count as a-z.
    """
    hashes, firsts, lasts = [], [], []
    for lo, hi in _pieces(data, is_word):
        b = data[lo:hi]
        w = is_word[b]
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        cuts = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, hi, "right")] - lo
        inner = cuts[cuts < hi - lo]
        first[inner] = w[inner]
        ending = cuts[cuts > 0] - 1
        last[ending] = w[ending]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _powers(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_VALUES[b] * power[: hi - lo], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)))
        firsts.append(s + lo)
        lasts.append(e + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    s = np.concatenate(firsts)
    return np.concatenate(hashes), s, np.concatenate(lasts), np.searchsorted(s, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by its first word; rows are not looked at."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out, k)
