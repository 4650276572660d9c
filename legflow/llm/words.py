"""Words of Arrow text columns, found and hashed by whole-array operations.

A batch is worked through in pieces of about ``PIECE`` bytes (a longer text
is a piece of its own), so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
BASE = 0x9E3779B97F4A7C15


class Cache(dict):
    """Tables kept by a process; a copy shipped with a function starts empty."""

    def __reduce__(self):
        return Cache, ()


CACHE = Cache()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed)) | np.uint64(1)


def lowered() -> np.ndarray:
    """Byte table: A-Z to a-z, all else as it is."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def spaced_words() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[9, 10, 11, 12, 13, 32]] = False
    return t


def plain_words() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(CACHE.get("powers", ((), ()))[0]) < n:
        n = max(n, 1 << 20)
        both = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        CACHE["powers"] = tuple(both)
    return CACHE["powers"]


@dataclass
class Words:
    """Words of the texts of one piece.

    ``at``: word range of each text (length texts + 1).  ``start``, ``end``:
    byte range of each word in ``data``.  ``hash``: 64-bit hash of each word.
    """

    data: np.ndarray
    offsets: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def pieces(column, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    size = 8 if wide else 4
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * size).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def split_words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    """Words of one piece: maximal runs of ``word_bytes`` inside each text, hashed with A-Z lower-cased."""
    n = len(data)
    inside = word_bytes[data]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    after = np.empty(n + 1, bool)
    after[:n] = inside
    after[n] = False
    before[offsets] = False
    start = np.flatnonzero(inside & ~before[:n])
    after[offsets] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    power, inverse = powers(n + 1)
    table = mix(lowered().astype(np.uint64) + np.uint64(0xA5A5A5A5))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * power[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * inverse[start])
    return Words(data, offsets, np.searchsorted(start, offsets), start, end, hashed)


def runs(words: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Hash of each run of k consecutive values (length len - k + 1, or 0)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(odd_numbers(k, seed)):
        out += words[j:j + n] * c
    return mix(out)


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, joined, and their ranges.

    A text of fewer than k words, but not none, has one shingle: all its words.
    """
    n = np.diff(w.at)
    full = runs(w.hash, k)
    sets = []
    for t in range(len(n)):
        a, b = w.at[t], w.at[t + 1]
        if n[t] >= k:
            s = np.sort(full[a:b - k + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
        elif n[t]:
            s = runs(w.hash[a:b], int(n[t]), seed=1000 + int(n[t]))
        else:
            s = full[:0]
        sets.append(s)
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=at[1:])
    return (np.concatenate(sets) if sets else full[:0]), at
