"""Vectorised hashing of UTF-8 bytes and words.

Every hash is a function of the bytes alone, so it is equal on all executors and in all runs. Work is done over whole
Arrow buffers; temporaries are bounded by the piece size, however long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial over bytes, and one for sequences of words.
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD1342543DE82EF95)
PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POW, _INV = powers(BASE, PIECE + 1), powers(_INVERSE, PIECE + 1)
#: A second polynomial, for 128 bits together with the first.
_POW2, _INV2 = powers(WORD_BASE, PIECE + 1), powers(np.uint64(pow(int(WORD_BASE), -1, 1 << 64)), PIECE + 1)


def utf8_or_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array one after the other, and the n + 1 offsets."""
    values = values.cast(pa.large_binary())
    if len(values) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def utf8(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array one after the other, and the n + 1 offsets; nulls are empty."""
    values = pa.compute.fill_null(values, "").cast(pa.large_string())
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if len(values) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word and the n + 1 word offsets of the texts.

    A word is a run of bytes that aren't ``apart``: by default, that are no ASCII white space.
    """
    found, starts_all, n, at = [], [], len(data), 0
    cuts = np.zeros(n + 1, bool)
    cuts[offsets] = True
    carry = None  # hash state of a word longer than a piece
    while at < n:
        end = min(n, at + PIECE)
        if end < n:  # cut at white space or at a text's end if there is any
            space = np.flatnonzero(apart[data[at:end]] | cuts[at + 1 : end + 1])
            end = at + int(space[-1]) + 1 if len(space) else end
        part = data[at:end]
        black = ~apart[part]
        before = np.empty_like(black)
        before[0], before[1:] = False, black[:-1]
        opens = black & (~before | cuts[at:end])
        after = np.empty_like(black)
        after[-1], after[:-1] = False, black[1:]
        closes = black & (~after | cuts[at + 1 : end + 1])
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POW[: len(part)], dtype=np.uint64, out=sums[1:])
        h = mix((sums[e] - sums[s]) * _INV[s] + (e - s).astype(np.uint64))
        s = s + at
        if carry is not None and len(s) and s[0] == at and not cuts[at]:  # goes on from the last piece
            h[:1] = mix(np.array([carry], np.uint64) * WORD_BASE + h[:1])
            found[-1] = found[-1][:-1]
            s = np.concatenate([starts_all[-1][-1:], s[1:]])
            starts_all[-1] = starts_all[-1][:-1]
        carry = h[-1] if len(h) and end < n and black[-1] and not cuts[end] else None
        found.append(h)
        starts_all.append(s)
        at = end
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    return hashes, np.searchsorted(starts, offsets, "left")


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of ASCII and of Latin-1 (lead byte C3) in lower case."""
    out = _LOWER[data]
    if len(data):
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[capital] += 0x20
    return out


def segments(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of one kind (0 is left out) inside texts: hashes, the texts' n + 1 offsets, starts, ends.

    Runs are hashed in pieces of the data that are cut between runs; a run longer than a piece is hashed by itself.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = kind[data]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = k[1:] != k[:-1]
    edge[offsets] = True
    bounds = np.flatnonzero(edge)
    s, e = bounds[:-1], bounds[1:]
    on = k[s] != 0
    s, e = s[on], e[on]
    hashes = np.zeros(len(s), np.uint64)
    i = 0
    while i < len(s):
        a = s[i]
        j = max(i + 1, int(np.searchsorted(e, a + PIECE, "right")))
        part = data[a : e[j - 1]]
        powers_, inverse = (_POW, _INV) if len(part) <= PIECE else (powers(BASE, len(part) + 1), powers(_INVERSE, len(part) + 1))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers_[: len(part)], dtype=np.uint64, out=sums[1:])
        hashes[i:j] = mix((sums[e[i:j] - a] - sums[s[i:j] - a]) * inverse[s[i:j] - a] + (e[i:j] - s[i:j]).astype(np.uint64))
        i = j
    return hashes, np.searchsorted(s, offsets, "left"), s, e


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words that stay in one text; a shorter text that has a word gives one."""
    n = np.diff(offsets)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(counts)])
    if not to[-1]:
        return np.zeros(0, np.uint64), to
    owner = np.repeat(np.arange(len(n)), counts)
    first = np.arange(to[-1]) - to[owner] + offsets[owner]
    out = np.zeros(to[-1], np.uint64)
    last = offsets[owner + 1]
    with np.errstate(over="ignore"):
        for k in range(size):
            at = first + k
            inside = at < last
            out = out * WORD_BASE + np.where(inside, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(k))
    return mix(out), to
