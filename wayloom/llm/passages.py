"""Runs of many words that documents share, for the report of ``suffix_dedup``.

Words are runs of bytes that are no ASCII white space. Every run of ``WINDOW`` words has an anchor: the ``ANCHOR`` words
in it whose hash is least (the leftmost of equals). An anchor depends on the run's words alone, so that equal runs have
equal anchors, and only runs whose anchor occurs in two documents are looked at again.
"""

from __future__ import annotations

import numpy as np

from wayloom.llm import hashing

WINDOW, ANCHOR = 51, 12


def _least(value: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` neighbouring values is, the leftmost of equals."""
    place, at = value, np.arange(len(value))
    have = 1
    while have < width:
        by = min(have, width - have)
        left, right = place[:-by], place[by:]
        first = left <= right
        place, at = np.where(first, left, right), np.where(first, at[:-by], at[by:])
        have += by
    return at


def anchors(words: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of each text's anchors: the text, the anchor's hash, the first and the last run (by first word) that it leads."""
    n = len(words)
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    hashed = np.zeros(n - anchor + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(anchor):
            hashed = hashed * hashing.WORD_BASE + words[k : n - anchor + 1 + k]
    hashed = hashing.mix(hashed)
    lead = _least(hashed, window - anchor + 1)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])  # runs inside one text
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    lead, text = lead[start], owner[start]
    opens = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (text[1:] != text[:-1])]))
    closes = np.concatenate([opens[1:], [len(start)]]) - 1
    base = offsets[text[opens]]
    return text[opens], hashed[lead[opens]], start[opens] - base, start[closes] - base


class Words:
    """The words of one text, for hashes of runs of them."""

    def __init__(self, words: np.ndarray):
        powers = hashing.powers(hashing.WORD_BASE, len(words) + 1)
        self.inverse = hashing.powers(np.uint64(pow(int(hashing.WORD_BASE), -1, 1 << 64)), len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers[:-1], dtype=np.uint64, out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return hashing.mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def runs(starts: list[tuple[int, int]], window: int = WINDOW) -> int:
    """How many separate passages runs that start in the given ranges (both ends inclusive) make up."""
    count, end = 0, -1
    for lo, hi in sorted(starts):
        count += lo > end
        end = max(end, hi + window)
    return count
