"""Words and word shingles of whole texts as 64-bit values, vectorised over a batch.

A word is a maximal run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return, with
A-Z lower-cased. A text is cut only between words, so its length bounds nothing but its own arrays: a slice of
`SLICE` bytes is hashed at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20
SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers[:] = tables
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """One hash per word of `data`, and the byte position at which each word starts."""
    hashes, places, at, total = [], [], 0, len(data)
    while at < total:
        end = min(total, at + SLICE)
        while end < total and not _BLANK[data[end]]:
            gap = np.flatnonzero(_BLANK[np.frombuffer(data, np.uint8, min(SLICE, total - end), end)])
            end += int(gap[0]) if len(gap) else min(SLICE, total - end)
        raw = _LOWER[np.frombuffer(data, np.uint8, end - at, at)]
        inside = np.concatenate(([False], ~_BLANK[raw], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edges[::2], edges[1::2]
        forward, back = _power_tables(max(SLICE, len(raw)) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * forward[:len(raw)])))
        hashes.append(mix((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64)))
        places.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def batches(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in runs of about `SLICE` bytes: (index of the first, word hashes, offsets of each text's words)."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or b"") <= SLICE):
            size += len(texts[last] or b"") + 1
            last += 1
        run = [t or b"" for t in texts[first:last]]
        hashes, places = word_hashes(b"\n".join(run))
        ends = np.cumsum([len(t) + 1 for t in run])
        yield first, hashes, np.concatenate(([0], np.searchsorted(places, ends)))
        first = last


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of `n` words (fewer than `n` words: none)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        out = out * _BASE + words[k:len(words) - n + 1 + k]
    return mix(out)


def shingle_sets(texts: list[bytes | None], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per text its distinct `n`-word shingles, ascending by hash, as int64; fewer words: the whole sequence as one."""
    for _, words, offsets in batches(texts):
        grams = gram_hashes(words, n).view(np.int64)
        for a, b in zip(offsets[:-1], offsets[1:]):
            if b - a >= n:
                own = np.sort(grams[a:b - n + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            else:
                yield gram_hashes(words[a:b], int(b - a)).view(np.int64) if b > a else np.zeros(0, np.int64)
