"""Words of many texts as arrays: where they start, how long they are, and 64-bit hashes.

Texts are handled as UTF-8 bytes in pieces of bounded size that end between words, so a very
long text needs no more memory than many short ones, apart from a few numbers per word.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Bytes of text worked on at once.
PIECE = 1 << 19
#: An odd constant whose powers weigh the places of a word, and the constants of the final mix.
PLACE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

#: White space of the contracts: space and the control characters 9 to 13.
BLANK = bytes([9, 10, 11, 12, 13, 32])
#: All ASCII characters but letters and digits.
PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum())


def byte_values(separators: bytes, seed: int = 11) -> np.ndarray:
    """A random 64-bit value per byte, 0 for separators; bytes map to no other byte's value."""
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) << np.uint64(1)
    values |= np.uint64(1)
    values[list(separators)] = 0
    return values


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of the input over all bits (a bijection of 64-bit numbers)."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(size: int) -> np.ndarray:
    out = np.full(size, PLACE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _pieces(buffer: np.ndarray, values: np.ndarray):
    """(first, last) of pieces that end between words."""
    at, size = 0, len(buffer)
    while at < size:
        end = min(size, at + PIECE)
        while end < size:
            gap = np.flatnonzero(values[buffer[end - 1 : end + PIECE]] == 0)
            if len(gap):
                end = end - 1 + int(gap[0]) + 1
                break
            end = min(size, end + PIECE)
        yield at, end
        at = end


def word_hashes(
    texts: Sequence[bytes], separators: bytes, prefixes: Sequence[int] = ()
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of words before each text (one more at the end), and one array of hashes per
    feature: the whole word first, then its first n bytes for every n of ``prefixes``."""
    values = byte_values(separators)
    blank = separators[:1]
    buffer = np.frombuffer(blank.join([*texts, b""]), np.uint8)
    counts, features = [], [[] for _ in range(1 + len(prefixes))]
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts_seen = []
    for first, last in _pieces(buffer, values):
        piece = buffer[first:last]
        value = values[piece]
        inside = value != 0
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        if not len(starts):
            continue
        starts_seen.append(starts + first)
        ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
        lengths = ends - starts
        gaps = np.diff(starts, append=len(piece))
        place = np.arange(int(starts[0]), len(piece)) - np.repeat(starts, gaps)
        weighed = value[int(starts[0]) :] * _powers(int(place.max()) + 1)[place]
        features[0].append(mix(np.add.reduceat(weighed, starts - int(starts[0]))))
        for n, out in zip(prefixes, features[1:]):
            total, weights = np.zeros(len(starts), np.uint64), _powers(n)
            for j in range(n):
                there = starts + np.minimum(j, lengths - 1)
                total += np.where(j < lengths, value[there] * weights[j], np.uint64(0))
            out.append(mix(total))
    at = np.concatenate(starts_seen) if starts_seen else np.empty(0, np.int64)
    counts = np.searchsorted(at, borders)
    none = np.empty(0, np.uint64)
    return counts, [np.concatenate(f) if f else none for f in features]


def chunks(sizes: Sequence[int], limit: int = PIECE):
    """(first, last) of runs of texts with about ``limit`` bytes, one text at least."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= limit:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)
