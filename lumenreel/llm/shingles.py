"""Hashes of word shingles of whole texts, many texts at a time.

Words are the runs between white space (space and bytes 9 to 13), with A-Z in lower case. A word's hash is a
polynomial over its bytes, read off a running sum over the whole slice, so no word becomes an object.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Words of a shingle.
SIZE = 5
#: Bytes that are hashed at a time; longer texts go through in windows.
SLICE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64, by doubling."""
    found = np.ones(SLICE + 1, dtype=np.uint64)
    size, factor = 1, base
    while size <= SLICE:
        end = min(2 * size, SLICE + 1)
        found[size:end] = found[: end - size] * np.uint64(factor)
        size, factor = end, factor * factor & _MASK
    return found


_UP, _DOWN = _powers(_ODD), _powers(pow(_ODD, -1, 1 << 64))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = mix((np.arange(256, dtype=np.uint64)[_LOWER] + np.uint64(1)) * np.uint64(_ODD))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def _words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and length of every word of a slice; ``begins`` are the starts of its texts."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = begins[begins < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * _UP[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _DOWN[starts], starts, ends - starts


def _long_text(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length; a word may go on from window to window."""
    parts, open_hash, open_length = [], 0, 0
    for at in range(0, len(data), SLICE):
        window = data[at : at + SLICE]
        hashes, starts, lengths = _words(window, np.zeros(1, dtype=np.int64))
        if open_length:
            if len(starts) and starts[0] == 0:
                shifted = int(hashes[0]) * pow(_ODD, open_length, 1 << 64)
                hashes[0] = np.uint64((open_hash + shifted) & _MASK)
                lengths[0] += open_length
            else:
                parts.append(np.array([open_hash], dtype=np.uint64))
        open_length = 0
        if len(starts) and not _SPACE[window[-1]]:
            open_hash, open_length = int(hashes[-1]), int(lengths[-1])
            hashes = hashes[:-1]
        parts.append(hashes)
    if open_length:
        parts.append(np.array([open_hash], dtype=np.uint64))
    return np.concatenate(parts)


def _shingled(words: np.ndarray) -> np.ndarray:
    """Distinct shingles of a text's words, sorted; fewer words than a shingle are one as a whole."""
    n = len(words)
    if not n:
        return words
    size = min(n, SIZE)
    rolled = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        rolled = mix(rolled * np.uint64(_ODD) + words[k : n - size + 1 + k])
    return np.unique(rolled)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted 64-bit numbers; null counts as empty."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    found, at = [], 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1
        if to <= at:
            found.append(_shingled(_long_text(data[offsets[at] : offsets[at + 1]])))
            at += 1
            continue
        to = min(to, len(texts))
        begins = offsets[at : to + 1] - offsets[at]
        hashes, starts, _ = _words(data[offsets[at] : offsets[to]], begins[:-1])
        cuts = np.searchsorted(starts, begins)
        found.extend(_shingled(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:]))
        at = to
    return found


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
