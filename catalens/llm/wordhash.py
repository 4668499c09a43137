"""64-bit hashes of all words of a batch of texts, in numpy passes over the bytes.

A word's hash is the sum of table[byte] * BASE**position over its bytes, modulo
2**64, then mixed. One running sum over the batch gives every word's sum, as BASE is
odd and so its powers can be divided out. Windows of about SLICE bytes bound memory;
a window never ends inside a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_random = np.random.RandomState(20240501)
_TABLE = _random.randint(0, 1 << 32, 256, dtype=np.uint64) << np.uint64(32) | _random.randint(0, 1 << 32, 256, dtype=np.uint64)

#: ASCII white space: \x09-\x0D and \x20.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII that is neither letter nor digit.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED = _TABLE[_LOWER]

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE + 4096)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and each text's bounds; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separators inside the texts."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~separators[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(texts: pa.Array, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and where each text's words begin."""
    hashes, _, firsts = words_of(*text_bytes(texts), separators)
    return hashes, firsts


def words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `word_hashes`, with the words' lengths in bytes."""
    hashes, lengths, firsts, seen, at = [], [], np.zeros(len(offsets), np.int64), 0, 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data):
            gaps = np.flatnonzero(separators[data[max(at, end - 4096) : end]])
            if len(gaps):
                end = max(at, end - 4096) + int(gaps[-1]) + 1
                break
            end = min(end + SLICE, len(data))
        part = data[at:end]
        low, high = np.searchsorted(offsets, [at, end])
        own = offsets[low:high] - at
        starts, ends = word_bounds(part, own, separators)
        up, down = _power(len(part))
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_LOWERED[part] * up, out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        lengths.append(ends - starts)
        firsts[low:high] = seen + np.searchsorted(starts, own)
        seen, at = seen + len(starts), end
    firsts[offsets >= at] = seen
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), firsts
    return np.concatenate(hashes), np.concatenate(lengths), firsts


def slices(texts: pa.Array, size: int = 4 << 20):
    """(start, stop) of runs of texts of about `size` bytes, one text at least."""
    _, offsets = text_bytes(texts)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, min(stop, len(texts))
        start = stop


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash per run of n words: entry i covers words[i : i + n]."""
    count = max(0, len(words) - n + 1)
    h = words[:count].copy()
    for k in range(1, n):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : count + k])
    return h
