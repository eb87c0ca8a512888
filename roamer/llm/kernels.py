"""NumPy kernels over the text buffers of Arrow batches: words, hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.Generator(np.random.Philox(key=20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=U64) | U64(1)
_BASE = _rng.integers(0, 2**64, 1, dtype=U64)[0] | U64(1)
#: A text is cut into blocks of so many bytes at document bounds (one document at least).
BLOCK = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``size`` bytes; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run without white space; none crosses a document."""
    inside = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes with A-Z in lower case."""
    if not len(starts):
        return np.empty(0, U64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    inside = np.repeat(starts - firsts, lengths) + np.arange(int(lengths.sum()))
    power = np.multiply.accumulate(np.full(int(lengths.max()), _BASE, U64))
    place = np.arange(len(inside)) - np.repeat(firsts, lengths)
    return mix(np.add.reduceat(_BYTE[LOWER[data[inside]]] * power[place], firsts) + lengths.astype(U64))


def folded(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each window of k hashes, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, U64(k))
    for i in range(k):
        out = mix(out * U64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles as hashes.

    A text of 1 to k-1 words has its whole sequence as one shingle; a text
    without words has none.
    """
    for _, data, offsets in blocks(texts):
        starts, ends = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        bounds = np.searchsorted(starts, offsets)
        windows = folded(hashes, k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(windows[a : b - k + 1])
            else:
                yield folded(hashes[a:b], b - a) if b > a else np.empty(0, U64)
