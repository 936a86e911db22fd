"""Vectorised hashing of words and shingles over Arrow string buffers.

Texts are read as bytes, a slice of a quarter of a megabyte at a time, so memory doesn't grow with the batch or with a text.
Hashes are 64 bits and the same in every process.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once.
SLICE = 1 << 18
_SEEDED = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _SEEDED.integers(1 << 62, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _SEEDED.integers(1 << 62, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)
_FAR = _SEEDED.integers(1 << 62, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)
_STEP = _SEEDED.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_FARTHEST = _SEEDED.integers(1 << 62, 1 << 63, 2048, dtype=np.uint64) | np.uint64(1)

BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def solid_bytes(piece: np.ndarray) -> np.ndarray:
    """Which bytes belong to words: all that aren't blank."""
    return ~BLANK[piece]


def word_bounds(data: np.ndarray, at: np.ndarray, solid_of: Callable[[np.ndarray], np.ndarray] = solid_bytes) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Word starts and ends (absolute), slice by slice; words are runs of solid bytes within one text."""
    first, last = int(at[0]), int(at[-1])
    lo = first
    while lo < last:
        hi = min(lo + SLICE, last)
        while hi < last:  # a slice ends at a blank or where a text begins
            window = BLANK[data[lo:hi]]
            if len(cut := np.flatnonzero(window)):
                hi = lo + int(cut[-1]) + 1
                break
            inside = at[(at > lo) & (at <= hi)]
            if len(inside):
                hi = int(inside[-1])
                break
            hi = min(hi + SLICE, last)
        solid = solid_of(data[lo:hi])
        edge = np.zeros(hi - lo + 1, bool)
        texts = at[(at >= lo) & (at <= hi)] - lo
        edge[texts] = True
        edge[0] = edge[-1] = True
        before = np.empty_like(solid)
        before[0], before[1:] = False, solid[:-1]
        after = np.empty_like(solid)
        after[-1], after[:-1] = False, solid[1:]
        starts = np.flatnonzero(solid & (edge[:-1] | ~before))
        ends = np.flatnonzero(solid & (edge[1:] | ~after)) + 1
        yield starts + lo, ends + lo, lo, hi
        lo = hi


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run the mixed sum of its values, each times a factor for its place in the run."""
    place = np.arange(len(values), dtype=np.int64) - np.repeat(starts, sizes)
    values = values * _PLACE[place & 1023]
    if (long := place > 1023).any():
        values[long] *= _FAR[(place[long] >> 10) & 1023]
        if (longest := place > 0xFFFFF).any():  # up to 2 GB, the largest string there is
            values[longest] *= _FARTHEST[(place[longest] >> 20) & 2047]
    return mixed(np.add.reduceat(values, starts))


def word_table(data: np.ndarray, at: np.ndarray, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (bytes mapped by `fold`), start and end of each word, and the number of words of each text."""
    hashes, first, last = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    weight = _BYTE[fold]
    weight[BLANK] = 0
    for starts, ends, _, hi in word_bounds(data, at):
        if not len(starts):
            continue
        sizes = np.diff(np.append(starts, hi))
        hashes.append(_sums(weight[data[starts[0] : hi]], starts - starts[0], sizes))
        first.append(starts)
        last.append(ends)
    starts = np.concatenate(first)
    return np.concatenate(hashes), starts, np.concatenate(last), np.diff(np.searchsorted(starts, at))


def word_hashes(data: np.ndarray, at: np.ndarray, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the number of words of each text."""
    hashes, _, _, counts = word_table(data, at, fold)
    return hashes, counts


def bounded_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """Hash of each run of bytes given by its bounds; runs must not overlap and ascend."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo, hi = int(starts[0]), int(ends[-1])
    inside = np.zeros(hi - lo + 1, np.int8)
    inside[starts - lo] += 1
    inside[ends - lo] -= 1
    weight = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, _BYTE[fold][data[lo:hi]], np.uint64(0))
    return _sums(weight, starts - lo, np.diff(np.append(starts, hi)))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` words of one sequence, in order."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total += words[k : k + len(total)] * _STEP[k]
    return mixed(total)


def whole(words: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence, apart from any window."""
    total = np.append(words * _STEP[32 : 32 + len(words)], _STEP[63:] * np.uint64(len(words))).sum(dtype=np.uint64, keepdims=True)
    return mixed(total)[0]


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, ascending.

    With fewer words than `size` the whole sequence is one shingle; without words the set is empty.
    """
    data, at = buffers(column)
    step = max(1, len(at) - 1)
    lo = 0
    while lo < len(at) - 1:  # as many texts as fit into a few slices at once
        hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + 4 * SLICE))), lo + step, len(at) - 1)
        words, counts = word_hashes(data, at[lo : hi + 1])
        stops = np.concatenate([[0], np.cumsum(counts)])
        for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(windows(words[a:b], size))
            elif b > a:
                yield np.array([whole(words[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
        lo = hi
