"""Word shingles as 64-bit fingerprints, computed on whole Arrow batches with numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pa.concat_arrays([pc.fill_null(column.cast(pa.large_string()), "")])
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and per text the index of its first word (with the end)."""
    solid = ~_SPACE[data]
    if not solid.any():
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] |= solid[edges]
    at = np.flatnonzero(solid)
    begin = np.flatnonzero(first[at])
    length = np.diff(begin, append=len(at))
    place = np.arange(len(at)) - np.repeat(begin, length)
    power = np.multiply.accumulate(np.full(int(length.max()), _BASE, np.uint64))
    value = _BYTE[_LOWER[data[at]]] * power[place]
    hashes = mix(np.add.reduceat(value, begin) + length.astype(np.uint64))
    return hashes, np.searchsorted(at[begin], offsets).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text.

    A text with fewer words than ``width`` has its whole word sequence as its
    only shingle; one without words has none.
    """
    words, start = word_hashes(data, offsets)
    n = len(words)
    joined = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        joined += words[j : j + len(joined)] * _STEP[j]
    joined = mix(joined + np.uint64(width))
    out = []
    for s, e in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        if e - s >= width:
            out.append(np.unique(joined[s : e - width + 1]))
        elif e > s:
            out.append(mix((words[s:e] * _STEP[: e - s]).sum(dtype=np.uint64, keepdims=True) + np.uint64(e - s)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
