"""Vectorised views of text batches: bytes, words and hashes of word windows as numpy arrays.

Words are ``[^\\x20\\x09-\\x0D]+``. Everything here works on one Arrow batch; nothing knows about Spark.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def release() -> None:
    """Give freed memory back to the system: workers stay between tasks, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their bounds (one more than texts); a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = col.buffers()
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = 1_000_000) -> list[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes, to keep temporary arrays small; a longer text is a run of its own."""
    out, i, n = [], 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = j
    return out


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and each text's bounds in the list of words."""
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


@functools.lru_cache(32)
def _table(seed: int) -> np.ndarray:
    """A random value per byte; seeds give independent hashes with one factor."""
    return mix(mix(np.arange(1, 257, dtype=np.uint64)) + np.uint64(0x632BE59BD9B4E019 * (seed + 1) & (1 << 64) - 1))


_kept: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the power 0, 1, .. n - 1 modulo 2**64; up to 2**21 of them are kept for the next call."""
    if len(_kept.get(base, ())) >= n:
        return _kept[base][:n]
    out = np.full(max(n, 1 << 12), base, dtype=np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if n <= 1 << 21:
        _kept[base] = out
    return out[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every byte span ``[start, end)``."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_table(seed)[data] * powers(FACTOR, len(data)), out=sums[1:])
    back = powers(INVERSE, len(data) + 1)
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def window_hashes(items: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of every run of ``n`` consecutive items (64-bit values); ``len(items) - n + 1`` of them."""
    if len(items) < n:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(items) + 1, dtype=np.uint64)
    np.cumsum(mix(items + np.uint64(0x632BE59BD9B4E019 * seed & (1 << 64) - 1)) * powers(FACTOR, len(items)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(INVERSE, len(items) + 1)[: len(items) - n + 1])


def range_hashes(items: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the items in every range ``[start, end)``."""
    sums = np.zeros(len(items) + 1, dtype=np.uint64)
    np.cumsum(mix(items + np.uint64(0x632BE59BD9B4E019 * seed & (1 << 64) - 1)) * powers(FACTOR, len(items)), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(items) + 1)[start] + (end - start).astype(np.uint64))


def text_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one row per item) over each text's ``[bounds[i], bounds[i + 1])``."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
