"""Minimal perfect hashes over byte strings, stored with their keys, as plain numpy arrays.

Level after level, keys are thrown at a bit array of twice their number; a key that falls alone sets its bit, the
others go on to the next level. A key's slot is the number of set bits before its own. Whether a string is a key at all
is told by comparing it with the key that is stored at its slot, so strange strings never count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textvec import mix, span_hashes, text_bytes

SPREAD = 2  # bits per key of a level


def key_hashes(keys: pa.Array, seed: int) -> np.ndarray:
    data, off = text_bytes(keys)
    if len(data) == 0:
        return np.zeros(len(keys), np.uint64)  # what an empty span hashes to
    return span_hashes(data, off[:-1], off[1:], seed)


def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to ``len(keys) - 1`` for distinct keys; ``find`` gives -1 for other strings."""

    def __init__(self, seed: int, sizes: np.ndarray, bits: np.ndarray, keys: pa.Array) -> None:
        self.seed, self.sizes, self.bits, self.keys = seed, sizes, bits, keys
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)  # set bits before each place

    @staticmethod
    def build(keys: pa.Array) -> PerfectHash:
        """Distinct keys in any order; they are stored by slot."""
        keys = keys.cast(pa.large_binary())
        seed = 0
        hashes = key_hashes(keys, seed)
        while len(np.unique(hashes)) < len(keys):  # two keys of one hash never part: another hash
            seed += 1
            hashes = key_hashes(keys, seed)
        left, sizes, bits, level = np.arange(len(keys)), [], [], 0
        while len(left):
            size = SPREAD * len(left)
            at = _places(hashes[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left, level = left[~alone[at]], level + 1
        made = PerfectHash(seed, np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool), keys)
        order = np.empty(len(keys), np.int64)
        order[made.slots(hashes)] = np.arange(len(keys))
        made.keys = keys.take(pa.array(order))
        return made

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot by hash; -1 where no level has a bit."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + _places(hashes[left], level, int(size))
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]]
            left = left[~hit]
        return out

    def find(self, strings: pa.Array) -> np.ndarray:
        """Slots of the strings, -1 for those that are no key."""
        if len(self.keys) == 0 or len(strings) == 0:
            return np.full(len(strings), -1, np.int64)
        slot = self.slots(key_hashes(strings, self.seed))
        some = np.flatnonzero(slot >= 0)
        same = pc.equal(self.keys.take(pa.array(slot[some])), strings.cast(pa.large_binary()).take(pa.array(some)))
        slot[some[~same.to_numpy(zero_copy_only=False)]] = -1
        return slot

    def dump(self) -> dict[str, bytes | int]:
        data, off = text_bytes(self.keys)
        return {
            "seed": self.seed, "sizes": self.sizes.astype("<i8").tobytes(), "bits": np.packbits(self.bits).tobytes(),
            "ends": np.diff(off).astype("<i8").tobytes(), "data": data.tobytes(),
        }

    @staticmethod
    def load(seed: int, sizes: bytes, bits: bytes, ends: bytes, data: bytes) -> PerfectHash:
        many = np.frombuffer(sizes, "<i8")
        flat = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(many.sum())).astype(bool)
        off = np.concatenate([[0], np.cumsum(np.frombuffer(ends, "<i8"))]).astype(np.int64)
        keys = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data)])
        return PerfectHash(seed, many, flat, keys)
