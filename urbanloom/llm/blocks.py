"""Two-sided exchange of packed arrays between blocks of documents and shards of keys.

A block holds the documents whose hash falls to it, a few megabytes of text. Blocks merge what they hold by key
(so a key that is everywhere is one entry per block), deal the entries to shards by key, and pack each shard's entries
as one row of byte strings. A shard sees all entries of its keys, decides, and packs one answer row per block. The
shuffled volume follows the entries; no task gets more than its block or its share of the key space. A key of any
frequency adds at most one entry per block to its shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textvec import release

BLOCK_BYTES = 3 << 20
U8, U64, I64, I32 = np.dtype("<u1"), np.dtype("<u8"), np.dtype("<i8"), np.dtype("<i4")
NO_ID = np.iinfo(np.int64).min  # stands for a null id: smaller than every other


def block_table(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``(block, id, text)`` with as many blocks as the texts' bytes ask for, and the number of blocks."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    n = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(n)).cast("long")
    return docs.select(block.alias("block"), F.col(id_col).cast("long").alias("id"), text.alias("text")), n


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def longs(col: pa.ChunkedArray) -> np.ndarray:
    """64-bit ids; a null is the smallest."""
    return col.fill_null(NO_ID).to_numpy().astype(np.int64, copy=False)


def null_ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def deal(shard: np.ndarray, sender: int, columns: list[np.ndarray], names: list[str]) -> pa.Table:
    """One row per shard that gets entries: ``(names[0] = shard, names[1] = sender, packed columns ..)``."""
    order = np.argsort(shard, kind="stable")
    keys, first = np.unique(shard[order], return_index=True)
    cuts = [*first.tolist(), len(order)]
    packed = []
    for c in columns:
        c = np.ascontiguousarray(c[order])
        raw, size = c.tobytes(), c.dtype.itemsize
        packed.append(pa.array([raw[a * size : b * size] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()))
    return pa.table([pa.array(keys, pa.int64()), pa.array(np.full(len(keys), sender), pa.int64()), *packed], names=names)


def tidy(step):
    """``step`` of a block or shard, freeing its memory at the end."""

    def one(table: pa.Table) -> pa.Table:
        out = step(table)
        release()
        return out

    def two(table: pa.Table, told: pa.Table) -> pa.Table:
        out = step(table, told)
        release()
        return out

    return one if step.__code__.co_argcount == 1 else two


def unpack(col: pa.ChunkedArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All entries of packed rows, and the row each came from."""
    raw = col.to_pylist()
    out = np.frombuffer(b"".join(raw), dtype)
    return out, np.repeat(np.arange(len(raw)), [len(x) // dtype.itemsize for x in raw])


def runs(keys: np.ndarray) -> np.ndarray:
    """First places of equal neighbours in sorted keys (1-d, or rows of several keys)."""
    if len(keys) == 0:
        return np.zeros(0, np.int64)
    new = np.ones(len(keys), dtype=bool)
    differ = keys[1:] != keys[:-1]
    new[1:] = differ if keys.ndim == 1 else differ.any(axis=1)
    return np.flatnonzero(new)


class Lookup:
    """Places of values in sorted distinct keys; a small table of leading bits turns most misses away at once."""

    def __init__(self, keys: np.ndarray, bits: int = 20) -> None:
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.some = np.zeros(1 << bits, dtype=bool)
        self.some[keys >> self.shift] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values that are keys, and where each stands among the keys."""
        if len(self.keys) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.some[values >> self.shift])
        where = np.searchsorted(self.keys, values[at])
        hit = self.keys[np.minimum(where, len(self.keys) - 1)] == values[at]
        return at[hit], where[hit]
