"""Repeated word passages by difference-cover anchors.

A window is ``window`` consecutive words. Word positions of a document are taken modulo ``period``; a difference cover
of the period holds two residues for every difference, so two equal windows, wherever they start, share a place at
which both documents are at a cover position. Hashing ``window - period + 1`` words at cover positions only
(a sixth of all positions here) therefore finds every pair: their anchors at that place are equal. Anchors met in two
documents are extended: every window that holds one is a candidate, and is compared by a 128-bit hash of all its
words. A word goes if a window over it also starts in a document with a smaller id.

Anchors and candidate windows are exchanged in packed form (see ``blocks``), merged per block before they move.

Defined results: a null text has no words; a null id counts as the smallest; rows with one id are one document with
itself (they do not remove each other's words); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import I64, U8, U64, Lookup, block_table, deal, longs, null_ids, runs, unpack
from .textvec import slices, span_hashes, text_bytes, window_hashes, word_spans

# Perfect difference covers, period: residues
COVERS = {7: [0, 1, 3], 13: [0, 1, 3, 9], 21: [3, 6, 7, 12, 14], 31: [1, 5, 11, 24, 25, 27]}


class Words:
    """Word hashes of a block's texts, and where each word stands."""

    def __init__(self, table: pa.Table) -> None:
        self.ids = longs(table.column("id"))
        data, off = text_bytes(table.column("text"))
        hashes, counts = [], []
        for i, j in slices(off, 1 << 20):
            part = off[i : j + 1]
            start, end, bounds = word_spans(data[part[0] : part[-1]], part - part[0])
            hashes.append(span_hashes(data[part[0] : part[-1]], start, end, seed=1))
            counts.append(np.diff(bounds))
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.left = self.first[self.doc + 1] - np.arange(len(self.doc))  # words from here to the text's end

    def anchors(self, window: int, period: int, cover: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors of all texts that hold a whole window."""
        span = window - period + 1
        at_cover = np.zeros(period, dtype=bool)
        at_cover[cover] = True
        place = np.arange(len(self.doc)) - self.first[self.doc]
        at = np.flatnonzero(at_cover[place % period] & (self.left >= span) & (self.count[self.doc] >= window))
        return at, window_hashes(self.hash, span, seed=2)[at] if len(at) else np.zeros(0, np.uint64)

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes (two arrays) of every place; only those with ``left >= window`` mean a window."""
        pad = len(self.hash) - max(0, len(self.hash) - window + 1)
        tail = np.zeros(pad, np.uint64)
        return tuple(np.concatenate([window_hashes(self.hash, window, seed=s), tail]) for s in (4, 5))


def merge(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (rows), the smallest id of each, and whether it has several ids."""
    order = np.lexsort((ids, *keys.T[::-1]))
    keys, ids = keys[order], ids[order]
    first = runs(keys)
    if len(first) == 0:
        return keys, ids, np.zeros(0, np.uint8)
    return keys[first], ids[first], (np.maximum.reduceat(ids, first) != ids[first]).astype(np.uint8)


def resolve(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a shard whose key stands in several documents: keys, smallest id of all, sending block."""
    cols = [unpack(table.column(f"k{i}"), U64)[0] for i in range(width)]
    ids, row = unpack(table.column("ids"), I64)
    several = unpack(table.column("several"), U8)[0]
    block = longs(table.column("block"))[row]
    keys = np.stack(cols, axis=1)
    order = np.lexsort((ids, *keys.T[::-1]))
    keys, ids, several, block = keys[order], ids[order], several[order], block[order]
    first = runs(keys)
    if len(first) == 0:
        return keys, ids, block
    size = np.diff([*first, len(keys)])
    least = ids[first]
    wide = (np.maximum.reduceat(ids, first) != least) | (np.maximum.reduceat(several, first) > 0)
    take = np.repeat(wide, size)
    return keys[take], np.repeat(least, size)[take], block[take]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, period: int = 31,
    keep_text: bool = False,
) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256[, kept_text])`` per row; kept words are joined by one space.

    ``period`` is one of ``COVERS`` and at most ``window``.
    """
    cover = COVERS[period]
    if period > window:
        raise ValueError("the period is longer than the window")
    texts, n = block_table(docs, id_col, text_col)
    blocks = texts.groupBy("block")

    def send_anchors(table: pa.Table) -> pa.Table:
        w = Words(table)
        at, hashes = w.anchors(window, period, cover)
        keys, ids, several = merge(hashes[:, None], w.ids[w.doc[at]])
        shard = (keys[:, 0] % np.uint64(n)).astype(np.int64)
        return deal(shard, table.column("block")[0].as_py(), [keys[:, 0], ids, several], ["shard", "block", "k0", "ids", "several"])

    def repeated_anchors(table: pa.Table) -> pa.Table:
        keys, _, block = resolve(table, 1)
        return deal(block, table.column("shard")[0].as_py(), [keys[:, 0]], ["block", "shard", "k0"])

    def send_windows(table: pa.Table, told: pa.Table) -> pa.Table:
        names = ["shard", "block", "k0", "k1", "ids", "several"]
        w = Words(table)
        at, hashes = w.anchors(window, period, cover)
        hit = at[Lookup(np.sort(unpack(told.column("k0"), U64)[0])).find(hashes)[0]]
        # a window over an anchor starts at most period - 1 words before it, in the same text
        cover_of = np.zeros(len(w.doc) + 1, dtype=np.int64)
        np.add.at(cover_of, np.maximum(hit - period + 1, w.first[w.doc[hit]]), 1)
        np.add.at(cover_of, hit + 1, -1)
        take = np.flatnonzero((np.cumsum(cover_of[:-1]) > 0) & (w.left >= window))
        h1, h2 = w.windows(window)
        keys, ids, several = merge(np.stack([h1[take], h2[take]], axis=1), w.ids[w.doc[take]])
        shard = (keys[:, 0] % np.uint64(n)).astype(np.int64)
        sender = table.column("block")[0].as_py() if len(table) else -1
        return deal(shard, sender, [keys[:, 0], keys[:, 1], ids, several], names)

    def repeated_windows(table: pa.Table) -> pa.Table:
        keys, least, block = resolve(table, 2)
        return deal(block, table.column("shard")[0].as_py(), [keys[:, 0], keys[:, 1], least], ["block", "shard", "k0", "k1", "ids"])

    def strip(table: pa.Table, told: pa.Table) -> pa.Table:
        w = Words(table)
        k0, k1, least = (unpack(told.column(c), t)[0] for c, t in (("k0", U64), ("k1", U64), ("ids", I64)))
        order = np.argsort(k0, kind="stable")
        k0, k1, least = k0[order], k1[order], least[order]
        h1, h2 = w.windows(window)
        at, where = Lookup(k0).find(h1)
        gone = np.zeros(len(w.doc) + 1, dtype=np.int64)
        while len(at):  # several answers may share the first half of a hash
            hit = (h2[at] == k1[where]) & (w.left[at] >= window) & (least[where] < w.ids[w.doc[at]])
            np.add.at(gone, at[hit], 1)
            np.add.at(gone, at[hit] + window, -1)
            where = where + 1
            more = where < len(k0)
            at, where = at[more], where[more]
            same = k0[where] == h1[at]
            at, where = at[same], where[same]
        keep = np.cumsum(gone[:-1]) == 0
        removed = np.array([b - a - int(keep[a:b].sum()) for a, b in zip(w.first, w.first[1:], strict=False)], dtype=np.int64)
        kept = []
        for i, text in enumerate(table.column("text").to_pylist()):
            words = text.encode().split()  # the six ASCII spaces, as in word_spans
            if removed[i]:
                words = compress(words, keep[w.first[i] : w.first[i + 1]])
            kept.append(b" ".join(words))
        out = [null_ids(w.ids), pa.array(w.count, pa.int64()), pa.array(removed, pa.int64()),
               pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        names = ["id", "n_words", "n_removed", "kept_sha256"]
        if keep_text:
            out.append(pa.array([x.decode() for x in kept], pa.string()))
            names.append("kept_text")
        return pa.table(out, names=names)

    sent = blocks.applyInArrow(send_anchors, "shard long, block long, k0 binary, ids binary, several binary")
    told = sent.groupBy("shard").applyInArrow(repeated_anchors, "block long, shard long, k0 binary")
    candidates = blocks.cogroup(told.groupBy("block")).applyInArrow(
        send_windows, "shard long, block long, k0 binary, k1 binary, ids binary, several binary"
    )
    answers = candidates.groupBy("shard").applyInArrow(
        repeated_windows, "block long, shard long, k0 binary, k1 binary, ids binary"
    )
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    out = blocks.cogroup(answers.groupBy("block")).applyInArrow(strip, schema)
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
