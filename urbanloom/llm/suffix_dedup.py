"""Repeated byte strings by suffix arrays over shards of the text.

Two equal strings of ``length`` bytes share the smallest hash among their ``span``-byte substrings (their anchor), so
the places where they start can be dealt to shards by anchor without losing a pair:

1. Blocks of documents find the anchor of every window of ``length`` bytes and send the anchors; shards tell which
   occur more than once. Most text stops here.
2. Neighbouring windows with one repeated anchor form a piece (its text is the windows' bytes). Blocks send each
   different piece once. A shard builds the suffix array of its pieces by induced sorting, in bins of whole anchor
   groups, and the permuted common prefixes; a window is repeated if its suffix shares ``length`` bytes with a
   neighbour in the order, or if its piece stands in several places.
3. Blocks remove the bytes under repeated windows.

An anchor in more than ``hot`` pieces (a passage that a large part of all documents share) would fill its shard; its
windows are compared by a 128-bit hash instead, merged per block and dealt by that hash. The result is the same.

Defined results: a null text is empty; a null id is kept; repeated rows count as separate documents (all their long
strings are repeated); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import I32, U8, U64, Lookup, block_table, deal, longs, null_ids, runs, unpack
from .suffixes import permuted_prefixes, suffix_array
from .textvec import FACTOR, INVERSE, _table, mix, powers, slices, text_bytes

GAP = 0xFF  # never a byte of UTF-8
MOST = 512  # windows of one piece


class Rolling:
    """Hashes of any substrings of ``data`` with one seed."""

    def __init__(self, data: np.ndarray, seed: int) -> None:
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_table(seed)[data] * powers(FACTOR, len(data)), out=self.sums[1:])
        self.back = powers(INVERSE, len(data) + 1)

    def all(self, n: int) -> np.ndarray:
        """Hash of the ``n`` bytes at every place that has them."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.back[: len(self.sums) - n])

    def at(self, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + n] - self.sums[start]) * self.back[start])


def sliding(values: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every ``n`` neighbours: prefixes and suffixes of runs of ``n``, joined."""
    count = len(values) - n + 1
    fill = values[-1:]
    padded = np.concatenate([values, np.repeat(fill, -len(values) % n)]).reshape(-1, n)
    ahead = op.accumulate(padded, axis=1).ravel()
    behind = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:count], ahead[n - 1 : n - 1 + count])


class Pieces:
    """Anchors and pieces of a slice of texts (``data`` and bounds ``off``)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int, span: int) -> None:
        self.data, self.off, self.length, self.span = data, off, length, span
        self.roll = Rolling(data, 11)
        self.start = np.zeros(0, np.int64)
        self.windows = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        self.least = self.grams = None
        if len(data) < length:
            return
        self.grams = self.roll.all(span)
        self.least = sliding(self.grams, length - span + 1, np.minimum)
        whole = np.zeros(len(self.least) + 1, dtype=np.int32)  # windows within one text
        first, last = off[:-1], off[1:] - length + 1
        held = last > first
        np.add.at(whole, first[held], 1)
        np.add.at(whole, last[held], -1)
        self.whole = np.cumsum(whole[:-1]) > 0
        at = np.flatnonzero(self.whole)
        if not len(at):
            return
        new = np.r_[True, (at[1:] != at[:-1] + 1) | (self.least[at[1:]] != self.least[at[:-1]])]
        new[np.searchsorted(at, first[held])] = True
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(at)])
        parts = -(-size // MOST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = np.repeat(at[begin], parts) + nth * MOST
        self.windows = np.minimum(MOST, np.repeat(size, parts) - nth * MOST)
        self.anchor = self.least[self.start]

    def places(self) -> np.ndarray:
        """Hashes at all places that are some window's anchor, one per place."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        wide = self.length - self.span
        held = np.where(self.whole, self.least, np.uint64(0))
        top = sliding(np.concatenate([np.zeros(wide, np.uint64), held, np.zeros(wide, np.uint64)]), wide + 1, np.maximum)
        return self.grams[top == self.grams]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hash of every piece."""
        n = self.windows + self.length - 1
        mark = n.astype(np.uint64)
        return self.roll.at(self.start, n) + mark, Rolling(self.data, 12).at(self.start, n) + mark


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """Places in each piece whose next ``length`` bytes also stand elsewhere in these (different) pieces."""
    data = np.frombuffer(b"\xff".join(pieces), np.uint8)
    symbols = np.zeros(len(data) + 1, dtype=np.int32)
    symbols[:-1] = data
    symbols[:-1] += 1
    sa = suffix_array(symbols, 257)
    shared = permuted_prefixes(data, sa)
    order = sa[sa < len(data)]
    again = shared >= length
    again[order[:-1][shared[order[1:]] >= length]] = True
    out, at = [], 0
    for p in pieces:
        out.append(np.flatnonzero(again[at : at + len(p) - length + 1]))
        at += len(p) + 1
    return out


def as_runs(places: np.ndarray) -> np.ndarray:
    """Sorted places as ``(first, count)`` pairs."""
    if not len(places):
        return np.zeros((0, 2), np.int32)
    begin = np.flatnonzero(np.r_[True, places[1:] != places[:-1] + 1])
    return np.stack([places[begin], np.diff(np.r_[begin, len(places)])], axis=1).astype(np.int32)


def bins(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of neighbours with about ``most`` in total; a larger one stands alone."""
    out, i = [], 0
    total = np.r_[0, np.cumsum(sizes)]
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, span: int = 64,
    hot: int = 1000, bin_bytes: int = 3_000_000, keep_text: bool = False,
) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256[, kept_bytes])`` per row.

    ``hot``: pieces of one anchor above which its windows are compared by hash.
    """
    texts, n = block_table(docs, id_col, text_col)
    blocks = texts.groupBy("block")

    def cut(table: pa.Table):
        data, off = text_bytes(table.column("text"))
        for i, j in slices(off, 1 << 20):
            part = off[i : j + 1]
            yield Pieces(data[part[0] : part[-1]], part - part[0], length, span)

    def sender(table: pa.Table) -> int:
        return table.column("block")[0].as_py() if len(table) else -1

    def shard_of(keys: np.ndarray) -> np.ndarray:
        return (keys % np.uint64(n)).astype(np.int64)

    def send_anchors(table: pa.Table) -> pa.Table:
        found = [(p.places(), p.anchor) for p in cut(table)]
        places = np.sort(np.concatenate([x for x, _ in found]))
        first = runs(places)
        keys, count = places[first], np.diff(np.r_[first, len(places)])
        named, uses = np.unique(np.concatenate([x for _, x in found]), return_counts=True)
        pieces = np.zeros(len(keys), np.int32)
        pieces[np.searchsorted(keys, named)] = uses
        return deal(shard_of(keys), sender(table), [keys, (count > 1).astype(U8), pieces.astype(I32)],
                    ["shard", "block", "k0", "several", "pieces"])

    def repeated_anchors(table: pa.Table) -> pa.Table:
        keys, row = unpack(table.column("k0"), U64)
        several, pieces = unpack(table.column("several"), U8)[0], unpack(table.column("pieces"), I32)[0]
        block = longs(table.column("block"))[row]
        order = np.argsort(keys, kind="stable")
        keys, several, pieces, block = keys[order], several[order], pieces[order], block[order]
        first = runs(keys)
        if len(first):
            size = np.diff(np.r_[first, len(keys)])
            wide = np.repeat((size > 1) | (np.maximum.reduceat(several, first) > 0), size)
            many = np.repeat(np.add.reduceat(pieces.astype(np.int64), first) > hot, size).astype(np.uint8)
            keys, block, many = keys[wide], block[wide], many[wide]
        else:
            many = several
        return deal(block, table.column("shard")[0].as_py(), [keys, many], ["block", "shard", "k0", "hot"])

    def send_pieces(table: pa.Table, told: pa.Table) -> pa.Table:
        keys, many = unpack(told.column("k0"), U64)[0], unpack(told.column("hot"), U8)[0]
        order = np.argsort(keys)
        look, many = Lookup(keys[order]), many[order]
        held: dict[tuple[int, bytes], int] = {}
        windows: list[np.ndarray] = []
        for p in cut(table):
            at, where = look.find(p.anchor)
            for k in at[many[where] == 0].tolist():
                a = int(p.start[k])
                piece = (int(p.anchor[k]), p.data[a : a + int(p.windows[k]) + length - 1].tobytes())
                held[piece] = held.get(piece, 0) + 1
            busy = at[many[where] == 1]
            if len(busy):
                k = p.windows[busy]
                start = np.repeat(p.start[busy], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                windows.append(np.stack([p.roll.at(start, length), Rolling(p.data, 12).at(start, length)], axis=1))
        names = ["shard", "block", "k0", "k1", "several", "text"]
        pack = zstandard.ZstdCompressor(level=1)
        anchors = np.array([a for a, _ in held], dtype=np.uint64)
        raw = [t for _, t in held]
        count = np.array(list(held.values()), dtype=np.int64)
        shard = shard_of(anchors)
        order = np.argsort(shard, kind="stable")
        out = deal(shard, sender(table), [anchors, np.array([len(t) for t in raw], dtype=np.uint64), (count > 1).astype(U8)],
                   names[:-1])
        first = np.r_[runs(shard[order]), len(order)].tolist()
        texts = [pack.compress(b"".join(raw[i] for i in order[a:b])) for a, b in zip(first, first[1:], strict=False)]
        out = out.append_column("text", pa.array(texts, pa.binary()))
        if windows:
            got = np.concatenate(windows)
            got = got[np.lexsort((got[:, 1], got[:, 0]))]
            begin = runs(got)
            several = (np.diff(np.r_[begin, len(got)]) > 1).astype(U8)
            more = deal(shard_of(got[begin, 0]), sender(table), [got[begin, 0], got[begin, 1], several], names[:-1])
            out = pa.concat_tables([out, more.append_column("text", pa.nulls(len(more), pa.binary()))])
        return out

    def repeated_windows(table: pa.Table) -> pa.Table:
        """Answers ``(block, shard, piece, runs)``: a piece's 128-bit hash with its repeated windows, or (no runs) windows."""
        whole = np.array(table.column("text").is_valid().to_pylist(), dtype=bool)
        shard = table.column("shard")[0].as_py()
        pieces, loose = table.filter(pa.array(whole)), table.filter(pa.array(~whole))
        out = [_piece_answers(pieces, shard, length, bin_bytes)]
        if len(loose):
            k0, row = unpack(loose.column("k0"), U64)
            keys = np.stack([k0, unpack(loose.column("k1"), U64)[0]], axis=1)
            several, block = unpack(loose.column("several"), U8)[0], longs(loose.column("block"))[row]
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            keys, several, block = keys[order], several[order], block[order]
            first = runs(keys)
            size = np.diff(np.r_[first, len(keys)])
            wide = np.repeat((size > 1) | (np.maximum.reduceat(several, first) > 0), size)
            none = np.zeros(int(wide.sum()), np.int32)
            out.append(deal(block[wide], shard, [keys[wide, 0], keys[wide, 1], none, none], ANSWER))
        return pa.concat_tables(out)

    def strip(table: pa.Table, told: pa.Table) -> pa.Table:
        k0, k1, at, count = (unpack(told.column(c), t)[0] for c, t in zip(ANSWER[2:], (U64, U64, I32, I32), strict=True))
        look = _Answers(k0[count > 0], k1[count > 0], at[count > 0], count[count > 0])
        loose = _Answers(k0[count == 0], k1[count == 0], at[count == 0], count[count == 0])
        out: list[tuple[int, int, int, bytes]] = []
        for p in cut(table):
            gone = np.zeros(len(p.data) + 1, dtype=np.int32)

            def cover(start: np.ndarray, more: np.ndarray, gone: np.ndarray = gone) -> None:
                np.add.at(gone, start, 1)
                np.add.at(gone, start + more + length - 1, -1)

            if len(look.k0) and len(p.start):
                piece, where = look.find(*p.keys())
                cover(p.start[piece] + look.at[where], look.count[where].astype(np.int64))
            if len(loose.k0) and len(p.start):
                start = np.flatnonzero(p.whole)
                hit, _ = loose.find(p.roll.at(start, length), Rolling(p.data, 12).at(start, length))
                cover(start[hit], np.ones(len(hit), np.int64))
            keep = np.cumsum(gone[:-1]) == 0
            for a, b in zip(p.off.tolist(), p.off.tolist()[1:], strict=False):
                mine = keep[a:b]
                kept = p.data[a:b]
                spans = 0
                if not mine.all():
                    spans = int((~mine[1:] & mine[:-1]).sum()) + int(not mine[0])
                    kept = kept[mine]
                out.append((b - a, b - a - len(kept), spans, kept.tobytes()))
        columns = [null_ids(longs(table.column("id")))]
        columns += [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
        columns.append(pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string()))
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if keep_text:
            columns.append(pa.array([x[3] for x in out], pa.binary()))
            names.append("kept_bytes")
        return pa.table(columns, names=names)

    sent = blocks.applyInArrow(send_anchors, "shard long, block long, k0 binary, several binary, pieces binary")
    told = sent.groupBy("shard").applyInArrow(repeated_anchors, "block long, shard long, k0 binary, hot binary")
    moved = blocks.cogroup(told.groupBy("block")).applyInArrow(
        send_pieces, "shard long, block long, k0 binary, k1 binary, several binary, text binary"
    )
    answers = moved.groupBy("shard").applyInArrow(
        repeated_windows, "block long, shard long, k0 binary, k1 binary, at binary, count binary"
    )
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out = blocks.cogroup(answers.groupBy("block")).applyInArrow(strip, schema + (", kept_bytes binary" if keep_text else ""))
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


ANSWER = ["block", "shard", "k0", "k1", "at", "count"]


class _Answers:
    """Answers of all shards to one block, found by a 128-bit hash; one hash may have several answers."""

    def __init__(self, k0: np.ndarray, k1: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        order = np.argsort(k0, kind="stable")
        self.k0, self.k1, self.at, self.count = k0[order], k1[order], at[order], count[order]
        self.look = Lookup(self.k0)

    def find(self, h0: np.ndarray, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        item, where = self.look.find(h0)
        end = np.searchsorted(self.k0, h0[item], "right")
        size = end - where
        place = np.repeat(where, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        item = np.repeat(item, size)
        hit = self.k1[place] == h1[item]
        return item[hit], place[hit]


def _piece_answers(table: pa.Table, shard: int, length: int, bin_bytes: int) -> pa.Table:
    unzip = zstandard.ZstdDecompressor()
    anchors, row = unpack(table.column("k0"), U64)
    sizes, several = unpack(table.column("k1"), U64)[0].astype(np.int64), unpack(table.column("several"), U8)[0]
    block = longs(table.column("block"))[row]
    raw = b"".join(unzip.decompress(x) for x in table.column("text").to_pylist())
    ends = np.cumsum(sizes)
    holders: dict[tuple[int, bytes], list[int]] = {}  # of each different piece: blocks, twice if it is twice in one
    for a, i, j, b, twice in zip(anchors.tolist(), (ends - sizes).tolist(), ends.tolist(), block.tolist(), several.tolist(),
                                 strict=True):
        holders.setdefault((a, raw[i:j]), []).extend([b, b] if twice else [b])
    groups: dict[int, list[bytes]] = {}
    for a, t in holders:
        groups.setdefault(a, []).append(t)
    found: dict[tuple[int, bytes], np.ndarray] = {}
    open_groups = []
    for a, members in groups.items():
        if len(members) == 1 and len(holders[a, members[0]]) > 1:
            found[a, members[0]] = np.arange(len(members[0]) - length + 1)
        else:
            open_groups.append(a)
    weight = np.array([sum(map(len, groups[a])) for a in open_groups], dtype=np.int64)
    for i, j in bins(weight, bin_bytes):
        members = [(a, t) for a in open_groups[i:j] for t in groups[a]]
        for key, places in zip(members, repeated_starts([t for _, t in members], length), strict=True):
            found[key] = np.arange(len(key[1]) - length + 1) if len(holders[key]) > 1 else places
    pieces = [k for k, places in found.items() if len(places)]
    data = np.frombuffer(b"".join(t for _, t in pieces), np.uint8)
    n = np.array([len(t) for _, t in pieces], dtype=np.int64)
    start = np.cumsum(n) - n
    h0 = Rolling(data, 11).at(start, n) + n.astype(np.uint64) if len(pieces) else np.zeros(0, np.uint64)
    h1 = Rolling(data, 12).at(start, n) + n.astype(np.uint64) if len(pieces) else np.zeros(0, np.uint64)
    out_block, out_piece, out_runs = [], [], []
    for k, key in enumerate(pieces):
        spans = as_runs(found[key])
        for b in set(holders[key]):
            out_block.append(np.full(len(spans), b))
            out_piece.append(np.full(len(spans), k))
            out_runs.append(spans)
    if not out_block:
        empty = np.zeros(0, np.uint64)
        return deal(np.zeros(0, np.int64), shard, [empty, empty, np.zeros(0, np.int32), np.zeros(0, np.int32)], ANSWER)
    to, piece, spans = np.concatenate(out_block), np.concatenate(out_piece), np.concatenate(out_runs)
    return deal(to, shard, [h0[piece], h1[piece], spans[:, 0], spans[:, 1]], ANSWER)
