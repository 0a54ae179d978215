"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. Blocks of documents send their distinct shingles (``words`` words; a shorter text is one shingle) to shards, which
   add up document frequencies over all documents and answer those above 1. Equal word sequences meet the same way:
   the smallest id stands for its copies from here on.
2. A shingle weighs ``tf * (1 + damp * ln(N / df) / ln N)``. The idf part is damped, because a copy's few edits are the
   rarest shingles there are and would outweigh all that the copies share. A text whose shingles of frequency 1 weigh
   more than ``1 - threshold`` of it cannot reach the threshold with any other text and goes no further (exact).
3. The others are sketched with ``bands * rows`` ICWS samples. Shingles of frequency 1 match nobody, so their samples
   are drawn at once: the smallest of their exponential marks is exponential in their total weight. Two texts agree in
   a sample with probability equal to their weighted Jaccard similarity; at 0.8 a pair shares no band with
   probability 3e-6.
4. In every bucket all texts are compared with its pivot, by their exact weighted Jaccard similarity. The pivot is the
   text with the most common shingles: in a group of edited copies that is the text they were copied from. Verified
   links are joined to components. In buckets that still hold several components, pairs across components are
   compared too, but for those that an exact bound excludes; so no link inside a bucket is lost, and a bucket of near
   copies does not make all its pairs.

Comparison moves the pivots' features to the blocks of the texts compared with them, once per block.

Defined results: texts without words are classes of their own, null texts too; rows without an id are not compared
(``class_id`` null, ``kept`` true); rows of one id are one document; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.operators.graph import connected_components
from urbanloom.scale import round_table

from .blocks import I32, I64, U64, block_table, deal, fresh, longs, runs, tidy, unpack
from .substring_dedup import Words
from .textvec import mix, range_hashes, window_hashes

LOG = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)  # exponential quantiles, by 16 random bits


class Shingles:
    """Distinct shingles of every text of a block, sorted by text and hash, with their counts."""

    def __init__(self, table: pa.Table, words: int, bits: int) -> None:
        w = Words(table)
        self.ids, self.first, self.count = w.ids, w.first, w.count
        at = np.flatnonzero(w.left >= words)
        short = np.flatnonzero((w.count > 0) & (w.count < words))
        self.whole = [range_hashes(w.hash, w.first[:-1], w.first[1:], s) for s in (6, 7)]
        doc = np.concatenate([w.doc[at], short])
        keys = np.concatenate([window_hashes(w.hash, words, seed=8)[at] if len(at) else np.zeros(0, np.uint64),
                               self.whole[0][short]]) >> np.uint64(64 - bits)
        order = np.lexsort((keys, doc))
        doc, keys = doc[order], keys[order]
        begin = runs(np.stack([doc.astype(np.uint64), keys], axis=1))
        self.doc, self.key = doc[begin], keys[begin]
        self.tf = np.diff(np.r_[begin, len(doc)])
        self.bounds = np.searchsorted(self.doc, np.arange(len(self.ids) + 1))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of the block, in how many texts each stands, and each entry's place among them."""
        keys, place, df = np.unique(self.key, return_inverse=True, return_counts=True)
        return keys, df, place


def samples(key: np.ndarray, log_weight: np.ndarray, starts: np.ndarray, private: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    """``n`` ICWS samples of every text (rows). ``starts`` are the texts' first entries in ``key`` (each has one at
    least); ``private`` is the weight that no other text shares and ``seed`` a number of the text's own."""
    out = np.empty((len(starts), n), dtype=np.uint64)
    size = np.diff(np.r_[starts, len(key)])
    with np.errstate(divide="ignore"):
        log_private = np.log(private)
    low = np.uint64(0xFFFF)
    for k in range(n):
        x = mix(key + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
        r = LOG[x & low] + LOG[(x >> np.uint64(16)) & low]
        c = LOG[(x >> np.uint64(32)) & low] + LOG[x >> np.uint64(48)]
        beta = ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_weight / r + beta)
        mark = np.log(c) - r * (t - beta + 1)
        least = np.minimum.reduceat(mark, starts)
        hit = np.flatnonzero(mark == np.repeat(least, size))
        hit = hit[np.searchsorted(hit, starts)]  # the first of equals
        drawn = mix(key[hit] ^ mix(t[hit].astype(np.int64).astype(np.uint64) + np.uint64(k + 1)))
        own = mix(seed + np.uint64(k + 1))
        u = ((own >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        out[:, k] = np.where(np.log(-np.log(u)) - log_private < least, mix(own), drawn)
    return out


def _pack(key: np.ndarray, weight: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(key.astype("<u8").tobytes() + weight.astype("<f4").tobytes())


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n = len(data) // 12
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<f4", n, 8 * n)


def sketch(
    docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float, damp: float, bands: int, rows: int
) -> DataFrame:
    """Table ``(id, rep, total, features, bands)``: a row per document. ``rep`` is the smallest id with the same words;
    features (packed shared shingles and weights) and bands stand only where ``id`` is ``rep`` and links are possible."""
    docs = docs.where(F.col(id_col).isNotNull())
    texts, n = block_table(docs, id_col, text_col)
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col))).alias("b")).first()
    many = max(2, total["n"])
    # 20 bits more than it takes to number all shingles; low 32 bits are sent as they are, the rest as counts
    bits = min(64, max(40, 20 + math.ceil(math.log2(max(2, total["b"] or 0)))))
    high = bits - 32
    blocks = texts.groupBy("block")
    fields = ["shard", "block", "low", "high", "df", "e0", "e1", "eid"]

    def shard_bounds(keys: np.ndarray) -> np.ndarray:
        """First key of each shard among sorted keys; shards are ranges of the high part."""
        edge = np.array([-(-(s << high) // n) for s in range(n + 1)], dtype=object)
        return np.searchsorted(keys >> np.uint64(32), edge.astype(np.uint64))

    def send(table: pa.Table) -> pa.Table:
        s = Shingles(table, words, bits)
        keys, df, _ = s.distinct()
        cuts = shard_bounds(keys)
        block = table.column("block")[0].as_py()
        out: list[list] = [[] for _ in range(5)]
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            part = keys[cuts[shard] : cuts[shard + 1]]
            base = -(-(shard << high) // n)
            top = (part >> np.uint64(32)).astype(np.int64) - base
            for column, value in zip(out, (shard, block, part.astype("<u4").tobytes(), np.bincount(top).astype("<u4").tobytes(),
                                           df[cuts[shard] : cuts[shard + 1]].astype(I32).tobytes()), strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]
        plain = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)] + [pa.nulls(len(out[0]), pa.binary())] * 3
        keep = np.flatnonzero(s.count > 0)
        e = np.stack([s.whole[0][keep], s.whole[1][keep]], axis=1)
        order = np.lexsort((s.ids[keep], e[:, 1], e[:, 0]))
        e, ids = e[order], s.ids[keep][order]
        begin = runs(e)
        same = deal((e[begin, 0] % np.uint64(n)).astype(np.int64), block, [e[begin, 0], e[begin, 1], ids[begin]],
                    ["shard", "block", "e0", "e1", "eid"])
        for name in ("low", "high", "df"):
            same = same.append_column(name, pa.nulls(len(same), pa.binary()))
        return pa.concat_tables([pa.table(plain, names=fields), same.select(fields)])

    def answer(table: pa.Table) -> pa.Table:
        """``(block, shard, place, df)``: places in the list the block sent, or ``(.., e0, e1, eid)``."""
        shard = table.column("shard")[0].as_py()
        valid = np.array(table.column("low").is_valid().to_pylist(), dtype=bool)
        counts, copies = table.filter(pa.array(valid)), table.filter(pa.array(~valid))
        names = ["block", "shard", "place", "df", "e0", "e1", "eid"]
        parts = []
        if len(counts):
            low, row = unpack(counts.column("low"), np.dtype("<u4"))
            tops, places = [], []
            for raw in counts.column("high").to_pylist():
                c = np.frombuffer(raw, "<u4")
                tops.append(np.repeat(np.arange(len(c)), c))
                places.append(np.arange(c.sum()))
            key = (np.concatenate(tops).astype(np.uint64) << np.uint64(32)) | low
            place, df = np.concatenate(places).astype(I32), unpack(counts.column("df"), I32)[0].astype(np.int64)
            block = longs(counts.column("block"))[row]
            order = np.argsort(key, kind="stable")
            key, place, df, block = key[order], place[order], df[order], block[order]
            begin = runs(key)
            size = np.diff(np.r_[begin, len(key)])
            df = np.repeat(np.add.reduceat(df, begin), size)
            told = df > 1
            order = np.lexsort((place[told], block[told]))
            got = deal(block[told][order], shard, [place[told][order], df[told][order]], names[:4])
            for name in names[4:]:
                got = got.append_column(name, pa.nulls(len(got), pa.binary()))
            parts.append(got)
        if len(copies):
            e0, row = unpack(copies.column("e0"), U64)
            e = np.stack([e0, unpack(copies.column("e1"), U64)[0]], axis=1)
            ids, block = unpack(copies.column("eid"), I64)[0], longs(copies.column("block"))[row]
            order = np.lexsort((ids, e[:, 1], e[:, 0]))
            e, ids, block = e[order], ids[order], block[order]
            begin = runs(e)
            least = np.repeat(ids[begin], np.diff(np.r_[begin, len(e)]))
            told = least != ids
            got = deal(block[told], shard, [e[told, 0], e[told, 1], least[told]], ["block", "shard", "e0", "e1", "eid"])
            for name in ("place", "df"):
                got = got.append_column(name, pa.nulls(len(got), pa.binary()))
            parts.append(got.select(names))
        return pa.concat_tables(parts)

    def draw(table: pa.Table, told: pa.Table) -> pa.Table:
        s = Shingles(table, words, bits)
        keys, _, place = s.distinct()
        df = np.ones(len(keys), dtype=np.int64)
        cuts = shard_bounds(keys)
        least: dict[tuple[int, int], int] = {}
        for r in told.to_pylist():
            if r["place"] is not None:
                df[cuts[r["shard"]] + np.frombuffer(r["place"], I32)] = np.frombuffer(r["df"], I64)
            else:
                e = [np.frombuffer(r[c], t).tolist() for c, t in (("e0", U64), ("e1", U64), ("eid", I64))]
                least.update({(a, b): c for a, b, c in zip(*e, strict=True)})
        here: dict[tuple[int, int], int] = {}  # copies within the block
        whole = list(zip(s.whole[0].tolist(), s.whole[1].tolist(), strict=True))
        for e, i, c in zip(whole, s.ids.tolist(), s.count.tolist(), strict=True):
            if c:
                here[e] = min(here.get(e, i), i)
        rep = np.array([least.get(e, here[e]) if c else i for e, i, c in zip(whole, s.ids.tolist(), s.count.tolist(), strict=True)],
                       dtype=np.int64)
        freq = df[place]
        weight = s.tf * (1 + damp * np.log(many / freq) / math.log(many))
        shared = freq > 1
        sums = np.zeros((len(s.key) + 1, 2))
        np.cumsum(np.stack([weight, weight * shared], axis=1), axis=0, out=sums[1:])
        mass = sums[s.bounds[1:]] - sums[s.bounds[:-1]]
        able = (rep == s.ids) & (mass[:, 1] > 0) & (mass[:, 1] >= threshold * mass[:, 0] * (1 - 1e-9))
        take = np.flatnonzero(shared & able[s.doc])
        chosen = np.flatnonzero(able)
        starts = np.searchsorted(s.doc[take], chosen)
        ends = np.r_[starts[1:], len(take)]
        # shared weight by 64 buckets of shingles: bounds from above what two texts share
        spread = np.zeros((len(s.ids), 64))
        np.add.at(spread, (s.doc[take], (s.key[take] & np.uint64(63)).astype(np.int64)), weight[take])
        features: list[bytes | None] = [None] * len(s.ids)
        marks: list[bytes | None] = [None] * len(s.ids)
        if len(chosen):
            got = samples(s.key[take], np.log(weight[take]).astype(np.float32), starts,
                          np.maximum(0, mass[chosen, 0] - mass[chosen, 1]), s.whole[0][chosen] ^ s.whole[1][chosen], bands * rows)
            band = range_hashes(got.ravel(), np.arange(0, got.size, rows), np.arange(rows, got.size + 1, rows), 9)
            band = (band + np.tile(np.arange(bands, dtype=np.uint64), len(chosen))).reshape(-1, bands)
            for k, (i, a, b) in enumerate(zip(chosen.tolist(), starts.tolist(), ends.tolist(), strict=True)):
                features[i] = _pack(s.key[take[a:b]], weight[take[a:b]])
                marks[i] = band[k].astype(U64).tobytes()
        # how common a text's shingles are: highest for what many others were copied from
        sums[1:, 0] = np.cumsum(weight * np.log(freq))
        centre = (sums[s.bounds[1:], 0] - sums[s.bounds[:-1], 0]) / np.maximum(mass[:, 0], 1e-9)
        return pa.table({"id": pa.array(s.ids), "rep": pa.array(rep), "total": pa.array(mass[:, 0]),
                         "shared": pa.array(mass[:, 1]), "centre": pa.array(centre),
                         "spread": pa.array([list(r) if a else None for r, a in zip(spread, able, strict=True)], pa.list_(pa.float64())),
                         "features": pa.array(features, pa.binary()), "bands": pa.array(marks, pa.binary())})

    sent = blocks.applyInArrow(
        tidy(send), "shard long, block long, low binary, high binary, df binary, e0 binary, e1 binary, eid binary")
    told = sent.groupBy("shard").applyInArrow(
        tidy(answer), "block long, shard long, place binary, df binary, e0 binary, e1 binary, eid binary")
    out = blocks.cogroup(told.groupBy("block")).applyInArrow(
        tidy(draw), "id long, rep long, total double, shared double, centre double, spread array<double>, features binary, bands binary")
    return round_table(out)


def compared(pairs: DataFrame, table: DataFrame, threshold: float, groups: int) -> DataFrame:
    """``(src, dst, common, linked)`` of ``pairs``: the weight both share, and whether their weighted Jaccard similarity
    reaches the threshold.

    The features of each ``src`` go once to every block that holds one of its partners.
    """
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("long").alias("block")
    held = table.where("features is not null").select("id", "total", "features")
    wanted = pairs.select(block("dst"), "src", "dst")
    sent = wanted.select("block", "src").distinct().join(held, F.col("src") == F.col("id"))
    nothing = F.lit(None)
    told = sent.select("block", "src", nothing.cast("long").alias("dst"), "total", "features").unionByName(
        wanted.select("block", "src", "dst", nothing.cast("double").alias("total"), nothing.cast("binary").alias("features"))
    )

    def compare(own: pa.Table, told: pa.Table) -> pa.Table:
        mine = {i: (t, f) for i, t, f in zip(*[own.column(c).to_pylist() for c in ("own", "sum", "held")], strict=True)}
        others, todo = {}, []
        for src, dst, total, raw in zip(*[told.column(c).to_pylist() for c in ("src", "dst", "total", "features")], strict=True):
            if dst is None:
                others[src] = (total, *_unpack(raw))
            else:
                todo.append((src, dst))
        todo.sort(key=lambda p: p[1])
        found, last, opened = [], None, None
        for src, dst in todo:
            if dst not in mine or src not in others:
                continue
            if dst != last:
                total, raw = mine[dst]
                last, opened = dst, (total, *_unpack(raw))
            (ta, ka, wa), (tb, kb, wb) = others[src], opened
            at = np.minimum(np.searchsorted(ka, kb), len(ka) - 1)
            hit = ka[at] == kb
            common = float(np.minimum(wa[at[hit]], wb[hit]).sum(dtype=np.float64))
            found.append((src, dst, common, common >= threshold * (ta + tb - common) * (1 - 1e-6)))
        columns = list(zip(*found, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["src", "dst", "common", "linked"])

    mine = held.select(block("id"), F.col("id").alias("own"), F.col("total").alias("sum"), F.col("features").alias("held"))
    return mine.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        tidy(compare), "src long, dst long, common double, linked boolean")


def _open_pairs(named: DataFrame, scored: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(src, dst)`` of buckets' members (``band, id, pivot, component``) that may still link two components.

    What two texts share lies in their pivot or outside it, so its weight is at most the smaller weight shared with
    the pivot plus the smaller shared weight outside it; nor is it more than the smaller weights of 64 buckets of
    shingles add up to. Pairs whose bound misses the threshold are no links (exact);
    that leaves out nearly all pairs of a group of copies, whose texts agree only where they agree with the pivot.
    """
    masses = table.where("features is not null").select(F.col("id").alias("mid"), "total", "shared", F.col("bands").alias("all"), "spread")
    common = scored.select(F.col("src").alias("cs"), F.col("dst").alias("cd"), "common")
    rows = named.join(masses, F.col("id") == F.col("mid")).join(
        common, (F.col("pivot") == F.col("cs")) & (F.col("id") == F.col("cd")), "left"
    ).select("band", "id", "pivot", "component", "total", F.coalesce("common", "shared").alias("inner"),
             (F.col("shared") - F.coalesce("common", "shared")).alias("outer"), "all", "spread")
    rows = round_table(rows)
    sizes = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("low"))
    largest = sizes.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.min("low").alias("low"))
    marked = rows.join(largest, "band")
    part = threshold / (1 + threshold) * (1 - 1e-6)  # of both totals, that a link must share
    x = marked.where(
        (F.col("component") != F.col("main")) & (F.col("inner") + F.col("outer") >= part * (F.col("total") + F.greatest("low", threshold * F.col("total"))))
    ).select("band", F.col("id").alias("x"), F.col("component").alias("xc"), F.col("inner").alias("xi"), F.col("outer").alias("xo"), F.col("total").alias("xt"), F.col("all").alias("xb"), F.col("spread").alias("xs"))
    y = marked.select("band", F.col("id").alias("y"), F.col("component").alias("yc"), "main", F.col("inner").alias("yi"),
                      F.col("outer").alias("yo"), F.col("total").alias("yt"), F.col("all").alias("yb"), F.col("spread").alias("ys"))
    needed = part * (F.col("xt") + F.col("yt"))
    most = F.aggregate(F.zip_with("xs", "ys", lambda a, b: F.least(a, b)), F.lit(0.0), lambda a, b: a + b)
    bound = F.when(F.least("xi", "yi") + F.least("xo", "yo") >= needed, most >= needed).otherwise(F.lit(False))
    once = (F.col("yc") == F.col("main")) | (F.col("x") < F.col("y"))
    # a pair counts in the first band that both share; the others would only repeat it
    places = F.sequence(F.lit(1), F.octet_length("xb") - 7, F.lit(8))
    piece = lambda c, i: F.substring(F.col(c), i, F.lit(8))
    first = F.element_at(F.filter(places, lambda i: piece("xb", i) == piece("yb", i)), 1)
    here = piece("xb", first) == x["band"]
    cross = x.join(y, (x["band"] == y["band"]) & F.when((F.col("xc") != F.col("yc")) & once & bound, here).otherwise(F.lit(False)))
    pairs = cross.select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct()
    for done in (common.select(F.col("cs").alias("src"), F.col("cd").alias("dst")), common.select(F.col("cd").alias("src"), F.col("cs").alias("dst"))):
        pairs = pairs.join(done, ["src", "dst"], "left_anti")
    return pairs


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8,
    damp: float = 0.05, bands: int = 24, rows: int = 4,
) -> DataFrame:
    """``(id, class_id, class_size, kept)`` per row: the class is named by its smallest id, and that row is kept."""
    table = sketch(docs, id_col, text_col, words, threshold, damp, bands, rows)
    groups = max(1, table.where("features is not null").count() // 500)
    split = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.substring(F.col("bands"), i * 8 + 1, F.lit(8)))
    entries = table.where("bands is not null").select("id", "centre", F.explode(split).alias("band"))
    pivots = entries.groupBy("band").agg(F.max_by("id", F.struct("centre", "id")).alias("pivot"), F.count(F.lit(1)).alias("n"))
    full = entries.join(pivots.where("n > 1"), "band").select("band", "id", "pivot")
    bucketed = round_table(full)
    first = bucketed.where("id <> pivot").select(F.col("pivot").alias("src"), F.col("id").alias("dst")).distinct()
    scored = round_table(compared(first, table, threshold, groups))
    links = round_table(scored.where("linked").select("src", "dst"))
    parts = connected_components(links)
    # buckets in which some texts are not yet linked to each other
    named = bucketed.join(parts, bucketed["id"] == parts["node"], "left").select(
        "band", "id", "pivot", F.coalesce("component", "id").alias("component"))
    mixed = named.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    rest = _open_pairs(named.join(mixed.select("band"), "band"), scored, table, threshold)
    more = round_table(compared(rest, table, threshold, groups).where("linked").select("src", "dst"))
    if not more.isEmpty():
        parts = connected_components(round_table(links.unionByName(more)))
    found = table.select("id", "rep").join(parts, F.col("rep") == F.col("node"), "left")
    found = found.select("id", F.coalesce("component", "rep").alias("class_id"))
    sizes = found.groupBy(F.col("class_id").alias("_class")).agg(F.count(F.lit(1)).alias("class_size"))
    out = found.join(sizes, F.col("class_id") == F.col("_class")).select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "class_id", "class_size",
        (F.col("id") == F.col("class_id")).alias("kept"))
    lone = docs.where(F.col(id_col).isNull()).select(
        F.col(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(lone)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that are not kept; all columns stay, and so do rows without an id."""
    gone = fresh(docs, "gone")
    dropped = near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col(id_col).alias(gone)).distinct()
    return docs.join(dropped, docs[id_col] == dropped[gone], "left_anti")
