"""Audit of how sources diverge within a language, by recounting terms through sharded minimal perfect hashes.

First pass: in how many documents of its language each term stands, counted exactly; terms in at least ``min_docs``
stay. They are dealt to shards of about ``shard_terms`` terms, and a task per shard builds a minimal perfect hash that
stores its keys. Second pass: the shards are broadcast, and each task looks its terms up and increments dense slots per
(language, source), which leave as packed counts. A reducer per shard turns the counts of all sources into fixed-point
frequencies and their differences.

What is broadcast grows with the vocabulary, so its size is measured: shards go out in as many rounds as keep each below
``broadcast_bytes``, with one reading of the texts per round. Dense slots of a task are flushed beyond ``slot_bytes``.
A reducer holds one shard for all sources of a language, ``cells`` counts at most (or one slot per source).

All arithmetic is on integers. A frequency is ``1 + floor(10**9 * (count + 2) / (N + 2 * V))``, a difference
``floor((p - q)**2 / (p + q))``; totals N may reach 9 * 10**15.

Defined results: null texts, languages and sources count as empty strings; a text without a term still makes its
(language, source) occur; a language without a kept term has pairs of value 0 and no terms; repeated rows are documents
of their own; ties are ordered by the item's UTF-8 bytes; an empty table gives an empty result; other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.scale import round_table

from .perfect_hash import PerfectHash, key_hashes
from .textvec import release, slices, text_bytes

DEAL = 77  # seed of the hash that deals terms to shards
#: bytes of a term: letters A-Z and a-z and everything that is not ASCII
TERM = np.zeros(256, dtype=bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, A-Z lower-cased, and each text's bounds among them."""
    inside = TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    packed = pa.py_buffer(LOWER[data[inside]].tobytes())
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.tobytes()), packed])
    return found, np.searchsorted(start, off)


def coded(batch: pa.RecordBatch) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, pa.Array]]:
    """Slices of a batch ``(lang, source, text)``: their rows, and of every term its row and its place among the
    slice's distinct terms."""
    data, off = text_bytes(batch.column("text"))
    for i, j in slices(off, 4_000_000):
        part = off[i : j + 1]
        found, bounds = terms(data[part[0] : part[-1]], part - part[0])
        kinds = found.dictionary_encode()
        row = np.repeat(np.arange(j - i), np.diff(bounds))
        yield pa.Table.from_batches([batch.slice(i, j - i)]), row, kinds.indices.to_numpy(), kinds.dictionary


def group_codes(rows: pa.Table, names: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """Number of every row's group and the groups."""
    seen: dict[tuple, int] = {}
    codes = [seen.setdefault(g, len(seen)) for g in zip(*(rows[c].to_pylist() for c in names), strict=True)]
    return np.array(codes, np.int64), list(seen)


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, term, docs)``: in how many documents of a slice a term stands."""
    for b in batches:
        for rows, row, code, kinds in coded(b):
            group, langs = group_codes(rows, ["lang"])
            once = np.unique(row * len(kinds) + code) if len(kinds) else np.zeros(0, np.int64)
            pair = group[once // max(1, len(kinds))] * len(kinds) + once % max(1, len(kinds))
            pair, n = np.unique(pair, return_counts=True)
            lang = pa.array([x[0] for x in langs], pa.string()).take(pa.array(pair // max(1, len(kinds))))
            term = kinds.cast(pa.binary()).take(pa.array(pair % max(1, len(kinds))))
            yield pa.RecordBatch.from_arrays([lang, term, pa.array(n, pa.int64())], ["lang", "term", "docs"])
        release()


def kept_terms(rows: DataFrame, min_docs: int) -> DataFrame:
    """``(lang, term)`` of the terms in at least ``min_docs`` documents of their language."""
    counts = rows.select("lang", "text").mapInArrow(document_counts, "lang string, term binary, docs long")
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")


def deal_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, term, many)`` with the shard, of ``many``, that holds the term."""
    for b in batches:
        shard = key_hashes(b.column("term"), DEAL) % b.column("many").to_numpy().astype(np.uint64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard.astype(np.int64))], [*b.schema.names, "shard"])


def build_shard(table: pa.Table) -> pa.Table:
    made = PerfectHash.build(table["term"].combine_chunks()).dump()
    fixed = {c: table[c][:1] for c in ("lang", "shard", "many")}
    return pa.table(fixed | {k: pa.array([v], pa.int64() if k == "seed" else pa.binary()) for k, v in made.items()})


def recount(rows: DataFrame, shards: list, slot_bytes: int) -> DataFrame:
    """``(lang, shard, source, slots, counts, total)``: packed counts of the terms of the given shards."""
    shared = rows.sparkSession.sparkContext.broadcast([tuple(bytes(x) if isinstance(x, bytearray) else x for x in s) for s in shards])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, list[tuple[int, PerfectHash]]] = {}
        many: dict[str, int] = {}
        for lang, shard, n, *parts in shared.value:
            tables.setdefault(lang, []).append((shard, PerfectHash.load(*parts)))
            many[lang] = n
        start = {lang: np.concatenate([[0], np.cumsum([len(h.keys) for _, h in held])]) for lang, held in tables.items()}
        dense: dict[tuple[str, str], np.ndarray] = {}

        def look_up(lang: str, kinds: pa.Array, dealt: np.ndarray) -> np.ndarray:
            """Dense slot of every term in its language, -1 for terms of no shard at hand."""
            out, shard = np.full(len(kinds), -1, np.int64), (dealt % np.uint64(many[lang])).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for k, (number, held) in enumerate(tables[lang]):
                own = order[slice(*np.searchsorted(shard[order], [number, number + 1]))]
                at = held.find(kinds.take(pa.array(own)))
                out[own] = np.where(at >= 0, at + start[lang][k], -1)
            return out

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                for k, (shard, _) in enumerate(tables[lang]):
                    own = counts[start[lang][k] : start[lang][k + 1]]
                    at = np.flatnonzero(own)
                    if len(at):
                        yield pa.RecordBatch.from_pydict({
                            "lang": [lang], "shard": [shard], "source": [source], "slots": [at.astype("<i4").tobytes()],
                            "counts": [own[at].astype("<i8").tobytes()], "total": [int(own.sum())],
                        })
            dense.clear()

        for b in batches:
            for part, row, code, kinds in coded(b):
                group, names = group_codes(part, ["lang", "source"])
                of_term = group[row]
                order = np.argsort(of_term, kind="stable")
                cuts = np.searchsorted(of_term[order], np.arange(len(names) + 1))
                slot: dict[str, np.ndarray] = {}
                dealt = key_hashes(kinds, DEAL)
                for g, (lang, source) in enumerate(names):
                    if lang not in tables:
                        continue
                    if lang not in slot:  # each distinct term of the slice is looked up once per language
                        slot[lang] = look_up(lang, kinds, dealt)
                    found = slot[lang][code[order[cuts[g] : cuts[g + 1]]]]
                    found = found[found >= 0]
                    if (lang, source) not in dense:
                        if sum(x.nbytes for x in dense.values()) + 8 * start[lang][-1] > slot_bytes:
                            yield from flush()
                        dense[lang, source] = np.zeros(start[lang][-1], np.int64)
                    if len(found):
                        hit, n = np.unique(found, return_counts=True)
                        dense[lang, source][hit] += n
        yield from flush()
        release()

    return rows.mapInArrow(run, "lang string, shard long, source string, slots binary, counts binary, total long")


def frequency(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """Fixed-point frequencies, three digits at a time, so that no product passes 63 bits."""
    under = total + 2 * terms
    out, rest = np.zeros(np.broadcast(counts, under).shape, np.int64), counts + 2
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, under)
        out = out * 1000 + more
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def compare(ranks: int):
    """Reducer of one shard of a language: partial sums per pair of sources, leading terms per source."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        info = told.slice(0, 1).to_pylist()[0]
        held = PerfectHash.load(*(info[c] for c in ("seed", "sizes", "bits", "ends", "data")))
        names, totals, kept = [s["source"] for s in info["sources"]], info["sources"], info["terms"]
        total = np.array([s["total"] for s in totals], np.int64)
        place = {s: i for i, s in enumerate(names)}
        counts = np.zeros((len(names), len(held.keys)), np.int64)
        for r in table.select(["source", "slots", "counts"]).to_batches():
            for source, slots, n in zip(*(r.column(i).to_pylist() for i in range(3)), strict=True):
                counts[place[source], np.frombuffer(slots, "<i4")] += np.frombuffer(n, "<i8")
        p = frequency(counts, total[:, None], kept)
        q = frequency(counts.sum(axis=0), total.sum(), kept)
        out: list[tuple] = []
        for i, s in enumerate(names):
            for j in range(i):
                f = int(difference(p[i], p[j]).sum())
                out += [(s, "pair", names[j].encode(), f), (names[j], "pair", s.encode(), f)]
            at = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            f = difference(p[i][at], q[at])
            if len(at) > ranks:  # all that reach the last rank's value
                keep = f >= np.partition(f, len(f) - ranks)[len(f) - ranks]
                at, f = at[keep], f[keep]
            first = sorted(zip((-f).tolist(), held.keys.take(pa.array(at)).to_pylist(), strict=True))[:ranks]
            out += [(s, "term", t, -v) for v, t in first]
        cols = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64())
        return pa.table([pa.array([info["lang"]] * len(out), pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                        names=["lang", "source", "part", "item", "value"])

    return run


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = 10,
    ranks: int = 10,
    shard_terms: int = 8192,
    cells: int = 4_000_000,
    broadcast_bytes: int = 64 << 20,
    slot_bytes: int = 128 << 20,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: every other source of the language with its divergence (``pair``),
    and the ``ranks`` terms by which a source stands out from its language (``term``)."""
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                         for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    kept = round_table(kept_terms(rows, min_docs))
    groups = round_table(rows.select("lang", "source").distinct())
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    wide = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("wide"))
    by_shard = F.greatest(F.lit(1), F.least(F.lit(shard_terms), F.floor(F.lit(cells) / F.col("wide"))))
    many = sizes.join(wide, "lang").select("lang", "terms", F.ceil(F.col("terms") / by_shard).alias("many"))
    dealt = kept.join(many, "lang").select("lang", "term", "many").mapInArrow(
        deal_terms, "lang string, term binary, many long, shard long"
    )
    # the join's partitioning by language would satisfy the grouping, with a whole language in one task
    shards = round_table(dealt.repartition("lang", "shard").groupBy("lang", "shard").applyInArrow(
        build_shard, "lang string, shard long, many long, seed long, sizes binary, bits binary, ends binary, data binary"
    ))
    parts = ["lang", "shard", "many", "seed", "sizes", "bits", "ends", "data"]
    weight = sum(F.octet_length(c) for c in parts[4:])
    total = shards.agg(F.sum(weight).alias("b")).first()["b"] or 0
    rounds = -(-total // broadcast_bytes)
    counts = None
    for r in range(rounds):
        mine = shards.where(F.pmod(F.xxhash64("lang", "shard"), F.lit(rounds)) == r)
        found = recount(rows, mine.select(*parts).collect(), slot_bytes)  # measured: about ``broadcast_bytes``
        counts = found if counts is None else counts.unionByName(found)
    empty = docs.sparkSession.createDataFrame([], "lang string, shard long, source string, slots binary, counts binary, total long")
    counts = round_table(empty if counts is None else counts)
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    listed = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("sources")
    )
    told = shards.join(listed, "lang").join(sizes, "lang").repartition("lang", "shard")
    found = round_table(counts.groupBy("lang", "shard").cogroup(told.groupBy("lang", "shard")).applyInArrow(
        compare(ranks), "lang string, source string, part string, item binary, value long"
    ))
    summed = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("other"))
    pairs = groups.join(other, "lang").where("source <> other").select("lang", "source", F.encode("other", "utf-8").alias("item"))
    pairs = pairs.join(summed, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= ranks)).select(
        "lang", "source", "part", F.decode("item", "utf-8").alias("item"), "value", "rank"
    )
