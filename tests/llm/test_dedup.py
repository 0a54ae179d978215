"""Exact, substring, suffix-array and near-duplicates against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from cases import WORD, texts
from pyspark.sql import functions as F

from urbanloom.llm import blocks, exact_dedup, minhash, substring_dedup, suffix_dedup


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(documents, keep):
    rows = [(1, "Ab"), (2, "aB"), (3, "äB"), (4, "Äb"), (5, None), (6, ""), (7, " ab"), (8, "x" * 50_000), (9, "X" * 50_000)]
    got = by_id(exact_dedup.exact_duplicates(documents(rows), keep=keep))
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    for i, t in rows:
        mine = groups[fold(t)]
        best = max(mine) if keep == "largest" else min(mine)
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (best, len(mine), i == best)
        assert got[i]["text_sha256"] == hashlib.sha256(fold(t).encode()).hexdigest()


def test_exact_separates_colliding_hashes(documents):
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "ab", "ab", "a"])]
    got = by_id(exact_dedup.exact_duplicates(documents(rows), keep="largest", hash_fn=F.length))
    assert [got[i]["keep_id"] for i in range(7)] == [2, 1, 2, 3, 5, 5, 6]
    assert [got[i]["group_size"] for i in range(7)] == [2, 1, 2, 1, 2, 2, 1]


def test_exact_rows_repeated_or_without_id(documents):
    df = documents([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c")]).withColumn("_row", F.lit(1)).withColumn("_h", F.lit(2))
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in kept.collect()) == [(0, "b"), (1, "a"), (2, "c")]


@pytest.mark.parametrize("block_bytes", [3 << 20, 2000])
def test_word_passages(documents, monkeypatch, block_bytes):
    monkeypatch.setattr(blocks.block_table, "__defaults__", (block_bytes,))
    rows = texts(2)
    got = by_id(substring_dedup.remove_repeats(documents(rows)))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first = {}
    for i, t in order:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    removed = 0
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] != i:
                gone[k : k + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        removed += sum(gone)
        assert tuple(got[i])[1:] == (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    assert removed > 500


@pytest.mark.parametrize(("block_bytes", "hot"), [(3 << 20, 1000), (3000, 1000), (3000, 2)])
def test_byte_strings(documents, monkeypatch, block_bytes, hot):
    monkeypatch.setattr(blocks.block_table, "__defaults__", (block_bytes,))
    rows = texts(3, 40)
    got = by_id(suffix_dedup.remove_repeats(documents(rows), length=120, span=24, hot=hot))
    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(t[k : k + 120] for t in data.values() for k in range(len(t) - 119))
    for i, t in data.items():
        gone = [False] * len(t)
        for k in range(len(t) - 119):
            if seen[t[k : k + 120]] > 1:
                gone[k : k + 120] = [True] * 120
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        assert tuple(got[i])[1:] == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert any(r["n_removed"] for r in got.values())


def near_classes(rows, damp, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])
    df = Counter(k for s in sets.values() for k in s)
    idf = {k: 1 + damp * math.log(len(rows) / v) / math.log(len(rows)) for k, v in df.items()}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                low = sum(min(n, sets[b][k]) * idf[k] for k, n in sets[a].items())
                high = sum(max(sets[a][k], sets[b][k]) * idf[k] for k in sets[a] | sets[b])
                if low >= threshold * high and find(a) != find(b):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block_bytes", [3 << 20, 4000])
def test_near_duplicates(documents, monkeypatch, block_bytes):
    monkeypatch.setattr(blocks.block_table, "__defaults__", (block_bytes,))
    rows = [r for r in texts(4, 50) if r[0] is not None]
    base = ("plain text of some hundred words that is edited a little " * 12 + "tail").split()
    base = [f"{w}{k}" for k, w in enumerate(base)]
    for k in range(12):  # a chain of copies, each edited further
        base = [*base[: 9 * k], f"new{k}", *base[9 * k + 1 :]]
        rows.append((3000 + k, " ".join(base)))
    want = near_classes(rows, 0.05)
    got = by_id(minhash.near_duplicates(documents([*rows, (None, rows[0][1])])))
    assert {i: got[i]["class_id"] for i in want} == want
    sizes = Counter(want.values())
    assert all(got[i]["class_size"] == sizes[want[i]] and got[i]["kept"] == (i == want[i]) for i in want)
    assert got[None]["class_id"] is None and got[None]["kept"]
    assert want[3011] == 3000


def test_empty_tables(documents):
    none = documents([]).withColumn("block", F.lit(1))
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.deduplicate(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.deduplicate(none).columns == none.columns
