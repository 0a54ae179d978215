"""Source divergence and its perfect hashes against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from urbanloom.llm import divergence
from urbanloom.llm.perfect_hash import PerfectHash, key_hashes

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash(n):
    keys = [f"k{i}".encode() for i in range(n)]
    made = PerfectHash.build(pa.array(keys, pa.binary()))
    made = PerfectHash.load(**made.dump())
    assert sorted(made.find(pa.array(keys, pa.binary())).tolist()) == list(range(n))
    assert [made.keys[int(i)].as_py() for i in made.find(pa.array(keys[:50], pa.binary()))] == keys[:50]
    strange = pa.array([b"", b"k", b"other", *[f"x{i}".encode() for i in range(3000)]], pa.binary())
    assert set(made.find(strange).tolist()) <= {-1}


def test_perfect_hash_tries_another_seed(monkeypatch):
    from urbanloom.llm import perfect_hash

    def weak(keys, seed):
        found = key_hashes(keys, seed)
        return found % np.uint64(7) if seed == 0 else found

    monkeypatch.setattr(perfect_hash, "key_hashes", weak)
    made = PerfectHash.build(pa.array([f"k{i}" for i in range(40)], pa.string()))
    assert made.seed > 0 and sorted(made.find(made.keys).tolist()) == list(range(40))


def brute(rows, least, ranks):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", TERM.findall(lower(text or ""))
        docs[lang].update(set(found))
        count[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = sum((count[lang, s] for s in sources), Counter())

        def p(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q, ps = p(whole), {s: p(count[lang, s]) for s in sources}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-f(ps[s][t], q[t]), t) for t in kept if count[lang, s][t] and ps[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found[:top])]
    return sorted(out)


def corpus(n=150):
    rng = random.Random(4)
    words = [f"{rng.choice(['Ab', 'été', 'x', 'ЖУК', 'Zz'])}{'abcdefgh'[i % 8]}{'ijklm'[i // 8 % 5]}" for i in range(60)]
    rows = []
    for i in range(n):
        text = "".join(w + rng.choice([" ", "1", "-", "\n", "_", "[", "\x00"]) for w in rng.choices(words[i % 5 * 7 :], k=rng.choice([0, 3, 30])))
        rows.append((text, rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "b", "é", None, "z"])))
    rows += [(None, "en", "a"), ("", "xx", "only"), (None, "yy", "s1"), ("rare", "yy", "s2"), ("long Ab " * 20_000, "en", "b")] + rows[:1] * 3
    return rows


@pytest.mark.parametrize("more", [{}, {"shard_terms": 5, "broadcast_bytes": 900, "slot_bytes": 200}, {"cells": 1}])
def test_audit(llm, more):
    rows = corpus()
    df = llm.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    df = df.withColumns({c: F.lit(1) for c in ("term", "shard", "terms", "many", "item", "rank")})
    got = sorted(tuple(r) for r in divergence.audit(df, min_docs=4, ranks=3, **more).collect())
    assert got == brute(rows, 4, 3)


def test_ties_and_empty(llm):
    schema = "text string, lang string, source string"
    rows = [(f"w{'abcdefghijklmnop'[i % 16]}", "en", "ab"[i % 16 // 8]) for i in range(64)]
    got = sorted(tuple(r) for r in divergence.audit(llm.createDataFrame(rows, schema), min_docs=2, ranks=5).collect())
    assert got == brute(rows, 2, 5)
    assert divergence.audit(llm.createDataFrame([], schema)).collect() == []
    # no term is frequent enough
    assert sorted(tuple(r) for r in divergence.audit(llm.createDataFrame(rows, schema)).collect()) == brute(rows, 10, 10)


def test_large_counts():
    counts, total = np.array([0, 1, 10**12, 4 * 10**15]), np.array(4 * 10**15 + 10**12 + 1)
    want = [1 + 10**9 * (int(c) + 2) // (int(total) + 8) for c in counts]
    assert divergence.frequency(counts, total, 4).tolist() == want
