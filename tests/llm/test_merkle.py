"""Merkle manifests against a tree built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from urbanloom.llm import catalog, merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout):
    """Root, and for every node its siblings level by level."""
    level, at, ways = list(nodes), list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i - i % fanout
            ways[k].append((level[run:i], level[i + 1 : run + fanout]))
            at[k] = i // fanout
        level = [H(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], ways


def brute(rows, fanout):
    groups = {}
    for r in rows:
        i, text, lang, source = r
        n = None if text is None else len(text)
        leaf = H(*map(field, (i, source, lang, n, text)))
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf, r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    roots, ways = [], {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        root, ways[g] = climb([x[2] for x in groups[g]], fanout)
        roots.append(root)
    root, heads = climb(roots, fanout)
    out = []
    for k, g in enumerate(order):
        for (_, _, leaf, r), way in zip(groups[g], ways[g], strict=True):
            steps = way + heads[k]
            out.append((r[0], g, leaf, roots[k], root, tuple(("".join(a), "".join(b)) for a, b in steps)))
    return out


def key(x):
    return tuple(str(v) for v in x)


LANGS = ["en", "de", None, "-", "", "Ünd", "fr"]


@pytest.mark.parametrize(("fanout", "height", "n"), [(2, 1, 45), (3, 0, 40), (3, 1, 64), (8, 4, 60), (2, 2, 1)])
def test_tree(documents, fanout, height, n):
    rows = [(i * 7 % 1000, f"Text {i} ÄÖ" * (i % 4), LANGS[i % 11 % 7] if i % 3 else "en", None if i % 5 == 0 else f"s{i % 3}") for i in range(n)]
    rows += [(3, None, "en", "x"), (None, "no id", "en", "x"), (3, "twice", "en", "x"), (3, "twice", "en", "x")][: n // 10]
    df = documents(rows).withColumn("tree", F.lit("clash")).withColumn("place", F.lit("clash")).withColumn("leaf", F.lit(1))
    got = merkle.manifest(df, fanout=fanout, height=height).collect()
    mine = [(r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["proof"])) for r in got]
    assert sorted(mine, key=key) == sorted(brute(rows, fanout), key=key)


def test_folding_finds_changes(documents):
    rows = [(i, f"Text {i}", "en", "s") for i in range(30)]
    changed = F.when(F.col("doc_id") % 4 == 0, merkle.leaf_hash([F.lit("other")]))
    found = merkle.manifest(documents(rows), carry={"new": changed}, fanout=3, height=1)
    found = found.withColumn("back", merkle.folded(F.coalesce("new", "leaf"), F.col("proof"))).collect()
    assert {r["doc_id"]: r["back"] == r["root"] for r in found} == {i: i % 4 != 0 for i in range(30)}


def test_empty(documents):
    assert merkle.manifest(documents([])).collect() == []


def test_query(llm, documents, tmp_path):
    rows = [(i, None if i == 4 else ["Upper", "lower"][i % 2] + "\n É", "en" if i % 2 else "fr", "s") for i in range(40)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in catalog.op11_merkle(llm, str(tmp_path)).collect()}
    want = {x[0]: x for x in brute(rows, 8)}
    for i, text, lang, source in rows:
        _, _, leaf, subroot, root, steps = want[i]
        assert (got[i]["leaf"], got[i]["subroot"], got[i]["root"]) == (leaf, subroot, root)
        assert got[i]["proof_sha256"] == H(*[a + b for a, b in steps])
        at = leaf
        if zlib.crc32(str(i).encode()) % 3 == 0:
            at = H(*map(field, (i, source, lang, None if text is None else len(text), text and text.replace("U", "u"))))
        for a, b in steps:
            at = H(a, at, b)
        assert (got[i]["folded_root"], got[i]["verified"]) == (at, at == root)
    assert {r["verified"] for r in got.values()} == {True, False}
