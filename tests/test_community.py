"""Louvain communities against all partitions of small graphs, planted groups and independent modularity."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from urbanloom.operators import community as CO
from urbanloom.operators import graph as GR


def frame(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, w double")


def quality(edges, label, resolution=1.0):
    m = sum(w for _, _, w in edges)
    inside, k = {}, {}
    for a, b, w in edges:
        k[label[a]] = k.get(label[a], 0) + w
        k[label[b]] = k.get(label[b], 0) + w
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0) + w
    return sum(inside.get(c, 0) / m - resolution * (k[c] / (2 * m)) ** 2 for c in k)


def run(spark, edges, **more):
    labels, levels = CO.louvain(frame(spark, edges), "w", **more)
    label = {r["node"]: r["community"] for r in labels.collect()}
    steps = [tuple(r) for r in levels.orderBy("level").collect()]
    assert all(a[2] < b[2] for a, b in zip(steps, steps[1:], strict=False))  # modularity rises level by level
    if steps:
        assert steps[-1][1] == len(set(label.values()))
        assert steps[-1][2] == pytest.approx(quality(edges, label, more.get("resolution", 1.0)))
    members = {}
    for n, c in label.items():
        members.setdefault(c, []).append(n)
    assert all(c == min(ns) for c, ns in members.items())
    return label, steps


def partitions(nodes):
    if not nodes:
        yield {}
        return
    head, *rest = nodes
    for p in partitions(rest):
        for c in set(p.values()) | {head}:
            yield p | {head: c}


@pytest.mark.parametrize("seed", [1])
def test_near_the_best_partition(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b, rng.choice([1, 2, 0.5])) for a, b in itertools.combinations(range(8), 2) if rng.random() < (0.8 if a // 4 == b // 4 else 0.2)]
    label, _ = run(spark, edges)
    best = max(quality(edges, p) for p in partitions(sorted(label)))
    assert quality(edges, label) >= 0.9 * best


def test_planted_groups(spark):
    # six cliques of five on a ring, one edge between neighbours
    edges = [(g * 10 + a, g * 10 + b, 1) for g in range(6) for a, b in itertools.combinations(range(5), 2)]
    edges += [(g * 10 + 4, (g + 1) % 6 * 10, 1) for g in range(6)]
    label, _ = run(spark, edges)
    assert label == {n: n // 10 * 10 for n in label}


def test_resolution(spark):
    edges = [(a, b, 1) for a, b in itertools.combinations(range(6), 2)]
    assert len(set(run(spark, edges, resolution=8.0)[0].values())) == 6


def test_star_is_one_group_of_cells(spark):
    # everybody wants to join the hub at once
    edges = [(0, i, 1) for i in range(1, 200)] + [(1000 + i, 1001 + i, 1) for i in range(200)]
    label, _ = run(spark, edges)
    assert len({label[i] for i in range(200)}) == 1


def test_loops_parallels_and_odd_weights(spark):
    edges = [(1, 2, 1), (2, 1, 2), (2, 3, 0.1), (3, 4, 3), (4, 4, 5)]
    odd = frame(spark, edges).unionByName(spark.createDataFrame([(1, 4, None), (2, 3, -1.0), (9, 9, 0.0)], "src long, dst long, w double"))
    labels, levels = CO.louvain(odd, "w")
    label = {r["node"]: r["community"] for r in labels.collect()}
    assert label == {1: 1, 2: 1, 3: 3, 4: 3}
    assert max(r["modularity"] for r in levels.collect()) == pytest.approx(quality(edges, label))
    none, levels = CO.louvain(odd.where("src = 9"), "w")
    assert none.collect() == [] and levels.collect() == []


def test_better_than_labels(spark):
    rng = random.Random(5)
    edges = {(min(a, b), max(a, b)) for a in range(150) for b in (a + 1, a + rng.choice([2, 3, 15]), a + 20) if b < 150}
    df = frame(spark, [(a, b, 1) for a, b in edges]).cache()
    labels, levels = CO.louvain(df)
    q = GR.modularity(df, labels).first()
    assert q["modularity"] == pytest.approx(levels.agg(F.max("modularity")).first()[0])
    assert q["modularity"] > GR.modularity(df, GR.communities(df.select("src", "dst"))).first()["modularity"]
