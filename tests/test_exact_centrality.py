"""Exact weighted betweenness and community labels of the registered queries, beside Brandes' algorithm in plain Python."""

import heapq
from collections import Counter, defaultdict

import pytest

from urbanloom.catalog.registry import queries
from urbanloom.catalog.shapes import Shapes
from urbanloom.operators import centrality as CE
from urbanloom.operators import graph as GR

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def streets(spark):
    rows = GR.simple_edges(Shapes(spark, SF_DIR).streets(), "street", ["street"]).collect()
    return {r["street"]: (r["src"], r["dst"]) for r in rows}


def brandes(streets):
    """Sums of node and edge dependencies over all sources; weights are whole numbers, so ties are exact."""
    around = defaultdict(list)
    for street, (a, b) in streets.items():
        around[a].append((b, street % 97 + 1))
        around[b].append((a, street % 97 + 1))
    nodes, edges = dict.fromkeys(around, 0.0), defaultdict(float)
    for s in around:
        dist, paths, before, heap, order = {s: 0}, Counter({s: 1}), defaultdict(list), [(0, s)], []
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u] or u in order:
                continue
            order.append(u)
            for v, w in around[u]:
                if d + w < dist.get(v, float("inf")):
                    dist[v], paths[v], before[v] = d + w, 0, []
                    heapq.heappush(heap, (d + w, v))
                if d + w == dist[v]:
                    paths[v] += paths[u]
                    before[v].append(u)
        back = Counter()
        for v in reversed(order):
            for u in before[v]:
                x = paths[u] / paths[v] * (1 + back[v])
                back[u] += x
                edges[min(u, v), max(u, v)] += x
            if v != s:
                nodes[v] += back[v]
    return nodes, edges


def test_betweenness_of_all_sources_with_weights(spark, streets):
    nodes, edges = brandes(streets)
    n = len(nodes)
    got = {r["node"]: r["betweenness"] for r in queries()["betweenness_exact"](spark, SF_DIR).collect()}
    assert got == pytest.approx({v: x / ((n - 1) * (n - 2)) for v, x in nodes.items()}, abs=1e-9)
    got = {r["street"]: r["betweenness"] for r in queries()["edge_betweenness_exact"](spark, SF_DIR).collect()}
    want = {k: edges[min(e), max(e)] / (n * (n - 1)) for k, e in streets.items()}
    assert got == pytest.approx({k: want.get(k, 0.0) for k in got}, abs=1e-9) and want.keys() <= got.keys()


def test_labels_are_returned_and_settled(spark, streets):
    label = {r["node"]: r["community"] for r in queries()["community_labels"](spark, SF_DIR).collect()}
    assert label.keys() == {v for e in streets.values() for v in e}
    votes = defaultdict(Counter)
    for a, b in streets.values():
        votes[a][label[b]] += 1
        votes[b][label[a]] += 1
    assert all(max(c.values()) <= c[label[v]] for v, c in votes.items())
    got = queries()["community_modularity"](spark, SF_DIR).first()
    m, degree = len(streets), Counter(label[v] for e in streets.values() for v in e)
    inside = sum(label[a] == label[b] for a, b in streets.values())
    assert got["communities"] == len(degree)
    assert got["modularity"] == pytest.approx(inside / m - sum((d / (2 * m)) ** 2 for d in degree.values()), abs=1e-8)


def hops(streets):
    """Sums of node dependencies by source, every edge counting 1."""
    around = defaultdict(set)
    for a, b in streets.values():
        around[a].add(b)
        around[b].add(a)
    out = {}
    for s in around:
        dist, paths, order = {s: 0}, Counter({s: 1}), [s]
        for u in order:
            for v in around[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        back = Counter()
        for v in reversed(order):
            for u in around[v]:
                if dist[u] == dist[v] - 1:
                    back[u] += paths[u] / paths[v] * (1 + back[v])
        back[s] = 0
        out[s] = back
    return out


def test_betweenness_within_a_stated_error(spark, streets):
    per = hops(streets)
    n = len(per)
    exact = {v: sum(per[s][v] for s in per) / ((n - 1) * (n - 2)) for v in per}
    edges = spark.createDataFrame(list(streets.values()), "src long, dst long")
    got = {r["node"]: r for r in CE.betweenness_within(edges, error=0.2, confidence=0.9).collect()}
    assert got.keys() == exact.keys()
    used = {r["sources"] for r in got.values()}
    assert len(used) == 1 and 0 < used.pop() < n
    assert all(0 < r["bound"] <= 0.2 and abs(r["betweenness"] - exact[v]) <= r["bound"] for v, r in got.items())
    every = {r["node"]: r for r in CE.betweenness_within(edges, error=1e-6).collect()}
    assert {v: r["betweenness"] for v, r in every.items()} == pytest.approx(exact, abs=1e-12)
    assert {(r["bound"], r["sources"]) for r in every.values()} == {(0.0, n)}
    pair = CE.betweenness_within(spark.createDataFrame([(1, 2), (3, 3)], "src long, dst long")).collect()
    assert sorted((r["node"], r["betweenness"]) for r in pair) == [(1, 0.0), (2, 0.0)]
