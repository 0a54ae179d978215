"""Closed forms and brute force on small fixtures, including skewed ones."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from urbanloom.operators import centrality as CE
from urbanloom.operators import cluster as CL
from urbanloom.operators import graph as GR
from urbanloom.operators import population as PO
from urbanloom.operators import profile as P
from urbanloom.operators import spatial as S
from urbanloom.operators import table as T
from urbanloom.operators import zoning as Z
from urbanloom.scale import exact_quantiles, with_position, with_running_total


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src long, dst long, id long")


def test_quantiles_skewed(spark):
    rnd = random.Random(1)
    vals = [(7.0 if rnd.random() < 0.35 else rnd.expovariate(0.01), "hot" if rnd.random() < 0.9 else "cold") for _ in range(30000)]
    d = spark.createDataFrame(vals, "v double, k string")
    want = d.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.1, 0.5, 0.99, 1.0)))).alias("q")).collect()
    got = {r["k"]: r["q"] for r in exact_quantiles(d, "v", [0.0, 0.1, 0.5, 0.99, 1.0], by=["k"], accuracy=1000).collect()}
    for r in want:
        assert got[r["k"]] == pytest.approx(r["q"])


def test_positions_skewed(spark):
    d = spark.range(5000).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"), (F.col("id") * 7919 % 5003).alias("v"))
    got = with_position(d, ["v"], "p", by=["k"])
    bad = got.join(got.select("k", F.col("v").alias("v2"), F.col("p").alias("p2")), "k").where((F.col("p2") == F.col("p") + 1) & (F.col("v2") <= F.col("v"))).count()
    assert bad == 0
    assert {r["k"]: (r["a"], r["b"]) for r in got.groupBy("k").agg(F.min("p").alias("a"), F.max("p").alias("b")).collect()} == {"hot": (1, 4500), "cold": (1, 500)}
    run = with_running_total(d, ["v"], "id", "s")
    assert run.orderBy(F.desc("v")).first()["s"] == sum(range(5000))


def test_largest_remainder(spark):
    d = spark.createDataFrame([(i, 1, 10.0, 1.0) for i in range(3)], "id long, sector long, pop double, weight double")
    got = [r["estimated_population"] for r in PO.distribute_population(d, "sector", "pop", "id").orderBy("id").collect()]
    assert got == [4, 3, 3]


def test_path_graph(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 3)])
    b = {r["node"]: r["betweenness"] for r in CE.betweenness(e).collect()}
    c = {r["node"]: r["closeness"] for r in CE.closeness(e).collect()}
    s = CE.path_summary(CE.eccentricities(e)).first()
    assert b[1] == pytest.approx(2 / 3) and b[2] == pytest.approx(2 / 3) and b[0] == 0
    assert c[0] == pytest.approx(0.5) and c[1] == pytest.approx(0.75)
    assert (s["diameter"], s["radius"]) == (3.0, 2.0)
    one = GR.contract_degree2(e.withColumn("length", F.lit(1.0)), "id").collect()
    assert [(r["src"], r["dst"], r["length"], r["merged"]) for r in one] == [(0, 3, 3.0, 3)]


def brute_betweenness(n, adj):
    out = dict.fromkeys(range(n), 0.0)
    for s, t in itertools.permutations(range(n), 2):
        best, paths, stack = None, [], [(0.0, [s])]
        while stack:
            d, p = stack.pop()
            if p[-1] == t:
                if best is None or d < best - 1e-12:
                    best, paths = d, [p]
                elif abs(d - best) < 1e-12:
                    paths.append(p)
                continue
            stack += [(d + w, p + [v]) for v, w in adj[p[-1]] if v not in p and (best is None or d + w <= best + 1e-12)]
        for p in paths:
            for v in p[1:-1]:
                out[v] += 1 / len(paths)
    return {v: x / ((n - 1) * (n - 2)) for v, x in out.items()}


def test_betweenness_both_ways(spark):
    rnd = random.Random(5)
    n = 9
    pairs = sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(14)} | {(i, i + 1) for i in range(n - 1)})
    ws = {p: rnd.choice([1.0, 2.0]) for p in pairs}
    adj = {i: [] for i in range(n)}
    for (a, b), w in ws.items():
        adj[a].append((b, w))
        adj[b].append((a, w))
    e = spark.createDataFrame([(a, b, w) for (a, b), w in ws.items()], "src long, dst long, w double")
    want = brute_betweenness(n, adj)
    got = {r["node"]: r["betweenness"] for r in CE.betweenness(e, "w").collect()}
    assert got == pytest.approx(want)


def test_zero_weights_and_rounding_ties(spark):
    # a ring of weight-0 edges hangs on both sides of a bridge; the search must end and spread over ties
    ring = [(0, 1, 0.0), (1, 2, 0.0), (2, 0, 0.0), (2, 3, 1.0), (3, 4, 0.0), (4, 5, 0.0), (5, 3, 0.0)]
    e = spark.createDataFrame(ring, "src long, dst long, w double")
    b = {r["node"]: r["betweenness"] for r in CE.betweenness(e, "w").collect()}
    assert b[2] == b[3] == pytest.approx(12 / 20) and b[0] == b[1] == b[4] == b[5] == 0
    # 0.1 + 0.2 and 0.3 tie although their doubles differ
    tie = [(0, 1, 0.1), (1, 3, 0.2), (0, 2, 0.2), (2, 3, 0.1), (0, 4, 0.15), (4, 3, 0.15)]
    e = spark.createDataFrame(tie, "src long, dst long, w double")
    b = {r["node"]: r["betweenness"] for r in CE.betweenness(e, "w").collect()}
    assert b[1] == pytest.approx(b[2]) == pytest.approx(b[4])


def test_sampled_closeness_covers_every_node(spark):
    e = edges(spark, [(i, i + 1) for i in range(30)])
    exact = {r["node"]: r["closeness"] for r in CE.closeness(e).collect()}
    full = {r["node"]: r["closeness"] for r in CE.closeness(e, k=31).collect()}
    part = {r["node"]: r["closeness"] for r in CE.closeness(e, k=12).collect()}
    assert full == pytest.approx(exact)
    assert part.keys() == exact.keys() and all(v > 0 for v in part.values())
    both = CE.centralities(e, None, 5).collect()
    assert len(both) == 31 and all(r["closeness"] is not None for r in both)


def test_flow_on_a_braided_network(spark):
    rows = [(3 * i + a, 3 * i + 3 + b, 0.5) for i in range(20) for a in range(3) for b in range(3)]
    e = spark.createDataFrame(rows, "src long, dst long, weight double")
    acc = {r["node"]: r["acc"] for r in GR.flow_accumulation(e).collect()}
    assert len(acc) == 63 and all(acc[3 * 20 + b] == pytest.approx(1.5 ** 20) for b in range(3))
    with pytest.raises(ValueError):
        GR.flow_accumulation(spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, weight double"))


def test_parallel_edges_stay(spark):
    e = spark.createDataFrame([(1, 2, 10, 1.0), (1, 2, 11, 2.0), (1, 3, 12, 1.0), (3, 2, 13, 1.0), (2, 9, 14, 1.0), (1, 8, 15, 1.0)],
                              "src long, dst long, id long, length double")
    got = {r["id"] for r in GR.contract_degree2(e, "id").collect()}
    assert got == {10, 11, 14, 15}  # the chain 12-13 would only double them


def test_communities_settle(spark):
    e = edges(spark, [(i, i + 1) for i in range(60)])
    c = {r["node"]: r["community"] for r in GR.communities(e).collect()}
    near = {i: [c[j] for j in (i - 1, i + 1) if j in c] for i in c}
    for i, labels in near.items():  # nobody has a commoner label around than its own
        assert max(labels.count(x) for x in labels) <= labels.count(c[i])


def test_components_and_indices(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2)])
    r = GR.alpha_beta_gamma(e.withColumn("length", F.lit(1.0))).first()
    assert (r["alpha"], r["beta"], r["gamma"]) == pytest.approx((0.4, 1.2, 6 / 9))
    two = edges(spark, [(0, 1), (1, 2)])
    cc = GR.connected_components(two, spark.createDataFrame([(9,)], "node long"))
    s = GR.graph_summary(two, cc).first()
    assert (s["fragmentation"], s["effective_components"], s["isolated"]) == pytest.approx((0.375, 1.6, 1))


def test_hub_components(spark):
    star = spark.range(1, 4000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    chain = spark.range(5000, 5200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = {r["component"]: r["size"] for r in GR.component_sizes(GR.connected_components(star.unionByName(chain))).collect()}
    assert got == {0: 4000, 5000: 201}


def test_flow(spark):
    e = spark.createDataFrame([(1, 3, 1 / 7), (2, 3, 1 / 7), (3, 4, 1 / 7)], "src long, dst long, weight double")
    got = {r["node"]: r["acc"] for r in GR.flow_accumulation(e).collect()}
    assert got[3] == pytest.approx(2 / 7) and got[4] == pytest.approx(2 / 49)
    with pytest.raises(ValueError):
        GR.flow_accumulation(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, weight double"))


def test_dbscan_against_brute_force(spark):
    rnd = random.Random(3)
    pts = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(150)]
    pts += [(150 + i, 5.0, 5.0) for i in range(100)]  # a third of the points on one place
    pts += [(250 + i, rnd.uniform(-8, 8), rnd.uniform(-8, 8)) for i in range(60)]
    eps, k = 0.5, 4
    near = {a: [b for b, x2, y2 in pts if (x - x2) ** 2 + (y - y2) ** 2 <= eps * eps] for a, x, y in pts}
    core = {a for a in near if len(near[a]) >= k}
    label = {}
    for a in sorted(core):
        if a in label:
            continue
        stack = [a]
        while stack:
            u = stack.pop()
            if u in label:
                continue
            label[u] = a
            stack += [v for v in near[u] if v in core and v not in label]
    want = {a: label[a] if a in core else min((label[b] for b in near[a] if b in core), default=-1) for a in near}
    got = {r["id"]: r["cluster_id"] for r in CL.dbscan(spark.createDataFrame(pts, "id long, x double, y double"), "id", eps, k).collect()}
    assert got == want


def test_join_is_independent_of_cell_size(spark):
    rnd = random.Random(2)
    boxes = spark.createDataFrame([(i, x := rnd.uniform(0, 100), y := rnd.uniform(0, 100), x + rnd.uniform(1, 30), y + rnd.uniform(1, 30)) for i in range(60)], "id long, minx double, miny double, maxx double, maxy double")
    seen = {frozenset((r["l_id"], r["r_id"]) for r in S.box_pairs(boxes, boxes, size).select("l_id", "r_id").collect()) for size in (3.0, 17.0, 500.0)}
    counts = {S.box_pairs(boxes, boxes, size).count() for size in (3.0, 17.0, 500.0)}
    assert len(seen) == 1 and counts == {len(next(iter(seen)))}


def test_nearest_brute_force(spark):
    rnd = random.Random(4)
    a = [(i, rnd.uniform(0, 1), rnd.uniform(0, 1)) for i in range(40)] + [(99, 500.0, 500.0)]
    b = [(i, rnd.uniform(0, 1) ** 4, rnd.uniform(0, 1)) for i in range(50)]
    got = {r["id"]: r["k"] for r in S.nearest_join(spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "k long, x double, y double"), "id", "k").collect()}
    want = {i: min(b, key=lambda q: ((q[1] - x) ** 2 + (q[2] - y) ** 2, q[0]))[0] for i, x, y in a}
    assert got == want


def test_diversity_and_fences(spark):
    d = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "k string")
    r = P.diversity(d, [], "k").first()
    assert r["shannon"] == pytest.approx(1.039721, abs=1e-6) and r["simpson"] == pytest.approx(0.625)
    v = spark.createDataFrame([(float(i),) for i in [*range(1, 10), 100]], "v double")
    o = T.outliers_iqr(v, ["v"]).first()
    assert (o["lower"], o["upper"], o["outliers"]) == (-10.25, 21.25, 1)


def test_active_periods(spark):
    d = spark.createDataFrame([(h,) for h in (8, 9, 10, 14, 15)], "hour int")
    got = sorted((r["start"], r["end"], r["length"]) for r in PO.active_periods(d).collect())
    assert got == [(8, 10, 3), (14, 15, 2)]


def test_conformity(spark):
    d = spark.createDataFrame([("housing", "industrial_fabrica"), ("housing", "comercial_varejo")], "landuse string, building_class_enhanced string")
    got = {r["building_class_enhanced"]: (r["conformidade_uso"], r["nivel_conformidade"]) for r in Z.zoning_conformity(d, "landuse").collect()}
    assert got == {"industrial_fabrica": ("não conforme", "proibido"), "comercial_varejo": ("conforme", "condicional")}


def test_voronoi_square(spark):
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (10, 0), (0, 10), (10, 10), (5, 5)])], "id long, x double, y double")
    v = {r["id"]: (r["area_km2"] * 1e6, r["neighbours"]) for r in CL.voronoi_cells(p, "id", pad=0.0).collect()}
    assert v[4][0] == pytest.approx(50.0) and v[4][1] == 4
    assert v[0][0] == pytest.approx(12.5)
