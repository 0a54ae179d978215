"""Faults of growth and of disk found on larger tables."""

import random

import pytest
from pyspark.sql import functions as F

from urbanloom.operators import graph as GR
from urbanloom.operators import spatial as S
from urbanloom.operators import telecom as TE


def test_flow_takes_few_rounds_on_a_long_river(spark, monkeypatch):
    made = []
    plain = GR.round_table
    monkeypatch.setattr(GR, "round_table", lambda df: made.append(1) or plain(df))
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(300)] + [(1000 + i, i, 0.5) for i in range(0, 300, 3)], "src long, dst long, weight double")
    got = {r["node"]: r["acc"] for r in GR.flow_accumulation(e).collect()}
    assert got[300] == pytest.approx(50.0) and len(got) == 401  # 0 is fed, so only the hundred brooks are sources
    assert len(made) < 40


def _flow(rows):
    need, acc = {}, {}
    for u, v, w in rows:
        acc[u] = acc[v] = 0.0
    for u, v, w in rows:
        need[v] = need.get(v, 0) + 1
    ready = [n for n in acc if n not in need]
    for n in ready:
        acc[n] = 1.0
    while ready:
        n = ready.pop()
        for u, v, w in rows:
            if u == n:
                acc[v] += w * acc[n]
                need[v] -= 1
                if not need[v]:
                    ready.append(v)
    return acc


def test_flow_through_trees_and_partings(spark):
    rnd = random.Random(5)
    rows = {}
    for u in range(120):
        for _ in range(rnd.choice([0, 1, 1, 1, 1, 2, 3])):
            rows[u, u + rnd.randint(1, 9)] = rnd.random()
    rows = [(u, v, w) for (u, v), w in rows.items()]
    schema = "src long, dst long, weight double"
    got = {r["node"]: r["acc"] for r in GR.flow_accumulation(spark.createDataFrame(rows, schema)).collect()}
    assert got == pytest.approx(_flow(rows))
    for more in ([(0, 1000, 1.0), (0, 1001, 1.0), (1001, 0, 1.0)], [(2000, 2001, 1.0), (2001, 2000, 1.0)], [(3000, 3000, 1.0)]):
        with pytest.raises(ValueError):
            GR.flow_accumulation(spark.createDataFrame(rows + more, schema))


def test_only_broken_rings_go_to_the_hull(spark, monkeypatch):
    from pyspark.sql import functions as F

    from urbanloom.operators import hulls
    from urbanloom.operators import table as T

    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def counted(s):
        seen.add(int(s.notna().sum()))
        return s.map(lambda ring: None)

    monkeypatch.setattr(hulls, "ring_hull", counted)
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    rows = [(1, square), (2, square[:2]), (3, square[::-1]), (4, None)]
    df = spark.createDataFrame(rows, "id long, ring array<struct<x:double,y:double>>")
    got = {r["id"]: r["repair_step"] for r in T.make_valid_chain(df, "ring").select("id", "repair_step").collect()}
    assert got == {1: "repaired", 2: "dropped", 3: "repaired", 4: "dropped"} and seen.value == 1


def _to_line(x, y, line):
    def one(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy) if dx or dy else 0.0
        t = max(0.0, min(1.0, t))
        return ((x - a[0] - t * dx) ** 2 + (y - a[1] - t * dy) ** 2) ** 0.5

    return min(one(a, b) for a, b in zip(line, line[1:], strict=False))


def test_lines_meet_points_without_a_shuffle_of_pairs(spark):
    from urbanloom.operators import spatial as S

    rnd = random.Random(9)
    lines = []
    for i in range(25):
        x, y, line = rnd.uniform(0, 60), rnd.uniform(0, 60), []
        for _ in range(rnd.choice([2, 3, 5, 6, 12])):
            line.append((x, y))
            x, y = x + rnd.uniform(-9, 9), y + rnd.uniform(-9, 9)
        lines.append((i, line))
    lines += [(98, [(1.0, 1.0)]), (99, None)]
    points = [(i, rnd.uniform(0, 60), rnd.uniform(0, 60), rnd.choice("abc")) for i in range(150)] + [(150, None, 3.0, "a")]
    ldf = spark.createDataFrame(lines, "line long, coords array<struct<x:double,y:double>>")
    pdf = spark.createDataFrame(points, "id long, x double, y double, kind string")
    r = 6.0
    near = {i: [(_to_line(x, y, line), k) for _, x, y, k in points if x is not None and _to_line(x, y, line) <= r] for i, line in lines[:25]}
    near |= {98: [], 99: []}
    df = S.station_accessibility(pdf, ldf, "id", "line", "coords", r)
    got = {q["line"]: (q["min_distance"], q["stations"]) for q in df.collect()}
    assert got == {i: (pytest.approx(min(n)[0]) if n else None, len(n)) for i, n in near.items()}
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("keys=[line") == 2  # no grouping by point


def test_points_are_copied_around_and_not_segments(spark):
    from urbanloom.operators import spatial as S

    segs = spark.createDataFrame([(1, 0.0, 0.0, 30.0, 5.0), (2, 12.0, 12.0, 12.0, 12.0), (3, -7.5, 20.0, -7.5, 31.0)], "line long, ax double, ay double, bx double, by double")
    boxed = segs.selectExpr("*", "least(ax, bx) minx", "least(ay, by) miny", "greatest(ax, bx) maxx", "greatest(ay, by) maxy")
    points = [(i, x * 2.5, y * 2.5) for i, (x, y) in enumerate((x, y) for x in range(-8, 18) for y in range(-6, 18))]
    got = sorted((r["l_id"], r["r_line"]) for r in S.segments_near_points(spark.createDataFrame(points, "id long, x double, y double"), boxed, 10.0, 20.0).collect())
    ends = {r["line"]: [(r["ax"], r["ay"]), (r["bx"], r["by"])] for r in segs.collect()}
    assert got == sorted((i, k) for i, x, y in points for k, e in ends.items() if _to_line(x, y, e) <= 10.0)


def test_edges_of_one_group_spread_over_tasks(spark):
    rng = random.Random(8)
    rows = [(i * 7 - 300, rng.random() * 900, rng.random() * 900, 3, "A") for i in range(400)]
    rows += [(9000 + i, 5.0 * i, 1.0, 4 + i % 2, "AB"[i % 3 % 2]) for i in range(30)]
    rows += [(9500, 0.0, 0.0, -1, "A"), (9501, 0.0, 0.0, 3, None), (9502, 1.0, 1.0, None, "A")]
    df = spark.createDataFrame(rows, "erb long, x double, y double, cluster_id long, operator string")
    edges = TE.station_station_edges(df, "erb", "operator", block=40)
    got = {(r["src"], r["dst"]): r["km"] for r in edges.collect()}
    want = {(a[0], b[0]): ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 / 1000 for a in rows for b in rows
            if a[0] < b[0] and a[3] == b[3] and a[4] == b[4] and a[4] and a[3] is not None and a[3] >= 0}
    assert got.keys() == want.keys() and edges.count() == len(want)
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    sizes = [r["count"] for r in edges.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < len(want) / 4, sizes


def test_land_use_is_counted_where_it_is_found(spark):
    rng = random.Random(4)
    lines = [(i, [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(rng.randint(2, 6))]) for i in range(40)]
    lines.append((99, [(5000, 5000), (5010, 5000)]))
    lots = [(i, float(rng.randint(0, 400)), float(rng.randint(0, 400)), rng.choice(["a", "b", "c", None])) for i in range(150)]

    def apart(x, y, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy)))
        return ((x - a[0] - t * dx) ** 2 + (y - a[1] - t * dy) ** 2) ** 0.5

    want = {}
    for k, c in lines:
        kinds = [u for _, x, y, u in lots if u and any(apart(x, y, a, b) <= 37.3 for a, b in zip(c, c[1:], strict=False))]
        want[k] = min(set(kinds), key=lambda u: (-kinds.count(u), u)) if kinds else "unknown"
    roads = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in c]) for k, c in lines], "road long, coords array<struct<x:double,y:double>>")
    places = spark.createDataFrame(lots, "lot long, x double, y double, landuse string")
    out = S.context_landuse(roads, places, "lot", "road", "coords", "landuse", 37.3)
    assert {r["road"]: r["landuse"] for r in out.collect()} == want and want[99] == "unknown"
    assert "l_lot" not in out._jdf.queryExecution().optimizedPlan().toString()  # pairs would be dealt by it
