"""Overlay of concave polygons and lines against signed fans of triangles and dense sampling."""

import math
import random

import pytest
from pyspark.sql import functions as F

from urbanloom.functions import geometry as G
from urbanloom.operators import overlay as O

SCHEMA = f"id long, rings {G.POLYGON}"


def ring_area(r):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) / 2


def cut(poly, a, b):
    """Convex polygon left of a to b."""
    def side(p):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    out = []
    for p, q in zip(poly, poly[1:] + poly[:1], strict=True):
        sp, sq = side(p), side(q)
        if sp >= 0:
            out.append(p)
        if (sp >= 0) != (sq >= 0):
            t = sp / (sp - sq)
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def fans(rings):
    """Signed triangles from the origin; holes run the other way."""
    for r in rings:
        for a, b in zip(r, r[1:], strict=False):
            k = a[0] * b[1] - b[0] * a[1]
            if k:
                yield (1 if k > 0 else -1), ([(0.0, 0.0), a, b] if k > 0 else [(0.0, 0.0), b, a])


def overlap(p, q):
    total = 0.0
    for s, t in fans(p):
        for z, u in fans(q):
            poly = t
            for a, b in zip(u, u[1:] + u[:1], strict=True):
                poly = cut(poly, a, b) if poly else poly
            if len(poly) > 2:
                total += s * z * ring_area([*poly, poly[0]])
    return total


def star(rng, cx, cy, n, r):
    """Concave ring around a centre, counter-clockwise."""
    pts = [(cx + r * d * math.cos(2 * math.pi * i / n), cy + r * d * math.sin(2 * math.pi * i / n))
           for i, d in ((i, rng.uniform(0.35, 1.0)) for i in range(n))]
    return [*pts, pts[0]]


def polygons(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        cx, cy = rng.uniform(10, 60), rng.uniform(10, 60)
        rings = [star(rng, cx, cy, rng.randint(3, 14), rng.uniform(4, 14))]
        if i % 3 == 0:
            rings.append(star(rng, cx, cy, 6, 1.2)[::-1])
        out.append((i, rings))
    # level and upright edges, shared heights, one inside another
    out.append((900, [[(20.0, 20.0), (50.0, 20.0), (50.0, 30.0), (30.0, 30.0), (30.0, 50.0), (20.0, 50.0), (20.0, 20.0)]]))
    out.append((901, [[(10.0, 10.0), (60.0, 10.0), (60.0, 60.0), (10.0, 60.0), (10.0, 10.0)],
                      [(25.0, 25.0), (25.0, 45.0), (45.0, 45.0), (45.0, 25.0), (25.0, 25.0)]]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_trapezoids_tile_the_polygon(spark):
    rows = polygons(1, 30)
    t = G.trapezoids("rings")
    got = frame(spark, rows).select("id", F.aggregate(t, F.lit(0.0), lambda s, x: s + G.trapezoid_area(x)).alias("a"),
                                    F.forall(t, lambda x: G.signed_ring_area(G.trapezoid_ring(x)) > 0).alias("ok")).collect()
    want = {i: sum(map(ring_area, r)) for i, r in rows}
    assert all(g["ok"] and g["a"] == pytest.approx(want[g["id"]]) for g in got)


def test_overlap_of_concave_polygons(spark):
    a, b = polygons(2, 12), polygons(3, 12)
    got = {(r["id"], r["other"]): r["overlap"] for r in
           O.overlap_area_join(frame(spark, a), frame(spark, b).withColumnRenamed("id", "other"), "id", "other", 16.0).collect()}
    for i, p in a:
        for j, q in b:
            want = overlap(p, q)
            assert got.get((i, j), 0.0) == pytest.approx(want, abs=1e-6)
    assert sum(v > 1 for v in got.values()) > 30


def test_two_ells(spark):
    def ell(x, y):  # 4 x 4 without its upper right 2 x 2
        return [[(x, y), (x + 4, y), (x + 4, y + 2), (x + 2, y + 2), (x + 2, y + 4), (x, y + 4), (x, y)]]

    a, b = [(1, ell(0.0, 0.0)), (2, None), (3, [])], [(1, ell(1.0, 1.0)), (2, ell(2.0, 2.0)), (3, ell(0.0, 0.0))]
    got = O.overlap_area_join(frame(spark, a), frame(spark, b).withColumnRenamed("id", "other"), "id", "other", 3.0)
    assert {r["other"]: r["overlap"] for r in got.collect()} == {1: 5.0, 3: 12.0}


def test_clip(spark):
    a, area = polygons(4, 15), polygons(5, 0)[:1]
    got = {r["id"]: r for r in O.clip(frame(spark, a), frame(spark, area), "id", 20.0).withColumn(
        "sum", F.aggregate("parts", F.lit(0.0), lambda s, p: s + G.polygon_area(p))).collect()}
    for i, p in a:
        want = overlap(p, area[0][1])
        if want > 1e-9:
            assert got[i]["area"] == pytest.approx(want, abs=1e-6) and got[i]["sum"] == pytest.approx(want, abs=1e-6)
        else:
            assert i not in got


def inside(x, y, rings):
    odd = False
    for r in rings:
        for a, b in zip(r, r[1:], strict=False):
            if (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]:
                odd = not odd
    return odd


def test_clip_lines(spark):
    rng = random.Random(6)
    area = polygons(7, 4)
    lines = [(i, [(rng.uniform(0, 70), rng.uniform(0, 70)) for _ in range(rng.randint(2, 5))]) for i in range(20)]
    lines.append((100, [(0.0, 22.0), (70.0, 22.0)]))
    df = spark.createDataFrame(lines, f"id long, coords {G.LINE}")
    got = O.clip_lines(df, frame(spark, area), "id", 15.0).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["id"], []).append(r)
    for i, line in lines:
        # runs of sampled places inside any polygon
        n, length, runs, was = 4000, 0.0, 0, False
        for a, b in zip(line, line[1:], strict=False):
            d = math.dist(a, b)
            for k in range(n):
                t = (k + 0.5) / n
                now = any(inside(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]), p) for _, p in area)
                length += d / n * now
                runs += now and not was
                was = now
        mine = pieces.get(i, [])
        assert sum(r["length"] for r in mine) == pytest.approx(length, abs=0.15)
        assert len(mine) == runs and sorted(r["piece"] for r in mine) == list(range(1, runs + 1))


def test_clip_lines_keeps_vertices(spark):
    square = [(1, [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]]), (2, [[(10.0, 0.0), (20.0, 0.0), (20.0, 10.0), (10.0, 10.0), (10.0, 0.0)]])]
    lines = [(1, [(-5.0, 5.0), (5.0, 5.0), (5.0, 15.0)]), (2, [(2.0, 5.0), (18.0, 5.0), (18.0, 6.0)]), (3, [(0.0, 0.0), (10.0, 0.0)]), (4, [(30.0, 0.0), (30.0, 9.0)])]
    df = spark.createDataFrame(lines, f"id long, coords {G.LINE}")
    got = {r["id"]: (r["piece"], [tuple(p) for p in r["coords"]], r["length"]) for r in O.clip_lines(df, frame(spark, square), "id", 4.0).collect()}
    assert got == {1: (1, [(0.0, 5.0), (5.0, 5.0), (5.0, 10.0)], 10.0), 2: (1, [(2.0, 5.0), (18.0, 5.0), (18.0, 6.0)], 17.0),
                   3: (1, [(0.0, 0.0), (10.0, 0.0)], 10.0)}


@pytest.mark.parametrize(("rule", "want"), [("evenodd", [2.0, 16.0, 12.0, 8.0]), ("nonzero", [2.0, 16.0, 16.0, 12.0]), ("positive", [1.0, 16.0, 16.0, 12.0])])
def test_crossing_rings(spark, rule, want):
    rows = [
        (0, [[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]]),  # bow-tie, one wing each way
        (1, [[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (7.0, 2.0), (4.0, 2.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]),  # spike
        (2, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]]),
        (3, [[(0.0, 0.0), (3.0, 0.0), (3.0, 2.0), (0.0, 2.0), (0.0, 0.0)], [(1.0, -1.0), (2.0, -1.0), (2.0, 5.0), (1.0, 5.0), (1.0, -1.0)]]),
    ]
    rows[3] = (3, [[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)], [(1.0, -1.0), (3.0, -1.0), (3.0, 3.0), (1.0, 3.0), (1.0, -1.0)]])
    got = O.valid_parts(frame(spark, rows), "rings", rule).orderBy("id").collect()
    assert [r["area"] for r in got] == pytest.approx(want)
