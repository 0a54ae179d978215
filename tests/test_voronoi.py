"""Voronoi cells on even, gridded and very uneven places, against all bisectors."""

import random

import pytest

from urbanloom.operators import cluster as CL


def brute(places, pad):
    """``{place: (area, neighbours)}``: every edge of a cell is the part of its line that all other lines leave."""
    xs, ys = zip(*places, strict=True)
    x0, x1, y0, y1 = min(xs) - pad, max(xs) + pad, min(ys) - pad, max(ys) + pad
    out = {}
    for px, py in places:
        lines = [(1, 0, x1 - px), (-1, 0, px - x0), (0, 1, y1 - py), (0, -1, py - y0)]
        for qx, qy in places:
            if (qx, qy) != (px, py):
                dx, dy = qx - px, qy - py
                d = (dx * dx + dy * dy) ** 0.5
                lines.append((dx / d, dy / d, d / 2))
        area, touching = 0.0, 0
        for k, (a, b, c) in enumerate(lines):
            low, high = -1e300, 1e300
            for m, (a2, b2, c2) in enumerate(lines):
                if m == k:
                    continue
                slope, room = a2 * -b + b2 * a, c2 - c * (a * a2 + b * b2)
                if abs(slope) < 1e-14:
                    if room < -1e-12:
                        high = low
                elif slope > 0:
                    high = min(high, room / slope)
                else:
                    low = max(low, room / slope)
            if high > low:
                area += c * (high - low) / 2
                touching += k >= 4 and high - low > 1e-6
        out[px, py] = area, touching
    return out


def uneven():
    rng = random.Random(8)
    p = [(rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for _ in range(150)] + [(rng.gauss(0, 9), rng.gauss(0, 9)) for _ in range(60)]
    return p + [(500.0, 3.0), (-2e3, 1e3), (40.0, -900.0)]


def line():
    return [(float(i * i), 2.0 * i * i) for i in range(40)]


@pytest.mark.parametrize("places", [uneven(), line(), [(0.0, 0.0), (1.0, 0.0)], [(float(i), random.Random(i).random()) for i in range(120)]])
def test_areas_and_neighbours(spark, places):
    df = spark.createDataFrame([(i, *q) for i, q in enumerate([*places, *places[:20]])], "id long, x double, y double")
    want = brute(places, 5.0)
    got = {(r["x"], r["y"]): (r["id"], r["area_km2"] * 1e6, r["neighbours"]) for r in CL.voronoi_cells(df, "id", pad=5.0).collect()}
    assert got.keys() == want.keys()
    for i, q in enumerate(places):
        assert got[q] == (i, pytest.approx(want[q][0], rel=1e-6, abs=1e-9), want[q][1]), q


def test_a_grid_and_few_places(spark):
    grid = spark.createDataFrame([(10 * i + j, float(i), float(j)) for i in range(10) for j in range(10)], "id long, x double, y double")
    rows = CL.voronoi_cells(grid, "id", pad=0.5).collect()
    assert len(rows) == 100 and all(r["area_km2"] * 1e6 == pytest.approx(1.0) for r in rows)
    one = spark.createDataFrame([(3, 1.0, 1.0), (2, 1.0, 1.0), (1, None, 0.0)], "id long, x double, y double")
    r, = CL.voronoi_cells(one, "id", pad=2.0).collect()
    assert (r["id"], r["neighbours"]) == (2, 0) and r["area_km2"] * 1e6 == pytest.approx(16.0)
    assert CL.voronoi_cells(one.limit(0), "id").count() == 0
