"""The binned density against the full sum over all points."""

import math
import random

import numpy as np
import pytest

from urbanloom.operators import grid as GD


def full(points, at):
    p = np.array(points, float)
    cov = np.cov(p.T) * len(p) ** (-1.0 / 3)
    inv = np.linalg.inv(cov)
    d = np.array(at, float)[:, None, :] - p[None]
    peak = 1 / (2 * math.pi * math.sqrt(np.linalg.det(cov)))
    return np.exp(-np.einsum("abi,ij,abj->ab", d, inv, d) / 2).mean(axis=1) * peak, peak


@pytest.mark.parametrize("error", [0.05, 1e-3])
def test_within_the_bound(spark, error):
    rng = random.Random(5)
    pts = [(rng.gauss(0, 1), rng.gauss(0, 30)) for _ in range(300)] + [(8.0 + rng.gauss(0, 0.01), 40.0) for _ in range(150)] + [(8.0, 40.0)] * 50
    at = [*pts[:40], *[(rng.uniform(-6, 10), rng.uniform(-90, 120)) for _ in range(100)], (8.0, 40.0), (1e4, -1e4)]
    want, peak = full(pts, at)
    df = spark.createDataFrame(pts, "x double, y double")
    places = spark.createDataFrame([(i, *q) for i, q in enumerate(at)], "id long, x double, y double")
    got = {r["id"]: r for r in GD.kde_binned(df, places, "id", error).collect()}
    assert len(got) == len(at)
    for i, w in enumerate(want):
        assert got[i]["bound"] == pytest.approx(error * peak)
        assert abs(got[i]["density"] - w) <= got[i]["bound"]
    exact = {r["id"]: r["density"] for r in GD.kde_points(df, places, "id").collect()}
    assert all(exact[i] == pytest.approx(w, abs=1e-12 * peak) for i, w in enumerate(want))


def test_without_a_density(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], "id long, x double, y double")
    none = spark.createDataFrame([], "x double, y double")
    for df in (none, places.where("id = 1").select("x", "y")):
        assert {(r["id"], r["density"], r["bound"]) for r in GD.kde_binned(df, places, "id").collect()} == {(1, 0.0, None), (2, 0.0, None)}


def test_full_sum_pairs_nothing(spark):
    """Beyond a double's resolution equal to the sum over pairs, by rows that follow points, places and cells."""
    rng = random.Random(7)
    pts = [(1e5 + rng.gauss(0, 3), -2e5 + rng.gauss(0, 50)) for _ in range(3000)] + [(1e5 + 40.0, -2e5)] * 20
    at = [*pts[::10], (1e5 + 20.0, -2e5 + 3.0), (1e9, 0.0)]
    want, peak = full(pts, at)
    df = spark.createDataFrame(pts, "x double, y double").unionByName(spark.createDataFrame([], "x double, y double"))
    places = spark.createDataFrame([(f"p{i}", *q) for i, q in enumerate(at)] + [("none", None, 1.0)], "id string, x double, y double")
    asked = GD.kde_points(df, places, "id")
    got = {r["id"]: r["density"] for r in asked.collect()}
    assert got.pop("none") == 0.0 and len(got) == len(at)
    assert all(abs(got[f"p{i}"] - w) <= 2e-13 * peak for i, w in enumerate(want))
    rows = asked._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count("MapInArrow") == 2 and rows.count("Join") == 2, rows  # places meet their own cell's nodes, no points
