"""Cells of many places that nearly meet."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.operators import cluster as CL


def facing(n):
    """Two clouds in cells two apart whose gap is just over 1, with extremes that do not face each other."""
    rng = random.Random(4)
    a = [(rng.uniform(0.3, 0.5997), rng.uniform(0.0, 0.7)) for _ in range(n)] + [(0.6, 0.1)]
    b = [(rng.uniform(1.6001, 1.9), rng.uniform(0.0, 0.7)) for _ in range(n)] + [(1.59985, 0.6)]
    return a, b


@pytest.mark.parametrize("meet", [False, True])
def test_two_dense_cells(spark, meet):
    a, b = facing(50_000)
    if meet:  # one pair out of 2.5e9, and neither place is an extreme of its cell
        a, b = [*a, (0.5999, 0.35)], [*b, (1.59988, 0.35)]
    df = spark.createDataFrame([(i, *q) for i, q in enumerate(a + b)], "id long, x double, y double")
    got = CL.dbscan(df, "id", 1.0, 5).groupBy("cluster_id").agg(F.count("id").alias("n")).collect()
    assert {r["cluster_id"]: r["n"] for r in got} == ({0: len(a) + len(b)} if meet else {0: len(a), len(a): len(b)})


@pytest.mark.parametrize("deepest", [0, 2, 24])
def test_pairs_against_brute_force(spark, deepest):
    rng = random.Random(6)
    side, e2 = 1 / 2**0.5, 1.0
    pts = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(120)] + [(1e-13 * i, 0.25) for i in range(9)]
    core = spark.createDataFrame(pts, "x double, y double").withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    cells = {}
    for x, y in pts:
        cells.setdefault((int(np.floor(x / side)), int(np.floor(y / side))), []).append((x, y))
    named = {(r["cx"], r["cy"]): r["c"] for r in core.select("cx", "cy", F.xxhash64("cx", "cy").alias("c")).distinct().collect()}
    pairs = [(p, q) for p in cells for q in cells if p < q and max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= 2]
    want = {(named[p], named[q]) for p, q in pairs if any((x - u) ** 2 + (y - v) ** 2 <= e2 for x, y in cells[p] for u, v in cells[q])}
    doubt = spark.createDataFrame([(named[p], named[q]) for p, q in pairs], "cell long, cell2 long")
    got = [tuple(r) for r in CL._meeting_cells(core, doubt, side, e2, deepest).collect()]
    assert len(got) == len(set(got)) and set(got) == want
