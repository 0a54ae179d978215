"""Blocks of a cluster, upright trapezoids, and containment with a fallback."""

import math

import pytest
from pyspark.sql import functions as F

from urbanloom.functions import geometry as G
from urbanloom.operators import cluster as CL
from urbanloom.operators import overlay as O
from urbanloom.operators import spatial as S


def test_a_cluster_is_not_cut_into_more_blocks_than_are_worth_it(spark):
    sizes = spark.createDataFrame([(1,), (20,), (21,), (60_000,), (4_000_000,)], "n long")
    cut = [r[0] for r in sizes.orderBy("n").select(CL._blocks(F.col("n"), 20)).collect()]
    assert cut == [1, 1, 2, 64, 1000]
    places = [(i, 7, float(i * 37 % 101), float(i * 53 % 97)) for i in range(400)]
    got = CL.intra_cluster_mean_distance(spark.createDataFrame(places, "id long, cluster_id long, x double, y double"), "id", block=3)
    want = {i: sum(math.hypot(x - u, y - v) for _, _, u, v in places) / 399 for i, _, x, y in places}
    assert {r["id"]: r["mean_distance"] for r in got.collect()} == pytest.approx(want, abs=1e-9)


def boxes(spark, name, rows):
    d = spark.createDataFrame(rows, f"{name} long, minx double, miny double, maxx double, maxy double")
    return d.withColumn("ring", G.rectangle("minx", "miny", "maxx", "maxy")).withColumn("rings", F.array("ring"))


def test_upright_trapezoids_take_no_general_overlap(spark, monkeypatch):
    a = boxes(spark, "a", [(1, 0.0, 0.0, 4.0, 4.0), (2, 10.0, 0.0, 12.0, 2.0)])
    b = boxes(spark, "b", [(1, 3.0, 1.0, 9.0, 3.0), (2, 4.0, 0.0, 8.0, 4.0), (3, 11.0, 1.0, 20.0, 20.0)])
    slope = spark.createDataFrame([(9,)], "b long").withColumn("rings", F.array(F.array(*[
        G.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0))])))
    mixed = b.select("b", "rings").unionByName(slope)
    want = {(1, 1): 2.0, (2, 3): 1.0}

    def shared(other):
        return {(r["a"], r["b"]): r["overlap"] for r in O.overlap_area_join(a.select("a", "rings"), other, "a", "b", 3.0).collect()}

    assert shared(mixed) == pytest.approx(want | {(1, 9): 8.0})
    monkeypatch.setattr(O.G, "trapezoid_overlap", lambda p, q: F.lit(None).cast("double"))
    assert shared(b.select("b", "rings")) == pytest.approx(want)


def test_containment_with_a_fallback(spark, monkeypatch):
    left = boxes(spark, "id", [(1, 1.0, 1.0, 2.0, 2.0), (2, 0.0, 1.0, 2.0, 2.0), (3, 50.0, 50.0, 51.0, 51.0), (4, 4.0, 4.0, 6.0, 6.0)])
    right = boxes(spark, "zone", [(7, 0.0, 0.0, 5.0, 5.0), (8, 0.5, 0.5, 9.0, 9.0)])

    def joined(**kw):
        out = S.join_with_fallback(left, right, "id", 3.0, ["zone"], S.polygon_inside(), S.polygons_meet(), **kw)
        assert out.columns == ["id", "ring", "rings", "zone"]
        return sorted((r["id"], r["zone"] or 0) for r in out.collect())

    # 2 touches the border of 7, so it falls back like 3
    found = [(1, 7), (1, 8), (2, 7), (2, 8), (4, 8)]
    assert joined() == sorted([*found, (3, 0)]) and joined(drop_unmatched=True) == found
    # too few are left for the fallback: they stay without a match
    assert joined(share=0.6, drop_unmatched=True) == [(1, 7), (1, 8), (2, 0), (3, 0), (4, 8)]
    monkeypatch.setattr(S.G, "point_in_polygon", lambda *a: F.lit(None).cast("boolean"))
    assert joined(drop_unmatched=True) == found  # rectangles are compared, not walked


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_buildings_near_a_line_are_counted_where_found(spark):
    roads = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]), (2, [(500.0, 500.0), (510.0, 500.0)])],
                                  "road long, coords array<struct<x:double,y:double>>")
    places = [(1, 5.0, 3.0, 10.0, 2.0), (2, 10.0, 1.0, 30.0, 4.0), (3, 14.0, 9.0, 50.0, None), (4, 40.0, 40.0, 7.0, 7.0)]
    near = spark.createDataFrame(places, "id long, x double, y double, area double, height double")
    out = S.context_buildings(roads, near, "id", "road", "coords", 5.0)
    got = {r["road"]: (r["building_count"], r["avg_area"], r["avg_height"]) for r in out.collect()}
    assert got == {1: (3, 30.0, 3.0), 2: (0, 0.0, 0.0)}
    assert "l_id" not in plan_of(out)  # before, pairs of road and building were shuffled


def test_close_pairs_look_to_one_side(spark):
    import random

    from urbanloom.operators import graph as GR

    rng = random.Random(3)
    places = {(float(rng.randrange(-20, 20)) / 2, float(rng.randrange(-20, 20)) / 2) for _ in range(300)}
    rows = [(i, x, y) for i, (x, y) in enumerate(sorted(places, key=lambda p: rng.random()))]
    out = GR.close_pairs(spark.createDataFrame(rows, "id long, x double, y double"), "id", 1.5)
    want = {(i, j) for i, x, y in rows for j, u, v in rows if i < j and math.hypot(u - x, v - y) <= 1.5}
    got = [(r["id1"], r["id2"]) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "explode(sequence(" in plan_of(out)  # before, every place was copied to the nine cells around it
