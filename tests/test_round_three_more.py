"""Faults of growth found on larger tables."""

from pyspark.sql import functions as F


def test_a_side_of_few_keys_is_broadcast(spark):
    from urbanloom.scale import joins_by_true_size

    joins_by_true_size(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(1000).select((F.col("id") % 2).alias("k"))
        few = spark.range(2_000_000).where("id < 2").select(F.col("id").alias("k"), F.lit("x").alias("v"))  # 16 MB by its estimate
        j = rows.join(few, "k")
        assert len(j.collect()) == 1000
        assert "BroadcastHashJoin" in j._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_buffer_clusters_link_cells_and_not_points(spark, monkeypatch):
    from urbanloom.operators import cluster as CL
    from urbanloom.operators import graph

    monkeypatch.setattr(graph, "close_pairs", None)  # pairs of points are not needed
    rows = [("b", 0.0, 0.0), ("c", 5.0, 0.0), ("a", 3.0, 0.0), ("d", 15.0, 0.0), ("e", 25.1, 0.0), ("f", 25.1, 0.0), ("g", None, 0.0)]
    points = spark.createDataFrame(rows, "key string, x double, y double")
    found = {r["key"]: r["group_id"] for r in CL.buffer_clusters(points, "key", 5.0).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e"}


def _zones(spark):
    from urbanloom.operators import spatial as S

    point = "struct<x:double,y:double>"
    box = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    wedge = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]  # the same box, half of it filled
    rows = [(1, [box]), (2, [wedge]), (3, [box, [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0)]])]
    return S.with_box(spark.createDataFrame(rows, f"zone int, rings array<array<{point}>>").withColumn("ring", F.col("rings")[0]), "ring")


def test_rectangles_are_compared_plainly_and_other_shapes_whole(spark):
    from urbanloom.functions import geometry as G
    from urbanloom.operators import spatial as S

    z = _zones(spark)
    flat = z.select("zone", G.is_box("rings", *S.BOX).alias("f")).collect()
    assert {r["zone"]: r["f"] for r in flat} == {1: True, 2: False, 3: False}
    shifted = z.withColumn("maxx", F.col("maxx") + 1).where("zone = 1").select(G.is_box("rings", *S.BOX).alias("f"))
    assert not shifted.first()["f"]  # a box that is not the ring's own decides nothing
    p = S.point_box(spark.createDataFrame([(1, 0.5, 0.5), (2, 3.5, 3.5), (3, 2.0, 2.5), (4, 4.0, 2.0), (5, 9.0, 9.0)], "id int, x double, y double"))
    got = {(r["id"], r["zone"]) for r in S.spatial_join(p, z, "id", 3.0, S.point_within(), ["zone"]).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (4, None), (5, None)}
    edge = {(r["l_id"], r["r_zone"]) for r in S.spatial_pairs(p, z, 3.0, S.point_touches()).collect()}
    assert edge == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (4, 1), (4, 3)}
    plan = S.spatial_pairs(p, z, 3.0, S.point_within())._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join" in row and "lambda" not in row for row in plan.splitlines())  # one join without a walk over rings


def test_shared_areas_of_rectangles_need_no_clipping(spark):
    from urbanloom.functions import geometry as G
    from urbanloom.operators import spatial as S

    one = spark.createDataFrame([(7, 1.0, 1.0, 3.0, 6.0)], "id int, minx double, miny double, maxx double, maxy double")
    one = one.withColumn("ring", G.rectangle("minx", "miny", "maxx", "maxy")).withColumn("rings", F.array("ring"))
    z = _zones(spark)
    p = S.overlap_pairs(one, z.where("zone < 3"), 3.0)
    assert {r["r_zone"]: r["overlap"] for r in p.collect()} == {1: 6.0, 2: 2.0}
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join" in row for row in plan.split("Union")[1].split("lambda")[0].splitlines())
    met = S.spatial_pairs(z, one, 3.0, S.polygons_meet()).select("l_zone").collect()
    assert {r[0] for r in met} == {1, 2, 3}
    small = one.withColumns({"minx": F.lit(3.0), "miny": F.lit(3.0), "maxx": F.lit(4.0), "maxy": F.lit(4.0)})
    small = small.withColumn("ring", G.rectangle("minx", "miny", "maxx", "maxy")).withColumn("rings", F.array("ring"))
    assert {r[0] for r in S.spatial_pairs(z, small, 3.0, S.polygon_covers()).select("l_zone").collect()} == {1, 3}


def test_risk_merges_hits_before_it_sorts_them(spark):
    from urbanloom.operators import hydro as H

    hits = spark.createDataFrame([(1, 1, "low"), (1, 3, "high"), (1, 3, "high"), (2, 2, "mid")], "id int, level int, description string")
    d = H.assign_risk(spark.createDataFrame([(1,), (2,), (3,)], "id int"), hits, "id")
    assert {tuple(r) for r in d.collect()} == {(1, 3, "high"), (2, 2, "mid"), (3, 0, "Sem risco")}
