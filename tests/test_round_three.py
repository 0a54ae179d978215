"""Faults of ties and rounding found on larger tables."""

from pyspark.sql import functions as F


def _box(x0, y0, x1, y1):
    from urbanloom.functions import geometry as G

    return G.rectangle(*[F.lit(float(v)) for v in (x0, y0, x1, y1)])


def test_shares_of_a_split_are_exact(spark):
    from urbanloom.operators import features as FE

    df = spark.range(90).withColumn("id", F.col("id"))
    a, b = FE._cuts(F.lit(90000).cast("bigint"), 0.7, 0.15)
    assert tuple(df.limit(1).select(a, b).first()) == (63000, 76500)


def test_nearest_line_ties_go_to_the_lowest_id(spark):
    from urbanloom.operators import spatial as S

    # one line drawn both ways: computed backwards its distance, 8.54, is an ulp less
    points = spark.createDataFrame([(1, 0.0, 0.0)], "erb int, x double, y double")
    line = "struct<x:double,y:double>"
    lines = spark.createDataFrame(
        [(1, [(-9.0, -6.0), (0.0, -9.0)]), (2, [(0.0, -9.0), (-9.0, -6.0)])], f"road int, coords array<{line}>")
    assert S.nearest_line(points, lines, "erb", "road", "coords", 50.0).first()["road"] == 1


def test_fallback_sql_states_the_share(spark, tmp_path):
    import duckdb

    from urbanloom.catalog.registry import oracle_sql

    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT k AS p_partkey, 1 AS p_size, 'ECONOMY' AS p_type FROM range(1, 20001) t(k)")
    # zones so many that nearly every building lies inside one: the fallback is not in force
    con.execute("CREATE TABLE supplier AS SELECT k AS s_suppkey, 1 AS s_nationkey FROM range(1, 6001) t(k)")
    got = con.execute(f"SELECT count(*), count(zone), count(DISTINCT id) FROM ({oracle_sql()['spatial_join_fallback']})").fetchone()
    assert got[2] == 20000 and got[1] < got[0]


def test_boxes_that_only_touch_share_nothing(spark):
    from urbanloom.functions import geometry as G

    pairs = [((0, 0, 400, 300), (58, 300, 658, 1050)), ((4, 4366, 804, 4666), (804, 4469, 1204, 5369)), ((4, 4366, 804, 4666), (62, 4666, 462, 5266))]
    areas = [G.overlap_area(a, b) for p, q in pairs for a, b in ((_box(*p), _box(*q)), (_box(*q), _box(*p)))]
    assert set(spark.range(1).select(F.array(*areas)).first()[0]) == {0.0}
