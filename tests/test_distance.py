import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from urbanloom.operators import raster as R


@settings(max_examples=100, deadline=None)
@given(
    st.lists(st.dictionaries(st.integers(-30, 60), st.integers(0, 40), min_size=1, max_size=25), min_size=1, max_size=4),
    st.integers(1, 37),
)
def test_lowest_parabola_at_every_place(rows, n):
    at = np.arange(-3, n - 3)
    col = np.array([c for r in rows for c in sorted(r)])
    v2 = np.array([r[c] ** 2 for r in rows for c in sorted(r)])
    bounds = np.cumsum([0, *[len(r) for r in rows]])
    want = [[min((x - c) ** 2 + g * g for c, g in r.items()) for x in at.tolist()] for r in rows]
    assert R.least_squares_from(at, col, v2, bounds).tolist() == want


def test_gaps_of_a_long_column_are_carried_over_bands(spark):
    n = 100_000
    cells = spark.range(n).select(F.col("id").cast("int").alias("row"), F.explode(F.array(*map(F.lit, (0, 1)))).alias("col"))
    rows = [17, 40_000, 40_003, 99_000]
    burned = spark.createDataFrame([(r, 0) for r in rows], "row int, col int")
    got = R.column_gaps(cells, burned)
    assert got.where("col = 1").agg(F.count("v")).first()[0] == 0
    mine = got.where("col = 0").orderBy("row").toPandas()["v"].to_numpy()
    want = np.abs(np.arange(n)[:, None] - np.array(rows)[None, :]).min(axis=1)
    assert (mine == want).all()


def test_distance_equals_brute_force_with_holes_and_a_wide_cap(spark):
    rng = np.random.default_rng(4)
    places = [(r, c) for r in range(-40, 300) for c in range(-20, 300, 3) if rng.random() < 0.3]
    marks = [places[i] for i in rng.choice(len(places), 25, replace=False)]
    cells = spark.createDataFrame(places, "row int, col int")
    burned = spark.createDataFrame(marks + marks[:3], "row int, col int")
    for cap in (70.0, 4000.0):
        got = {(r, c): d for r, c, d in R.distance_to_burned(cells, burned, 10.0, cap).collect()}
        assert len(got) == len(places)
        at, to = np.array(places), np.array(marks)
        # a mark counts where its row holds a given cell of the searched column, as columns are scanned first
        for (r, c), d in list(got.items())[::37]:
            best = cap
            for cc in {p[1] for p in places if p[0] == r}:
                gaps = np.abs(to[to[:, 1] == cc][:, 0] - r)
                if len(gaps):
                    best = min(best, 10.0 * np.hypot(gaps.min(), cc - c))
            assert abs(d - best) < 1e-9
        assert (len(at) == len(places)) and max(got.values()) <= cap


def test_nothing_burned_and_no_cells(spark):
    none = spark.createDataFrame([], "row int, col int")
    one = spark.createDataFrame([(3, 4)], "row int, col int")
    assert [r["distance"] for r in R.distance_to_burned(one, none, 10.0, 50.0).collect()] == [50.0]
    assert R.distance_to_burned(none, one, 10.0, 50.0).count() == 0
