import numpy as np

from urbanloom.operators import cluster as CL


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id int, cluster_id bigint, x double, y double")


def _check(out, rows, rel):
    assert len(out) == sum(r[1] >= 0 for r in rows)
    for c in {r[1] for r in rows if r[1] >= 0}:
        mine = [r for r in rows if r[1] == c]
        at = np.array([r[2:] for r in mine])
        want = np.hypot(at[:, None, 0] - at[None, :, 0], at[:, None, 1] - at[None, :, 1]).sum(axis=1)
        for r, w in zip(mine, want, strict=True):
            size, got = out[r[0]]
            assert size == len(mine)
            if size == 1:
                assert got is None
            else:
                assert abs(got * (size - 1) - w) <= rel * w + 1e-9


def test_tree_keeps_its_bound_amid_dense_places_and_far_ones(spark):
    rng = np.random.default_rng(8)
    at = np.concatenate([rng.normal(0, 1, (900, 2)), rng.normal(40, 5, (600, 2)), rng.uniform(-4000, 4000, (30, 2))])
    rows = [(i, 3, float(x), float(y)) for i, (x, y) in enumerate(at)]
    rows += [(5000 + i, 3, rows[i][2], rows[i][3]) for i in range(40)]
    for rel in (1e-3,):
        out = {r[0]: (r[2], r[3]) for r in CL.intra_cluster_distance_tree(_frame(spark, rows), "id", rel, leaf=4).collect()}
        _check(out, rows, rel)


def test_small_and_coincident_clusters(spark):
    rows = [(1, 0, 5.0, 5.0), (2, 1, 1.0, 1.0), (3, 1, 1.0, 1.0), (4, 2, 0.0, 0.0), (5, 2, 3.0, 4.0), (6, -1, 0.0, 0.0)]
    out = {r[0]: (r[2], r[3]) for r in CL.intra_cluster_distance_tree(_frame(spark, rows), "id").collect()}
    _check(out, rows, 0.0)
    assert CL.intra_cluster_distance_tree(_frame(spark, []), "id").count() == 0
