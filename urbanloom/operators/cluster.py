"""Point clustering and tessellation: DBSCAN, cluster statistics, buffer clusters, Voronoi cells."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.classify import cluster_class
from ..scale import cut_lineage, one_row
from .graph import close_pairs, connected_components
from .hulls import group_hulls
from .profile import diversity
from .spatial import cell, mode_by
from .voronoi import voronoi_cells as voronoi_cells

_MOST_BLOCKS, _LARGEST_BLOCK = 64, 4000


def _offsets(k: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-k, k + 1) for j in range(-k, k + 1)]))


def dbscan(points: DataFrame, key: str, eps: float, min_samples: int) -> DataFrame:
    """``(key, cluster_id, is_core)``; noise is -1, a cluster is named by its lowest core id.

    Cells have side eps/sqrt(2): a cell with ``min_samples`` points is all core and one cluster, so its
    points are never paired with each other. Only points of sparse cells are counted against their
    surroundings, and components run over cells, not points. Cell pairs are first linked through their
    extreme core points; where that leaves a doubt, both cells are halved level by level.
    """
    return _density_clusters(points, key, eps, min_samples).select(
        key, F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("is_core", F.lit(False)).alias("is_core")
    )


def _density_clusters(points: DataFrame, key: str, eps: float, min_samples: int) -> DataFrame:
    """``dbscan`` with nulls for noise."""
    side = eps / 2**0.5
    keyed = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    keyed = keyed.withColumns({"cx": cell("x", side), "cy": cell("y", side)})
    p = cut_lineage(keyed.groupBy("x", "y", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo")))
    cells = p.groupBy("cx", "cy").agg(F.sum("n").alias("cn"))
    tagged = cut_lineage(p.join(cells, ["cx", "cy"]))
    dense = tagged.where(F.col("cn") >= min_samples).withColumn("core", F.lit(True))
    sparse = tagged.where(F.col("cn") < min_samples)
    e2 = float(eps) * float(eps)

    def near(a: DataFrame, b: DataFrame) -> DataFrame:
        around = a.select("x", "y", _offsets(2).alias("o"), "cx", "cy").select(
            "x", "y", (F.col("cx") + F.col("o.i")).alias("bx"), (F.col("cy") + F.col("o.j")).alias("by")
        )
        other = b.select(F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("x").alias("x2"), F.col("y").alias("y2"),
                         *[F.col(c) for c in b.columns if c not in ("x", "y", "cx", "cy")])
        j = around.join(other, ["bx", "by"])
        dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
        return j.where(dx * dx + dy * dy <= e2)

    counts = near(sparse, tagged.select("x", "y", "cx", "cy", "n")).groupBy("x", "y").agg(F.sum("n").alias("m"))
    judged = sparse.join(counts, ["x", "y"], "left").withColumn("core", F.coalesce(F.col("m") >= min_samples, F.lit(False)))
    allp = cut_lineage(dense.unionByName(judged.drop("m")))
    core = allp.where("core")
    ext = core.groupBy("cx", "cy").agg(
        F.min("lo").alias("lo"),
        F.array(*[
            F.max_by(F.struct("x", "y"), F.col("x") * c + F.col("y") * s)
            for c, s in [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]
        ]).alias("ext"),
    )
    ext = cut_lineage(ext.withColumn("cell", F.xxhash64("cx", "cy")))
    half = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
        for i in range(0, 3) for j in range(-2, 3) if (i, j) > (0, 0)
    ]))
    a = ext.select("cell", "ext", "cx", "cy", half.alias("o")).select(
        "cell", F.col("ext").alias("ext1"), (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy")
    )
    b = ext.select(F.col("cell").alias("cell2"), F.col("ext").alias("ext2"), "cx", "cy")

    def dist2(p1, p2):
        return (p1["x"] - p2["x"]) * (p1["x"] - p2["x"]) + (p1["y"] - p2["y"]) * (p1["y"] - p2["y"])

    sure = F.exists("ext1", lambda u: F.exists("ext2", lambda v: dist2(u, v) <= e2))
    cand = cut_lineage(a.join(b, ["cx", "cy"]).select("cell", "cell2", sure.alias("sure")))
    linked = cand.where("sure").select(F.col("cell").alias("src"), F.col("cell2").alias("dst"))
    exact = _meeting_cells(core, cand.where(~F.col("sure")).select("cell", "cell2"), side, e2).withColumnsRenamed({"cell": "src", "cell2": "dst"})
    cc = connected_components(linked.unionByName(exact), ext.select(F.col("cell").alias("node")))
    named = ext.join(cc, F.col("cell") == F.col("node")).select("cx", "cy", "lo", "component")
    label = named.groupBy("component").agg(F.min("lo").alias("cluster_id"))
    cell_label = cut_lineage(named.join(label, "component").select("cx", "cy", "cluster_id"))
    core_l = core.join(cell_label, ["cx", "cy"]).select("x", "y", "cx", "cy", "cluster_id")
    border = near(allp.where(~F.col("core")), core_l).groupBy("x", "y").agg(F.min("cluster_id").alias("cluster_id"))
    done = core_l.select("x", "y", "cluster_id", F.lit(True).alias("is_core")).unionByName(
        border.select("x", "y", "cluster_id", F.lit(False).alias("is_core"))
    )
    return keyed.join(done, ["x", "y"], "left").select(key, "cluster_id", "is_core")


def _meeting_cells(core: DataFrame, doubt: DataFrame, side: float, e2: float, deepest: int = 24) -> DataFrame:
    """The pairs ``(cell, cell2)`` of ``doubt`` that hold core places with a squared distance of at most ``e2``.

    Both cells of a pair are halved level by level. Parts whose bounds lie too far apart are dropped, a pair is settled
    by one place of each part or by bounds that lie wholly within the distance, and only parts that could still meet go
    on. These lie along the two facing borders, so their number follows a border and not the pairs of places. Beyond
    ``deepest`` halvings the places of a part, which hardly differ, are compared one by one.
    """
    def parts(level: int) -> DataFrame:
        ids = [F.floor(F.col(c) / side * 2.0**k).alias(n + c) for k, n in ((level - 1, "p"), (level, "i")) for c in "xy"]
        t = core.select("x", "y", *ids).groupBy("px", "py", "ix", "iy", *(["x", "y"] if level > deepest else []))
        return t.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "y")).alias("rep"),
                     F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"))

    names = core.select("cx", "cy").distinct().withColumn("cell", F.xxhash64("cx", "cy"))
    one, two = (names.select(F.col("cell").alias(k), F.col("cx").alias(s + "x"), F.col("cy").alias(s + "y")) for k, s in (("cell", "p"), ("cell2", "q")))
    todo = cut_lineage(doubt.join(one, "cell").join(two, "cell2"))
    found = doubt.where(F.lit(False))
    u, v = "l", "r"

    def square(dx, dy):
        return dx * dx + dy * dy

    def col(s: str, name: str) -> Column:
        return F.col(f"{s}.{name}")

    gap = square(*[F.greatest(col(v, lo) - col(u, hi), col(u, lo) - col(v, hi), F.lit(0.0)) for lo, hi in ("ac", "bd")])
    span = square(*[F.greatest(col(v, hi) - col(u, lo), col(u, hi) - col(v, lo)) for lo, hi in ("ac", "bd")])
    rep = square(col(u, "rep.x") - col(v, "rep.x"), col(u, "rep.y") - col(v, "rep.y"))
    level = 0
    while not todo.isEmpty():
        level += 1
        t = parts(level)
        left = t.select("px", "py", F.struct("ix", "iy", "n", "rep", "a", "b", "c", "d").alias(u))
        right = left.withColumnsRenamed({"px": "qx", "py": "qy", u: v})
        pairs = todo.join(left, ["px", "py"]).join(right, ["qx", "qy"]).where(gap <= e2)
        pairs = pairs.withColumn("hit", (rep <= e2) | (span <= e2)).where(F.col("hit") | (col(u, "n") * col(v, "n") > 1))
        pairs = cut_lineage(pairs.select("cell", "cell2", "hit", *[col(s, f"i{c}").alias(k + c) for s, k in ((u, "p"), (v, "q")) for c in "xy"]))
        hit = pairs.where("hit").select("cell", "cell2").distinct()
        found = found.unionByName(hit)
        if level > deepest:
            break
        todo = cut_lineage(pairs.where(~F.col("hit")).drop("hit").join(hit, ["cell", "cell2"], "left_anti"))
    return found


def standardise(points: DataFrame, cols: Sequence[str] = ("x", "y")) -> DataFrame:
    """Zero mean, unit population deviation."""
    from .table import zscore

    out = zscore(points, cols, ddof=0, suffix="_s")
    return out.drop(*cols).withColumnsRenamed({f"{c}_s": c for c in cols})


def cluster_stats(members: DataFrame, kind: str = "building") -> DataFrame:
    """Counts, sizes, heights, centroid, hull, density, dominant type, diversity and class per cluster."""
    m = members.where(F.col("cluster_id") >= 0)
    g = m.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("count"), F.sum("area").alias("area_total"), F.avg("area").alias("area_mean"),
        F.avg("height").alias("height_mean"), F.stddev_samp("height").alias("height_std"),
        F.sum(F.col("area") * F.col("height")).alias("volume_total"),
        F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"),
    )
    hull = group_hulls(m, "cluster_id").select("cluster_id", "hull_area")
    div = diversity(m, ["cluster_id"], kind).select("cluster_id", F.col("shannon").alias("type_diversity"))
    out = g.join(hull, "cluster_id").join(div, "cluster_id").join(mode_by(m, ["cluster_id"], kind, "dominant_type"), "cluster_id", "left")
    out = out.withColumn("density", F.when(F.col("hull_area") > 0, F.col("area_total") / F.col("hull_area")))
    return out.withColumn("cluster_class", cluster_class("dominant_type", "density", "type_diversity"))


def cluster_type_counts(members: DataFrame, kind: str) -> DataFrame:
    return members.where(F.col("cluster_id") >= 0).groupBy("cluster_id", kind).agg(F.count(F.lit(1)).alias("n"))


def cluster_back_join(members: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    return members.join(stats.select("cluster_id", *cols), "cluster_id", "left")


def cluster_spatial_density(members: DataFrame) -> DataFrame:
    """Points per hull km2 of clusters with at least three points."""
    m = members.where(F.col("cluster_id") >= 0)
    n = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= 3)
    h = group_hulls(m.join(n, "cluster_id", "left_semi"), "cluster_id").select("cluster_id", (F.col("hull_area") / 1e6).alias("area_km2"))
    return n.join(h, "cluster_id").withColumn("density", F.when(F.col("area_km2") > 0, F.col("count") / F.col("area_km2")))


def overall_density(points: DataFrame, key: str) -> DataFrame:
    h = group_hulls(points.withColumn("_g", F.lit(0)), "_g")
    n = one_row(points, n=F.count(key))["n"]
    return h.select((F.col("hull_area") / 1e6).alias("area_km2"), n.alias("count"), (n / (F.col("hull_area") / 1e6)).alias("density"))


def _blocks(places: Column, block: int) -> Column:
    """Blocks of a cluster: of ``block`` places, but not more than ``_MOST_BLOCKS`` unless they would grow too large."""
    most = F.greatest(F.lit(_MOST_BLOCKS), F.ceil(places / _LARGEST_BLOCK))
    return F.least(F.ceil(places / block), most).cast("int")


def intra_cluster_mean_distance(members: DataFrame, key: str, block: int = 2000) -> DataFrame:
    """Mean distance of every member to the other members, with the cluster size.

    Coincident points are merged, clusters are cut into blocks, and each task sums the distances of one
    block against one other block; only the sums leave the task. A place is copied once per block of its cluster,
    so a cluster is not cut into more than ``_MOST_BLOCKS`` of ``block`` places but into larger ones, up to
    ``_LARGEST_BLOCK`` places.
    """
    m, places = _cluster_places(members)
    sizes = places.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_c"), F.sum("w").alias("size"))
    cut = places.join(sizes, "cluster_id").withColumn("blocks", _blocks(F.col("_c"), block))
    cut = cut_lineage(cut.withColumn("b", F.pmod(F.xxhash64("x", "y"), "blocks").cast("int")))
    span = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    left = cut.select("cluster_id", F.col("b").alias("ba"), span, "x", "y", F.lit(0.0).alias("w")).withColumnRenamed("other", "bb")
    right = cut.select("cluster_id", F.col("b").alias("bb"), span, F.col("x"), F.col("y"), "w").withColumnRenamed("other", "ba")

    def sums(k, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"cluster_id": [], "x": [], "y": [], "s": []})
        ax, ay = a["x"].to_numpy(float), a["y"].to_numpy(float)
        bx, by, w = b["x"].to_numpy(float), b["y"].to_numpy(float), b["w"].to_numpy(float)
        s = np.zeros(len(ax))
        for i in range(0, len(bx), 512):
            s += np.hypot(ax[:, None] - bx[None, i:i + 512], ay[:, None] - by[None, i:i + 512]) @ w[i:i + 512]
        return pd.DataFrame({"cluster_id": a["cluster_id"].to_numpy(), "x": ax, "y": ay, "s": s})

    keys = ["cluster_id", "ba", "bb"]
    part = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(sums, "cluster_id bigint, x double, y double, s double")
    return _mean_distances(m, key, part, sizes)


def _cluster_places(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of clusters, and their different places with the number of members ``w``."""
    m = members.where(F.col("cluster_id") >= 0)
    return m, m.groupBy("cluster_id", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))


def _mean_distances(m: DataFrame, key: str, part: DataFrame, sizes: DataFrame) -> DataFrame:
    """Partial sums of distances ``s`` per place as means per member."""
    tot = part.groupBy("cluster_id", "x", "y").agg(F.sum("s").alias("s")).join(sizes.select("cluster_id", "size"), "cluster_id")
    j = m.select(key, "cluster_id", "x", "y").join(tot, ["cluster_id", "x", "y"])
    return j.select(key, "cluster_id", F.col("size").cast("bigint").alias("cluster_size"), F.when(F.col("size") > 1, F.col("s") / (F.col("size") - 1)).alias("mean_distance"))


def intra_cluster_distance_tree(members: DataFrame, key: str, rel: float = 1e-3, leaf: int = 16, deepest: int = 40) -> DataFrame:
    """Mean distance of every member to the other members, at most ``rel`` times itself off; columns as the exact form.

    Clusters are halved level by level into cells. Where a cell lies far enough from another one, its places count
    for each place there as one: their number times the distance ``r`` to their mean, plus the second-order term of
    their covariance. The third derivative of a distance along a line is at most ``2 / (3**0.5 * r**2)``, so the rest
    is at most ``0.19245 * variance * radius / gap**2`` per place, and as distance is convex, ``r`` times the number
    never exceeds the true sum: a pair of cells is far if that rest is within ``rel * gap``. Pairs of cells that are
    near and hold few places (``leaf`` squared) are summed place by place, others are halved again, ``deepest`` times
    at most. A cell meets a bounded number of far cells per level, however many places the cluster has.

    Null coordinates never lie in a cluster; repeated places are one place with a weight; a cluster of one member has
    a null mean.
    """
    m, places = _cluster_places(members.where(F.col("x").isNotNull() & F.col("y").isNotNull()))
    frame = places.groupBy("cluster_id").agg(
        F.sum("w").alias("size"), F.count(F.lit(1)).alias("_c"), F.min("x").alias("x0"), F.min("y").alias("y0"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"),
    )
    sizes = cut_lineage(frame)
    places = cut_lineage(places.join(sizes, "cluster_id").select(
        "cluster_id", "x", "y", "w", *[
            F.when(F.col("side") > 0, (F.col(c) - F.col(f"{c}0")) / F.col("side")).otherwise(0.0).alias(f"u{c}") for c in "xy"
        ]))

    def at(level: int) -> list[Column]:
        return [F.floor(F.col(f"u{c}") * 2.0**level).alias(f"i{c}") for c in "xy"]

    def cells(level: int) -> DataFrame:
        t = places.select("*", *at(level)).groupBy("cluster_id", "ix", "iy").agg(
            F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.min("x").alias("a"), F.min("y").alias("b"),
            F.max("x").alias("c"), F.max("y").alias("d"), F.sum(F.col("w") * F.col("x")).alias("sx"),
            F.sum(F.col("w") * F.col("y")).alias("sy"),
        ).withColumns({"gx": F.col("sx") / F.col("w"), "gy": F.col("sy") / F.col("w")})
        mean = t.select("cluster_id", "ix", "iy", "gx", "gy")
        dx, dy = F.col("x") - F.col("gx"), F.col("y") - F.col("gy")
        spread = places.select("*", *at(level)).join(mean, ["cluster_id", "ix", "iy"]).groupBy("cluster_id", "ix", "iy").agg(
            F.sum(F.col("w") * dx * dx).alias("xx"), F.sum(F.col("w") * dx * dy).alias("xy"),
            F.sum(F.col("w") * dy * dy).alias("yy"), F.max(F.sqrt(dx * dx + dy * dy)).alias("radius"),
        )
        t = t.join(spread, ["cluster_id", "ix", "iy"])
        return t.select("cluster_id", F.shiftright("ix", 1).alias("px"), F.shiftright("iy", 1).alias("py"), F.struct(
            "ix", "iy", "n", "w", "a", "b", "c", "d", "gx", "gy", "xx", "xy", "yy", "radius").alias("cell"))

    def col(s: str, name: str) -> Column:
        return F.col(f"{s}.{name}")

    u, v = "t", "s"
    sides = [F.greatest(col(v, lo) - col(u, hi), col(u, lo) - col(v, hi), F.lit(0.0)) for lo, hi in ("ac", "bd")]
    gap = F.sqrt(sides[0] * sides[0] + sides[1] * sides[1])
    variance = (col(v, "xx") + col(v, "yy")) / col(v, "w")
    one = col(v, "n") == 1
    far = one | ((gap > 0) & (0.19245 * variance * col(v, "radius") <= rel * gap * gap * gap))
    keys = ["cluster_id", "ix", "iy"]
    sums: list[DataFrame] = []
    todo = sizes.select("cluster_id", *[F.lit(0).cast("bigint").alias(k) for k in ("px", "py", "qx", "qy")])
    level = 0
    while True:
        t = cut_lineage(cells(level))
        left, right = t.withColumnRenamed("cell", u), t.withColumnsRenamed({"px": "qx", "py": "qy", "cell": v})
        pairs = todo.join(left, ["cluster_id", "px", "py"]).join(right, ["cluster_id", "qx", "qy"])
        few = (col(u, "n") * col(v, "n") <= leaf * leaf) | F.lit(level >= deepest)
        pairs = cut_lineage(pairs.select(
            "cluster_id", col(u, "ix").alias("ix"), col(u, "iy").alias("iy"), v,
            F.when(far, "far").when(few, "near").otherwise("open").alias("kind"),
        ))
        here = places.select("cluster_id", "x", "y", "w", *at(level))
        dx, dy = F.col("x") - col(v, "gx"), F.col("y") - col(v, "gy")
        r2 = dx * dx + dy * dy
        bend = (col(v, "xx") * dy * dy - 2 * col(v, "xy") * dx * dy + col(v, "yy") * dx * dx) / (2 * r2 * F.sqrt(r2))
        value = col(v, "w") * F.sqrt(r2) + F.when(one | (r2 == 0), 0.0).otherwise(bend)
        sums.append(here.join(pairs.where("kind = 'far'"), keys).groupBy("cluster_id", "x", "y").agg(F.sum(value).alias("s")))
        near = pairs.where("kind = 'near'").select(*keys, col(v, "ix").alias("jx"), col(v, "iy").alias("jy"))
        there = here.select("cluster_id", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("w").alias("w2"),
                            F.col("ix").alias("jx"), F.col("iy").alias("jy"))
        ex, ey = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
        met = here.join(near, keys).join(there, ["cluster_id", "jx", "jy"])
        sums.append(met.groupBy("cluster_id", "x", "y").agg(F.sum(F.col("w2") * F.sqrt(ex * ex + ey * ey)).alias("s")))
        todo = pairs.where("kind = 'open'").select(
            "cluster_id", F.col("ix").alias("px"), F.col("iy").alias("py"), col(v, "ix").alias("qx"), col(v, "iy").alias("qy"))
        if todo.isEmpty():
            break
        level += 1
    return _mean_distances(m, key, reduce(DataFrame.unionByName, sums), sizes)


def buffer_clusters(points: DataFrame, key: str, d: float = 100.0) -> DataFrame:
    """Groups of points whose ``d`` buffers touch (chains of gaps up to 2d): ``(key, group_id)``, named by the lowest key.

    That is density clustering where every point is a core, so cells are linked and points are not paired. Rows without
    a place have no group.
    """
    whole = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    return _density_clusters(whole, key, 2 * d, 1).select(key, F.col("cluster_id").alias("group_id"))


def buffer_cluster_sizes(groups: DataFrame, k: int = 5) -> DataFrame:
    return groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "group_id").limit(k)


def cluster_pairs(points: DataFrame, key: str, d: float) -> DataFrame:
    return close_pairs(points, key, d)
