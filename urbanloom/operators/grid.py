"""Square and hexagonal grids: cell morphology, population cells, heat grids, density surfaces."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import geometry as G
from ..scale import cut_lineage, join_on, one_row
from .profile import diversity
from .spatial import cell, cover_cells, mode_by
from .table import bin_unique_quantile, minmax_norm


def grid_origin(df: DataFrame, size: float) -> tuple[Column, Column]:
    """Lower-left grid corner snapped down to a multiple of the cell size."""
    s = one_row(df, x=F.min("minx"), y=F.min("miny"))
    return F.floor(s["x"] / size) * size, F.floor(s["y"] / size) * size


def dense_cells(df: DataFrame, size: float) -> DataFrame:
    """All cells of the layer's extent (only when empty cells are asked for)."""
    ext = df.agg(F.min("minx").alias("a"), F.min("miny").alias("b"), F.max("maxx").alias("c"), F.max("maxy").alias("d"))
    row = ext.select(F.explode(F.sequence(cell("a", size), cell("c", size))).alias("cx"), "b", "d").repartition("cx")
    return row.select("cx", F.explode(F.sequence(cell("b", size), cell("d", size))).alias("cy"))


def grid_morphology(buildings: DataFrame, size: float = 100.0, kind: str = "building", dense: bool = False) -> DataFrame:
    """Per cell: count, coverage ratio, floor area ratio, heights, density, volume, type mix.

    A building counts in every cell its box meets; ratios are relative to the cell area.
    """
    b = cover_cells(buildings, size)
    keys = ["cx", "cy"]
    area = size * size
    g = b.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("building_count"),
        (F.sum("area") / area).alias("building_coverage_ratio"),
        (F.sum(F.col("area") * F.col("levels")) / area).alias("floor_area_ratio"),
        F.avg("height").alias("avg_height"), F.stddev_samp("height").alias("height_std"),
        (F.count(F.lit(1)) / (area / 10000)).alias("building_density"),
        F.avg(F.col("area") * F.col("height")).alias("avg_volume"),
    )
    g = g.join(mode_by(b, keys, kind, "dominant_type"), keys, "left")
    g = g.join(diversity(b, keys, kind).select(*keys, F.col("shannon").alias("shannon_diversity")), keys, "left")
    if dense:
        g = dense_cells(buildings, size).join(g, keys, "left")
    zeros = ["building_count", "building_coverage_ratio", "floor_area_ratio", "avg_height", "height_std",
             "building_density", "avg_volume", "shannon_diversity"]
    g = g.fillna(0, subset=zeros)
    return g.withColumn("dominant_type", F.coalesce("dominant_type", F.lit("none")))


def classify_cells(g: DataFrame) -> DataFrame:
    """Typology, verticalisation, heterogeneity, compactness and use mix of grid cells."""
    return g.withColumns({
        "urban_typology": C.urban_typology("building_count", "building_coverage_ratio", "building_density"),
        "verticalization": C.five_steps("avg_height", [4, 9, 15, 30]),
        "height_heterogeneity": C.five_steps("height_std", [1, 3, 6, 10]),
        "urban_compactness": C.urban_compactness("building_coverage_ratio", "floor_area_ratio"),
        "use_mix": C.five_steps(
            "shannon_diversity", [0.2, 0.5, 0.8, 1.2],
            ["Monofuncional", "Baixa diversidade", "Média diversidade", "Alta diversidade", "Muito alta diversidade"],
            "Indeterminado",
        ),
    })


def cell_centrality(g: DataFrame) -> DataFrame:
    """Weighted index of normalised density, floor area and diversity with its quantile class."""
    cols = ["building_density", "floor_area_ratio", "shannon_diversity"]
    g = cut_lineage(g)  # read by the extremes, the index and its quantile edges
    n = minmax_norm(g, cols)
    n = n.withColumn("centrality_index", C.weighted_index({
        "building_density_norm": 0.4, "floor_area_ratio_norm": 0.4, "shannon_diversity_norm": 0.2,
    }))
    return bin_unique_quantile(n, "centrality_index", F.col("building_count") > 0, "centrality_class",
                               ["Muito baixa", "Baixa", "Média", "Alta", "Muito alta"])


def grid_back_join(df: DataFrame, cells: DataFrame, size: float, cols: list[str]) -> DataFrame:
    """Cell columns back on the features by centroid cell."""
    keyed = df.withColumns({"cx": cell("x", size), "cy": cell("y", size)})
    return keyed.join(cells.select("cx", "cy", *cols), ["cx", "cy"], "left")


def grid_population(buildings: DataFrame, size: float) -> DataFrame:
    """Inhabited buildings per cell: count, population, density per km2 with class, mean density."""
    b = cover_cells(buildings.where(F.col("population") > 0), size)
    g = b.groupBy("cx", "cy").agg(
        F.count(F.lit(1)).alias("building_count"), F.sum("population").alias("population"),
        (F.sum("population") / (size * size / 1e6)).alias("population_density"),
        F.avg("density_per_area").alias("mean_building_density"),
    )
    return g.withColumn("density_class", C.named_bin("population_density", "grid_density", "incl"))


def grid_line_heat(lines: DataFrame, coords: str, size: float = 1000.0) -> DataFrame:
    """Line length per cell, each segment counted at its first vertex."""
    s = lines.select(F.explode(G.segments(coords)).alias("e")).select("e.*")
    length = G.hypot2(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return s.groupBy(cell("ax", size).alias("cx"), cell("ay", size).alias("cy")).agg(
        F.sum(length).alias("length"), F.count(F.lit(1)).alias("segments")
    )


def grid_area_heat(df: DataFrame, value: str, cells: int = 100) -> DataFrame:
    """Sum of a value over an n x n grid of the point extent ``(row, col, value)``."""
    s = one_row(df, x0=F.min("x"), x1=F.max("x"), y0=F.min("y"), y1=F.max("y"))

    def at(v, lo, hi):
        return F.least(F.lit(cells - 1), F.floor((F.col(v) - lo) / (hi - lo) * cells)).cast("int")

    return df.groupBy(at("y", s["y0"], s["y1"]).alias("row"), at("x", s["x0"], s["x1"]).alias("col")).agg(
        F.sum(value).alias("value")
    )


def kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Normalised 1-D Gaussian weights by offset."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    t = sum(w)
    return [(i, v / t) for i, v in zip(range(-r, r + 1), w)]


def gaussian_smooth(cells: DataFrame, rows: Column, cols: Column, sigma: float, value: str = "value") -> DataFrame:
    """Separable Gaussian filter with reflected borders over ``(row, col, value)``; absent cells are 0.

    ``rows`` and ``cols`` give the raster height and width.
    """
    offsets = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(w).alias("w")) for i, w in kernel(sigma)])

    def fold(v: Column, n: Column) -> Column:
        m = F.pmod(v, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)

    def spread(df: DataFrame, axis: str, n: Column, keep: str) -> DataFrame:
        # scatter form: every cell adds to the targets whose reflected source it is
        t = df.select("row", "col", value, F.explode(offsets).alias("k")).select(
            "row", "col", value, F.col("k.o").alias("o"), F.col("k.w").alias("w")
        )
        src = F.col(axis)
        # targets t with fold(t + o) == src inside [0, n)
        cand = F.array_distinct(F.array(src - F.col("o"), -1 - src - F.col("o"), 2 * n - 1 - src - F.col("o")))
        t = t.withColumn("t", F.explode(cand)).where(
            (F.col("t") >= 0) & (F.col("t") < n) & (fold(F.col("t") + F.col("o"), n) == src)
        )
        return t.groupBy(F.col("t").cast("int").alias(axis), keep).agg(F.sum(F.col(value) * F.col("w")).alias(value))

    a = spread(cells, "row", rows, "col")
    return spread(a, "col", cols, "row").select("row", "col", value)


def _whitening(points: DataFrame):
    """Size of ``points`` and the function that adds whitened ``u``, ``v`` and the kernel's scales ``_a``, ``_c``.

    The covariance scaled by Scott's factor is taken apart by Cholesky, so the kernel becomes a unit disc.
    """
    row = points.agg(F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("cv"))
    f2 = F.pow("n", F.lit(-1.0 / 3.0))  # squared Scott factor in two dimensions
    row = row.withColumn("a", F.sqrt(F.col("vx") * f2)).withColumn("b", F.col("cv") * f2 / F.col("a"))
    row = row.withColumn("c", F.sqrt(F.col("vy") * f2 - F.col("b") * F.col("b")))
    s = row.select(F.struct("n", "a", "b", "c").alias("s")).scalar()  # one subquery, computed once

    def white(df: DataFrame, *keep) -> DataFrame:
        u = F.col("x") / s["a"]
        return df.select(*keep, u.alias("u"), ((F.col("y") - s["b"] * u) / s["c"]).alias("v"), s["a"].alias("_a"), s["c"].alias("_c"))

    return s["n"], white


NODES = 16  # Chebyshev nodes a cell and axis, for ``kde_points``


def _lagrange(t: np.ndarray) -> np.ndarray:
    """Shares (one column per node) of places ``t`` in a cell from -1 to 1: interpolation through the Chebyshev nodes."""
    m = np.arange(NODES)
    at_nodes = np.cos(np.outer(m, (m + 0.5) * (math.pi / NODES)))
    at_nodes[1:] *= 2
    return np.cos(np.outer(np.arccos(np.clip(t, -1, 1)), m)) @ at_nodes / NODES


def kde_points(points: DataFrame, at: DataFrame, key: str, cutoff: float = 8.5) -> DataFrame:
    """Gaussian KDE (Scott factor, full covariance) of ``points`` evaluated at ``at``: the full sum, without pairing.

    The whitened plane gets cells one kernel width wide. Inside a cell the kernel is interpolated through 16 Chebyshev
    nodes an axis, for points and for places; by Cramer's bound one such step errs by at most 2.2 * 4**-16 / sqrt(16!),
    about 1e-16 of the kernel's peak, the resolution of a double. Points are dealt to the nodes of their cell, the kernel is
    applied along one axis and then the other to all cells that come within ``cutoff`` (contributions beyond it are below
    exp(-cutoff**2/2) of the kernel's peak, at the default below the resolution of a double), and values are read back
    from the nodes. The work is that of the points, the places and the occupied cells:
    with Scott's factor, n points occupy at most about 4 * n**(2/3) cells, wherever they lie.
    """
    n, white = _whitening(points)
    reach = math.ceil(cutoff)
    there = F.expr("u IS NOT NULL AND v IS NOT NULL AND NOT isnan(u) AND NOT isnan(v)")
    cells = {"i": F.when(there, F.floor("u")), "j": F.when(there, F.floor("v"))}

    def deal(batches):
        """Partial sums ``(i, j, w)`` of a task, 16 * 16 node weights a row; sent on before they take much room."""
        held: dict[tuple[int, int], np.ndarray] = {}

        def out():
            flat = pa.array(np.concatenate([w.ravel() for w in held.values()]))
            ij = np.array(list(held), dtype=np.int64)
            ends = pa.array(np.arange(0, len(flat) + 1, NODES * NODES, dtype=np.int32))
            return pa.RecordBatch.from_arrays([pa.array(ij[:, 0]), pa.array(ij[:, 1]), pa.ListArray.from_arrays(ends, flat)], ["i", "j", "w"])

        for b in batches:
            if not b.num_rows:
                continue
            i, j, u, v, m = (b.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "u", "v", "m"))
            order = np.lexsort((j, i))
            i, j = i[order], j[order]
            su = _lagrange(2 * (u[order] - i) - 1) * m[order][:, None]
            sv = _lagrange(2 * (v[order] - j) - 1)
            cuts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])]).tolist()
            for a, z in zip(cuts, [*cuts[1:], len(i)], strict=True):
                w = su[a:z].T @ sv[a:z]
                k = (int(i[a]), int(j[a]))
                held[k] = held[k] + w if k in held else w
            if len(held) > 8192:
                yield out()
                held.clear()
        if held:
            yield out()

    def read(batches):
        for b in batches:
            e = np.zeros(b.num_rows)
            hit = b.filter(b.column("w").is_valid())
            if hit.num_rows:
                i, j, u, v = (hit.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "u", "v"))
                field = hit.column("w").flatten().to_numpy().reshape(-1, NODES, NODES)
                got = np.einsum("np,npq,nq->n", _lagrange(2 * (u - i) - 1), field, _lagrange(2 * (v - j) - 1), optimize=True)
                # what lies below the resolution may come out below zero
                e[b.column("w").is_valid().to_numpy(zero_copy_only=False)] = np.maximum(got, 0.0)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("norm"), pa.array(e)], ["key", "norm", "e"])

    def spread(nodes: DataFrame, axis: str, node: str) -> DataFrame:
        """Sums along ``axis`` of cells, ``node`` the node's number on that axis, at all nodes of the cells within reach."""
        wide = F.explode(F.sequence(F.lit(0), F.lit((2 * reach + 1) * NODES - 1)))
        t = nodes.select("i", "j", "p", "q", "w", wide.alias("o"))
        t = t.withColumn("to", F.floor(F.col("o") / NODES).cast("long") - reach).withColumn("on", F.col("o") % NODES)
        place = lambda c: F.get(F.array(*[F.lit(0.5 * math.cos((k + 0.5) * math.pi / NODES)) for k in range(NODES)]), c)
        d = F.col("to") + place(F.col("on")) - place(F.col(node))
        t = t.select(*[c for c in ("i", "j", "p", "q") if c not in (axis, node)], (F.col(axis) + F.col("to")).alias(axis),
                     F.col("on").alias(node), (F.col("w") * F.exp(-d * d / 2)).alias("w"))
        return t.groupBy("i", "j", "p", "q").agg(F.sum("w").alias("w"))

    mass = points.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("m"))
    dealt = white(mass, "m").where(there).withColumns(cells).select("i", "j", "u", "v", "m").mapInArrow(
        deal, "i long, j long, w array<double>")
    nodes = dealt.select("i", "j", F.posexplode("w").alias("k", "w")).groupBy("i", "j", "k").agg(F.sum("w").alias("w"))
    nodes = nodes.select("i", "j", F.floor(F.col("k") / NODES).cast("int").alias("p"), (F.col("k") % NODES).alias("q"), "w")
    field = spread(spread(nodes, "i", "p"), "j", "q")
    asked = white(at, F.col(key).alias("key")).withColumns(cells)
    asked = asked.select("key", "u", "v", "i", "j", (2 * math.pi * F.col("_a") * F.col("_c") * n).alias("norm"))
    wanted = field.join(asked.select("i", "j").distinct(), ["i", "j"], "left_semi")
    inside = wanted.groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct("p", "q", "w"))).alias("l"))  # 256 a cell
    inside = inside.select("i", "j", F.transform("l", lambda x: x["w"]).alias("w"))
    kind = at.schema[key].dataType.simpleString()
    told = asked.join(inside, ["i", "j"], "left").select("key", "i", "j", "u", "v", "norm", "w").mapInArrow(
        read, f"key {kind}, norm double, e double")
    return told.select(F.col("key").alias(key), F.when(F.col("e") > 0, F.col("e") / F.col("norm")).otherwise(F.lit(0.0)).alias("density"))


def binning(error: float) -> tuple[float, int]:
    """Mesh width in kernel widths, and reach of the kernel in meshes, for ``kde_binned`` at ``error``."""
    h = math.sqrt(1.8 * error)
    return h, math.ceil(math.sqrt(2 * math.log(10 / error)) / h)


def kde_binned(points: DataFrame, at: DataFrame, key: str, error: float = 1e-3) -> DataFrame:
    """``(key, density, bound)``: the density of ``kde_points`` within ``bound``, without pairing points.

    The whitened plane gets a mesh of width h. Points are dealt to the four nodes around them, the kernel is applied
    along one axis and then along the other, and values are read back from the four nodes around each place. Dealing and
    reading are linear interpolations of a kernel whose second derivatives along an axis stay within its peak, so each
    errs by at most h*h/8 an axis, h*h/2 in all; a node beyond the reach gave at most a tenth of ``error``. With
    h*h = 1.8 * error the sum errs by at most ``error`` times the peak of one kernel of the whole mass, which is
    ``bound``. The work follows the occupied nodes: the extent in kernel widths, not the number of points in them.

    Rows without a coordinate count for nothing and have density 0; where no density exists (fewer than two points, or
    all on a line) every density is 0 and ``bound`` is null.
    """
    h, reach = binning(error)
    n, white = _whitening(points)

    def corners(df: DataFrame, *keep) -> DataFrame:
        """Four rows for each row: node ``i, j`` and its share ``p``."""
        on = df.withColumns({"gu": F.col("u") / h, "gv": F.col("v") / h}).where("gu IS NOT NULL AND gv IS NOT NULL AND NOT isnan(gu) AND NOT isnan(gv)")
        on = on.withColumns({"i": F.floor("gu"), "j": F.floor("gv")}).withColumns({"fu": F.col("gu") - F.col("i"), "fv": F.col("gv") - F.col("j")})
        four = F.explode(F.array(*[F.struct(
            (F.col("i") + i).alias("i"), (F.col("j") + j).alias("j"),
            ((F.col("fu") if i else 1 - F.col("fu")) * (F.col("fv") if j else 1 - F.col("fv"))).alias("p"),
        ) for i in (0, 1) for j in (0, 1)]))
        return on.select(*keep, four.alias("k")).select(*keep, "k.*")

    def spread(nodes: DataFrame, axis: str, other: str) -> DataFrame:
        t = nodes.select("i", "j", "w", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("o"))
        near = F.col("w") * F.exp(-(F.col("o") * h) * (F.col("o") * h) / 2)
        return t.groupBy((F.col(axis) + F.col("o")).alias(axis), other).agg(F.sum(near).alias("w"))

    p = white(points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m")), "m")
    nodes = corners(p, "m").groupBy("i", "j").agg(F.sum(F.col("m") * F.col("p")).alias("w"))
    field = spread(spread(nodes, "i", "j"), "j", "i")
    q = white(at, key)
    read = corners(q, key).join(field, ["i", "j"]).groupBy(key).agg(F.sum(F.col("p") * F.col("w")).alias("e"))
    peak = 1 / (2 * math.pi * F.col("_a") * F.col("_c"))
    peak = F.when(F.col("_a") * F.col("_c") > 0, peak)
    return q.select(key, peak.alias("_k")).join(read, key, "left").select(
        key, F.coalesce(F.col("e") * F.col("_k") / n, F.lit(0.0)).alias("density"), (error * F.col("_k")).alias("bound"))


def hex_key(x, y, size: float) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon of edge ``size`` holding a point."""
    x, y = G._c(x), G._c(y)
    q = (math.sqrt(3) / 3 * x - y / 3) / size
    r = (2.0 / 3 * y) / size
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return fq.cast("bigint"), fr.cast("bigint")


def hex_centre(q, r, size: float) -> tuple[Column, Column]:
    q, r = G._c(q), G._c(r)
    return size * math.sqrt(3) * (q + r / 2), size * 1.5 * r


def hex_ring(q, r, size: float) -> Column:
    """Closed counter-clockwise hexagon ring."""
    cx, cy = hex_centre(q, r, size)
    corners = [
        G.point(cx + size * math.cos(math.radians(60 * i - 30)), cy + size * math.sin(math.radians(60 * i - 30)))
        for i in range(6)
    ]
    return F.array(*corners, corners[0])


def hex_grid(points: DataFrame, size: float) -> DataFrame:
    """Occupied hexagons with their point count, centre and ring."""
    q, r = hex_key("x", "y", size)
    g = points.groupBy(q.alias("q"), r.alias("r")).agg(F.count(F.lit(1)).alias("points"))
    cx, cy = hex_centre("q", "r", size)
    return g.withColumns({"x": cx, "y": cy, "ring": hex_ring("q", "r", size)})


def hex_cover(df: DataFrame, size: float) -> DataFrame:
    """Hexagons covering the extent of a layer."""
    ext = df.agg(F.min("minx").alias("a"), F.min("miny").alias("b"), F.max("maxx").alias("c"), F.max("maxy").alias("d"))
    r = ext.select(F.explode(F.sequence(F.floor(F.col("b") / (1.5 * size)), F.ceil(F.col("d") / (1.5 * size)))).alias("r"), "a", "c")
    w = size * math.sqrt(3)
    q = r.repartition("r").select("r", F.explode(F.sequence(
        F.floor(F.col("a") / w - F.col("r") / 2), F.ceil(F.col("c") / w - F.col("r") / 2)
    )).alias("q"))
    cx, cy = hex_centre("q", "r", size)
    return q.withColumns({"x": cx, "y": cy, "ring": hex_ring("q", "r", size)})


def attach(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return join_on(df, other, keys, "left")
