"""Rasters as tables ``(row, col, value)`` with an affine origin and resolution."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.classify import clip01, minmax, named_bin
from ..functions.formulas import hypsometric_integral
from ..scale import exact_quantiles, one_row
from .grid import gaussian_smooth
from .spatial import box_pairs, point_box


@dataclass(frozen=True)
class Affine:
    """Upper-left corner and square cell size; rows grow downwards."""

    x0: float
    y0: float
    res: float

    def row(self, y) -> Column:
        return F.floor((F.lit(self.y0) - G._c(y)) / self.res).cast("int")

    def col(self, x) -> Column:
        return F.floor((G._c(x) - self.x0) / self.res).cast("int")

    def x(self, col="col") -> Column:
        return F.lit(self.x0) + (G._c(col) + 0.5) * self.res

    def y(self, row="row") -> Column:
        return F.lit(self.y0) - (G._c(row) + 0.5) * self.res


def mask_nodata(cells: DataFrame, nodata: float | None) -> DataFrame:
    return cells if nodata is None else cells.withColumn("value", F.when(F.col("value") != nodata, F.col("value")))


def sample_points(points: DataFrame, cells: DataFrame, a: Affine, height: str | None = None) -> DataFrame:
    """Value of the cell under each point (NULL outside); ``top`` adds a height column."""
    p = points.withColumns({"row": a.row("y"), "col": a.col("x")})
    out = p.join(cells.select("row", "col", F.col("value").alias("elevation")), ["row", "col"], "left").drop("row", "col")
    return out if height is None else out.withColumn("elevation_top", F.col("elevation") + F.col(height))


def sample_lines(lines: DataFrame, key: str, coords: str, cells: DataFrame, a: Affine) -> DataFrame:
    """Elevation min/max/mean/range along each line and the slope between its first and last valid samples."""
    length = G.line_length(coords)
    pts = lines.select(key, length.alias("_len"), F.explode(G.line_points(coords, G.samples_by_resolution(length, a.res))).alias("p"))
    s = pts.select(key, "_len", "p.seq", a.row(F.col("p.y")).alias("row"), a.col(F.col("p.x")).alias("col"))
    s = s.join(cells.where(F.col("value").isNotNull()), ["row", "col"])
    g = s.groupBy(key, "_len").agg(
        F.min("value").alias("elevation_min"), F.max("value").alias("elevation_max"), F.avg("value").alias("elevation_mean"),
        F.min_by("value", "seq").alias("_a"), F.max_by("value", "seq").alias("_z"), F.count(F.lit(1)).alias("samples"),
    )
    pct = F.when(F.col("_len") > 0, F.abs(F.col("_z") - F.col("_a")) / F.col("_len") * 100)
    g = g.withColumns({
        "elevation_range": F.col("elevation_max") - F.col("elevation_min"), "slope_pct": pct,
    })
    g = g.withColumns({"slope_deg": F.degrees(F.atan(F.col("slope_pct") / 100))}).drop("_a", "_z", "_len")
    out = lines.select(key).join(g, key, "left")
    return out.withColumn("slope_class", named_bin(F.coalesce("slope_pct", F.lit(0.0)), "road_slope", "incl"))


def cells_in_polygons(polys: DataFrame, key: str, rings: str, cells: DataFrame, a: Affine, tile: float) -> DataFrame:
    """Cells whose centre lies inside each polygon ``(key, row, col, value)``."""
    pts = point_box(cells.withColumns({"x": a.x(), "y": a.y()}))
    p = box_pairs(pts, polys.select(key, rings, "minx", "miny", "maxx", "maxy"), tile)
    hit = p.where(G.point_in_polygon("l_x", "l_y", F.col(f"r_{rings}"), False))
    return hit.select(F.col(f"r_{key}").alias(key), F.col("l_row").alias("row"), F.col("l_col").alias("col"), F.col("l_value").alias("value"))


def zonal_stats(polys: DataFrame, key: str, rings: str, cells: DataFrame, a: Affine, tile: float) -> DataFrame:
    """count, min, max, mean, median, population std, range, p10 and p90 of the inside cells."""
    inside = cells_in_polygons(polys, key, rings, cells.where(F.col("value").isNotNull()), a, tile)
    g = inside.groupBy(key).agg(
        F.count(F.lit(1)).alias("cells"), F.min("value").alias("elevation_min"), F.max("value").alias("elevation_max"),
        F.avg("value").alias("elevation_mean"), F.stddev_pop("value").alias("elevation_std"),
    )
    q = exact_quantiles(inside, "value", [0.1, 0.5, 0.9], by=[key])
    q = q.select(key, F.get("q", 0).alias("elevation_percentile_10"), F.get("q", 1).alias("elevation_median"),
                 F.get("q", 2).alias("elevation_percentile_90"))
    out = g.join(q, key).withColumn("elevation_range", F.col("elevation_max") - F.col("elevation_min"))
    out = out.withColumn("hypsometric_integral", hypsometric_integral("elevation_mean", "elevation_min", "elevation_max"))
    return polys.select(key).join(out, key, "left")


def focal_slope(points: DataFrame, key: str, cells: DataFrame, a: Affine, r: float = 30.0) -> DataFrame:
    """(max-min within the disc)/(2r)*100; NULL unless the disc lies inside the raster."""
    k = int(r // a.res) + 1
    s = one_row(cells, r0=F.min("row"), r1=F.max("row"), c0=F.min("col"), c1=F.max("col"))
    inside = (
        (a.row(F.col("y") + r) >= s["r0"]) & (a.row(F.col("y") - r) <= s["r1"])
        & (a.col(F.col("x") - r) >= s["c0"]) & (a.col(F.col("x") + r) <= s["c1"])
    )
    span = F.sequence(F.lit(-k), F.lit(k))
    p = points.where(inside).select(key, "x", "y", F.explode(span).alias("dr")).select(
        key, "x", "y", (a.row("y") + F.col("dr")).alias("row"), F.explode(span).alias("dc")
    ).withColumn("col", a.col("x") + F.col("dc"))
    dx, dy = a.x() - F.col("x"), a.y() - F.col("y")
    p = p.where(dx * dx + dy * dy <= r * r)
    g = p.join(cells, ["row", "col"]).groupBy(key).agg(((F.max("value") - F.min("value")) / (2 * r) * 100).alias("terrain_slope"))
    out = points.select(key).join(g, key, "left")
    return out.withColumn("terrain_slope_class", named_bin("terrain_slope", "building_slope"))


def gradient(cells: DataFrame, spacing: float = 1.0) -> DataFrame:
    """Central differences along rows (``g_row``) and columns (``g_col``), one-sided at the border.

    A window partition is one raster line.
    """

    def diff(axis: str, other: str) -> Column:
        w = Window.partitionBy(other).orderBy(axis)
        before, after = F.lag("value").over(w), F.lead("value").over(w)
        first, last = F.lag(axis).over(w).isNull(), F.lead(axis).over(w).isNull()
        v = F.col("value")
        return F.when(first & last, F.lit(0.0)).when(first, after - v).when(last, v - before).otherwise((after - before) / 2) / spacing

    return cells.withColumns({"g_row": diff("row", "col")}).withColumns({"g_col": diff("col", "row")})


def slope_aspect(cells: DataFrame, spacing: float = 1.0) -> DataFrame:
    """Slope in degrees and aspect in [0, 360) from the gradient; the row gradient plays x."""
    g = gradient(cells, spacing)
    gx, gy = F.col("g_row"), F.col("g_col")
    return g.select(
        "row", "col", "value",
        F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).alias("slope"),
        F.pmod(F.degrees(F.atan2(-gx, gy)), F.lit(360.0)).alias("aspect"),
    )


def zonal_slope(polys: DataFrame, key: str, rings: str, cells: DataFrame, a: Affine, tile: float, spacing: float = 1.0) -> DataFrame:
    """Mean, min, max and std of slope and mean aspect per polygon with classes."""
    from ..functions.classify import aspect_direction

    s = slope_aspect(cells, spacing)
    slope = cells_in_polygons(polys, key, rings, s.select("row", "col", F.struct("slope", "aspect").alias("value")), a, tile)
    g = slope.groupBy(key).agg(
        F.avg("value.slope").alias("slope_mean"), F.min("value.slope").alias("slope_min"),
        F.max("value.slope").alias("slope_max"), F.stddev_pop("value.slope").alias("slope_std"),
        F.avg("value.aspect").alias("aspect_mean"),
    )
    out = polys.select(key).join(g, key, "left")
    return out.withColumns({
        "slope_category": named_bin("slope_mean", "land_slope"), "aspect_direction": aspect_direction("aspect_mean"),
    })


def rasterize_lines(lines: DataFrame, coords: str, a: Affine) -> DataFrame:
    """Distinct cells touched by the lines (exact grid traversal per segment)."""
    e = lines.select(F.explode(G.segments(coords)).alias("e")).select("e.*")
    u0, v0 = (F.col("ax") - a.x0) / a.res, (F.lit(a.y0) - F.col("ay")) / a.res
    u1, v1 = (F.col("bx") - a.x0) / a.res, (F.lit(a.y0) - F.col("by")) / a.res
    e = e.select(u0.alias("u0"), v0.alias("v0"), u1.alias("u1"), v1.alias("v1"))

    def crossings(p: str, q: str) -> Column:
        lo, hi = F.least(p, q), F.greatest(p, q)
        ticks = F.when(F.ceil(lo) <= F.floor(hi), F.sequence(F.ceil(lo), F.floor(hi))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.col(p) == F.col(q), F.array().cast("array<double>")).otherwise(
            F.transform(ticks, lambda k: (k - F.col(p)) / (F.col(q) - F.col(p)))
        )

    ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings("u0", "u1"), crossings("v0", "v1"))))
    e = e.withColumn("t", ts)
    mids = F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda p, q: (p + q) / 2)
    m = e.select("u0", "v0", "u1", "v1", F.explode(mids).alias("m"))
    return m.select(
        F.floor(F.col("v0") + F.col("m") * (F.col("v1") - F.col("v0"))).cast("int").alias("row"),
        F.floor(F.col("u0") + F.col("m") * (F.col("u1") - F.col("u0"))).cast("int").alias("col"),
    ).distinct()


def least_squares_from(at: np.ndarray, col: np.ndarray, v2: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``min((at - col)**2 + v2)`` for every place ``at`` and every run ``bounds[i]:bounds[i + 1]`` of ascending ``col``.

    The parabola that is lowest at a place never lies left of the one lowest at a place further left. So the places are
    solved by halving: each looks only at the parabolas between the answers of its two solved neighbours, and a level
    costs as much as there are parabolas and places.
    """
    n = len(at)
    best = np.zeros((len(bounds) - 1, n + 2), dtype=np.int64)  # lowest parabola by place, a fence at either end
    best[:, 0], best[:, n + 1] = bounds[:-1], bounds[1:] - 1
    out = np.zeros((len(bounds) - 1, n), dtype=np.int64)
    step = 1 << n.bit_length() >> 1
    while step:
        mid = np.arange(step, n + 1, 2 * step)
        low = best[:, mid - step].ravel()
        size = best[:, np.minimum(mid + step, n + 1)].ravel() - low + 1
        start = np.cumsum(size) - size
        which = np.repeat(low - start, size) + np.arange(size.sum())
        place = np.repeat(np.tile(at[mid - 1], len(best)), size)
        cost = (place - col[which]) ** 2 + v2[which]
        least = np.minimum.reduceat(cost, start)
        hit = np.flatnonzero(cost == np.repeat(least, size))
        best[:, mid] = which[hit[np.searchsorted(hit, start)]].reshape(len(best), -1)
        out[:, mid - 1] = least.reshape(len(best), -1)
        step >>= 1
    return out


def column_gaps(cells: DataFrame, burned: DataFrame, tall: int = 256) -> DataFrame:
    """Rows to the nearest burned cell of the same column: ``(row, col, v)``, null where a column has none.

    Columns are cut into bands of ``tall`` rows. Only the first and last burned row of each band are carried along the
    column; the rows themselves are scanned band by band, so no task holds a column.
    """
    at = F.when(F.col("b") == 1, F.col("row"))
    marked = cells.select("row", "col").join(burned.select("row", "col").distinct().withColumn("b", F.lit(1)), ["row", "col"], "left")
    marked = marked.select("row", "col", at.alias("at"), F.floor(F.col("row") / tall).alias("band"))
    # the last value up to a row, in either order: frames that end at the last row are rescanned for every row
    past = Window.unboundedPreceding
    bands = marked.groupBy("col", "band").agg(F.min("at").alias("a"), F.max("at").alias("z"))
    by_band = Window.partitionBy("col")
    carried = bands.select(
        "col", "band",
        F.last("z", ignorenulls=True).over(by_band.orderBy("band").rowsBetween(past, -1)).alias("above"),
        F.last("a", ignorenulls=True).over(by_band.orderBy(F.desc("band")).rowsBetween(past, -1)).alias("below"),
    )
    by_row = Window.partitionBy("col", "band")
    up = F.last("at", ignorenulls=True).over(by_row.orderBy("row").rowsBetween(past, 0))
    down = F.last("at", ignorenulls=True).over(by_row.orderBy(F.desc("row")).rowsBetween(past, 0))
    v = marked.join(carried, ["col", "band"]).withColumns({"up": F.coalesce(up, "above"), "down": F.coalesce(down, "below")})
    return v.select("row", "col", F.least(F.col("row") - F.col("up"), F.col("down") - F.col("row")).alias("v"))


def distance_to_burned(cells: DataFrame, burned: DataFrame, res: float, cap: float = 1000.0) -> DataFrame:
    """Exact Euclidean distance to the nearest burned cell, capped: gaps along columns, then parabolas along rows."""
    k = int(cap // res)
    v = column_gaps(cells, burned).where(F.col("v") <= k)
    # along rows in tiles: a cell belongs to its own tile and, within k cells of an edge, to the next one
    wide = max(256, 2 * k)
    tall = max(1, 8192 // wide)
    tiles = F.array_distinct(F.array(*[F.floor((F.col("col") + o) / wide) for o in (-k, 0, k)]))
    parts = v.select("row", "col", "v", F.explode(tiles).alias("tile"), F.floor(F.col("row") / tall).alias("band"))

    def nearest(part: pd.DataFrame) -> pd.DataFrame:
        at = int(part["tile"].iloc[0]) * wide + np.arange(wide)
        row, col, gap = (part[c].to_numpy(np.int64) for c in ("row", "col", "v"))
        order = np.lexsort((col, row))
        row, col, gap = row[order], col[order], gap[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        d2 = least_squares_from(at, col, gap * gap, np.r_[first, len(row)])
        out = pd.DataFrame({"row": np.repeat(row[first], wide), "col": np.tile(at, len(first)), "d2": d2.ravel()})
        return out[out["d2"] <= k * k]

    kinds = {c: cells.schema[c].dataType.simpleString() for c in ("row", "col")}
    near = parts.groupBy("band", "tile").applyInPandas(nearest, f"row {kinds['row']}, col {kinds['col']}, d2 bigint")
    dist = F.least(F.lit(float(cap)), F.sqrt("d2") * res)
    return cells.select("row", "col").join(near, ["row", "col"], "left").select("row", "col", F.coalesce(dist, F.lit(float(cap))).alias("distance"))


def flood_susceptibility(cells: DataFrame, burned: DataFrame, res: float, accumulation: DataFrame | None = None,
                         cap: float = 1000.0, spacing: float = 2.0, sigma: float = 3.0) -> DataFrame:
    """Susceptibility in [0, 1] from elevation, slope, distance to water and (optional) accumulation.

    ``accumulation`` is a sparse ``(row, col, value)`` raster; it is smoothed and scaled by its maximum.
    """
    g = gradient(cells, spacing).withColumn("slope", F.sqrt(F.col("g_row") * F.col("g_row") + F.col("g_col") * F.col("g_col")))
    s = one_row(g, e0=F.min("value"), e1=F.max("value"), s0=F.min("slope"), s1=F.max("slope"))
    d = distance_to_burned(cells, burned, res, cap)
    j = g.join(d, ["row", "col"])
    elev = 1 - (F.col("value") - s["e0"]) / (s["e1"] - s["e0"])
    slope = minmax("slope", s["s0"], s["s1"])
    near = 1 - F.col("distance") / cap
    if accumulation is None:
        index = 0.4 * elev + 0.3 * (1 - slope) + 0.3 * near
    else:
        h = one_row(cells, r=F.max("row") + 1, c=F.max("col") + 1)
        sm = gaussian_smooth(accumulation, h["r"], h["c"], sigma)
        top = one_row(sm, m=F.max("value"))["m"]
        j = j.join(sm.select("row", "col", F.col("value").alias("acc")), ["row", "col"], "left")
        with_acc = 0.3 * elev + 0.2 * (1 - slope) + 0.2 * near + 0.3 * F.coalesce("acc", F.lit(0.0)) / top
        index = F.when(top > 0, with_acc).otherwise(0.4 * elev + 0.3 * (1 - slope) + 0.3 * near)
    return j.select("row", "col", "value", clip01(index).alias("susceptibility"))


# --- fixed values: susceptibility thresholds and risk descriptions by level ------------------------
FLOOD_LEVELS = [(0.7, 1, "Risco Baixo"), (0.8, 2, "Risco Médio"), (0.9, 3, "Risco Alto")]


def flood_zones(cells: DataFrame, thresholds=FLOOD_LEVELS) -> DataFrame:
    """4-neighbour regions of cells at or above each threshold ``(level, description, zone, row, col)``."""
    from .graph import connected_components

    stride = 1 << 31
    flat = cells.select("row", "col", F.explode(F.array(*[
        F.struct(F.lit(lv).alias("level"), F.lit(name).alias("description"), F.lit(float(t)).alias("t"))
        for t, lv, name in thresholds
    ])).alias("z"), "susceptibility").where(F.col("susceptibility") >= F.col("z.t")).select(
        "z.level", "z.description", "row", "col"
    )
    node = (F.col("level") * (1 << 60)) + F.col("row").cast("bigint") * stride + F.col("col")
    n = flat.withColumn("node", node)
    right = n.select("level", "row", (F.col("col") + 1).alias("col"), F.col("node").alias("src"))
    below = n.select("level", (F.col("row") + 1).alias("row"), "col", F.col("node").alias("src"))
    edges = right.unionByName(below).join(n.select("level", "row", "col", F.col("node").alias("dst")), ["level", "row", "col"]).select("src", "dst")
    cc = connected_components(edges, n.select("node"))
    return n.join(cc, "node").select("level", "description", F.col("component").alias("zone"), "row", "col")


def flood_zone_table(zones: DataFrame, res: float) -> DataFrame:
    """One row per zone: level, cells, area in km2, extent in cells."""
    return zones.groupBy("level", "description", "zone").agg(
        F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * res * res / 1e6).alias("area_km2"),
        F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"),
    )


def assign_risk_from_cells(points: DataFrame, zones: DataFrame, key: str, a: Affine, buffer: float = 30.0) -> DataFrame:
    """Highest zone level whose cells come within ``buffer`` of the point; ``Sem risco`` otherwise."""
    k = int(buffer // a.res) + 1
    span = F.sequence(F.lit(-k), F.lit(k))
    p = points.select(key, "x", "y", F.explode(span).alias("dr")).select(
        key, "x", "y", (a.row("y") + F.col("dr")).alias("row"), F.explode(span).alias("dc")
    ).withColumn("col", a.col("x") + F.col("dc"))
    gap_x = F.greatest(F.abs(a.x() - F.col("x")) - a.res / 2, F.lit(0.0))
    gap_y = F.greatest(F.abs(a.y() - F.col("y")) - a.res / 2, F.lit(0.0))
    p = p.where(gap_x * gap_x + gap_y * gap_y <= buffer * buffer)
    z = zones.groupBy("row", "col").agg(F.max(F.struct("level", "description")).alias("z"))
    g = p.join(z, ["row", "col"]).groupBy(key).agg(F.max("z").alias("z"))
    return points.select(key).join(g, key, "left").select(
        key, F.coalesce("z.level", F.lit(0)).alias("risco_inundacao"), F.coalesce("z.description", F.lit("Sem risco")).alias("nivel_risco")
    )
