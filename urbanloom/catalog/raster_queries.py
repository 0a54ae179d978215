"""Queries on the raster table and its combination with layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import hydro as H
from ..operators import profile as P
from ..operators import raster as R
from .registry import query
from .shapes import AFFINE, Shapes
from .table_queries import _bins

_CX, _CY = "(col + 0.5) * 100", "10000 - (\"row\" + 0.5) * 100"
_ZC = f'SELECT zone, z.area, c."row", c.col, value FROM v_zones z JOIN v_cells c ON {_CX} > x0 AND {_CX} < x1 AND {_CY} > y0 AND {_CY} < y1'


@query("raster_profile", "cells min max mean:5 std:5 median:5 nodata_pct:6", "SELECT count(*) AS cells, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std, median(v) AS median, (count(*) - count(v)) / count(*) * 100 AS nodata_pct FROM (SELECT CASE WHEN col <> 7 THEN value END AS v FROM v_cells)")
def raster_profile(s: Shapes):
    return P.raster_profile(R.mask_nodata(s.cells().withColumn("value", F.when(F.col("col") == 7, -9999.0).otherwise(F.col("value"))), -9999.0))


@query("sample_points", "id elevation elevation_top", """SELECT id, value AS elevation, value + height AS elevation_top FROM v_bld LEFT JOIN v_cells ON "row" = floor((10000 - y) / 100) AND col = floor(x / 100)""")
def sample_points(s: Shapes):
    return R.sample_points(s.buildings(), s.cells(), AFFINE, "height")


_LINE = """WITH p AS (SELECT road, ax, ay, qx, qy, len, greatest(10, CAST(floor(len / 80) AS INTEGER)) AS n FROM (SELECT road, c[1].x AS ax, c[1].y AS ay, c[2].x AS qx, c[2].y AS qy, sqrt((c[2].x - c[1].x) ** 2 + (c[2].y - c[1].y) ** 2) AS len FROM v_roads)),
    t AS (SELECT road, len, i, value FROM (SELECT *, unnest(range(n)) AS i FROM p) JOIN v_cells ON "row" = floor((10000 - (ay + (qy - ay) * i / (n - 1))) / 100) AND col = floor((ax + (qx - ax) * i / (n - 1)) / 100)),
    g AS (SELECT road, max(len) AS len, min(value) AS elevation_min, max(value) AS elevation_max, avg(value) AS elevation_mean, abs(arg_max(value, i) - arg_min(value, i)) / max(len) * 100 AS slope_pct FROM t GROUP BY road)"""


@query("sample_lines", "road elevation_min elevation_max elevation_mean:9 elevation_range:8 slope_pct:8 slope_deg:8 slope_class", f"""{_LINE}
--final
SELECT road, elevation_min, elevation_max, elevation_mean, elevation_max - elevation_min AS elevation_range, slope_pct, degrees(atan(slope_pct / 100)) AS slope_deg, {_bins('coalesce(slope_pct, 0)', 'road_slope', incl=True)} AS slope_class FROM v_roads LEFT JOIN g USING (road)""")
def sample_lines(s: Shapes):
    first = F.slice("coords", 1, 2)
    return R.sample_lines(s.roads().withColumn("coords", first), "road", "coords", s.cells(), AFFINE)


@query("zonal_stats", "zone cells elevation_min elevation_max elevation_mean:9 elevation_std:8 elevation_median:9 elevation_percentile_10:9 elevation_percentile_90:9 hypsometric_integral:9", f"""SELECT v_zones.zone, cells, a AS elevation_min, b AS elevation_max, m AS elevation_mean, sd AS elevation_std, med AS elevation_median, q1 AS elevation_percentile_10, q9 AS elevation_percentile_90, CASE WHEN b > a THEN (m - a) / (b - a) WHEN m IS NOT NULL THEN 0.5 END AS hypsometric_integral
    FROM v_zones LEFT JOIN (SELECT zone, count(*) AS cells, min(value) AS a, max(value) AS b, avg(value) AS m, stddev_pop(value) AS sd, median(value) AS med, quantile_cont(value, 0.1) AS q1, quantile_cont(value, 0.9) AS q9 FROM ({_ZC}) GROUP BY zone) g ON g.zone = v_zones.zone""")
def zonal_stats(s: Shapes):
    return R.zonal_stats(s.zones(), "zone", "rings", s.cells(), AFFINE, 500.0)


@query("focal_slope", "erb terrain_slope:5 terrain_slope_class", f"""SELECT s.erb, v AS terrain_slope, {_bins('v', 'building_slope')} AS terrain_slope_class FROM v_stations s LEFT JOIN (SELECT erb, (max(value) - min(value)) / 300 * 100 AS v FROM v_stations JOIN v_cells ON ({_CX} - x) ** 2 + ({_CY} - y) ** 2 <= 22500, (SELECT max("row") AS r1, max(col) AS c1 FROM v_cells)
    WHERE floor((10000 - (y + 150)) / 100) >= 0 AND floor((10000 - (y - 150)) / 100) <= r1 AND floor((x - 150) / 100) >= 0 AND floor((x + 150) / 100) <= c1 GROUP BY erb) g ON g.erb = s.erb""")
def focal_slope(s: Shapes):
    return R.focal_slope(s.stations(), "erb", s.cells(), AFFINE, 150.0)


_GRAD = """SELECT "row", col, value, CASE WHEN ru IS NULL AND rd IS NULL THEN 0 WHEN ru IS NULL THEN rd - value WHEN rd IS NULL THEN value - ru ELSE (rd - ru) / 2 END AS g_row, CASE WHEN cl IS NULL AND cr IS NULL THEN 0 WHEN cl IS NULL THEN cr - value WHEN cr IS NULL THEN value - cl ELSE (cr - cl) / 2 END AS g_col
    FROM (SELECT *, lag(value) OVER (PARTITION BY col ORDER BY "row") AS ru, lead(value) OVER (PARTITION BY col ORDER BY "row") AS rd, lag(value) OVER (PARTITION BY "row" ORDER BY col) AS cl, lead(value) OVER (PARTITION BY "row" ORDER BY col) AS cr FROM v_cells)"""


@query("gradient", "row col g_row:6 g_col:6", _GRAD)
def gradient(s: Shapes):
    return R.gradient(s.cells())


@query("slope_aspect", "row col slope:6 aspect:5", f'SELECT "row", col, degrees(atan(sqrt(g_row * g_row + g_col * g_col))) AS slope, (degrees(atan2(-g_row, g_col)) + 360) % 360 AS aspect FROM ({_GRAD})')
def slope_aspect(s: Shapes):
    return R.slope_aspect(s.cells())


@query("zonal_slope", "zone slope_mean:5 slope_min:5 slope_max:5 slope_std:5 aspect_mean:4 slope_category", f"""SELECT v_zones.zone, slope_mean, slope_min, slope_max, slope_std, aspect_mean, {_bins('slope_mean', 'land_slope')} AS slope_category FROM v_zones LEFT JOIN (SELECT zone, avg(s) AS slope_mean, min(s) AS slope_min, max(s) AS slope_max, stddev_pop(s) AS slope_std, avg(a) AS aspect_mean
    FROM v_zones z JOIN (SELECT "row", col, degrees(atan(sqrt(g_row * g_row + g_col * g_col))) AS s, (degrees(atan2(-g_row, g_col)) + 360) % 360 AS a FROM ({_GRAD})) ON {_CX} > x0 AND {_CX} < x1 AND {_CY} > y0 AND {_CY} < y1 GROUP BY zone) g ON g.zone = v_zones.zone""")
def zonal_slope(s: Shapes):
    return R.zonal_slope(s.zones(), "zone", "rings", s.cells(), AFFINE, 500.0)


def _burned(s: Shapes):
    """Stations rows as water: a horizontal line along y of every station over 2 km."""
    line = F.array(G.point("x", F.col("y") + 0.5), G.point(F.col("x") + 2000, F.col("y") + 0.5))
    return R.rasterize_lines(s.stations().select(line.alias("coords")), "coords", AFFINE)


_BURN = """SELECT DISTINCT CAST(floor((10000 - (y + 0.5)) / 100) AS INTEGER) AS "row", CAST(i AS INTEGER) AS col FROM v_stations, LATERAL (SELECT unnest(range(CAST(floor(x / 100) AS BIGINT), CAST(ceil((x + 2000) / 100) AS BIGINT))) AS i)"""


@query("rasterize_lines", "row col", _BURN)
def rasterize_lines(s: Shapes):
    return _burned(s)


_DIST = f"""SELECT c."row", c.col, least(1000, coalesce(min(sqrt((c."row" - b."row") ** 2 + (c.col - b.col) ** 2)) * 100, 1000)) AS distance FROM v_cells c LEFT JOIN (SELECT b.* FROM ({_BURN}) b JOIN v_cells k ON k."row" = b."row" AND k.col = b.col) b ON abs(c."row" - b."row") <= 10 AND abs(c.col - b.col) <= 10 GROUP BY ALL"""


@query("distance_to_burned", "row col distance:5", _DIST)
def distance_to_burned(s: Shapes):
    return R.distance_to_burned(s.cells(), _burned(s), 100.0)


_SUSC = f"""SELECT "row", col, greatest(0, least(1, 0.4 * (1 - (value - e0) / (e1 - e0)) + 0.3 * (1 - (sl - s0) / (s1 - s0)) + 0.3 * (1 - distance / 1000))) AS susceptibility FROM (SELECT *, min(value) OVER () AS e0, max(value) OVER () AS e1, min(sl) OVER () AS s0, max(sl) OVER () AS s1 FROM (SELECT "row", col, value, sqrt((g_row / 2) ** 2 + (g_col / 2) ** 2) AS sl FROM ({_GRAD})) JOIN ({_DIST}) USING ("row", col))"""


def _susceptibility(s: Shapes):
    return R.flood_susceptibility(s.cells(), _burned(s), 100.0)


@query("flood_susceptibility", "row col susceptibility:7", _SUSC)
def flood_susceptibility(s: Shapes):
    return _susceptibility(s)


@query("flood_susceptibility_accumulation", "cells low high", "SELECT count(*) AS cells, true AS low, true AS high FROM v_cells")
def flood_susceptibility_accumulation(s: Shapes):
    acc = s.cells().select("row", "col", (F.col("value") - 500).alias("value"))
    f = R.flood_susceptibility(s.cells(), _burned(s), 100.0, acc)
    return f.agg(F.count("susceptibility").alias("cells"), (F.min("susceptibility") >= 0).alias("low"), (F.max("susceptibility") <= 1).alias("high"))


_LEVELS = ((0.6, 1, "Risco Baixo"), (0.7, 2, "Risco Médio"), (0.8, 3, "Risco Alto"))


@query("flood_zones", "level cells zones", f"""WITH RECURSIVE f AS MATERIALIZED (SELECT level, "row", col, level * 100000000 + "row" * 1000 + col AS n FROM ({_SUSC}), (VALUES (0.6, 1), (0.7, 2), (0.8, 3)) t(th, level) WHERE susceptibility >= th),
    l AS (SELECT a.n AS a, b.n AS b FROM f a JOIN f b ON a.level = b.level AND abs(a."row" - b."row") + abs(a.col - b.col) = 1),
    cc(n, c) USING KEY (n) AS (SELECT n, n FROM f UNION SELECT l.b, min(cc.c) FROM cc JOIN l ON l.a = cc.n JOIN recurring.cc r ON r.n = l.b WHERE cc.c < r.c GROUP BY l.b)
--final
SELECT level, CAST(count(*) AS BIGINT) AS cells, count(DISTINCT c) AS zones FROM cc JOIN f USING (n) GROUP BY level""")
def flood_zones(s: Shapes):
    z = R.flood_zones(_susceptibility(s), _LEVELS)
    t = R.flood_zone_table(z, 100.0)
    return t.groupBy("level").agg(F.sum("cells").alias("cells"), F.count(F.lit(1)).alias("zones"))


@query("assign_risk_from_cells", "id risco_inundacao nivel_risco", f"""WITH f AS (SELECT "row", col, max(level) AS level FROM ({_SUSC}), (VALUES (0.6, 1), (0.7, 2), (0.8, 3)) t(th, level) WHERE susceptibility >= th GROUP BY ALL)
--final
SELECT b.id, CAST(coalesce(max(level), 0) AS INTEGER) AS risco_inundacao, CASE coalesce(max(level), 0) WHEN 0 THEN 'Sem risco' WHEN 1 THEN 'Risco Baixo' WHEN 2 THEN 'Risco Médio' ELSE 'Risco Alto' END AS nivel_risco FROM v_bld b LEFT JOIN f ON greatest(abs({_CX} - b.x) - 50, 0) ** 2 + greatest(abs({_CY} - b.y) - 50, 0) ** 2 <= 900 GROUP BY b.id""")
def assign_risk_from_cells(s: Shapes):
    return R.assign_risk_from_cells(s.buildings(), R.flood_zones(_susceptibility(s), _LEVELS), "id", AFFINE, 30.0)


_NATURE = f"""WITH g AS (SELECT zone, min(value) AS a, max(value) AS b, avg(value) AS m, stddev_pop(value) AS sd, median(value) AS med, quantile_cont(value, 0.1) AS q1, quantile_cont(value, 0.9) AS q9 FROM ({_ZC}) GROUP BY zone),
    k AS (SELECT *, CASE WHEN b > a THEN CASE WHEN (med - a) / (b - a) < 0.4 THEN -1 WHEN (med - a) / (b - a) > 0.6 THEN 1 ELSE 0 END END::DOUBLE AS pr, (rank() OVER (ORDER BY m) - 1 + count(*) OVER (ORDER BY m) + 1) * 50.0 / count(*) OVER () AS pc, max(m) OVER () AS mm, max(sd) OVER () AS ms, max(b - a) OVER () AS mr, (SELECT quantile_cont(m, 0.25) FROM g) AS q25 FROM g),
    r AS (SELECT *, m / mm * 0.4 + sd / ms * 0.4 + (b - a) / mr * 0.2 AS epi FROM k)"""


@query("nature_indices", "zone relief_class terrain_profile exposure_index:7 elevation_percentile:6 elevation_zone hydrological_relevance:6 ecological_protection_index:6 ecological_protection_category", f"""{_NATURE}
--final
SELECT v_zones.zone, {_bins('(b - a)', 'relief')} AS relief_class, pr AS terrain_profile, CASE WHEN m > 0 THEN (q9 - q1) / m END AS exposure_index, pc AS elevation_percentile, {_bins('m', 'elevation_zone')} AS elevation_zone,
    CASE WHEN m <= q25 THEN 0.5 ELSE 0.5 * (1 - (m - q25) / (mm - q25)) END + 0.25 * (1 - sd / ms) + CASE pr WHEN -1 THEN 0.25 WHEN 0 THEN 0.125 ELSE 0 END AS hydrological_relevance, epi AS ecological_protection_index, {_bins('coalesce(epi, 0)', 'eco')} AS ecological_protection_category FROM v_zones LEFT JOIN r ON r.zone = v_zones.zone""")
def nature_indices(s: Shapes):
    from ..scale import cut_lineage

    return H.nature_indices(cut_lineage(R.zonal_stats(s.zones(), "zone", "rings", s.cells(), AFFINE, 500.0)))


@query("basin_terrain", "zone basin_age_class terrain_ruggedness_class topographic_wetness_index:6 moisture_potential", f"""WITH g AS (SELECT zone, max(area) AS area, min(value) AS a, max(value) AS b, avg(value) AS m, stddev_pop(value) AS sd FROM ({_ZC}) GROUP BY zone), h AS (SELECT *, CASE WHEN b > a THEN (m - a) / (b - a) ELSE 0.5 END AS hi FROM g),
    t AS (SELECT *, CASE WHEN b - a <> 0 AND hi <> 0 THEN ln(area / tan(greatest(atan((b - a) / (2 * sqrt(area / pi()))) * (1 + hi), 0.001))) END AS twi FROM h), q AS (SELECT quantile_cont(sd, [0.25, 0.75]) AS qs, quantile_cont(twi, [0.25, 0.75]) AS qt FROM t)
--final
SELECT v_zones.zone, CASE WHEN hi < 0.35 THEN 'Antiga/Plana' WHEN hi <= 0.6 THEN 'Madura/Equilibrada' WHEN hi > 0.6 THEN 'Jovem/Montanhosa' ELSE 'Indeterminada' END AS basin_age_class, CASE WHEN sd IS NULL THEN 'Indeterminada' WHEN sd < qs[1] THEN 'Baixa Rugosidade' WHEN sd <= qs[2] THEN 'Rugosidade Média' ELSE 'Alta Rugosidade' END AS terrain_ruggedness_class,
    twi AS topographic_wetness_index, CASE WHEN twi IS NULL THEN 'Indeterminado' WHEN twi < qt[1] THEN 'Baixo Potencial de Umidade' WHEN twi <= qt[2] THEN 'Médio Potencial de Umidade' ELSE 'Alto Potencial de Umidade' END AS moisture_potential FROM v_zones LEFT JOIN t ON t.zone = v_zones.zone, q""")
def basin_terrain(s: Shapes):
    from ..scale import cut_lineage

    z = cut_lineage(R.zonal_stats(s.zones(), "zone", "rings", s.cells(), AFFINE, 500.0).drop("hypsometric_integral"))
    return H.basin_terrain(z.join(s.zones().select("zone", "area"), "zone"), "area")


@query("elevation_drop", "springs:4 outlets:4 drop:4", """SELECT avg(value) FILTER (k = 0) AS springs, avg(value) FILTER (k = 1) AS outlets, avg(value) FILTER (k = 0) - avg(value) FILTER (k = 1) AS drop FROM (SELECT erb % 2 AS k, value FROM v_stations LEFT JOIN v_cells ON "row" = floor((10000 - y) / 100) AND col = floor(x / 100))""")
def elevation_drop(s: Shapes):
    n = R.sample_points(s.stations(), s.cells(), AFFINE).withColumn("type", F.when(F.col("erb") % 2 == 0, "spring").otherwise("outlet"))
    return H.elevation_drop(n)


@query("cells_in_polygons", "zone n total:3", f"SELECT zone, count(*) AS n, sum(value) AS total FROM ({_ZC}) GROUP BY zone")
def cells_in_polygons(s: Shapes):
    return R.cells_in_polygons(s.zones(), "zone", "rings", s.cells(), AFFINE, 500.0).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


