"""Queries joining layers by location and distance, grids and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..functions import geometry as G

from ..operators import cluster as CL
from ..operators import grid as GD

from ..operators import spatial as S
from ..operators import telecom as TE

from ..plans.enrich import planar_sector
from .registry import query
from .shapes import Shapes, _px, _py
from .table_queries import _bins

_IN = "b.x > z.x0 AND b.x < z.x1 AND b.y > z.y0 AND b.y < z.y1"
_MEET = "b.x0 <= z.x1 AND z.x0 <= b.x1 AND b.y0 <= z.y1 AND z.y0 <= b.y1"
_OV = "(least(b.x1, z.x1) - greatest(b.x0, z.x0)) * (least(b.y1, z.y1) - greatest(b.y0, z.y0))"


def _points(s: Shapes):
    """Building centres as a point layer."""
    return S.point_box(s.buildings().select("id", "kind", "landuse", "area", "height", "x", "y"))


@query("spatial_join_within", "id zone", f"SELECT id, zone FROM v_bld b LEFT JOIN v_zones z ON {_IN}")
def spatial_join_within(s: Shapes):
    return S.spatial_join(_points(s), s.zones(), "id", 500.0, S.point_within(), ["zone"])


@query("spatial_join_intersects", "id zone landuse", f"SELECT id, zone, z.landuse FROM v_bld b JOIN v_zones z ON {_MEET}")
def spatial_join_intersects(s: Shapes):
    b = s.buildings().select("id", "rings", *S.BOX)
    return S.spatial_join(b, s.zones(), "id", 500.0, S.polygons_meet(), ["zone", "landuse"], "inner")


@query("spatial_join_contains", "zone n", f"SELECT zone, count(*) AS n FROM v_zones z JOIN v_bld b ON b.x0 >= z.x0 AND b.x1 <= z.x1 AND b.y0 >= z.y0 AND b.y1 <= z.y1 GROUP BY zone")
def spatial_join_contains(s: Shapes):
    p = S.spatial_pairs(s.zones().select("zone", "rings", *S.BOX), s.buildings().select("id", "rings", *S.BOX), 500.0, S.polygon_covers())
    return p.groupBy(F.col("l_zone").alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query("spatial_join_lines", "road sector", """SELECT DISTINCT road, sector FROM v_segs, v_sectors WHERE least(ax, qx) <= x1 AND greatest(ax, qx) >= x0 AND least(ay, qy) <= y1 AND greatest(ay, qy) >= y0
    AND (((ax BETWEEN x0 AND x1) AND (ay BETWEEN y0 AND y1)) OR ((qx BETWEEN x0 AND x1) AND (qy BETWEEN y0 AND y1))
    OR (ax <> qx AND ((x0 - ax) / (qx - ax) BETWEEN 0 AND 1) AND (ay + (x0 - ax) / (qx - ax) * (qy - ay) BETWEEN y0 AND y1)) OR (ax <> qx AND ((x1 - ax) / (qx - ax) BETWEEN 0 AND 1) AND (ay + (x1 - ax) / (qx - ax) * (qy - ay) BETWEEN y0 AND y1)))""")
def spatial_join_lines(s: Shapes):
    return S.spatial_pairs(s.boxed_roads().select("road", "coords", *S.BOX), s.sectors(), 2002.0, S.line_meets_polygon()).select(F.col("l_road").alias("road"), F.col("r_sector").alias("sector"))


@query("filter_aoi", "id", f"SELECT id FROM v_bld b WHERE EXISTS (SELECT 1 FROM v_zones z WHERE z.landuse = 'industrial' AND {_MEET})")
def filter_aoi(s: Shapes):
    return S.filter_aoi(s.buildings().select("id", "rings", *S.BOX), s.zones().where("landuse = 'industrial'"), S.polygons_meet(), 500.0, "id").select("id")


@query("filter_aoi_empty", "mode n", "SELECT 'keep' AS mode, count(*) AS n FROM v_bld UNION ALL SELECT 'empty', 0")
def filter_aoi_empty(s: Shapes):
    far = s.zones().withColumns({"minx": F.col("minx") + 1e6, "maxx": F.col("maxx") + 1e6})
    b = s.buildings().select("id", "rings", *S.BOX)
    out = [S.filter_aoi(b, far, S.polygons_meet(), 1000.0, "id", m).agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("mode"), "n") for m in ("keep", "empty")]
    return out[0].unionByName(out[1])


@query("prepare_overlay", "outside n", """SELECT count(*) FILTER (NOT (b.x0 <= e.x1 AND e.x0 <= b.x1 AND b.y0 <= e.y1 AND e.y0 <= b.y1)) AS outside, count(*) AS n FROM v_bld b, (SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM v_zones) e""")
def prepare_overlay(s: Shapes):
    from ..scale import one_row

    e = one_row(s.zones(), x0=F.min("minx"), y0=F.min("miny"), x1=F.max("maxx"), y1=F.max("maxy"))
    meet = (F.col("minx") <= e["x1"]) & (e["x0"] <= F.col("maxx")) & (F.col("miny") <= e["y1"]) & (e["y0"] <= F.col("maxy"))
    return s.buildings().agg(F.count_if(~meet).alias("outside"), F.count(F.lit(1)).alias("n"))


@query("spatial_join_fallback", "id zone", f"""WITH w AS (SELECT id, zone FROM v_bld b JOIN v_zones z ON b.x0 > z.x0 AND b.x1 < z.x1 AND b.y0 > z.y0 AND b.y1 < z.y1)
, rest AS (SELECT * FROM v_bld WHERE id NOT IN (SELECT id FROM w)), u AS (SELECT (SELECT count(*) FROM rest) / (SELECT count(*) FROM v_bld)::DOUBLE > 0.05 AS use)
--final
SELECT id, zone FROM w UNION ALL SELECT id, zone FROM rest b JOIN v_zones z ON {_MEET} WHERE (SELECT use FROM u) UNION ALL SELECT id, NULL FROM rest WHERE NOT (SELECT use FROM u)""")
def spatial_join_fallback(s: Shapes):
    b = s.buildings().select("id", "ring", "rings", *S.BOX)
    return S.join_with_fallback(b, s.zones(), "id", 500.0, ["zone"], S.polygon_inside(), S.polygons_meet(), drop_unmatched=True).select("id", "zone")


@query("resolve_multi_match", "id zone overlap:4", f"""SELECT id, zone, overlap FROM (SELECT id, zone, {_OV} AS overlap, row_number() OVER (PARTITION BY id ORDER BY {_OV} DESC, zone) AS r FROM v_bld b JOIN v_zones z ON b.x0 < z.x1 AND z.x0 < b.x1 AND b.y0 < z.y1 AND z.y0 < b.y1) WHERE r = 1""")
def resolve_multi_match(s: Shapes):
    p = S.overlap_pairs(s.buildings().select("id", "ring", *S.BOX), s.zones().select("zone", "ring", *S.BOX), 500.0)
    p = p.select(F.col("l_id").alias("id"), F.col("r_zone").alias("zone"), F.round("overlap", 6).alias("overlap"))
    return S.resolve_multi_match(p, "id", "zone", "overlap")


@query("overlap_area_join", "sector zone overlap:3", f"SELECT sector, zone, {_OV} AS overlap FROM v_sectors b JOIN v_zones z ON b.x0 < z.x1 AND z.x0 < b.x1 AND b.y0 < z.y1 AND z.y0 < b.y1")
def overlap_area_join(s: Shapes):
    p = S.overlap_pairs(s.sectors().select("sector", "ring", *S.BOX), s.zones().select("zone", "ring", *S.BOX), 1000.0)
    return p.select(F.col("l_sector").alias("sector"), F.col("r_zone").alias("zone"), "overlap")


@query("overlapping_features", "zone partners overlap:3", f"SELECT b.zone, count(*) AS partners, sum({_OV}) AS overlap FROM v_zones b JOIN v_zones z ON b.zone <> z.zone AND b.x0 < z.x1 AND z.x0 < b.x1 AND b.y0 < z.y1 AND z.y0 < b.y1 GROUP BY b.zone")
def overlapping_features(s: Shapes):
    return S.overlapping_features(s.zones().select("zone", "ring", *S.BOX), "zone", 500.0)


@query("cross_layer_links", "links", f"SELECT count(*) AS links FROM v_bld b JOIN v_zones z ON {_MEET}")
def cross_layer_links(s: Shapes):
    return S.cross_layer_links(s.buildings().select("id", "rings", *S.BOX), s.zones(), 500.0, S.polygons_meet())


@query("unmatched", "id", f"SELECT id FROM v_bld b WHERE NOT EXISTS (SELECT 1 FROM v_zones z WHERE {_IN})")
def unmatched(s: Shapes):
    p = _points(s)
    hit = S.spatial_pairs(p, s.zones(), 500.0, S.point_within()).select(F.col("l_id").alias("id"))
    return S.unmatched(p, hit, "id").select("id")




@query("nearest_join", "id erb distance:5", """SELECT id, erb, d AS distance FROM (SELECT id, erb, sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2) AS d, row_number() OVER (PARTITION BY id ORDER BY sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2), erb) AS r FROM v_customers c, v_stations s) WHERE r = 1""")
def nearest_join(s: Shapes):
    return S.nearest_join(s.customers(), s.stations(), "id", "erb")


@query("nearest_join_bounded", "id erb distance:5 near", """SELECT id, CASE WHEN d <= 400 THEN erb END AS erb, CASE WHEN d <= 400 THEN d END AS distance, coalesce(CASE WHEN d <= 400 THEN d < 100 END, false) AS near FROM (SELECT id, erb, sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2) AS d, row_number() OVER (PARTITION BY id ORDER BY sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2), erb) AS r FROM v_customers c, v_stations s) WHERE r = 1""")
def nearest_join_bounded(s: Shapes):
    n = S.nearest_join(s.customers(), s.stations(), "id", "erb", max_dist=400.0)
    return n.withColumn("near", F.coalesce(F.col("distance") < 100, F.lit(False)))


@query("nearest_neighbour", "erb neighbour distance:5", """SELECT erb, nb AS neighbour, d AS distance FROM (SELECT a.erb, b.erb AS nb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY a.erb ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.erb) AS r FROM v_stations a, v_stations b WHERE a.erb <> b.erb) WHERE r = 1""")
def nearest_neighbour(s: Shapes):
    a = s.stations().select("erb", "x", "y")
    return S.nearest_join(a, a.withColumnRenamed("erb", "neighbour"), "erb", "neighbour", self_join=True)


_PSD = """sqrt((p.x - (ax + t * (qx - ax))) ** 2 + (p.y - (ay + t * (qy - ay))) ** 2)"""
_PST = "greatest(0, least(1, CASE WHEN (qx - ax) ** 2 + (qy - ay) ** 2 > 0 THEN ((p.x - ax) * (qx - ax) + (p.y - ay) * (qy - ay)) / ((qx - ax) ** 2 + (qy - ay) ** 2) ELSE 0 END))"


def _near_sql(points: str, key: str, d: float) -> str:
    return f"""SELECT *, {_PSD} AS dist FROM (SELECT p.*, g.road, g.highway, ax, ay, qx, qy, {_PST} AS t FROM {points} p JOIN v_segs g ON least(ax, qx) <= p.x + {d} AND greatest(ax, qx) >= p.x - {d} AND least(ay, qy) <= p.y + {d} AND greatest(ay, qy) >= p.y - {d}) p WHERE {_PSD} <= {d}"""


@query("nearest_line", "erb road highway distance:5 road_accessibility near_road", f"""SELECT erb, road, highway, dist AS distance, {_bins('dist', 'road_access')} AS road_accessibility, coalesce(dist <= 20, false) AS near_road FROM v_stations LEFT JOIN (SELECT erb, road, highway, dist, row_number() OVER (PARTITION BY erb ORDER BY round(dist, 7), road) AS r FROM ({_near_sql('v_stations', 'erb', 50)})) USING (erb) WHERE coalesce(r, 1) = 1""")
def nearest_line(s: Shapes):
    return S.nearest_line(s.stations().select("erb", "x", "y"), s.roads(), "erb", "road", "coords", 50.0, ["highway"], near=20.0)


@query("nearest_sampled", "erb close", f"""SELECT s.erb, coalesce(min(dist), 1e9) <= 60 AS close FROM v_stations s LEFT JOIN ({_near_sql('v_stations', 'erb', 60)}) n ON n.erb = s.erb GROUP BY s.erb""")
def nearest_sampled(s: Shapes):
    # n = max(2, int(L / 10)) samples leave gaps below 30 m, so the nearest sample is within 15 m along the line
    exact = S.nearest_line(s.stations().select("erb", "x", "y"), s.roads(), "erb", "road", "coords", 60.0).select("erb", F.col("distance").alias("d"))
    n = S.nearest_sampled(s.stations().select("erb", "x", "y"), s.roads(), "erb", "road", "coords", 10.0).join(exact, "erb")
    ok = F.when(F.col("d").isNull(), F.col("distance") > 60).otherwise((F.col("distance") >= F.col("d") - 1e-6) & (F.col("distance") <= F.sqrt(F.col("d") * F.col("d") + 225) + 1e-6))
    return n.where(ok).select("erb", F.col("d").isNotNull().alias("close"))


@query("neighbour_isolation", "id distance:5 isolation_category", f"""WITH k AS (SELECT a.id, a.x, a.y, count(*) AS n FROM v_customers a JOIN v_customers b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 40000 GROUP BY ALL),
    m AS (SELECT a.id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM k a, k b WHERE a.n < 3 AND b.n >= 3 GROUP BY a.id)
--final
SELECT id, d AS distance, {_bins('d', 'isolation')} AS isolation_category FROM m""")
def neighbour_isolation(s: Shapes):
    c = s.customers().select("id", "x", "y")
    k = S.within_radius_counts(c, c, "id", 200.0).join(c, "id")
    return S.neighbour_isolation(k.where("count < 3"), k.where("count >= 3").withColumnRenamed("id", "other"), "id", "other")


@query("density_within", "id neighbours", "SELECT a.id, count(*) - 1 AS neighbours FROM v_customers a JOIN v_customers b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1000000 GROUP BY a.id")
def density_within(s: Shapes):
    return S.density_within(s.customers(), "id", 1000.0)


@query("within_radius_counts", "erb count", "SELECT a.erb, count(b.id) AS count FROM v_stations a LEFT JOIN v_customers b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 250000 GROUP BY a.erb")
def within_radius_counts(s: Shapes):
    return S.within_radius_counts(s.stations(), s.customers(), "erb", 500.0)


_DISC = """SELECT erb, sum(CASE WHEN a > 0 AND d > 0 AND t1 > t0 THEN (t1 - t0) * sqrt(a) ELSE 0 END) AS len FROM (SELECT *, greatest(0, (-b - sqrt(greatest(d, 0))) / (2 * a)) AS t0, least(1, (-b + sqrt(greatest(d, 0))) / (2 * a)) AS t1
    FROM (SELECT *, b * b - 4 * a * k AS d FROM (SELECT erb, (qx - ax) ** 2 + (qy - ay) ** 2 AS a, 2 * ((ax - x) * (qx - ax) + (ay - y) * (qy - ay)) AS b, (ax - x) ** 2 + (ay - y) ** 2 - 250000 AS k FROM v_stations JOIN v_segs ON least(ax, qx) <= x + 500 AND greatest(ax, qx) >= x - 500 AND least(ay, qy) <= y + 500 AND greatest(ay, qy) >= y - 500))) GROUP BY erb"""


@query("line_density_within", "erb road_density:6 urban_integration", f"SELECT erb, v AS road_density, {_bins('v', 'integration')} AS urban_integration FROM (SELECT erb, coalesce(len, 0) / 1000 / (pi() * 0.25) AS v FROM v_stations LEFT JOIN ({_DISC}) USING (erb))")
def line_density_within(s: Shapes):
    return S.line_density_within(s.stations().select("erb", "x", "y"), s.roads(), "erb", "road", "coords", 500.0)


@query("station_accessibility", "road accessible min_distance:5 stations", f"SELECT r.road, min(dist) IS NOT NULL AS accessible, min(dist) AS min_distance, count(DISTINCT erb) AS stations FROM v_roads r LEFT JOIN ({_near_sql('v_stations', 'erb', 150)}) n ON n.road = r.road GROUP BY r.road")
def station_accessibility(s: Shapes):
    return S.station_accessibility(s.stations(), s.roads(), "erb", "road", "coords", 150.0)


@query("sample_stations", "street seq x:4 y:4", f"""SELECT street, CAST(i AS INTEGER) AS seq, ax + (qx - ax) * i / 2 AS x, ay + (qy - ay) * i / 2 AS y FROM (SELECT street, {_px('src')} AS ax, {_py('src')} AS ay, {_px('dst')} AS qx, {_py('dst')} AS qy FROM v_streets), (SELECT unnest([0, 1, 2]) AS i)
    WHERE sqrt((qx - ax) ** 2 + (qy - ay) ** 2) > 10000""")
def sample_stations(s: Shapes):
    return S.sample_stations(s.street_lines(), "street", "coords", 10_000.0)


@query("context_mean_mode", "road pop:4 region", """WITH p AS (SELECT DISTINCT road, sector, pop, region FROM v_segs, v_sectors WHERE ax BETWEEN x0 AND x1 AND ay BETWEEN y0 AND y1),
    m AS (SELECT road, region, row_number() OVER (PARTITION BY road ORDER BY count(*) DESC, region) AS r FROM p GROUP BY road, region), a AS (SELECT road, avg(pop) AS pop FROM p GROUP BY road)
--final
SELECT v_roads.road, pop, region FROM v_roads LEFT JOIN a ON a.road = v_roads.road LEFT JOIN m ON m.road = v_roads.road AND r = 1""")
def context_mean_mode(s: Shapes):
    starts = s.roads().select("road", F.explode(G.segments("coords")).alias("e")).select("road", F.col("e.ax").alias("x"), F.col("e.ay").alias("y"))
    p = S.spatial_pairs(S.point_box(starts), s.sectors(), 2002.0, S.point_touches()).select(
        F.col("l_road").alias("road"), F.col("r_sector").alias("sector"), F.col("r_pop").alias("pop"), F.col("r_region").alias("region")).distinct()
    return S.context_mean_mode(s.roads(), "road", p, ["pop"], ["region"])


@query("context_landuse", "road landuse", f"""SELECT v_roads.road, coalesce(landuse, 'unknown') AS landuse FROM v_roads LEFT JOIN (SELECT road, landuse, row_number() OVER (PARTITION BY road ORDER BY count(*) DESC, landuse) AS r FROM (SELECT DISTINCT road, id, landuse FROM ({_near_sql('(SELECT id, x, y, landuse FROM v_bld WHERE landuse IS NOT NULL)', 'id', 100)})) GROUP BY road, landuse) m ON m.road = v_roads.road AND r = 1""")
def context_landuse(s: Shapes):
    return S.context_landuse(s.roads(), _points(s).where(F.col("landuse").isNotNull()), "id", "road", "coords", "landuse", 100.0)


@query("context_buildings", "road building_count building_density_ha:6 avg_area:4 avg_height:5", f"""SELECT r.road, coalesce(n, 0) AS building_count, coalesce(n / ((100 * r.len + pi() * 2500) / 10000), 0) AS building_density_ha, coalesce(a, 0) AS avg_area, coalesce(h, 0) AS avg_height
    FROM v_roadlen r LEFT JOIN (SELECT road, count(*) AS n, avg(area) AS a, avg(height) AS h FROM (SELECT DISTINCT road, id, area, height FROM ({_near_sql('(SELECT id, x, y, area, height FROM v_bld)', 'id', 50)})) GROUP BY road) g ON g.road = r.road""")
def context_buildings(s: Shapes):
    return S.context_buildings(s.roads(), _points(s), "id", "road", "coords", 50.0)


@query("polygon_adjacency", "id1 id2 shared_edges", "SELECT a.sector AS id1, b.sector AS id2, 1::BIGINT AS shared_edges FROM v_sectors a JOIN v_sectors b ON a.sector < b.sector AND ((a.x1 = b.x0 AND a.y0 = b.y0) OR (a.y1 = b.y0 AND a.x0 = b.x0))")
def polygon_adjacency(s: Shapes):
    return S.polygon_adjacency(s.sectors(), "sector", "ring")


_ADJ = "SELECT a.region AS r1, b.region AS r2 FROM v_sectors a JOIN v_sectors b ON a.sector < b.sector AND ((a.x1 = b.x0 AND a.y0 = b.y0) OR (a.y1 = b.y0 AND a.x0 = b.x0))"


@query("adjacency_matrix", "a b n", f"SELECT a, b, count(*) AS n FROM (SELECT r1 AS a, r2 AS b FROM ({_ADJ}) UNION ALL SELECT r2, r1 FROM ({_ADJ})) GROUP BY ALL")
def adjacency_matrix(s: Shapes):
    return S.adjacency_matrix(S.polygon_adjacency(s.sectors(), "sector", "ring", ["region"]), "region")


@query("interspersion_index", "region iji:6", f"""SELECT region, coalesce(iji, 0) AS iji FROM (SELECT DISTINCT region FROM v_sectors) LEFT JOIN (SELECT a, -sum(p * ln(p)) * 100 / ln((SELECT count(DISTINCT region) FROM v_sectors) - 1) AS iji FROM (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS p FROM (SELECT a, b, count(*) AS n FROM (SELECT r1 AS a, r2 AS b FROM ({_ADJ}) UNION ALL SELECT r2, r1 FROM ({_ADJ})) GROUP BY ALL)) WHERE a <> b GROUP BY a) ON a = region""")
def interspersion_index(s: Shapes):
    z = s.sectors()
    return S.interspersion_index(S.adjacency_matrix(S.polygon_adjacency(z, "sector", "ring", ["region"]), "region"), z, "region")


@query("lines_overlapping_union", "sector", "SELECT DISTINCT sector FROM (SELECT a.sector FROM v_sectors a JOIN v_sectors b ON a.sector <> b.sector AND ((a.x1 = b.x0 AND a.y0 = b.y0) OR (a.y1 = b.y0 AND a.x0 = b.x0) OR (b.x1 = a.x0 AND a.y0 = b.y0) OR (b.y1 = a.y0 AND a.x0 = b.x0)))")
def lines_overlapping_union(s: Shapes):
    return S.shared_segments(s.sectors(), "sector", "ring")


@query("edge_endpoint_join", "street bal_orig:4 bal_dest:4 delta_bal:4 rel_delta_bal:6", """SELECT street, a.c_acctbal AS bal_orig, b.c_acctbal AS bal_dest, b.c_acctbal - a.c_acctbal AS delta_bal, (b.c_acctbal - a.c_acctbal) / (a.c_acctbal + 1e-6) AS rel_delta_bal FROM v_streets LEFT JOIN customer a ON a.c_custkey = src LEFT JOIN customer b ON b.c_custkey = dst""")
def edge_endpoint_join(s: Shapes):
    return S.edge_endpoint_join(s.streets(), s.customers(), "id", ["bal"])


# ---- grids -----------------------------------------------------------------------------------------------

_CELLS = "SELECT b.*, cx, cy FROM v_bld b, LATERAL (SELECT unnest(range(CAST(floor(x0 / 100) AS BIGINT), CAST(floor(x1 / 100) AS BIGINT) + 1)) AS cx), LATERAL (SELECT unnest(range(CAST(floor(y0 / 100) AS BIGINT), CAST(floor(y1 / 100) AS BIGINT) + 1)) AS cy)"
_MORPH = f"""SELECT cx, cy, count(*) AS building_count, sum(area) / 10000 AS building_coverage_ratio, sum(area * levels) / 10000 AS floor_area_ratio, avg(height) AS avg_height, coalesce(stddev_samp(height), 0) AS height_std, count(*)::DOUBLE AS building_density,
    avg(area * height) AS avg_volume FROM ({_CELLS}) GROUP BY cx, cy"""
_SHAN = f"SELECT cx, cy, -sum(c / t * ln(c / t)) + 0.0 AS shannon_diversity, arg_min(kind, (-c, kind)) AS dominant_type FROM (SELECT cx, cy, kind, count(*) AS c, sum(count(*)) OVER (PARTITION BY cx, cy) AS t FROM ({_CELLS}) GROUP BY cx, cy, kind) GROUP BY cx, cy"


@query("grid_morphology", "cx cy building_count building_coverage_ratio:6 floor_area_ratio:6 avg_height:5 height_std:5 building_density:5 avg_volume:3 dominant_type shannon_diversity:7", f"SELECT * FROM ({_MORPH}) JOIN ({_SHAN}) USING (cx, cy)")
def grid_morphology(s: Shapes):
    return GD.grid_morphology(s.buildings(), 100.0, "kind")


@query("classify_cells", "cx cy urban_typology verticalization height_heterogeneity use_mix urban_compactness", f"""SELECT cx, cy, CASE WHEN building_coverage_ratio < 0.1 THEN 'Espaço aberto' WHEN building_coverage_ratio < 0.3 AND building_density < 5 THEN 'Suburbano de baixa densidade' WHEN building_coverage_ratio < 0.3 THEN 'Residencial de média densidade'
    WHEN building_coverage_ratio < 0.5 THEN 'Urbano de média densidade' ELSE 'Urbano de alta densidade' END AS urban_typology, CASE WHEN avg_height < 4 THEN 'Muito baixa' WHEN avg_height < 9 THEN 'Baixa' WHEN avg_height < 15 THEN 'Média' WHEN avg_height < 30 THEN 'Alta' ELSE 'Muito alta' END AS verticalization,
    CASE WHEN height_std < 1 THEN 'Muito baixa' WHEN height_std < 3 THEN 'Baixa' WHEN height_std < 6 THEN 'Média' WHEN height_std < 10 THEN 'Alta' ELSE 'Muito alta' END AS height_heterogeneity,
    CASE WHEN shannon_diversity < 0.2 THEN 'Monofuncional' WHEN shannon_diversity < 0.5 THEN 'Baixa diversidade' WHEN shannon_diversity < 0.8 THEN 'Média diversidade' WHEN shannon_diversity < 1.2 THEN 'Alta diversidade' ELSE 'Muito alta diversidade' END AS use_mix,
    CASE WHEN building_coverage_ratio < 0.2 AND floor_area_ratio < 0.5 THEN 'Muito baixa' WHEN building_coverage_ratio < 0.4 AND floor_area_ratio < 1 THEN 'Baixa' WHEN building_coverage_ratio < 0.6 AND floor_area_ratio < 2 THEN 'Média' WHEN building_coverage_ratio < 0.8 AND floor_area_ratio < 4 THEN 'Alta' ELSE 'Muito alta' END AS urban_compactness
    FROM ({_MORPH}) JOIN ({_SHAN}) USING (cx, cy)""")
def classify_cells(s: Shapes):
    return GD.classify_cells(GD.grid_morphology(s.buildings(), 100.0, "kind"))


@query("cell_centrality", "cx cy centrality_index:8", f"""SELECT cx, cy, 0.4 * (building_density - d0) / (d1 - d0) + 0.4 * (floor_area_ratio - f0) / (f1 - f0) + 0.2 * (shannon_diversity - s0) / (s1 - s0) AS centrality_index FROM (SELECT *, min(building_density) OVER () AS d0, max(building_density) OVER () AS d1,
    min(floor_area_ratio) OVER () AS f0, max(floor_area_ratio) OVER () AS f1, min(shannon_diversity) OVER () AS s0, max(shannon_diversity) OVER () AS s1 FROM ({_MORPH}) JOIN ({_SHAN}) USING (cx, cy))""")
def cell_centrality(s: Shapes):
    return GD.cell_centrality(GD.grid_morphology(s.buildings(), 100.0, "kind"))


@query("grid_dense", "n filled", f"SELECT (floor(max(x1) / 100) - floor(min(x0) / 100) + 1)::BIGINT * (floor(max(y1) / 100) - floor(min(y0) / 100) + 1)::BIGINT AS n, (SELECT count(*) FROM ({_MORPH})) AS filled FROM v_bld")
def grid_dense(s: Shapes):
    g = GD.grid_morphology(s.buildings(), 100.0, "kind", dense=True)
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dominant_type") != "none").alias("filled"))


@query("grid_back_join", "id building_count", f"SELECT id, building_count FROM v_bld JOIN ({_MORPH}) ON cx = floor(x / 100) AND cy = floor(y / 100)")
def grid_back_join(s: Shapes):
    return GD.grid_back_join(s.buildings(), GD.grid_morphology(s.buildings(), 100.0, "kind"), 100.0, ["building_count"])


@query("grid_population", "cx cy building_count population population_density:3 mean_building_density:6 density_class", f"""SELECT cx, cy, building_count, population, population / 0.01 AS population_density, mean_building_density, {_bins('(population / 0.01)', 'grid_density', incl=True)} AS density_class FROM (SELECT cx, cy, count(*) AS building_count, sum(id % 40)::DOUBLE AS population, avg((id % 40) / area) AS mean_building_density FROM ({_CELLS}) WHERE id % 40 > 0 GROUP BY cx, cy)""")
def grid_population(s: Shapes):
    b = s.buildings().withColumn("population", (F.col("id") % 40).cast("double")).withColumn("density_per_area", F.col("population") / F.col("area"))
    return GD.grid_population(b, 100.0)


@query("grid_line_heat", "cx cy length:4 segments", "SELECT CAST(floor(ax / 1000) AS BIGINT) AS cx, CAST(floor(ay / 1000) AS BIGINT) AS cy, sum(sqrt((qx - ax) ** 2 + (qy - ay) ** 2)) AS length, count(*) AS segments FROM v_segs GROUP BY ALL")
def grid_line_heat(s: Shapes):
    return GD.grid_line_heat(s.roads(), "coords")


_HEAT = "SELECT CAST(least(19, floor((y - y0) / (y1 - y0) * 20)) AS INTEGER) AS \"row\", CAST(least(19, floor((x - x0) / (x1 - x0) * 20)) AS INTEGER) AS col, sum(area) AS value FROM v_zones, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM (SELECT x, y FROM v_zones)) GROUP BY ALL"


@query("grid_area_heat", "row col value:2", _HEAT.replace("FROM v_zones, (SELECT", "FROM (SELECT x, y, area FROM v_zones), (SELECT"))
def grid_area_heat(s: Shapes):
    return GD.grid_area_heat(s.zones(), "area", 20)


_K1 = GD.kernel(1.0)
_KV = "(VALUES " + ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in _K1) + ") k(o, w)"


@query("gaussian_smooth", "row col value:4", f"""WITH h AS ({_HEAT.replace("FROM v_zones, (SELECT", "FROM (SELECT x, y, area FROM v_zones), (SELECT")}), t AS (SELECT a.r, b.c FROM (SELECT unnest(range(20)) AS r) a, (SELECT unnest(range(20)) AS c) b), k AS (SELECT * FROM {_KV}),
    v AS (SELECT t.r, t.c, sum(w * value) AS value FROM t, k, h WHERE h.col = t.c AND h."row" = CASE WHEN t.r + o < 0 THEN -1 - (t.r + o) WHEN t.r + o > 19 THEN 39 - (t.r + o) ELSE t.r + o END GROUP BY ALL),
    z AS (SELECT t.r, t.c, sum(w * value) AS value FROM t, k, v WHERE v.r = t.r AND v.c = CASE WHEN t.c + o < 0 THEN -1 - (t.c + o) WHEN t.c + o > 19 THEN 39 - (t.c + o) ELSE t.c + o END GROUP BY ALL)
--final
SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, value FROM z""")
def gaussian_smooth(s: Shapes):
    return GD.gaussian_smooth(GD.grid_area_heat(s.zones(), "area", 20), F.lit(20), F.lit(20), 1.0)


@query("kde_points", "erb density:12", """WITH g AS (SELECT count(*) AS n, var_samp(x) * count(*) ** (-1.0 / 3) AS a, var_samp(y) * count(*) ** (-1.0 / 3) AS b, covar_samp(x, y) * count(*) ** (-1.0 / 3) AS c FROM v_customers)
--final
SELECT erb, sum(exp(-0.5 * (b * (s.x - p.x) ** 2 - 2 * c * (s.x - p.x) * (s.y - p.y) + a * (s.y - p.y) ** 2) / (a * b - c * c))) / (max(n) * 2 * pi() * sqrt(max(a * b - c * c))) AS density FROM v_stations s, v_customers p, g GROUP BY erb""")
def kde_points(s: Shapes):
    return GD.kde_points(s.customers(), s.stations(), "erb")


_MESH, _REACH = GD.binning(1e-3)


@query("kde_binned", "erb density:12 bound:12", f"""WITH g AS (SELECT count(*) AS n, var_samp(x) * count(*) ** (-1.0 / 3) AS vx, var_samp(y) * count(*) ** (-1.0 / 3) AS vy, covar_samp(x, y) * count(*) ** (-1.0 / 3) AS cv FROM v_customers),
w AS (SELECT n, sqrt(vx) AS a, cv / sqrt(vx) AS b, sqrt(vy - cv * cv / vx) AS c FROM g),
m AS (SELECT floor(u) AS i, floor(v) AS j, u - floor(u) AS fu, v - floor(v) AS fv FROM (SELECT x / a / {_MESH!r} AS u, (y - b * (x / a)) / c / {_MESH!r} AS v FROM v_customers, w)),
q AS (SELECT erb, floor(u) AS i, floor(v) AS j, u - floor(u) AS fu, v - floor(v) AS fv FROM (SELECT erb, x / a / {_MESH!r} AS u, (y - b * (x / a)) / c / {_MESH!r} AS v FROM v_stations, w)),
k AS (SELECT i, j, sum(p) AS p FROM (SELECT i + di AS i, j + dj AS j, CASE di WHEN 1 THEN fu ELSE 1 - fu END * CASE dj WHEN 1 THEN fv ELSE 1 - fv END AS p FROM m, range(2) r(di), range(2) t(dj)) GROUP BY ALL),
e AS (SELECT erb, i + di AS i, j + dj AS j, CASE di WHEN 1 THEN fu ELSE 1 - fu END * CASE dj WHEN 1 THEN fv ELSE 1 - fv END AS p FROM q, range(2) r(di), range(2) t(dj)),
s AS (SELECT erb, sum(e.p * k.p * exp(-0.5 * ((e.i - k.i) * {_MESH!r}) ** 2) * exp(-0.5 * ((e.j - k.j) * {_MESH!r}) ** 2)) AS e FROM e JOIN k ON abs(e.i - k.i) <= {_REACH} AND abs(e.j - k.j) <= {_REACH} GROUP BY erb)
--final
SELECT erb, coalesce(e, 0) / (2 * pi() * a * c * n) AS density, 0.001 / (2 * pi() * a * c) AS bound FROM v_stations LEFT JOIN s USING (erb), w""")
def kde_binned(s: Shapes):
    return GD.kde_binned(s.customers(), s.stations(), "erb", 1e-3)


@query("hex_grid", "q r points", """SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r, count(*) AS points FROM (SELECT *, round(fq) AS rq, round(fr) AS rr, round(fs) AS rs, abs(round(fq) - fq) AS dq, abs(round(fr) - fr) AS dr, abs(round(fs) - fs) AS ds
    FROM (SELECT fq, fr, -fq - fr AS fs FROM (SELECT (sqrt(3) / 3 * x - y / 3) / 500 AS fq, (2.0 / 3 * y) / 500 AS fr FROM v_customers))) GROUP BY ALL""")
def hex_grid(s: Shapes):
    return GD.hex_grid(s.customers(), 500.0)


# ---- clusters ----------------------------------------------------------------------------------------------

_DB = """k AS (SELECT a.erb, a.x, a.y, count(*) AS n FROM v_stations a JOIN v_stations b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 810000 GROUP BY ALL), core AS (SELECT * FROM k WHERE n >= 4),
    reach(a, b) AS (SELECT erb, erb FROM core UNION SELECT reach.a, q.erb FROM reach JOIN core p ON p.erb = reach.b JOIN core q ON (p.x - q.x) ** 2 + (p.y - q.y) ** 2 <= 810000),
    lab AS (SELECT b AS erb, min(a) AS cid FROM reach GROUP BY b), border AS (SELECT k.erb, min(cid) AS cid FROM k JOIN core c ON (k.x - c.x) ** 2 + (k.y - c.y) ** 2 <= 810000 JOIN lab ON lab.erb = c.erb WHERE k.n < 4 GROUP BY k.erb),
    db AS (SELECT k.erb, coalesce(lab.cid, border.cid, -1) AS cluster_id, k.n >= 4 AS is_core FROM k LEFT JOIN lab ON lab.erb = k.erb LEFT JOIN border ON border.erb = k.erb)"""


def _clusters(s: Shapes):
    return CL.dbscan(s.stations(), "erb", 900.0, 4)


@query("dbscan", "erb cluster_id is_core", f"WITH RECURSIVE {_DB}\n--final\nSELECT * FROM db")
def dbscan(s: Shapes):
    return _clusters(s)


@query("dbscan_standardised", "id cluster_id is_core", """WITH RECURSIVE p AS (SELECT id, (x - mx) / sx AS x, (y - my) / sy AS y FROM v_customers, (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM v_customers)),
    k AS (SELECT a.id, a.x, a.y, count(*) AS n FROM p a JOIN p b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.05 * 0.05 GROUP BY ALL), core AS (SELECT * FROM k WHERE n >= 5),
    reach(a, b) AS (SELECT id, id FROM core UNION SELECT reach.a, q.id FROM reach JOIN core p ON p.id = reach.b JOIN core q ON (p.x - q.x) ** 2 + (p.y - q.y) ** 2 <= 0.05 * 0.05), lab AS (SELECT b AS id, min(a) AS cid FROM reach GROUP BY b),
    border AS (SELECT k.id, min(cid) AS cid FROM k JOIN core c ON (k.x - c.x) ** 2 + (k.y - c.y) ** 2 <= 0.05 * 0.05 JOIN lab ON lab.id = c.id WHERE k.n < 5 GROUP BY k.id)
--final
SELECT k.id, coalesce(lab.cid, border.cid, -1) AS cluster_id, k.n >= 5 AS is_core FROM k LEFT JOIN lab ON lab.id = k.id LEFT JOIN border ON border.id = k.id""")
def dbscan_standardised(s: Shapes):
    return CL.dbscan(CL.standardise(s.customers().select("id", "x", "y")), "id", 0.05, 5)


def _members(s: Shapes):
    a = s.stations().withColumns({"area": F.col("watts") * 10, "height": F.col("gain"), "building": F.col("operator")})
    return a.join(_clusters(s), "erb")


@query("cluster_stats", "cluster_id count area_total:4 area_mean:4 height_mean:5 height_std:5 volume_total:4 centroid_x:4 centroid_y:4 dominant_type type_diversity:7", f"""WITH RECURSIVE {_DB}, m AS (SELECT cluster_id, watts * 10 AS area, gain AS height, operator, x, y FROM v_stations JOIN db USING (erb) WHERE cluster_id >= 0),
    t AS (SELECT cluster_id, operator, count(*) AS c, sum(count(*)) OVER (PARTITION BY cluster_id) AS t FROM m GROUP BY cluster_id, operator), d AS (SELECT cluster_id, -sum(c / t * ln(c / t)) AS type_diversity, arg_min(operator, (-c, operator)) AS dominant_type FROM t GROUP BY cluster_id)
--final
SELECT cluster_id, count(*) AS count, sum(area) AS area_total, avg(area) AS area_mean, avg(height) AS height_mean, stddev_samp(height) AS height_std, sum(area * height) AS volume_total, avg(x) AS centroid_x, avg(y) AS centroid_y, any_value(dominant_type) AS dominant_type, any_value(type_diversity) AS type_diversity FROM m JOIN d USING (cluster_id) GROUP BY cluster_id""")
def cluster_stats(s: Shapes):
    return CL.cluster_stats(_members(s))


@query("cluster_type_counts", "cluster_id operator n", f"WITH RECURSIVE {_DB}\n--final\nSELECT cluster_id, operator, count(*) AS n FROM v_stations JOIN db USING (erb) WHERE cluster_id >= 0 GROUP BY ALL")
def cluster_type_counts(s: Shapes):
    return CL.cluster_type_counts(_members(s), "operator")


@query("cluster_back_join", "erb cluster_id count", f"WITH RECURSIVE {_DB}, g AS (SELECT cluster_id, count(*) AS count FROM db WHERE cluster_id >= 0 GROUP BY 1)\n--final\nSELECT erb, cluster_id, count FROM db LEFT JOIN g USING (cluster_id)")
def cluster_back_join(s: Shapes):
    m = _members(s)
    g = m.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("count"))
    return CL.cluster_back_join(m, g, ["count"])


@query("intra_cluster_mean_distance", "erb cluster_id cluster_size mean_distance:4", f"WITH RECURSIVE {_DB}, m AS (SELECT erb, cluster_id, x, y FROM v_stations JOIN db USING (erb) WHERE cluster_id >= 0)\n--final\nSELECT a.erb, a.cluster_id, count(*) AS cluster_size, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) / nullif(count(*) - 1, 0) AS mean_distance FROM m a JOIN m b USING (cluster_id) GROUP BY a.erb, a.cluster_id")
def intra_cluster_mean_distance(s: Shapes):
    return CL.intra_cluster_mean_distance(_members(s), "erb", block=20)


@query("intra_cluster_distance_tree", "erb cluster_id cluster_size mean_distance")
def intra_cluster_distance_tree(s: Shapes):
    return CL.intra_cluster_distance_tree(_members(s), "erb")


@query("cluster_spatial_density", "cluster_id count hull_ok", f"WITH RECURSIVE {_DB}\n--final\nSELECT cluster_id, count(*) AS count, true AS hull_ok FROM v_stations JOIN db USING (erb) WHERE cluster_id >= 0 GROUP BY cluster_id HAVING count(*) >= 3")
def cluster_spatial_density(s: Shapes):
    d = CL.cluster_spatial_density(_members(s))
    return d.withColumn("hull_ok", (F.col("area_km2") > 0) & (F.abs(F.col("density") * F.col("area_km2") - F.col("count")) < 1e-6))


@query("group_hulls", "sector hull_area:2", """WITH p AS (SELECT DISTINCT sector, x, y FROM v_customers), e AS (SELECT a.sector, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bb FROM p a JOIN p b ON a.sector = b.sector AND (a.x <> b.x OR a.y <> b.y)
    WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.sector = a.sector AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0 OR (c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) > (b.x - a.x) ** 2 + (b.y - a.y) ** 2)))))
--final
SELECT sector, sum(ax * bb - bx * ay) / 2 AS hull_area FROM e GROUP BY sector""")
def group_hulls(s: Shapes):
    from ..operators.hulls import group_hulls as hulls

    return hulls(s.customers(), "sector")


@query("overall_density", "count area_km2:6 density:6", """WITH p AS (SELECT DISTINCT x, y FROM v_stations), e AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bb FROM p a JOIN p b ON (a.x <> b.x OR a.y <> b.y) WHERE NOT EXISTS (SELECT 1 FROM p c WHERE ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0 OR (c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) > (b.x - a.x) ** 2 + (b.y - a.y) ** 2))))), h AS (SELECT sum(ax * bb - bx * ay) / 2 / 1e6 AS a FROM e)
--final
SELECT (SELECT count(*) FROM v_stations) AS count, a AS area_km2, (SELECT count(*) FROM v_stations) / a AS density FROM h""")
def overall_density(s: Shapes):
    return CL.overall_density(s.stations(), "erb")


@query("buffer_clusters", "erb group_id", """WITH RECURSIVE l AS (SELECT a.erb AS a, b.erb AS b FROM v_stations a JOIN v_stations b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 640000), r(a, b) AS (SELECT erb, erb FROM v_stations UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
--final
SELECT b AS erb, min(a) AS group_id FROM r GROUP BY b""")
def buffer_clusters(s: Shapes):
    return CL.buffer_clusters(s.stations(), "erb", 400.0)


@query("buffer_cluster_sizes", "group_id count", """WITH RECURSIVE l AS (SELECT a.erb AS a, b.erb AS b FROM v_stations a JOIN v_stations b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 640000), r(a, b) AS (SELECT erb, erb FROM v_stations UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
--final
SELECT * FROM (SELECT group_id, count(*) AS count FROM (SELECT b, min(a) AS group_id FROM r GROUP BY b) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)""")
def buffer_cluster_sizes(s: Shapes):
    return CL.buffer_cluster_sizes(CL.buffer_clusters(s.stations(), "erb", 400.0))


@query("voronoi_cells", "cells total:4 covered", """SELECT count(*) AS cells, (max(x) - min(x) + 20000) * (max(y) - min(y) + 20000) / 1e6 AS total, true AS covered FROM (SELECT DISTINCT x, y FROM v_stations)""")
def voronoi_cells(s: Shapes):
    # the cells tile the padded extent, and every cell holds its own place
    v = CL.voronoi_cells(s.stations(), "erb")
    own = G.point_in_polygon("x", "y", F.array(F.concat("ring", F.slice("ring", 1, 1))), True)
    return v.agg(F.count(F.lit(1)).alias("cells"), F.sum("area_km2").alias("total"), F.every(own & (F.col("neighbours") > 0)).alias("covered"))


@query("voronoi_measures", "erb area_km2:6 neighbours", """WITH p AS (SELECT x, y, min(erb) AS erb FROM v_stations GROUP BY x, y), b AS (SELECT min(x) - 10000 AS x0, max(x) + 10000 AS x1, min(y) - 10000 AS y0, max(y) + 10000 AS y1 FROM p),
l AS (SELECT p.erb, q.erb AS other, (q.x - p.x) / d AS a, (q.y - p.y) / d AS b, d / 2 AS c FROM p JOIN (SELECT * FROM p) q ON q.erb <> p.erb, LATERAL (SELECT sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS d)
    UNION ALL SELECT erb, -1, 1, 0, x1 - x FROM p, b UNION ALL SELECT erb, -2, -1, 0, x - x0 FROM p, b UNION ALL SELECT erb, -3, 0, 1, y1 - y FROM p, b UNION ALL SELECT erb, -4, 0, -1, y - y0 FROM p, b),
e AS (SELECT s.erb, s.other, s.c, s.a * -t.b + s.b * t.a AS w, s.c - t.c * (t.a * s.a + t.b * s.b) AS room, t.other AS side, t.c AS tc FROM l t JOIN l s ON s.erb = t.erb AND s.other <> t.other),
g AS (SELECT erb, side, any_value(tc) AS c, min(room / w) FILTER (w > 1e-14) AS high, max(room / w) FILTER (w < -1e-14) AS low, bool_or(abs(w) <= 1e-14 AND room < -1e-9) AS shut FROM e GROUP BY erb, side)
--final
SELECT erb, sum(c * (high - low)) / 2 / 1e6 AS area_km2, count(*) FILTER (side >= 0 AND high - low > 1e-3) AS neighbours FROM g WHERE high > low AND NOT shut GROUP BY erb""")
def voronoi_measures(s: Shapes):
    return CL.voronoi_cells(s.stations(), "erb")


# ---- telecom ----------------------------------------------------------------------------------------------

_ST = f"""SELECT s.*, e, n, t, least((10 ** ((e + 100 - 32.44 - 20 * log10(freq)) / 20)) / (1 + CASE t WHEN 'URBANA_DENSA' THEN 28 WHEN 'URBANA' THEN 22 WHEN 'SUBURBANA' THEN 16 WHEN 'RURAL' THEN 10 ELSE 18 END / 10.0), least(20, 25000 / freq)) AS r
    FROM (SELECT s.*, {_bins('n', 'telecom_area')} AS t FROM (SELECT s.*, 10 * log10(watts * 1000) + gain AS e, (SELECT count(*) - 1 FROM v_stations o WHERE (o.x - s.x) ** 2 + (o.y - s.y) ** 2 <= 1000000) AS n FROM v_stations s) s) s"""


def _covered(s: Shapes):
    return TE.station_coverage(TE.station_power(s.stations(), "watts", "gain"), "erb", "freq")


@query("station_coverage", "erb eirp:6 categoria_eirp densidade_local tipo_area radius:6 categoria_raio", f"SELECT erb, e AS eirp, {_bins('e', 'eirp')} AS categoria_eirp, n AS densidade_local, t AS tipo_area, r AS radius, {_bins('r', 'radius')} AS categoria_raio FROM ({_ST})")
def station_coverage(s: Shapes):
    return _covered(s).withColumnsRenamed({"EIRP_dBm": "eirp", "Raio_Cobertura_km": "radius"})


@query("operator_summary", "Operadora Quantidade EIRP_Media:6 Raio_Medio:6 Cobertura_Total_km2:4", f"SELECT operator AS Operadora, count(*) AS Quantidade, avg(e) AS EIRP_Media, avg(r) AS Raio_Medio, sum(pi() * r * r / 3) AS Cobertura_Total_km2 FROM ({_ST}) GROUP BY operator")
def operator_summary(s: Shapes):
    return TE.operator_summary(_covered(s), "operator")


def _hexes(s: Shapes):
    return GD.hex_cover(S.point_box(s.stations()), 1500.0)


def _sectors(s: Shapes):
    d = TE.station_power(s.stations(), "watts", "gain")
    ring = planar_sector("x", "y", "azimuth", F.col("watts") * 40)
    return d.withColumn("ring", ring).where(F.col("ring").isNotNull()).select("erb", "operator", "EIRP_dBm", "ring")


# Hexagons and wedges are convex: they are apart if some edge normal of either separates their projections.
_HEX_SECTORS = f"""ext AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v_stations), hr AS (SELECT unnest(range(CAST(floor(y0 / 2250) AS BIGINT), CAST(ceil(y1 / 2250) AS BIGINT) + 1)) AS r, x0 / (1500 * sqrt(3)) AS a, x1 / (1500 * sqrt(3)) AS c FROM ext),
    hx AS (SELECT q, r, 1500 * sqrt(3) * (q + r / 2) AS cx, 2250.0::DOUBLE * r AS cy FROM (SELECT r, unnest(range(CAST(floor(a - r / 2) AS BIGINT), CAST(ceil(c - r / 2) AS BIGINT) + 1)) AS q FROM hr)),
    sc AS (SELECT erb, operator, x, y, 10 * log10(watts * 1000) + gain AS e, radians(((90 - azimuth) % 360 + 360) % 360) AS m, watts * 40 AS w FROM v_stations WHERE azimuth IS NOT NULL),
    sv AS (SELECT erb, 0 AS i, x, y FROM sc UNION ALL SELECT erb, i + 1, x + w * cos(m + radians(4 * i - 60)), y + w * sin(m + radians(4 * i - 60)) FROM sc, (SELECT unnest(range(31)) AS i)),
    ax AS (SELECT u.erb, v.y - u.y AS nx, u.x - v.x AS ny FROM sv u JOIN sv v ON v.erb = u.erb AND v.i = (u.i + 1) % 32 UNION ALL SELECT erb, cos(radians(60 * k)), sin(radians(60 * k)) FROM sc, (SELECT unnest(range(3)) AS k)),
    sp AS (SELECT ax.erb, nx, ny, min(x * nx + y * ny) AS lo, max(x * nx + y * ny) AS hi, (SELECT max(1500 * (cos(radians(60 * k - 30)) * nx + sin(radians(60 * k - 30)) * ny)) FROM (SELECT unnest(range(6)) AS k)) AS half FROM ax JOIN sv USING (erb) GROUP BY ax.erb, nx, ny),
    hs AS MATERIALIZED (SELECT q, r, sc.erb, operator AS op, e FROM hx, sc WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.erb = sc.erb AND (cx * nx + cy * ny + half < lo OR cx * nx + cy * ny - half > hi)))"""


def _hex_cover_sql(all_sectors: bool) -> str:
    per = "SELECT q, r, op, arg_min(e, erb) AS e1, sum(e) AS es, count(*) AS n FROM hs GROUP BY ALL"
    means = "sum(n), sum(es) / sum(n)" if all_sectors else "count(*), avg(e1)"
    return f"""WITH {_HEX_SECTORS}, g(q, r, ops, secs, pm) AS (SELECT q, r, count(*), {means} FROM ({per}) GROUP BY q, r)
--final
SELECT q, r, coalesce(ops, 0) AS num_operadoras, CAST(coalesce(secs, 0) AS BIGINT) AS num_setores, pm AS potencia_media, {_bins('coalesce(ops, 0)', 'hex_vulnerability')} AS vulnerabilidade, pm / secs AS densidade_potencia FROM hx LEFT JOIN g USING (q, r)"""


@query("hex_cover_join", "q r num_operadoras num_setores potencia_media:6 vulnerabilidade densidade_potencia:6", _hex_cover_sql(False))
def hex_cover_join(s: Shapes):
    return TE.hex_cover_join(_hexes(s), _sectors(s), 2000.0, "operator", "erb")


@query("hex_cover_join_all", "q r num_operadoras num_setores potencia_media:6 vulnerabilidade densidade_potencia:6", _hex_cover_sql(True))
def hex_cover_join_all(s: Shapes):
    return TE.hex_cover_join(_hexes(s), _sectors(s), 2000.0, "operator", "erb", all_sectors=True)


@query("hex_operator_matrix", "q r OP0 OP1 OP2 OP3", f"WITH {_HEX_SECTORS}\n--final\nSELECT q, r, " + ", ".join(f"count(*) FILTER (op = 'OP{k}') AS OP{k}" for k in range(4)) + " FROM hs GROUP BY q, r")
def hex_operator_matrix(s: Shapes):
    p = TE.hex_sector_pairs(_hexes(s), _sectors(s), 2000.0).select(F.col("l_q").alias("q"), F.col("l_r").alias("r"), F.col("r_operator").alias("op"))
    return TE.hex_operator_matrix(p, ["OP0", "OP1", "OP2", "OP3"])


@query("hex_voronoi_stats", "stations covered_ok", "SELECT count(*) AS stations, true AS covered_ok FROM v_stations")
def hex_voronoi_stats(s: Shapes):
    # every occupied hexagon lies inside the padded extent, so its cells cover it completely
    pts = _covered(s)
    h = TE.hex_voronoi_stats(_hexes(s), pts, CL.voronoi_cells(s.stations(), "erb"), 1500.0, "densidade_local", "Raio_Cobertura_km", 2000.0)
    ok = (F.col("erbs_count") == 0) | (F.abs(F.col("percentual_cobertura") - 100) < 1e-4)
    return h.agg(F.sum("erbs_count").alias("stations"), F.every(ok).alias("covered_ok"))


@query("station_station_edges", "src dst km:6", f"WITH RECURSIVE {_DB}, m AS (SELECT erb, cluster_id, operator, x, y FROM v_stations JOIN db USING (erb) WHERE cluster_id >= 0)\n--final\nSELECT a.erb AS src, b.erb AS dst, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 1000 AS km FROM m a JOIN m b ON a.cluster_id = b.cluster_id AND a.operator = b.operator AND a.erb < b.erb")
def station_station_edges(s: Shapes):
    return TE.station_station_edges(_members(s), "erb", "operator")


@query("coverage_bipartite_graph", "kind edges km:4", f"""WITH RECURSIVE {_DB}, {_HEX_SECTORS}, m AS (SELECT erb, cluster_id, operator, x, y FROM v_stations JOIN db USING (erb) WHERE cluster_id >= 0)
--final
SELECT 'erb_hex' AS kind, count(*) AS edges, NULL::DOUBLE AS km FROM hs UNION ALL SELECT 'erb_erb', count(*), sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) / 1000 FROM m a JOIN m b ON a.cluster_id = b.cluster_id AND a.operator = b.operator AND a.erb < b.erb""")
def coverage_bipartite_graph(s: Shapes):
    p = TE.hex_sector_pairs(_hexes(s), _sectors(s), 2000.0)
    g = TE.coverage_bipartite_graph(TE.station_hex_edges(p, "erb"), TE.station_station_edges(_members(s), "erb", "operator"))
    return g.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.sum("km").alias("km"))


@query("redundancy", "erb hexagons redundancy:6", f"WITH {_HEX_SECTORS}, n AS (SELECT q, r, count(*) AS n FROM hs GROUP BY ALL)\n--final\nSELECT erb, count(*) AS hexagons, avg(n - 1) AS redundancy FROM hs JOIN n USING (q, r) GROUP BY erb")
def redundancy(s: Shapes):
    return TE.redundancy(TE.station_hex_edges(TE.hex_sector_pairs(_hexes(s), _sectors(s), 2000.0), "erb"))


@query("erb_importance", "erb pontuacao_importancia:7 classe_importancia erb_critica_evacuacao", f"""SELECT erb, v AS pontuacao_importancia, {_bins('v', 'importance')} AS classe_importancia, coalesce(v > 0.6 AND v <= 1.0 AND bn > 0.6 AND cv > 0, false) AS erb_critica_evacuacao FROM (SELECT erb, 0.15 * (e - min(e) OVER ()) / (max(e) OVER () - min(e) OVER ()) + 0.15 * (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ())
    + 0.25 * bn + 0.2 * (gain - 10) / 8 + 0.15 * (watts - 5) / 35 + 0.1 * (1 - (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ())) + 0.2 * cv / max(cv) OVER () AS v, bn, cv FROM (SELECT *, ((erb * 31) % 100 - min((erb * 31) % 100) OVER ()) / (max((erb * 31) % 100) OVER () - min((erb * 31) % 100) OVER ()) AS bn, erb % 6 AS cv FROM ({_ST})))""")
def erb_importance(s: Shapes):
    d = _covered(s).withColumns({"betweenness": ((F.col("erb") * 31) % 100).cast("double"), "degree": F.col("gain"), "closeness": F.col("watts")})
    cover = s.stations().select("erb", (F.col("erb") % 6).alias("cobertura_vulneravel"))
    return TE.erb_importance(d, cover)


@query("hydro_distance_by_type", "p_brand count mean_distance:5 pct_30:5 pct_100:5 median_distance:5", """SELECT p_brand, count(*) AS count, avg(d) AS mean_distance, avg((d <= 30)::INT) * 100 AS pct_30, avg((d <= 100)::INT) * 100 AS pct_100, median(d) AS median_distance FROM (SELECT p_brand, p_retailprice - 890 AS d FROM part) WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 8) GROUP BY p_brand""")
def hydro_distance_by_type(s: Shapes):
    return S.hydro_distance_by_type(s.part.withColumn("d", F.col("p_retailprice") - 890), "p_brand", "d", 8)


