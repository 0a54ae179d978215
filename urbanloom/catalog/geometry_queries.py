"""Queries over single geometries: measures, projections, shapes, sampling, text form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crs
from ..functions import geometry as G
from ..functions.formulas import building_volumetrics
from ..operators import table as T
from ..operators.hulls import orientation_degrees, ring_hull
from ..plans.enrich import planar_sector
from .registry import query
from .shapes import Shapes

_ENDS = "c[1].x AS ax, c[1].y AS ay, c[len(c)].x AS qx, c[len(c)].y AS qy"


@query("line_length", "road len:6", "SELECT road, len FROM v_roadlen")
def line_length(s: Shapes):
    return s.roads().select("road", G.line_length("coords").alias("len"))


@query("polygon_measures", "id area perimeter cx:6 cy:6 minx maxy", "SELECT id, area, perimeter, x AS cx, y AS cy, x0 AS minx, y1 AS maxy FROM v_bld")
def polygon_measures(s: Shapes):
    c, b = G.ring_centroid("ring"), G.line_bbox("ring")
    return s.buildings().select("id", G.polygon_area("rings").alias("area"), G.polygon_perimeter("rings").alias("perimeter"),
                                c["x"].alias("cx"), c["y"].alias("cy"), b["minx"].alias("minx"), b["maxy"].alias("maxy"))


@query("polygon_with_hole", "id area:6 inside", "SELECT id, area - area / 4 AS area, false AS inside FROM v_bld")
def polygon_with_hole(s: Shapes):
    hole = G.rectangle(F.col("x") - F.col("w") / 4, F.col("y") - F.col("h") / 4, F.col("x") + F.col("w") / 4, F.col("y") + F.col("h") / 4)
    b = s.buildings().withColumn("rings", F.array("ring", hole))
    return b.select("id", G.polygon_area("rings").alias("area"), G.point_in_polygon("x", "y", "rings").alias("inside"))


@query("compactness", "id raw:9 unit:9 top:9", "SELECT id, v AS raw, greatest(0, least(1, v)) AS unit, CASE WHEN v > 1 THEN 1 ELSE v END AS top FROM (SELECT id, 4 * pi() * area * 1.4 / perimeter ** 2 AS v FROM v_bld)")
def compactness(s: Shapes):
    a = F.col("area") * 1.4
    return s.buildings().select("id", G.compactness(a, "perimeter").alias("raw"), G.compactness(a, "perimeter", "unit").alias("unit"), G.compactness(a, "perimeter", "top").alias("top"))


@query("shape_index", "id shape_index:9 area_ha:8", "SELECT id, perimeter / (2 * sqrt(pi() * area)) AS shape_index, area / 10000 AS area_ha FROM v_bld")
def shape_index(s: Shapes):
    return s.buildings().select("id", G.shape_index("area", "perimeter").alias("shape_index"), (F.col("area") / 10000).alias("area_ha"))


_SIN = f"SELECT road, len / nullif(sqrt((qx - ax) ** 2 + (qy - ay) ** 2), 0) AS v FROM v_roadlen JOIN (SELECT road, {_ENDS} FROM v_roads) USING (road)"


@query("sinuosity", "road v:8", _SIN)
def sinuosity(s: Shapes):
    return s.roads().select("road", G.sinuosity("coords").alias("v"))


@query("sinuosity_closed", "road null_mode one zero", "SELECT road, CAST(NULL AS DOUBLE) AS null_mode, 1.0::DOUBLE AS one, 0.0::DOUBLE AS zero FROM v_roads")
def sinuosity_closed(s: Shapes):
    loop = F.concat("coords", F.slice("coords", 1, 1))
    return s.roads().select("road", *[G.sinuosity(loop, m).alias(n) for m, n in (("null", "null_mode"), ("one", "one"), ("zero", "zero"))])


@query("multi_sinuosity", "road longest:8 weighted:8 one", f"""SELECT road, 1.0::DOUBLE AS longest, 1.0::DOUBLE AS weighted, 1.0::DOUBLE AS one FROM v_roads""")
def multi_sinuosity(s: Shapes):
    parts = F.transform(G.segments("coords"), lambda e: F.array(G.point(e["ax"], e["ay"]), G.point(e["bx"], e["by"])))
    return s.roads().select("road", *[G.multi_sinuosity(parts, m).alias(m) for m in ("longest", "weighted", "one")])


@query("curvature", "road v:8", """SELECT r.road, coalesce(t, 0) / len AS v FROM v_roadlen r LEFT JOIN (SELECT a.road, sum(acos(greatest(-1, least(1, ((a.qx - a.ax) * (b.qx - b.ax) + (a.qy - a.ay) * (b.qy - b.ay))
    / (sqrt((a.qx - a.ax) ** 2 + (a.qy - a.ay) ** 2) * sqrt((b.qx - b.ax) ** 2 + (b.qy - b.ay) ** 2)))))) AS t FROM v_segs a JOIN v_segs b ON a.road = b.road AND b.seg = a.seg + 1 GROUP BY a.road) u ON u.road = r.road""")
def curvature(s: Shapes):
    return s.roads().select("road", G.curvature("coords").alias("v"))


@query("point_density_bearing", "road density:8 bearing:6 axis:6", f"""SELECT road, len(c) / len AS density, (degrees(atan2(qx - ax, qy - ay)) + 360) % 360 AS bearing, (degrees(atan2(qy - ay, qx - ax)) + 180) % 180 AS axis
    FROM v_roadlen JOIN (SELECT road, c, {_ENDS} FROM v_roads) USING (road)""")
def point_density_bearing(s: Shapes):
    return s.roads().select("road", G.point_density("coords").alias("density"), G.bearing("coords").alias("bearing"), G.axis_angle("coords").alias("axis"))


@query("line_merge", "road len:6 n", "SELECT road, len, len(c) AS n FROM v_roadlen JOIN v_roads USING (road)")
def line_merge(s: Shapes):
    parts = F.transform(G.segments("coords"), lambda e: F.array(G.point(e["ax"], e["ay"]), G.point(e["bx"], e["by"])))
    m = s.roads().withColumn("m", G.line_merge(parts))
    return m.select("road", G.line_length("m").alias("len"), F.size("m").cast("bigint").alias("n"))


@query("longest_part", "road len:6", "SELECT road, max(sqrt((qx - ax) ** 2 + (qy - ay) ** 2)) AS len FROM v_segs GROUP BY road")
def longest_part(s: Shapes):
    parts = F.transform(G.segments("coords"), lambda e: F.array(G.point(e["ax"], e["ay"]), G.point(e["bx"], e["by"])))
    return s.roads().select("road", G.line_length(G.longest_part(parts)).alias("len"))


@query("largest_part", "id area", "SELECT id, greatest(area, 400) AS area FROM v_bld")
def largest_part(s: Shapes):
    other = F.array(G.rectangle(F.lit(0.0), F.lit(0.0), F.lit(20.0), F.lit(20.0)))
    return s.buildings().select("id", G.polygon_area(G.largest_part(F.array("rings", other))).alias("area"))


@query("explode_multi", "road seg len:6", "SELECT road, seg - 1 AS seg, sqrt((qx - ax) ** 2 + (qy - ay) ** 2) AS len FROM v_segs")
def explode_multi(s: Shapes):
    parts = F.transform(G.segments("coords"), lambda e: F.array(G.point(e["ax"], e["ay"]), G.point(e["bx"], e["by"])))
    return s.roads().select("road", F.posexplode(parts).alias("seg", "part")).select("road", "seg", G.line_length("part").alias("len"))


@query("convex_hull", "id hull_area complexity:9 vertices", "SELECT id, area AS hull_area, 1.0 AS complexity, 5 AS vertices FROM v_bld")
def convex_hull(s: Shapes):
    mid = F.array(G.point("x", "y"))
    b = s.buildings().withColumn("h", ring_hull(F.concat("ring", mid)))
    return b.select("id", G.ring_area("h").alias("hull_area"), (G.ring_area("h") / F.col("area")).alias("complexity"), F.size("h").alias("vertices"))


@query("orientation_degrees", "id angle:4", "SELECT id, degrees(atan2(h * 2, w)) AS angle FROM v_bld")
def orientation(s: Shapes):
    # a right triangle has one farthest pair: its hypotenuse
    tri = F.array(G.point("minx", "miny"), G.point(F.col("minx") + F.col("w"), F.col("miny") + F.col("h") * 2), G.point(F.col("minx") + F.col("w"), F.col("miny")), G.point("minx", "miny"))
    return s.buildings().select("id", orientation_degrees(tri).alias("angle"))


@query("shape_ratios", "id aspect_ratio:8 elongation:8 volume_density:8", "SELECT id, greatest(w, h) / least(w, h) AS aspect_ratio, greatest(w, h) / least(w, h) AS elongation, 1.0 AS volume_density FROM v_bld")
def shape_ratios(s: Shapes):
    b = G.line_bbox("ring")
    w, h = b["maxx"] - b["minx"], b["maxy"] - b["miny"]
    long, short = F.greatest(w, h), F.least(w, h)
    return s.buildings().select("id", (long / F.greatest(short, F.lit(0.001))).alias("aspect_ratio"), (long / short).alias("elongation"), (F.col("area") / (w * h)).alias("volume_density"))


@query("building_volumetrics", "id volume_m3:4 facade_exposure:4 area_height_ratio:6 roof_area_m2", "SELECT id, area * height AS volume_m3, perimeter * height AS facade_exposure, area / height AS area_height_ratio, area AS roof_area_m2 FROM v_bld")
def volumetrics(s: Shapes):
    return s.buildings().select("id", *[c.alias(n) for n, c in building_volumetrics("area", "perimeter", "height").items()])


@query("line_buffer_area", "road area:5", "SELECT road, 2 * 50 * len + pi() * 2500 AS area FROM v_roadlen")
def line_buffer_area(s: Shapes):
    return s.roads().select("road", G.line_buffer_area(G.line_length("coords"), 50.0).alias("area"))


@query("coverage_sector", "erb n x5:7 y5:7", """SELECT erb, CAST(33 AS INTEGER) AS n, -47 + 2 * cos(a) / 111.32 / cos(radians(-23.5)) AS x5, -23.5 + 2 * sin(a) / 111.32 AS y5 FROM (SELECT erb, radians((450 - azimuth) % 360) - radians(60) + 4 * radians(120) / 30 AS a FROM v_stations WHERE azimuth IS NOT NULL)""")
def coverage_sector(s: Shapes):
    r = s.stations().withColumn("ring", G.coverage_sector(F.lit(-47.0), F.lit(-23.5), "azimuth", F.lit(2.0))).where(F.col("ring").isNotNull())
    p = F.get("ring", 5)
    return r.select("erb", F.size("ring").alias("n"), p["x"].alias("x5"), p["y"].alias("y5"))


@query("coverage_sector_area", "erb area:3", "SELECT erb, 30 * 0.5 * sin(radians(4)) * (watts * 100) ** 2 AS area FROM v_stations WHERE azimuth IS NOT NULL")
def coverage_sector_area(s: Shapes):
    r = s.stations().withColumn("ring", planar_sector("x", "y", "azimuth", F.col("watts") * 100)).where(F.col("ring").isNotNull())
    return r.select("erb", G.ring_area("ring").alias("area"))


@query("footprint_local_coords", "id seq lx:6 ly:6", "SELECT id, CAST(i - 1 AS INTEGER) AS seq, ([-w / 2, w / 2, w / 2, -w / 2, -w / 2])[i] AS lx, ([-h / 2, -h / 2, h / 2, h / 2, -h / 2])[i] AS ly FROM v_bld, (SELECT unnest(range(1, 6)) AS i)")
def footprint_local_coords(s: Shapes):
    b = s.buildings().where(F.col("height") > 0)
    return b.select("id", F.posexplode(G.local_ring("ring")).alias("seq", "p")).select("id", "seq", F.col("p.x").alias("lx"), F.col("p.y").alias("ly"))


@query("line_points", "road n total:4 step:6", "SELECT road, greatest(2, floor(len / 10))::BIGINT AS n, len AS total, len / (greatest(2, floor(len / 10)) - 1) AS step FROM v_roadlen WHERE road IN (SELECT road FROM v_roads WHERE len(c) = 2) OR true")
def line_points(s: Shapes):
    d = s.roads().withColumn("len", G.line_length("coords"))
    p = d.withColumn("pts", G.line_points("coords", G.samples_by_step("len", 10.0)))
    a, b = F.get("pts", 0), F.element_at("pts", -1)
    ok = (a["x"] == G.first_point("coords")["x"]) & (F.abs(b["x"] - G.last_point("coords")["x"]) < 1e-6)
    return p.where(ok).select("road", F.size("pts").cast("bigint").alias("n"), F.col("len").alias("total"), (F.col("len") / (F.size("pts") - 1)).alias("step"))


@query("line_points_two", "road seq x:5 y:5", f"""SELECT road, CAST(i AS INTEGER) AS seq, ax + (qx - ax) * i / 9 AS x, ay + (qy - ay) * i / 9 AS y FROM (SELECT road, {_ENDS} FROM v_roads), (SELECT unnest(range(10)) AS i)""")
def line_points_two(s: Shapes):
    straight = F.array(G.first_point("coords"), G.last_point("coords"))
    return s.roads().select("road", F.explode(G.line_points(straight, F.lit(10))).alias("p")).select("road", "p.seq", "p.x", "p.y")


@query("to_crs_mercator", "erb mx:4 my:4", "SELECT erb, 6378137 * radians(x / 1000 - 52) AS mx, 6378137 * ln(tan(pi() / 4 + radians(y / 1000 - 28) / 2)) AS my FROM v_stations")
def to_crs_mercator(s: Shapes):
    c = G.first_point(crs.to_crs(F.array(G.point(F.col("x") / 1000 - 52, F.col("y") / 1000 - 28)), 3857, 4326))
    return s.stations().select("erb", c["x"].alias("mx"), c["y"].alias("my"))


@query("to_crs_round_trip", "erb lon:8 lat:8", "SELECT erb, x / 5000 - 46 AS lon, y / 1000 - 28 AS lat FROM v_stations")
def to_crs_round_trip(s: Shapes):
    p = crs.to_crs(F.array(G.point(F.col("x") / 5000 - 46, F.col("y") / 1000 - 28)), 31983)
    q = G.first_point(crs.to_crs(p, 4674, 31983))
    return s.stations().select("erb", q["x"].alias("lon"), q["y"].alias("lat"))


@query("to_wkt", "road wkt_points", "SELECT road, len(c)::INTEGER AS wkt_points FROM v_roads")
def to_wkt(s: Shapes):
    return s.roads().select("road", F.size(G.from_wkt(G.to_wkt("coords"))).alias("wkt_points"))


@query("wkt_round_trip", "id area same", "SELECT id, area, true AS same FROM v_bld")
def wkt_round_trip(s: Shapes):
    b = s.buildings().withColumn("back", G.from_wkt(G.to_wkt("rings", "POLYGON")))
    return b.select("id", G.ring_area("back").alias("area"), (F.col("back") == F.col("ring")).alias("same"))


@query("repair_geom", "id area n", "SELECT id, area, 5 AS n FROM v_bld")
def repair_geom(s: Shapes):
    # clockwise, open and with a doubled vertex
    broken = F.concat(F.slice(F.reverse("ring"), 1, 4), F.slice(F.reverse("ring"), 4, 1))
    b = T.repair_polygons(s.buildings().withColumn("ring", broken), "ring")
    return b.select("id", G.signed_ring_area("ring").alias("area"), F.size("ring").alias("n"))


@query("drop_still_invalid", "id", "SELECT id FROM v_bld WHERE landuse IS NOT NULL")
def drop_still_invalid(s: Shapes):
    bad = F.when(F.col("landuse").isNotNull(), F.col("ring")).otherwise(F.slice("ring", 1, 2))
    return T.repair_polygons(s.buildings().withColumn("ring", bad), "ring").select("id")


@query("make_valid_chain", "repair_step n", "SELECT CASE WHEN landuse IS NULL THEN 'dropped' ELSE 'repaired' END AS repair_step, count(*) AS n FROM v_bld GROUP BY 1")
def make_valid_chain(s: Shapes):
    bad = F.when(F.col("landuse").isNotNull(), F.col("ring")).otherwise(F.slice("ring", 1, 2))
    return T.make_valid_chain(s.buildings().withColumn("ring", bad), "ring").groupBy("repair_step").agg(F.count(F.lit(1)).alias("n"))


@query("dedup_geometry", "n first_id", "SELECT count(*) AS n, CAST(sum(i) AS BIGINT) AS first_id FROM (SELECT min(id) AS i FROM v_bld GROUP BY w, h)")
def dedup_geometry(s: Shapes):
    b = s.buildings().withColumn("ring", G.local_ring("ring")).select("id", "w", "h", "ring")
    return T.dedup_geometry(b, "ring", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("first_id"))


@query("clip", "zone area:4", """SELECT zone, w * h AS area FROM (SELECT zone, least(x1, 6000) - greatest(x0, 2000) AS w, least(y1, 7000) - greatest(y0, 1000) AS h FROM v_zones) WHERE w > 0 AND h > 0""")
def clip(s: Shapes):
    from ..operators.spatial import clip_polygons

    box = G.rectangle(F.lit(2000.0), F.lit(1000.0), F.lit(6000.0), F.lit(7000.0))
    c = clip_polygons(s.zones(), "ring", box)
    return c.select("zone", G.ring_area("ring").alias("area")).where(F.col("area") > 0)


@query("heat_weight", "road seq weight", "SELECT road, CAST(i - 1 AS INTEGER) AS seq, CAST(CASE WHEN highway = 'motorway' THEN 3 ELSE 1 END AS INTEGER) AS weight FROM (SELECT road, highway, unnest(range(1, len(c) + 1)) AS i FROM v_roads)")
def heat_weight(s: Shapes):
    v = s.roads().select("road", "highway", F.posexplode("coords").alias("seq", "p"))
    return v.select("road", "seq", F.when(F.col("highway") == "motorway", 3).otherwise(1).alias("weight"))


@query("segment_in_disc", "road len:5", f"""SELECT road, CASE WHEN a > 0 AND d > 0 AND t1 > t0 THEN (t1 - t0) * sqrt(a) ELSE 0 END AS len FROM (SELECT *, greatest(0, (-b - sqrt(greatest(d, 0))) / (2 * a)) AS t0, least(1, (-b + sqrt(greatest(d, 0))) / (2 * a)) AS t1
    FROM (SELECT *, b * b - 4 * a * k AS d FROM (SELECT road, (qx - ax) ** 2 + (qy - ay) ** 2 AS a, 2 * ((ax - 5000) * (qx - ax) + (ay - 5000) * (qy - ay)) AS b, (ax - 5000) ** 2 + (ay - 5000) ** 2 - 3000.0 ** 2 AS k FROM (SELECT road, {_ENDS} FROM v_roads))))""")
def segment_in_disc(s: Shapes):
    a, b = G.first_point("coords"), G.last_point("coords")
    v = G.segment_in_disc_length(a["x"], a["y"], b["x"], b["y"], F.lit(5000.0), F.lit(5000.0), F.lit(3000.0))
    return s.roads().select("road", v.alias("len"))
