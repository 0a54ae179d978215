"""Enrichment of whole layers: compositions of the operators, one DataFrame in, one out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import tags
from ..functions.classify import (
    impervious_pct, map_by_substring, map_class, named_bin, railway_class, simple_building_class,
    simple_landuse_class, simple_road_class,
)
from ..functions import lookups as L
from ..functions.formulas import building_volumetrics
from ..operators import centrality as CE
from ..operators import cluster as CL
from ..operators import graph as GR
from ..operators import grid as GD
from ..operators import hydro as H
from ..operators import population as PO
from ..operators import raster as R
from ..operators import spatial as S
from ..operators import table as T
from ..operators import telecom as TE
from ..operators.hulls import orientation_degrees, ring_hull
from ..scale import cut_lineage


def building_shape(df: DataFrame) -> DataFrame:
    """Aspect ratio, elongation, hull complexity, orientation, volumes of buildings with ``ring``."""
    b = G.line_bbox("ring")
    w, h = b["maxx"] - b["minx"], b["maxy"] - b["miny"]
    long, short = F.greatest(w, h), F.least(w, h)
    d = df.withColumns({"area": G.ring_area("ring"), "perimeter": G.line_length("ring")})
    d = d.withColumns({
        "compactness_index": G.compactness("area", "perimeter"), "aspect_ratio": long / F.greatest(short, F.lit(0.001)),
        "elongation": F.when(short > 0, long / short), "_hull": ring_hull(F.col("ring")),
        "orientation_degrees": orientation_degrees(F.col("ring")),
        "volume_density": F.when((w * h > 0) & F.col("height").isNotNull(), F.col("area") / (w * h)),
        **building_volumetrics("area", "perimeter", "height"),
    })
    return d.withColumn("shape_complexity", F.when(F.col("area") > 0, G.ring_area("_hull") / F.col("area"))).drop("_hull")


def enrich_buildings(df: DataFrame, key: str, roads: DataFrame, road_key: str, dem: DataFrame, affine: R.Affine,
                     eps: float = 0.05, min_samples: int = 5, cell: float = 100.0) -> DataFrame:
    """Heights, shape, clusters, street relation, terrain and cell metrics of buildings."""
    hh, lv = tags.fill_height_levels("height", "levels", "other_tags", "building")
    d = df.withColumns({"height": hh, "levels": lv})
    d = building_shape(d)
    c = G.ring_centroid("ring")
    base = cut_lineage(d.withColumns({"x": c["x"], "y": c["y"]}))  # read by every step below
    at = base.select(key, "x", "y")
    cl = cut_lineage(CL.dbscan(CL.standardise(at), key, eps, min_samples).select(key, "cluster_id"))
    stats = CL.cluster_stats(base.join(cl, key)).select("cluster_id", "cluster_class", F.col("density").alias("cluster_density"), "type_diversity")
    near = S.nearest_line(at, roads, key, road_key, "coords").drop("x", "y").withColumnRenamed("distance", "distance_to_road")
    dens = S.line_density_within(at, roads, key, road_key, "coords")
    elev = R.sample_points(base.select(key, "x", "y", "height"), dem, affine, "height").drop("x", "y", "height")
    slope = R.focal_slope(at, key, dem, affine)
    cells = cut_lineage(GD.cell_centrality(GD.classify_cells(GD.grid_morphology(S.with_box(base, "ring"), cell))))
    out = base.join(cl, key).join(stats, "cluster_id", "left")
    for side in (near, dens, elev, slope):
        out = out.join(side, key, "left")
    return GD.grid_back_join(out, cells, cell, ["urban_typology", "centrality_index", "centrality_class"]).drop("cx", "cy")


def enrich_roads(df: DataFrame, key: str, dem: DataFrame, affine: R.Affine, k: int | None = None) -> DataFrame:
    """Sinuosity, betweenness, connectivity, terrain and class of roads."""
    d = df.withColumns({"length": G.line_length("coords"), "sinuosity": G.sinuosity("coords", "one")})
    e = cut_lineage(GR.line_endpoints(d, key, "coords"))
    bt = CE.line_betweenness(e, key, "length", k)
    con = GR.feature_connectivity(e, key)
    terrain = R.sample_lines(d, key, "coords", dem, affine)
    out = d.join(bt, key, "left").join(con, key, "left").join(terrain, key, "left")
    if "highway" in df.columns:
        return out.withColumn("road_class", map_class("highway", L.ROAD_CLASS_ENRICHED, "Local"))
    return T.bin_quantile(out, "betweenness", "road_class", ["Local", "Secundária", "Coletora", "Arterial"], (0.25, 0.5, 0.75), inclusive_top=False, default="Local")


def enrich_hydro(reaches: DataFrame, key: str, basins: DataFrame, basin_key: str, dem: DataFrame, affine: R.Affine, tile: float) -> dict[str, DataFrame]:
    """Reaches with order, terrain and stream power; basins with terrain indices; typed nodes."""
    d = H.strahler_normalise(reaches).withColumn("sinuosity", G.sinuosity("coords", "one"))
    d = d.join(R.sample_lines(d, key, "coords", dem, affine), key, "left")
    d = H.stream_power(d)
    z = R.zonal_stats(S.with_box(basins.withColumn("rings", F.array("ring")), "ring"), basin_key, "rings", dem, affine, tile)
    b = basins.withColumn("area_m2", G.ring_area("ring")).join(z.drop("hypsometric_integral"), basin_key, "left")
    nodes = GR.stream_nodes(GR.line_endpoints(d, key, "coords"), key)
    return {"trecho_drenagem": d, "area_drenagem": H.basin_terrain(b, "area_m2"), "nodes": nodes}


def enrich_landuse(df: DataFrame, key: str, dem: DataFrame, affine: R.Affine, tile: float) -> DataFrame:
    """Category, size, compactness, elevation and slope classes of land-use polygons."""
    d = df.withColumns({
        "area_km2": G.ring_area("ring") / 1e6, "perimeter_km": G.line_length("ring") / 1000,
        "land_category": map_by_substring("landuse", L.LAND_KEYWORDS),
    })
    d = d.withColumn("compactness", G.compactness("area_km2", "perimeter_km", "top"))
    d = d.withColumns({"size_category": named_bin("area_km2", "land_size"), "compactness_category": named_bin("compactness", "compactness")})
    boxed = cut_lineage(S.with_box(d.withColumn("rings", F.array("ring")), "ring"))
    z = R.zonal_stats(boxed, key, "rings", dem, affine, tile)
    sl = R.zonal_slope(boxed, key, "rings", dem, affine, tile)
    out = d.join(z, key, "left").join(sl, key, "left")
    return out.withColumn("elevation_category", named_bin("elevation_range", "elevation_range"))


def enrich_natural(df: DataFrame, key: str, dem: DataFrame, affine: R.Affine, tile: float) -> DataFrame:
    boxed = S.with_box(df.withColumn("rings", F.array("ring")), "ring")
    z = cut_lineage(R.zonal_stats(boxed, key, "rings", dem, affine, tile))
    return H.nature_indices(df.join(z, key, "left"))


def enrich_railways(df: DataFrame, key: str) -> DataFrame:
    """Tag columns, sinuosity, connectivity, centrality and importance of railways."""
    d = df.withColumns({t: tags.tag_value("other_tags", t) for t in ("gauge", "operator", "service", "usage", "ref", "branch", "layer")})
    d = d.withColumns({
        "electrified": tags.has_tag("other_tags", "electrified"), "is_bridge": tags.has_tag("other_tags", "bridge"),
        "is_tunnel": tags.has_tag("other_tags", "tunnel"), "railway_class": railway_class("usage", "service"),
        "length_km": G.line_length("coords") / 1000, "sinuosity": G.sinuosity("coords", "one"),
    })
    e = cut_lineage(GR.build_tolerant_graph(d, key, "coords"))
    cen = cut_lineage(CE.centralities(e, "length").join(GR.degree_centrality(e).drop("degree"), "node"))
    out = d.join(GR.feature_connectivity(e, key), key, "left")
    for m in ("betweenness", "closeness", "degree_centrality"):
        out = out.join(CE.line_mean(e, key, cen, m), key, "left")
    return TE.rail_importance(out)


def enrich_census(df: DataFrame, key: str, dem: DataFrame, affine: R.Affine, tile: float, pop: str | None = None) -> DataFrame:
    """Area, elevation, population by hour, vulnerability and evacuation priority of sectors."""
    d = df.withColumns({"area_km2": G.ring_area("ring") / 1e6, "perimetro_km": G.line_length("ring") / 1000})
    d = d.withColumns({"compacidade": G.compactness("area_km2", "perimetro_km"), "categoria_tamanho": named_bin("area_km2", "sector_size")})
    z = cut_lineage(R.zonal_stats(S.with_box(d.withColumn("rings", F.array("ring")), "ring"), key, "rings", dem, affine, tile))
    d = d.join(z, key, "left")
    d = PO.population_by_hour(PO.estimate_population(d, "area_km2", pop), "tipo_area")
    d = cut_lineage(PO.vulnerability(d))
    return PO.evacuation_priority(d, key)


def enrich_telecom(df: DataFrame, key: str, operator: str, eps: float = 500.0, min_samples: int = 3, hex_size: float = 500.0) -> dict[str, DataFrame]:
    """Stations with power, coverage, clusters and Voronoi area; hexagons with vulnerability."""
    d = df.where(F.col("azimuth").isNotNull())
    d = cut_lineage(TE.station_coverage(TE.station_power(d, "watts", "gain"), key, "freq"))
    cl = CL.dbscan(d.select(key, "x", "y"), key, eps, min_samples).select(key, "cluster_id")
    v = CL.voronoi_cells(d.select(key, "x", "y"), key).select("x", "y", "area_km2", "neighbours")
    st = d.join(cl, key).join(v, ["x", "y"], "left")
    sectors = d.withColumn("ring", planar_sector("x", "y", "azimuth", F.col("Raio_Cobertura_km") * 1000)).where(F.col("ring").isNotNull())
    hexes = GD.hex_cover(S.point_box(d), hex_size)
    cover = TE.hex_cover_join(hexes, sectors.select(key, operator, "EIRP_dBm", "ring"), hex_size * 2, operator, key)
    return {"stations": st, "sectors": sectors, "hexagons": cover}


def planar_sector(x, y, azimuth, radius, opening: float = 120.0, steps: int = 30):
    """Wedge ring in projected metres."""
    import math

    x, y, azimuth, radius = map(G._c, (x, y, azimuth, radius))
    mid = F.radians(F.pmod(90 - azimuth, F.lit(360.0)))
    half = math.radians(opening) / 2
    arc = F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda i: G.point(x + radius * F.cos(mid - half + i * (2 * half / steps)), y + radius * F.sin(mid - half + i * (2 * half / steps))),
    )
    return F.when((radius > 0) & azimuth.isNotNull(), F.concat(F.array(G.point(x, y)), arc, F.array(G.point(x, y))))


def quick_enrich_all(buildings: DataFrame, landuse: DataFrame, roads: DataFrame, natural: DataFrame) -> dict[str, DataFrame]:
    """Basic measures, classes and constant defaults for four layers."""
    b = buildings.withColumns({
        "area_m2": G.ring_area("ring"), "perimeter_m": G.line_length("ring"), "height": F.lit(3.0), "levels": F.lit(1.0),
        "building_class": simple_building_class("building"),
    }).withColumn("compactness_index", G.compactness("area_m2", "perimeter_m"))
    u = landuse.withColumns({"area_km2": G.ring_area("ring") / 1e6, "perimeter_km": G.line_length("ring") / 1000, "landuse_class": simple_landuse_class("landuse"), "density_class": F.lit("unknown")})
    u = u.withColumn("impervious_pct", impervious_pct("landuse_class"))
    flat = {c: F.lit(0.0) for c in ("elevation_min", "elevation_max", "elevation_mean", "elevation_range", "slope_pct", "slope_deg")}
    r = roads.withColumns({
        "length_km": G.line_length("coords") / 1000, "sinuosity": F.coalesce(G.sinuosity("coords"), F.lit(1.0)),
        "road_class": simple_road_class("highway"), "connectivity": F.lit(2), **flat, "slope_class": F.lit("flat"),
    })
    n = natural.withColumns({"area_km2": G.ring_area("ring") / 1e6, "perimeter_km": G.line_length("ring") / 1000})
    return {"buildings": b, "landuse": u, "roads": r, "natural": n}


def road_features(d: DataFrame) -> DataFrame:
    """Curvature, point density, bearing, length and sinuosity categories, speed and time of lines."""
    from ..functions.formulas import travel_minutes

    d = d.withColumns({
        "length_m": G.line_length("coords"), "sinuosity": G.sinuosity("coords", "inf"), "curvature": G.curvature("coords"),
        "point_density": G.point_density("coords"), "bearing": G.bearing("coords"),
        "road_category": map_class(F.lower("highway"), L.ROAD_CATEGORY, "other"),
    })
    speed, minutes = travel_minutes("length_m", "road_category")
    return d.withColumns({
        "length_category": named_bin("length_m", "road_length", "left"), "sinuosity_category": named_bin("sinuosity", "road_sinuosity", "left"),
        "speed_kmh": speed, "travel_time_min": minutes,
    })


def prepare_road_graph(lines: DataFrame, key: str, tol: float = 1.0, weight: str = "length", k: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Snapped, cleaned lines as node and edge feature tables with classes and a split.

    Edges keep the first parallel line; only the largest component stays.
    """
    from ..functions.classify import normalise_text
    from ..operators import features as FE

    d = lines.withColumn("highway", normalise_text("highway"))
    d = T.dedup_geometry(T.repair_lines(d, "coords"), "coords", key)
    d = cut_lineage(road_features(GR.snap_topology(d, key, "coords", tol)))
    vocab = FE.ordinal_encode(d, "highway", "highway_code")
    e = cut_lineage(GR.build_road_graph(vocab, key, "coords", ["highway_code", "sinuosity", "curvature", "travel_time_min"]))
    cen = CE.centralities(e, weight, k)
    cls = GR.node_classes(e, "highway_code", "min")
    nodes = cut_lineage(cen.join(cls, "node"))
    nodes = T.zscore(nodes, ["degree", "betweenness", "closeness"], ddof=1)
    return FE.random_split(nodes, "node", seed=seed), e


def profile_directory(spark, path: str) -> DataFrame:
    """Profile of every layer or table below a folder: rows, columns, missing values, status."""
    import os

    from ..operators.profile import missing_report
    from ..sources.tables import read_csv_sniff

    parts = []
    for n in sorted(os.listdir(path)):
        full = os.path.join(path, n)
        try:
            if n.endswith(".parquet"):
                d = spark.read.parquet(full)
            elif n.lower().endswith((".csv", ".txt")):
                d = read_csv_sniff(spark, full)
            else:
                raise ValueError("unsupported kind")
            m = missing_report(d).agg(F.sum("missing").alias("missing"))
            parts.append(d.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(n).alias("file"), "rows", F.lit(len(d.columns)).alias("columns"), m.scalar().alias("missing"), F.lit("processed").alias("status")))
        except Exception as ex:  # a failed file is a row of the report
            status = "skipped" if isinstance(ex, ValueError) else "failed"
            parts.append(spark.range(1).select(
                F.lit(n).alias("file"), F.lit(None).cast("bigint").alias("rows"), F.lit(None).cast("int").alias("columns"),
                F.lit(None).cast("bigint").alias("missing"), F.lit(status).alias("status")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
