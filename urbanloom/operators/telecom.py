"""Telecom stations: power, coverage, hex vulnerability, coverage network and importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.classify import named_bin, weighted_index
from ..functions.formulas import coverage_radius_km, eirp_dbm, sector_area_km2
from ..scale import one_row, round_table
from .spatial import box_pairs, density_within, with_box
from .table import minmax_norm


def station_power(df: DataFrame, watts: str, gain: str) -> DataFrame:
    d = df.withColumn("EIRP_dBm", eirp_dbm(watts, gain))
    return d.withColumn("categoria_eirp", named_bin("EIRP_dBm", "eirp"))


def station_coverage(df: DataFrame, key: str, freq: str, r: float = 1000.0) -> DataFrame:
    """Neighbour density, area type, radius, radius class and sector area."""
    n = density_within(df, key, r).select(key, F.col("neighbours").alias("densidade_local"))
    d = df.join(n, key)
    d = d.withColumn("tipo_area", named_bin("densidade_local", "telecom_area"))
    d = d.withColumn("Raio_Cobertura_km", coverage_radius_km("EIRP_dBm", freq, "tipo_area"))
    return d.withColumns({
        "categoria_raio": named_bin("Raio_Cobertura_km", "radius"), "Area_Cobertura_km2": sector_area_km2("Raio_Cobertura_km"),
    })


def operator_summary(df: DataFrame, operator: str) -> DataFrame:
    return df.groupBy(F.col(operator).alias("Operadora")).agg(
        F.count(F.lit(1)).alias("Quantidade"), F.avg("EIRP_dBm").alias("EIRP_Media"),
        F.avg("Raio_Cobertura_km").alias("Raio_Medio"), F.sum("Area_Cobertura_km2").alias("Cobertura_Total_km2"),
    )


def hex_sector_pairs(hexes: DataFrame, sectors: DataFrame, size: float) -> DataFrame:
    """Intersecting (hexagon, sector) pairs; both frames carry ``ring``."""
    h, s = with_box(hexes, "ring"), with_box(sectors, "ring")
    p = box_pairs(h, s, size)
    return p.where(G.polygons_intersect(F.array("l_ring"), F.array("r_ring")))


def hex_cover_join(hexes: DataFrame, sectors: DataFrame, size: float, operator: str, key: str, all_sectors: bool = False) -> DataFrame:
    """Per hexagon: operators, sectors, mean EIRP of one sector per operator (the lowest id), vulnerability.

    ``all_sectors`` counts and averages every intersecting sector instead.
    """
    p = hex_sector_pairs(hexes, sectors, size).select(
        F.col("l_q").alias("q"), F.col("l_r").alias("r"), F.col(f"r_{operator}").alias("op"), F.col(f"r_{key}").alias("sid"), F.col("r_EIRP_dBm").alias("e"),
    )
    per = p.groupBy("q", "r", "op").agg(F.min_by("e", "sid").alias("e1"), F.sum("e").alias("es"), F.count(F.lit(1)).alias("n"))
    if all_sectors:
        g = per.groupBy("q", "r").agg(F.count(F.lit(1)).alias("ops"), F.sum("n").alias("secs"), (F.sum("es") / F.sum("n")).alias("pm"))
    else:
        g = per.groupBy("q", "r").agg(F.count(F.lit(1)).alias("ops"), F.count(F.lit(1)).alias("secs"), F.avg("e1").alias("pm"))
    d = hexes.select("q", "r").join(g, ["q", "r"], "left").select(
        "q", "r", F.coalesce("ops", F.lit(0)).alias("num_operadoras"), F.coalesce("secs", F.lit(0)).alias("num_setores"), F.col("pm").alias("potencia_media"),
    )
    return d.withColumns({
        "vulnerabilidade": named_bin("num_operadoras", "hex_vulnerability"),
        "densidade_potencia": F.when(F.col("num_setores") > 0, F.col("potencia_media") / F.col("num_setores")),
    })


def hex_operator_matrix(pairs: DataFrame, operators: list[str]) -> DataFrame:
    """Sectors per hexagon and operator as columns."""
    return pairs.groupBy("q", "r").pivot("op", operators).agg(F.count(F.lit(1))).fillna(0)


def hex_voronoi_stats(hexes: DataFrame, points: DataFrame, cells: DataFrame, size: float, density: str, radius: str, tile: float) -> DataFrame:
    """Per hexagon: stations inside, their mean density and radius, share covered by Voronoi cells.

    ``cells`` carries open ``ring`` arrays; hexagons without stations get zeros.
    """
    from .grid import hex_key

    q, r = hex_key("x", "y", size)
    inside = points.groupBy(q.alias("q"), r.alias("r")).agg(
        F.count(F.lit(1)).alias("erbs_count"), F.avg(density).alias("densidade_media"), F.avg(radius).alias("raio_medio")
    )
    closed = cells.withColumn("ring", F.concat("ring", F.slice("ring", 1, 1)))
    p = box_pairs(with_box(hexes.select("q", "r", "ring"), "ring"), with_box(closed.select("ring"), "ring"), tile)
    cover = p.groupBy(F.col("l_q").alias("q"), F.col("l_r").alias("r")).agg(
        (F.sum(G.overlap_area("r_ring", "l_ring")) / F.first(G.ring_area("l_ring")) * 100).alias("percentual_cobertura")
    )
    j = hexes.select("q", "r").join(inside, ["q", "r"], "left").join(cover, ["q", "r"], "left")
    some = F.col("erbs_count").isNotNull()
    return j.select(
        "q", "r", F.coalesce("erbs_count", F.lit(0)).alias("erbs_count"), F.coalesce("densidade_media", F.lit(0.0)).alias("densidade_media"),
        F.coalesce("raio_medio", F.lit(0.0)).alias("raio_medio"), F.when(some, F.coalesce("percentual_cobertura", F.lit(0.0))).otherwise(0.0).alias("percentual_cobertura"),
    )


def station_hex_edges(pairs: DataFrame, key: str) -> DataFrame:
    """Station-hexagon edges ``(erb, q, r)`` of intersecting coverage."""
    return pairs.select(F.col(f"r_{key}").alias("erb"), F.col("l_q").alias("q"), F.col("l_r").alias("r")).distinct()


def station_station_edges(stations: DataFrame, key: str, operator: str, cluster: str = "cluster_id", block: int = 2000) -> DataFrame:
    """Edges between all stations of one operator in one cluster, with their distance in km.

    The edge set itself is the result here, so its rows are the pairs of a group. A group is dealt into blocks of about
    ``block`` stations by a hash of their key; every two blocks of it meet once, in a place of their own, so the largest
    task holds a few pairs of blocks however large the group is. A station is copied once per block of its group.
    """
    own = stations.where(F.col(cluster) >= 0).select(F.col(key).alias("id"), "x", "y", F.col(cluster).alias("c"), F.col(operator).alias("o"))
    own = round_table(own)
    sizes = own.groupBy("c", "o").agg(F.ceil(F.count(F.lit(1)) / block).alias("n"))
    meetings = sizes.agg(F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()[0] or 1
    dealt = own.join(sizes, ["c", "o"]).withColumn("at", F.pmod(F.xxhash64("id"), F.col("n")))
    tasks = int(min(20_000, max(meetings, own.sparkSession.sparkContext.defaultParallelism)))

    def side(name: str, mine: str, other: str, begin: Column, end: Column) -> DataFrame:
        copies = dealt.select("c", "o", F.struct("id", "x", "y").alias(name), F.col("at").alias(mine), F.explode(F.sequence(begin, end)).alias(other))
        return copies.repartition(tasks, "c", "o", "i", "j")

    a = side("a", "i", "j", F.col("at"), F.col("n") - 1)
    b = side("b", "j", "i", F.lit(0).cast("long"), F.col("at"))
    # of two blocks all pairs count, of one block each pair once
    j = a.join(b, ["c", "o", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("a.id") < F.col("b.id")))
    km = G.hypot2(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")) / 1000
    return j.select(F.least("a.id", "b.id").alias("src"), F.greatest("a.id", "b.id").alias("dst"), km.alias("km"))


def coverage_bipartite_graph(hex_edges: DataFrame, erb_edges: DataFrame) -> DataFrame:
    """One typed edge table ``(kind, src, dst, km)`` with text node names."""
    h = hex_edges.select(F.lit("erb_hex").alias("kind"), F.concat(F.lit("erb_"), F.col("erb")).alias("src"),
                         F.concat(F.lit("hex_"), F.col("q"), F.lit("_"), F.col("r")).alias("dst"), F.lit(None).cast("double").alias("km"))
    e = erb_edges.select(F.lit("erb_erb").alias("kind"), F.concat(F.lit("erb_"), F.col("src")).alias("src"),
                         F.concat(F.lit("erb_"), F.col("dst")).alias("dst"), "km")
    return h.unionByName(e)


def redundancy(hex_edges: DataFrame) -> DataFrame:
    """Stations per hexagon and, per station, the mean number of alternatives over its hexagons."""
    n = hex_edges.groupBy("q", "r").agg(F.count(F.lit(1)).alias("n"))
    return hex_edges.join(n, ["q", "r"]).groupBy("erb").agg(
        F.count(F.lit(1)).alias("hexagons"), F.avg(F.col("n") - 1).alias("redundancy")
    )


def vulnerable_cover(hex_edges: DataFrame, hexes: DataFrame) -> DataFrame:
    """Vulnerable hexagons covered per station."""
    v = hexes.where(F.col("vulnerabilidade").isin("Alta vulnerabilidade", "Média vulnerabilidade")).select("q", "r")
    return hex_edges.join(v, ["q", "r"], "left_semi").groupBy("erb").agg(F.count(F.lit(1)).alias("cobertura_vulneravel"))


def erb_importance(df: DataFrame, cover: DataFrame | None = None, key: str = "erb") -> DataFrame:
    """Weighted importance, class (NULL above 1) and the critical-for-evacuation flag."""
    cols = ["EIRP_dBm", "Raio_Cobertura_km", "betweenness", "degree", "closeness"]
    d = minmax_norm(df, cols, constant=0.5)
    s = one_row(df, lo=F.min("densidade_local"), hi=F.max("densidade_local"))
    inv = F.when(s["hi"] > s["lo"], 1 - (F.col("densidade_local") - s["lo"]) / (s["hi"] - s["lo"])).otherwise(0.0)
    score: Column = weighted_index({
        "EIRP_dBm_norm": 0.15, "Raio_Cobertura_km_norm": 0.15, "betweenness_norm": 0.25, "degree_norm": 0.20, "closeness_norm": 0.15,
    }) + inv * 0.10
    covered = F.lit(True)
    if cover is not None:
        d = d.join(cover, key, "left").withColumn("cobertura_vulneravel", F.coalesce("cobertura_vulneravel", F.lit(0)))
        top = one_row(cover, m=F.max("cobertura_vulneravel"))["m"]
        score = score + F.when(top > 0, F.col("cobertura_vulneravel") / top * 0.2).otherwise(0.0)
        covered = F.col("cobertura_vulneravel") > 0
    d = d.withColumn("pontuacao_importancia", score)
    d = d.withColumn("classe_importancia", named_bin("pontuacao_importancia", "importance"))
    crit = F.coalesce(F.col("classe_importancia").isin("Alta", "Crítica"), F.lit(False)) & (F.col("betweenness_norm") > 0.6) & covered
    return d.withColumn("erb_critica_evacuacao", crit)


def rail_importance(df: DataFrame) -> DataFrame:
    """0.4 betweenness + 0.3 degree centrality + 0.3 length over the longest, in five levels."""
    from ..functions.classify import score_class

    top = one_row(df, m=F.max("length_km"))["m"]
    score = 0.4 * F.col("betweenness") + 0.3 * F.col("degree_centrality") + 0.3 * F.col("length_km") / top
    d = df.withColumn("pontuacao_importancia", score)
    return d.withColumn("nivel_importancia", score_class("pontuacao_importancia"))


def road_quality_metrics(roads: DataFrame, nodes: DataFrame, area_km2: Column) -> DataFrame:
    """Sinuosity and slope shares of roads with intersection density and mean degree."""
    s, p = F.col("sinuosity"), F.col("slope_pct")
    x = one_row(nodes, n=F.count(F.lit(1)), d=F.avg("degree"))
    return roads.agg(
        F.avg(s).alias("sinuosity_mean"), F.max(s).alias("sinuosity_max"), F.min(s).alias("sinuosity_min"), F.stddev_samp(s).alias("sinuosity_std"),
        (F.avg(F.when(s.isNotNull(), (s < 1.05).cast("double"))) * 100).alias("pct_straight"),
        (F.avg(F.when(s.isNotNull(), (s > 1.2).cast("double"))) * 100).alias("pct_winding"),
        F.avg(p).alias("slope_mean"), (F.avg(F.when(p.isNotNull(), (p > 8.0).cast("double"))) * 100).alias("pct_high_slope"),
    ).withColumns({"intersections_per_km2": x["n"] / area_km2, "avg_intersection_degree": x["d"]})
