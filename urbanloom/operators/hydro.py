"""Drainage networks, basins, terrain indices and flood exposure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.classify import basin_age, clip01, drainage_quality, named_bin
from ..functions.formulas import (
    exposure_index, hydrological_relevance, hypsometric_integral, stream_power_index, terrain_profile,
    topographic_wetness_index,
)
from ..scale import one_row, quantile_row
from .table import bin_quantile, max_norm, percentile_rank


def strahler_normalise(df: DataFrame, name: str = "strahler_order") -> DataFrame:
    """First column named after the stream order, as a number; missing values and missing columns give 1."""
    hit = next((c for c in df.columns if "strahler" in c.lower() or "ordem" in c.lower()), None)
    v = F.lit(1.0) if hit is None else F.coalesce(F.col(hit).try_cast("double"), F.lit(1.0))
    return df.withColumn(name, v)


def drainage_density(layers: dict[str, DataFrame], coords: str, area_km2: Column | None = None) -> DataFrame:
    """km of line per km2, per layer and in total; the area defaults to the extent of all layers."""
    parts = []
    for n, d in layers.items():
        b = G.line_bbox(coords)
        parts.append(d.agg(
            F.lit(n).alias("layer"), (F.sum(G.line_length(coords)) / 1000).alias("length_km"),
            F.min(b["minx"]).alias("x0"), F.min(b["miny"]).alias("y0"), F.max(b["maxx"]).alias("x1"), F.max(b["maxy"]).alias("y1"),
        ))
    t = reduce(DataFrame.unionByName, parts)
    e = one_row(t, a=(F.max("x1") - F.min("x0")) * (F.max("y1") - F.min("y0")) / 1e6)["a"]
    area = e if area_km2 is None else area_km2
    total = t.agg(F.lit("total").alias("layer"), F.sum("length_km").alias("length_km"))
    out = t.select("layer", "length_km").unionByName(total)
    return out.withColumn("density", F.col("length_km") / area)


def drainage_pattern(lines: DataFrame, coords: str) -> DataFrame:
    """Pattern scores from the 18-bin direction histogram and the best pattern with its confidence."""
    ang = lines.where(F.size(coords) >= 2).select(G.axis_angle(coords).alias("a"))
    h = ang.groupBy(F.least(F.floor(F.col("a") / 10), F.lit(17)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    bins = lines.sparkSession.range(18).select(F.col("id").alias("bin"))
    n = one_row(h, n=F.sum("c"))["n"]
    p = bins.join(h, "bin", "left").select("bin", (F.coalesce("c", F.lit(0)) / n).alias("p"))
    # bins starting less than 10 degrees from 0, 90 or 180
    cross = F.col("bin").isin(0, 9)
    s = p.agg((1 - F.stddev_pop("p") * 10).alias("d"), (F.max("p") * 2).alias("l"), (F.sum(F.when(cross, F.col("p"))) * 1.5).alias("r"))
    best = F.greatest("d", "l", "r", F.lit(0.0))
    name = F.when(F.col("d") == best, "dendrítico").when(F.col("l") == best, "paralelo").when(F.col("r") == best, "retangular").otherwise("radial")
    return s.select(
        F.col("d").alias("dendritic_score"), F.col("l").alias("parallel_score"), F.col("r").alias("rectangular_score"),
        name.alias("pattern"), F.least(F.lit(1.0), best).alias("confidence"),
    )


def water_quality_indices(lines: DataFrame, sinuosity: str, density: Column, connectivity: Column) -> DataFrame:
    """Sinuosity, drainage and connectivity indices in [0, 1]."""
    s = F.col(sinuosity)
    high, low = F.avg(F.when(s.isNotNull(), (s > 1.5).cast("double"))), F.avg(F.when(s.isNotNull(), (s < 1.05).cast("double")))
    g = lines.agg(F.avg(s).alias("mean_sinuosity"), (high * 100).alias("high_sinuosity_pct"), clip01(high * 0.7 + (1 - low) * 0.3).alias("sinuosity_quality"))
    return g.withColumns({"drainage_quality": drainage_quality(density), "connectivity_quality": clip01(connectivity)})


def connectivity_quality(components: Column, density: Column, largest: Column, features: Column) -> Column:
    """0.4 (1 - fragmentation) + 3 network density + 0.3 largest share, in [0, 1]."""
    n = F.greatest(features, F.lit(1))
    return clip01((1 - components / n) * 0.4 + density * 10 * 0.3 + largest / n * 0.3)


def stream_power(df: DataFrame, strahler: str = "strahler_order", slope: str = "slope_pct") -> DataFrame:
    d = df.withColumn("stream_power_index", stream_power_index(strahler, slope))
    return bin_quantile(d, "stream_power_index", "erosion_potential",
                        ["Baixo Potencial Erosivo", "Médio Potencial Erosivo", "Alto Potencial Erosivo"])


def basin_terrain(df: DataFrame, area_m2: str) -> DataFrame:
    """Hypsometric integral, age class, ruggedness class, wetness index and moisture class of basins."""
    d = df.withColumn("hypsometric_integral", hypsometric_integral("elevation_mean", "elevation_min", "elevation_max"))
    d = d.withColumns({"basin_age_class": basin_age("hypsometric_integral"), "ruggedness_index": F.col("elevation_std")})
    d = bin_quantile(d, "ruggedness_index", "terrain_ruggedness_class",
                     ["Baixa Rugosidade", "Rugosidade Média", "Alta Rugosidade"], default="Indeterminada")
    d = d.withColumn("topographic_wetness_index", topographic_wetness_index(area_m2, "elevation_range", "hypsometric_integral"))
    return bin_quantile(d, "topographic_wetness_index", "moisture_potential",
                        ["Baixo Potencial de Umidade", "Médio Potencial de Umidade", "Alto Potencial de Umidade"])


def nature_indices(df: DataFrame, zones: str = "fixed") -> DataFrame:
    """Relief, profile, percentile, zone, exposure, hydrological relevance and protection index of areas."""
    d = df.withColumns({
        "terrain_roughness_index": F.col("elevation_std"), "relief_class": named_bin("elevation_range", "relief"),
        "terrain_profile": terrain_profile("elevation_min", "elevation_max", "elevation_median"),
        "exposure_index": exposure_index("elevation_percentile_10", "elevation_percentile_90", "elevation_mean"),
    })
    d = max_norm(d, ["terrain_roughness_index"], "_rel").withColumnRenamed("terrain_roughness_index_rel", "relative_roughness")
    if zones == "fixed":
        zone = named_bin("elevation_mean", "elevation_zone")
    else:
        s = one_row(df, m=F.avg("elevation_mean"), s=F.stddev_samp("elevation_mean"))
        zone = F.when(F.col("elevation_mean") < s["m"] - s["s"], "Baixada").when(F.col("elevation_mean") > s["m"] + s["s"], "Montanhas Altas").otherwise("Colinas Altas")
    d = d.withColumn("elevation_zone", zone)
    d = percentile_rank(d, "elevation_mean", "elevation_percentile")
    q25 = F.get(quantile_row(df, "elevation_mean", [0.25]), 0)
    t = one_row(df, e=F.max("elevation_mean"), r=F.max("elevation_std"), g=F.max("elevation_range"))
    d = d.withColumn("hydrological_relevance", hydrological_relevance(
        "elevation_mean", "terrain_roughness_index", "terrain_profile", q25, t["e"], t["r"]))

    def part(c: str, top: Column) -> Column:
        return F.when(top > 0, F.col(c) / top).otherwise(0.0)

    d = d.withColumn("ecological_protection_index", part("elevation_mean", t["e"]) * 0.4 + part("elevation_std", t["r"]) * 0.4 + part("elevation_range", t["g"]) * 0.2)
    return d.withColumn("ecological_protection_category", named_bin(F.coalesce("ecological_protection_index", F.lit(0.0)), "eco"))


def affected_population(overlaps: DataFrame, sectors: DataFrame, key: str, level: str, area: str, pop: str) -> DataFrame:
    """Area (km2) and pro-rata population per risk level and sector, shares, predominant level.

    ``overlaps`` holds one row per sector and zone piece ``(key, level, overlap)`` in square metres.
    """
    pieces = overlaps.groupBy(key).agg(*[
        F.sum(F.when(F.col(level) == n, F.col("overlap")).otherwise(0.0)).alias(f"_a{n}") for n in (1, 2, 3)
    ])
    j = sectors.select(key, area, pop).join(pieces, key, "left").fillna(0.0, subset=["_a1", "_a2", "_a3"])
    names = {3: "alto", 2: "medio", 1: "baixo"}
    cols = {}
    for n, t in names.items():
        cols[f"area_risco_{t}_km2"] = F.col(f"_a{n}") / 1e6
        cols[f"pop_risco_{t}"] = F.col(pop) * F.col(f"_a{n}") / F.col(area)
    j = j.withColumns(cols)
    area_t = sum(F.col(f"area_risco_{t}_km2") for t in names.values())
    pop_t = sum(F.col(f"pop_risco_{t}") for t in names.values())
    j = j.withColumns({"area_risco_total_km2": area_t, "pop_risco_total": pop_t})
    level_name = F.when(F.col("pop_risco_alto") > 0, "Risco Alto").when(F.col("pop_risco_medio") > 0, "Risco Médio").when(
        F.col("pop_risco_baixo") > 0, "Risco Baixo").otherwise("Sem risco")
    return j.withColumns({
        "pct_area_risco": F.col("area_risco_total_km2") / (F.col(area) / 1e6) * 100,
        "pct_pop_risco": F.col("pop_risco_total") / F.col(pop) * 100, "nivel_risco_predominante": level_name,
    }).drop("_a1", "_a2", "_a3")


def population_at_risk_totals(df: DataFrame, pop: str) -> DataFrame:
    cols = ["pop_risco_total", "pop_risco_alto", "pop_risco_medio", "pop_risco_baixo",
            "area_risco_alto_km2", "area_risco_medio_km2", "area_risco_baixo_km2"]
    return df.agg(F.sum(pop).alias("pop_total"), *[F.sum(c).alias(c) for c in cols])


def assign_risk(features: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Highest level of the matched zones ``(key, level, description)``; ``Sem risco`` without a match."""
    few = hits.select(key, "level", "description").distinct()  # merged where they were found, before the structs are sorted
    best = few.groupBy(key).agg(F.max(F.struct("level", "description")).alias("z"))
    return features.join(best, key, "left").withColumns({
        "risco_inundacao": F.coalesce("z.level", F.lit(0)), "nivel_risco": F.coalesce("z.description", F.lit("Sem risco")),
    }).drop("z")


def sector_building_risk(sectors: DataFrame, inside: DataFrame, key: str, area_m2: str) -> DataFrame:
    """Buildings and buildings at risk per sector; ``inside`` is ``(key, risco_inundacao)``."""
    g = inside.groupBy(key).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("risco_inundacao") > 0).alias("r"))
    j = sectors.join(g, key, "left").withColumns({"total_edificacoes": F.coalesce("t", F.lit(0)), "edificacoes_em_risco": F.coalesce("r", F.lit(0))}).drop("t", "r")
    return j.withColumns({
        "dens_edif_risco": F.col("edificacoes_em_risco") / (F.col(area_m2) / 1e6),
        "pct_edif_risco": F.when(F.col("total_edificacoes") > 0, F.col("edificacoes_em_risco") / F.col("total_edificacoes") * 100).otherwise(0.0),
    })


def integrated_flood_risk(df: DataFrame) -> DataFrame:
    """0.3 area + 0.4 population + 0.3 buildings, each scaled to its maximum, in five classes."""
    d = max_norm(df, ["pct_area_risco", "pct_pop_risco", "pct_edif_risco"], "_n", 100.0)
    d = d.withColumn("indice_risco_integrado", 0.3 * F.col("pct_area_risco_n") + 0.4 * F.col("pct_pop_risco_n") + 0.3 * F.col("pct_edif_risco_n"))
    d = d.withColumn("categoria_risco", named_bin("indice_risco_integrado", "flood_index"))
    return d.withColumnsRenamed({"pct_area_risco_n": "area_risco_norm", "pct_pop_risco_n": "pop_risco_norm", "pct_edif_risco_n": "edif_risco_norm"})


def order_stats(df: DataFrame, order: str, cols: list[str]) -> DataFrame:
    """Mean, sample std and count of measures per stream order or basin level."""
    aggs = [F.count(F.lit(1)).alias("count")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(order).agg(*aggs)


def elevation_drop(nodes: DataFrame) -> DataFrame:
    """Mean spring elevation minus mean outlet elevation of ``(type, elevation)`` nodes."""
    return nodes.agg(
        F.avg(F.when(F.col("type") == "spring", F.col("elevation"))).alias("springs"),
        F.avg(F.when(F.col("type") == "outlet", F.col("elevation"))).alias("outlets"),
    ).withColumn("drop", F.col("springs") - F.col("outlets"))
