"""Population: weights, allocation, densities, hourly presence and the urban pulse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.classify import map_class, named_bin, use_profile
from ..functions.formulas import occupancy_units
from ..scale import exact_quantiles, join_on, one_row, with_position
from .profile import class_shares, describe_numeric
from .table import best_column, impute_positive_median, max_norm, robust_index, top_fraction_flag


def distribution_strategy(df: DataFrame, area: str | None, height: str | None, volume: str | None) -> str:
    """volume when most rows have one, else area x height, area, or a plain count (one aggregate row)."""
    if volume:
        share = df.agg(F.avg((F.coalesce(F.col(volume), F.lit(0)) > 0).cast("double")).alias("s")).first()["s"] or 0
        if share > 0.5:
            return "volume"
    if area and height:
        return "area_height"
    return "area" if area else "count"


def strategy_by_names(df: DataFrame) -> tuple[str, dict[str, str | None]]:
    """Strategy with the best covered area, height and volume columns found by name."""
    found = {
        "area": best_column(df, ["area"]),
        "volume": best_column(df, ["volume"]) if any("volume" in c.lower() for c in df.columns) else None,
        "height": best_column(df, ["height", "altura", "levels", "andar", "pavimento"]),
    }
    return distribution_strategy(df, found["area"], found["height"], found["volume"]), found


def distribution_weights(df: DataFrame, strategy: str, pop: str, residential: str = "is_residential",
                         area: str = "area", height: str = "height", volume: str = "volume") -> DataFrame:
    """Allocation weight of residential rows with a census match (all matched rows when none is residential)."""
    matched = F.col(pop).isNotNull()
    some = one_row(df, n=F.count_if(F.col(residential) & matched))["n"]
    base = df.withColumn("_m", matched & (F.col(residential) | (some == 0)))
    m = F.col("_m")
    if strategy == "volume":
        base = impute_positive_median(base, volume, m)
        w = F.col(volume)
    elif strategy == "area_height":
        base = impute_positive_median(base, area, m)
        base = base.withColumn(height, F.when(m & (F.col(height) <= 0), F.lit(1.0)).otherwise(F.col(height).cast("double")))
        w = F.col(area) * F.col(height)
    elif strategy == "area":
        base = impute_positive_median(base, area, m)
        w = F.col(area)
    else:
        w = F.lit(1.0)
    return base.withColumn("weight", F.when(m, w).otherwise(F.lit(0.0))).drop("_m")


def distribute_population(df: DataFrame, sector: str, pop: str, key: str, weight: str = "weight") -> DataFrame:
    """Sector total shared by weight, largest-remainder integers (ties: lowest key).

    Sector totals are partial sums joined back; the residual order is a range-partitioned position, so
    one huge sector is ranked by many tasks.
    """
    positive = F.col(weight) > 0
    tot = df.groupBy(sector).agg(F.sum(F.when(positive, F.col(weight))).alias("_w"), F.max(pop).alias("_p"))
    j = join_on(df, tot, [sector])
    est = F.when(positive & (F.col("_w") > 0) & (F.col("_p") > 0), F.col(weight) / F.col("_w") * F.col("_p")).otherwise(0.0)
    j = j.withColumn("_e", est).withColumns({"_f": F.floor("_e"), "_r": F.col("_e") - F.floor("_e")}).drop("_w", "_p", "_e")
    placed = with_position(j, [F.desc("_r"), F.col(key)], "_pos", by=[sector])
    given = placed.groupBy(sector).agg(F.sum("_f").alias("_g"), F.max(pop).alias("_p"), F.max(F.when(positive, 1)).alias("_ok"))
    out = join_on(placed, given, [sector])
    missing = F.when((F.col("_ok") == 1) & (F.col("_p") > 0), F.bround(F.col("_p") - F.col("_g"))).otherwise(0)
    extra = F.when(F.col("_pos") <= missing, 1).otherwise(0)
    return out.withColumn("estimated_population", (F.col("_f") + extra).cast("bigint")).drop("_f", "_r", "_pos", "_g", "_p", "_ok")


def density_metrics(df: DataFrame, area: str = "area", height: str = "height", pop: str = "estimated_population") -> DataFrame:
    """Densities per area and volume, units and occupancy, density class and robust index."""
    populated = F.col(pop) > 0
    d = impute_positive_median(df, area, populated)
    d = impute_positive_median(d, height, populated)
    d = d.withColumns({
        "density_per_area": F.col(pop) / F.col(area),
        "approx_volume": F.col(area) * F.col(height),
        "density_per_volume": F.col(pop) / (F.col(area) * F.col(height)),
        **occupancy_units(area, height, pop),
    })
    d = d.withColumns({
        "density_class": named_bin("density_per_area", "population_density", "incl"),
        "bedroom_occupancy_class": named_bin("occupancy_per_bedroom", "bedroom", "incl"),
    })
    return robust_index(d, "density_per_area")


def density_by_type(df: DataFrame, kind: str, pop: str = "estimated_population") -> DataFrame:
    """Per building type: count, population, densities (mean and median), occupancy."""
    g = df.where(F.col(pop) > 0).groupBy(kind).agg(
        F.count(F.lit(1)).alias("building_count"), F.sum(pop).alias("total_population"), F.avg(pop).alias("mean_population"),
        F.avg("density_per_area").alias("mean_density_area"), F.avg("occupancy_per_unit").alias("mean_occupancy"),
    )
    q = exact_quantiles(df.where(F.col(pop) > 0), "density_per_area", [0.5], by=[kind]).select(kind, F.get("q", 0).alias("median_density_area"))
    return g.join(q, kind)


def density_class_shares(df: DataFrame, kind: str) -> DataFrame:
    return class_shares(df.where(F.col("density_class").isNotNull()), kind, "density_class")


def population_by_hour(df: DataFrame, area_type: str, pop: str = "est_populacao") -> DataFrame:
    """Presence at five hours, largest absolute and relative variation, active population (0.65)."""
    cols = {}
    for i, h in enumerate(L.PRESENCE_HOURS):
        cols[f"pop_atual_{h}"] = F.col(pop) * map_class(area_type, {k: v[i] for k, v in L.PRESENCE.items()}, L.PRESENCE_DEFAULT[i])
    out = df.withColumns({"est_pop_pea": F.col(pop) * 0.65, **cols})
    hours = [F.col(c) for c in cols]
    out = out.withColumn("pop_variacao_max", F.greatest(*hours) - F.least(*hours))
    out = out.withColumn("pop_variacao_rel", F.col("pop_variacao_max") / F.col(pop))
    return out.withColumn("categoria_variacao_pop", named_bin("pop_variacao_rel", "variation"))


def estimate_population(df: DataFrame, area_km2: str, pop: str | None = None) -> DataFrame:
    """Known population, else 1000 inhabitants per km2; density and area type."""
    est = F.col(pop).cast("double") if pop else F.col(area_km2) * 1000
    out = df.withColumn("est_populacao", est).withColumn("densidade_pop", F.col("est_populacao") / F.col(area_km2))
    return out.withColumn("tipo_area", named_bin("densidade_pop", "census_area"))


def vulnerability(df: DataFrame) -> DataFrame:
    """Vulnerability from population variation, roughness and (1 - compactness)."""
    d = max_norm(df, ["elevation_std"], "_rug").withColumnRenamed("elevation_std_rug", "indice_rugosidade")
    d = d.withColumn("indice_acessibilidade", 1 - F.col("compacidade"))
    d = d.withColumn("indice_vulnerabilidade", F.col("pop_variacao_rel") * 0.3 + F.col("indice_rugosidade") * 0.3 + F.col("indice_acessibilidade") * 0.4)
    return d.withColumn("categoria_vulnerabilidade", named_bin("indice_vulnerabilidade", "fifths"))


def evacuation_priority(df: DataFrame, key: str) -> DataFrame:
    """Priority from normalised density, population and vulnerability; top 10 % flagged."""
    d = max_norm(df, ["densidade_pop", "est_populacao"])
    d = d.withColumn("indice_prioridade_evacuacao", F.col("densidade_pop_norm") * 0.25 + F.col("est_populacao_norm") * 0.25 + F.col("indice_vulnerabilidade") * 0.5)
    d = d.withColumn("categoria_prioridade", named_bin("indice_prioridade_evacuacao", "fifths"))
    return top_fraction_flag(d, "indice_prioridade_evacuacao", [key], 0.1, "top_prioridade")


def assign_profile(df: DataFrame, use: str) -> DataFrame:
    return df.withColumn("temporal_profile", use_profile(use))


def use_column(df: DataFrame, candidates: list[str]) -> str | None:
    """Candidate column with most distinct values falling in a use category."""
    from functools import reduce

    from ..functions.classify import contains_any

    cols = [c for c in candidates if c in df.columns]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("e")).select("e.*").distinct()
    hits = reduce(lambda a, b: a + b, [contains_any(F.lower("v"), w).cast("int") for w in L.USE_WORDS.values()])
    top = long.groupBy("c").agg(F.sum(hits).alias("n")).where("n > 0").orderBy(F.desc("n"), "c").first()
    return top["c"] if top else None


def hourly_occupancy(df: DataFrame, profiles: DataFrame, key: str, pop: str = "estimated_population") -> DataFrame:
    """Long ``(key, temporal_profile, hour, population)``; ``profiles`` is ``(temporal_profile, hour, rate)``.

    Unknown profiles fall back to ``default``; rows without population stay at 0.
    """
    names = profiles.select("temporal_profile").distinct().withColumn("_known", F.lit(True))
    base = df.select(key, "temporal_profile", pop).join(names, "temporal_profile", "left")
    base = base.withColumn("_p", F.when(F.col("_known"), F.col("temporal_profile")).otherwise("default"))
    rates = profiles.groupBy(F.col("temporal_profile").alias("_p")).agg(F.sort_array(F.collect_list(F.struct("hour", "rate"))).alias("r"))  # 24 entries
    j = base.join(rates, "_p").select(key, "temporal_profile", pop, F.explode("r").alias("r"))
    v = F.when(F.col(pop) > 0, F.col(pop) * F.col("r.rate")).otherwise(0.0)
    return j.select(key, "temporal_profile", F.col("r.hour").alias("hour"), v.alias("population"))


def hourly_totals(hourly: DataFrame) -> DataFrame:
    """Total, residential and other population by hour (24 rows)."""
    res = F.col("temporal_profile") == "residential"
    return hourly.groupBy("hour").agg(
        F.sum("population").alias("total"), F.sum(F.when(res, F.col("population")).otherwise(0.0)).alias("residential"),
        F.sum(F.when(res, F.lit(0.0)).otherwise(F.col("population"))).alias("other"),
    )


def hourly_wide(hourly: DataFrame, key: str) -> DataFrame:
    """24 columns ``population_hNN`` per feature."""
    p = hourly.groupBy(key).pivot("hour", list(range(24))).agg(F.sum("population"))
    return p.withColumnsRenamed({str(h): f"population_h{h:02d}" for h in range(24)})


def active_periods(hours: DataFrame, hour: str = "hour") -> DataFrame:
    """Runs of consecutive hours ``(start, end, length)``; the input has at most 24 rows."""
    w = Window.orderBy(hour)
    isl = hours.select(F.col(hour).alias("h"), (F.col(hour) - F.row_number().over(w)).alias("g"))
    return isl.groupBy("g").agg(F.min("h").alias("start"), F.max("h").alias("end"), F.count(F.lit(1)).alias("length")).drop("g")


def urban_pulse(totals: DataFrame) -> DataFrame:
    """Amplitude, peak and valley, day and night indices, active periods, commuting index of 24 totals."""
    day = (F.col("hour") >= 8) & (F.col("hour") < 20)
    s = totals.agg(
        F.max("total").alias("hi"), F.min("total").alias("lo"),
        F.min(F.struct((-F.col("total")).alias("t"), "hour")).getField("hour").alias("peak_hour"),
        F.min(F.struct(F.col("total").alias("t"), "hour")).getField("hour").alias("valley_hour"),
        F.avg(F.when(day, F.col("total"))).alias("d"), F.avg(F.when(~day, F.col("total"))).alias("n"), F.avg("total").alias("a"),
        F.stddev_pop("residential").alias("sr"), F.stddev_pop("other").alias("so"), F.corr("residential", "other").alias("c"),
    )
    top = one_row(totals, hi=F.max("total"))["hi"]
    runs = active_periods(totals.where(F.col("total") >= top * 0.8))
    text = F.when(F.col("length") == 1, F.format_string("%02dh", "start")).otherwise(F.format_string("%02dh-%02dh", "start", "end"))
    r = one_row(
        runs, n=F.count(F.lit(1)), m=F.max("length"),
        t=F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", text.alias("t")))), lambda e: e["t"]), ", "),
    )
    return s.select(
        (F.col("hi") - F.col("lo")).alias("amplitude_abs"), ((F.col("hi") - F.col("lo")) / F.col("hi") * 100).alias("amplitude_pct"),
        "peak_hour", "valley_hour", (F.col("d") / F.col("a")).alias("daytime_activity_index"),
        (F.col("n") / F.col("a")).alias("night_activity_index"), F.when(F.col("n") > 0, F.col("d") / F.col("n")).otherwise(float("inf")).alias("day_night_ratio"),
        r["n"].alias("num_active_periods"), r["m"].alias("longest_active_period"), r["t"].alias("active_periods"),
        F.when((F.col("sr") > 0) & (F.col("so") > 0), -F.col("c")).otherwise(0.0).alias("commuting_index"),
    )


def census_summary(df: DataFrame) -> DataFrame:
    return describe_numeric(df, ["est_populacao", "densidade_pop", "area_km2"])


def allocation_check(df: DataFrame, sector: str, pop: str) -> DataFrame:
    """Allocated against census totals per sector."""
    return df.groupBy(sector).agg(F.sum("estimated_population").alias("allocated"), F.max(pop).alias("census")).withColumn(
        "difference", F.col("census") - F.col("allocated")
    )


def rate(c: Column) -> Column:
    return F.avg(c.cast("double"))
