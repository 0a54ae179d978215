"""Profiles, quality metrics, class summaries and diversity indices."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..scale import exact_quantiles, join_on, one_row, with_running_total
from .table import _long, numeric_columns


def _attach_quantiles(stats: DataFrame, q: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    wide = q.select(*by, *[F.get("q", i).alias(n) for i, n in enumerate(names)])
    return join_on(stats, wide, by, "left")


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample std, min, quartiles, max, biased skew and kurtosis, IQR per column (and group)."""
    long = _long(df, cols or numeric_columns(df), by)
    keys = [*by, "column"]
    stats = long.groupBy(*keys).agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
        F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"),
    )
    q = exact_quantiles(long, "v", [0.25, 0.5, 0.75], by=keys)
    return _attach_quantiles(stats, q, keys, ["q1", "median", "q3"]).withColumn("iqr", F.col("q3") - F.col("q1"))


def basic_stats(df: DataFrame, cols: Sequence[str], ddof: int = 0) -> DataFrame:
    """min, max, mean, population std and median, ignoring NULL and NaN."""
    long = _long(df, cols).where(~F.isnan("v") | F.col("v").isNull())
    sd = F.stddev_samp if ddof else F.stddev_pop
    stats = long.groupBy("column").agg(
        F.count("v").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.avg("v").alias("mean"), sd("v").alias("std"),
    )
    return _attach_quantiles(stats, exact_quantiles(long, "v", [0.5], by=["column"]), ["column"], ["median"])


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """mean, median, sample std, quartiles, count, nulls and their share; infinities count as null."""
    inf = float("inf")
    long = _long(df, cols).withColumn("v", F.when(~F.isnan("v") & (F.abs("v") < inf), F.col("v")))
    stats = long.groupBy("column").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.count("v").alias("count"), F.count_if(F.col("v").isNull()).alias("nulls"),
        (F.count_if(F.col("v").isNull()) / F.count(F.lit(1)) * 100).alias("null_pct"),
    )
    q = exact_quantiles(long, "v", [0.25, 0.5, 0.75], by=["column"])
    return _attach_quantiles(stats, q, ["column"], ["q1", "median", "q3"])


def missing_report(df: DataFrame) -> DataFrame:
    """``(column, missing, pct)`` for every column, from one aggregate row."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    return wide.unpivot(["_n"], cols, "column", "missing").select(
        "column", "missing", (F.col("missing") / F.col("_n") * 100).alias("pct")
    )


def completeness_score(df: DataFrame) -> DataFrame:
    nulls = sum(F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns)
    return df.agg((1 - nulls / (F.count(F.lit(1)) * len(df.columns))).alias("completeness_score"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct non-null values per column in one shuffle of ``(column, value)`` pairs."""
    cols = list(cols or df.columns)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols
    ])).alias("e")).select("e.*")
    pairs = long.where(F.col("v").isNotNull()).distinct()
    return pairs.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))


def data_quality(df: DataFrame, key_cols: Sequence[str] | None = None) -> DataFrame:
    """Missing share and distinct values per column with table totals on every row."""
    m = missing_report(df)
    d = distinct_counts(df, key_cols)
    t = one_row(m, total=F.sum("missing"), cols=F.count_if(F.col("missing") > 0))
    dup = duplicate_rows(df).scalar()
    return m.join(d, "column", "left").select(
        "column", "missing", "pct", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
        t["total"].alias("total_missing"), t["cols"].alias("columns_with_nulls"), dup.alias("duplicate_rows"),
    )


def value_counts(df: DataFrame, col: str, n: int | None = 20) -> DataFrame:
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)
    return g if n is None else g.limit(n)


def class_counts(df: DataFrame, col: str) -> DataFrame:
    total = one_row(df, n=F.count(F.lit(1)))["n"]
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).withColumn("pct", F.col("count") / total * 100)


def class_sum(df: DataFrame, col: str, value: str, name: str = "total") -> DataFrame:
    return df.groupBy(col).agg(F.sum(value).alias(name))


def cumulative_cover(df: DataFrame, col: str, share: float = 0.9) -> DataFrame:
    """Types by falling count while the cumulative count stays within ``share`` of all rows."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    n = one_row(df, n=F.count(F.lit(1)))["n"]
    run = with_running_total(counts, [F.desc("count"), F.col(col).asc_nulls_last()], "count", "cumulative")
    return run.where(F.col("cumulative") <= share * n)


def histogram(df: DataFrame, col: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal-width bins over the data range (or a fixed one); the top edge is closed; empty bins show 0."""
    s = one_row(df, lo=F.min(col), hi=F.max(col))
    lo = s["lo"] if low is None else F.lit(float(low))
    hi = s["hi"] if high is None else F.lit(float(high))
    c = F.col(col)
    raw = F.floor((c - lo) / ((hi - lo) / bins)).cast("int")
    b = F.when(c == hi, bins - 1).when((c >= lo) & (c < hi), F.least(raw, F.lit(bins - 1)))
    got = df.select(b.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(got, "bin", "left").select(
        "bin", (lo + F.col("bin") * (hi - lo) / bins).alias("low"), F.coalesce("n", F.lit(0)).alias("count")
    )


def stats_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str], min_count: int = 0) -> DataFrame:
    """count, sum, mean, median, min, max per group and column; groups above ``min_count`` rows."""
    long = _long(df, cols, keys)
    by = [*keys, "column"]
    g = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.sum("v").alias("sum"), F.avg("v").alias("mean"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    ).where(F.col("count") > min_count)
    return _attach_quantiles(g, exact_quantiles(long, "v", [0.5], by=by), by, ["median"])


def quartiles_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exact quartiles per group and column."""
    by = [*keys, "column"]
    q = exact_quantiles(_long(df, cols, keys), "v", [0.25, 0.5, 0.75], by=by)
    return q.select(*by, "n", F.get("q", 0).alias("q1"), F.get("q", 1).alias("median"), F.get("q", 2).alias("q3"))


def top_types(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k commonest values (ties by value), one small frame."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c")).orderBy(
        F.desc("_c"), col
    ).limit(k).select(col)


def keep_top_types(df: DataFrame, col: str, k: int) -> DataFrame:
    """Semi-join with the k commonest values (k rows, so the broadcast is bounded)."""
    return df.join(F.broadcast(top_types(df, col, k)), col, "left_semi")


def fragmentation_by_type(df: DataFrame, col: str, value: str, k: int = 8) -> DataFrame:
    return quartiles_by(keep_top_types(df, col, k), [col], [value]).drop("column")


def top_n_plus_other(df: DataFrame, col: str, value: str, n: int = 10, other: str = "outros") -> DataFrame:
    """Share of the n largest classes; everything else is one bucket."""
    sums = df.groupBy(col).agg(F.sum(value).alias("total"))
    top = sums.orderBy(F.desc("total"), col).limit(n).select(F.col(col).alias("_top"))
    tagged = sums.join(F.broadcast(top), F.col(col).eqNullSafe(F.col("_top")), "left")
    label = F.when(F.col("_top").isNotNull(), F.col(col)).otherwise(F.lit(other))
    out = tagged.groupBy(label.alias(col)).agg(F.sum("total").alias("total"))
    s = one_row(df, t=F.sum(value))["t"]
    return out.withColumn("pct", F.col("total") / s * 100)


def diversity(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Shannon, Simpson and dominance of ``col`` within each group (two aggregation levels)."""
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("c"))
    return _diversity_from(counts, keys, "c")


def _diversity_from(counts: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    # sum(-p ln p) = ln N - sum(c ln c)/N, so one pass over the class counts is enough
    n, clc, c2 = F.sum(c), F.sum(F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c)))), F.sum(F.col(c) * F.col(c))
    return counts.groupBy(*keys).agg(
        n.alias("total"),
        F.when(n > 0, F.log(n) - clc / n).otherwise(0.0).alias("shannon"),
        F.when(n > 0, 1 - c2 / (n * n)).alias("simpson"),
        F.when(n > 0, c2 / (n * n)).alias("dominance"),
    )


def landscape_metrics(df: DataFrame, category: str, area: str) -> DataFrame:
    """Patches, areas, largest-patch index and patch density per category."""
    total = one_row(df, a=F.sum(area))["a"]
    g = df.groupBy(category).agg(
        F.count(F.lit(1)).alias("num_patches"), F.sum(area).alias("total_area"), F.avg(area).alias("mean_patch"),
        F.max(area).alias("largest_patch"),
    )
    return g.withColumns({
        "largest_patch_index": F.when(F.col("total_area") > 0, F.col("largest_patch") / F.col("total_area") * 100).otherwise(0.0),
        "patch_density": F.when(total > 0, F.col("num_patches") / total).otherwise(0.0),
        "area_pct": F.col("total_area") / total * 100,
    })


def landscape_overall(df: DataFrame, category: str, area: str, perimeter: str) -> DataFrame:
    """Area-based diversity, edge density and totals of the whole landscape."""
    sums = df.groupBy(category).agg(
        F.sum(area).alias("a"), F.sum(perimeter).alias("p"), F.count(F.lit(1)).alias("n")
    )
    a, a2, al = F.sum("a"), F.sum(F.col("a") * F.col("a")), F.sum(F.when(F.col("a") > 0, F.col("a") * F.log("a")))
    return sums.agg(
        (F.log(a) - al / a).alias("shannon"), (1 - a2 / (a * a)).alias("simpson"), (a2 / (a * a)).alias("dominance"),
        (F.sum("p") / 2).alias("total_edge"), (F.sum("p") / 2 / a).alias("edge_density"),
        F.count(F.lit(1)).alias("num_categories"), F.sum("n").alias("total_patches"), a.alias("landscape_area"),
    )


def crosstab(df: DataFrame, a: str, b: str, margins: bool = True) -> DataFrame:
    """Long crosstab ``(a, b, n, row_share)`` with ``All`` margins from one cube."""
    plain = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cube = plain.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    if not margins:
        cube = cube.where(F.col("_g") == 0)
    label = cube.select(
        F.when(F.col("_g").bitwiseAND(2) == 0, F.col(a)).otherwise("All").alias(a),
        F.when(F.col("_g").bitwiseAND(1) == 0, F.col(b)).otherwise("All").alias(b),
        "n",
    )
    totals = plain.groupBy(F.col(a).alias("_a")).agg(F.count(F.lit(1)).alias("_t"))
    grand = one_row(plain, n=F.count(F.lit(1)))["n"]
    out = label.join(totals, label[a] == totals["_a"], "left")
    return out.withColumn("row_share", F.col("n") / F.coalesce("_t", grand)).drop("_a", "_t")


def two_level_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def linreg(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.corr(y, x).alias("r"), F.regr_count(F.col(y), F.col(x)).alias("n"),
    )


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair ``(a, b, r)`` in one aggregate."""
    pairs = [(p, q) for p in cols for q in cols]
    row = df.agg(*[F.corr(p, q).alias(f"{p}|{q}") for p, q in pairs])
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"`{p}|{q}`").alias("r")) for p, q in pairs
    ])).alias("e"))
    return long.select("e.*")


def spatial_stats(df: DataFrame, x: str, y: str, size: str | None = None) -> DataFrame:
    """Bounds, centre, spread, clustered-or-dispersed flag and (optional) size statistics."""
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"),
        F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        F.stddev_samp(x).alias("std_x"), F.stddev_samp(y).alias("std_y"),
    ]
    if size:
        aggs += [F.avg(size).alias("size_mean"), F.stddev_samp(size).alias("size_std"),
                 F.min(size).alias("size_min"), F.max(size).alias("size_max")]
    spread = (F.col("maxx") - F.col("minx") + F.col("maxy") - F.col("miny")) / 4
    flag = F.when((F.col("std_x") + F.col("std_y")) / 2 < spread, F.lit("clustered")).otherwise("dispersed")
    return df.agg(*aggs).withColumn("spatial_distribution", flag)


def layer_catalog(df: DataFrame, samples: int = 5) -> DataFrame:
    """Per column: type, rows, non-null count and the first distinct sample values."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    atomic = [c for c, k in kinds.items() if not k.startswith(("array", "map", "struct"))]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(f"`{c}`").cast("string").alias("v"))
        for c in atomic
    ])).alias("e")).select("e.*")
    counts = long.groupBy("column", "type", "v").agg(F.count(F.lit(1)).alias("c"))
    low = _lowest(counts.where(F.col("v").isNotNull()), ["column"], "v", samples)
    totals = counts.groupBy("column", "type").agg(
        F.sum("c").alias("rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("c"))).alias("non_null"),
        F.count("v").alias("distinct_values"),
    )
    return totals.join(low, "column", "left").select(
        "column", "type", "rows", F.coalesce("non_null", F.lit(0)).alias("non_null"), "distinct_values",
        F.concat_ws("|", "low").alias("samples"),
    )


def _lowest(df: DataFrame, keys: Sequence[str], col: str, k: int) -> DataFrame:
    """k lowest values per group, reduced in salted sub-groups first."""
    salted = df.withColumn("_s", F.pmod(F.xxhash64(col), F.lit(64)))
    w = Window.partitionBy(*keys, "_s").orderBy(col)
    part = salted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return part.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(col)), 1, k).alias("low"))


def bbox_overlap_ratio(a: DataFrame, b: DataFrame, x0="minx", y0="miny", x1="maxx", y1="maxy") -> DataFrame:
    """Intersection over union of the extents of two layers."""
    ext = {"x0": F.min(x0), "y0": F.min(y0), "x1": F.max(x1), "y1": F.max(y1)}
    s = one_row(b, **ext)
    p = a.agg(*[c.alias(k) for k, c in ext.items()])
    w = F.greatest(F.least(F.col("x1"), s["x1"]) - F.greatest(F.col("x0"), s["x0"]), F.lit(0.0))
    h = F.greatest(F.least(F.col("y1"), s["y1"]) - F.greatest(F.col("y0"), s["y0"]), F.lit(0.0))
    area_a = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    area_b = (s["x1"] - s["x0"]) * (s["y1"] - s["y0"])
    return p.select((w * h).alias("overlap_area"), (w * h / (area_a + area_b - w * h)).alias("overlap_ratio"))


def building_density(df: DataFrame, area: str, region_km2: Column) -> DataFrame:
    """Buildings per km2 and built-up ratio over a region."""
    return df.agg(F.count(F.lit(1)).alias("n"), (F.sum(area) / 1e6).alias("built_km2")).select(
        "n", "built_km2", region_km2.alias("region_km2"), (F.col("n") / region_km2).alias("buildings_per_km2"),
        (F.col("built_km2") / region_km2).alias("built_up_ratio"),
    )


def raster_profile(cells: DataFrame, value: str = "value") -> DataFrame:
    """min, max, mean, population std, median and nodata share of a raster table."""
    from ..scale import quantile_row

    med = F.get(quantile_row(cells, value, [0.5]), 0)
    return cells.agg(
        F.count(F.lit(1)).alias("cells"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        (F.count_if(F.col(value).isNull()) / F.count(F.lit(1)) * 100).alias("nodata_pct"),
    ).withColumn("median", med)


def recommendations(profile: DataFrame) -> DataFrame:
    """Rule texts from a describe table ``(column, count, mean, std, max, skewness, ...)``."""
    rules = F.array(
        F.when((F.col("std") > 0) & ((F.col("max") - F.col("mean")) / F.col("std") > 3), F.lit("outliers")),
        F.when(F.abs("skewness") > 1, F.lit("skewed")),
        F.when(F.col("min") == 0, F.lit("zero_minimum")),
    )
    return profile.select("column", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("recommendation"))


def graph_recommendations(summary: DataFrame) -> DataFrame:
    rules = F.array(
        F.when(F.col("components") > 1, F.lit("disconnected")),
        F.when(F.col("avg_degree") < 2, F.lit("low_connectivity")),
    )
    return summary.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("recommendation"))


def layer_recommendations(missing: DataFrame, srid: int, wanted: int = 4674) -> DataFrame:
    """Column names with missing values, plus a projection hint."""
    hint = F.when(F.lit(srid != wanted), F.lit("reproject"))
    return missing.select(
        "column", F.explode(F.filter(F.array(F.when(F.col("missing") > 0, F.lit("handle_missing")), hint),
                                     lambda r: r.isNotNull())).alias("recommendation")
    )


def quality_report(df: DataFrame, classes: Sequence[str] = (), numeric: Sequence[str] = ()) -> DataFrame:
    """Long report ``(section, metric, key, value)``: totals, completeness, statistics, class counts."""
    total = df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("summary").alias("section"), F.lit("rows").alias("metric"), F.lit("all").alias("key"), "value"
    )
    parts = [total]
    parts.append(missing_report(df).select(
        F.lit("completeness").alias("section"), F.lit("missing").alias("metric"), F.col("column").alias("key"),
        F.col("missing").cast("double").alias("value"),
    ))
    if numeric:
        stats = basic_stats(df, numeric)
        names = ["count", "min", "max", "mean", "std", "median"]
        long = stats.select("column", *[F.col(n).cast("double") for n in names]).unpivot(["column"], names, "metric", "value")
        parts.append(long.select(F.lit("statistics").alias("section"), "metric", F.col("column").alias("key"), "value"))
    for c in classes:
        parts.append(df.groupBy(c).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.lit("classes").alias("section"), F.lit(c).alias("metric"), F.col(c).cast("string").alias("key"), "value"
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def enrichment_report(before: DataFrame, after: DataFrame, metrics: Sequence[str] = (), classes: Sequence[str] = ()) -> DataFrame:
    """Retention ratio, columns added, metric statistics and class counts in the long report form."""
    new = [c for c in after.columns if c not in before.columns]
    n0 = one_row(before, n=F.count(F.lit(1)))["n"]
    kept = after.agg((F.count(F.lit(1)) / n0).alias("value")).select(
        F.lit("retention").alias("section"), F.lit("ratio").alias("metric"), F.lit("all").alias("key"), "value"
    )
    added = after.agg(*[F.count(F.col(f"`{c}`")).cast("double").alias(c) for c in new]).unpivot(
        [], new, "key", "value"
    ).select(F.lit("new_columns").alias("section"), F.lit("non_null").alias("metric"), "key", "value") if new else None
    body = quality_report(after.select(*metrics, *classes), classes, metrics).where(
        F.col("section").isin("statistics", "classes")
    )
    out = kept if added is None else kept.unionByName(added)
    return out.unionByName(body)


def geometry_counts(df: DataFrame, kind: str) -> DataFrame:
    return class_counts(df, kind)


def wind_rose(df: DataFrame, direction: str, speed: str, width: float = 10.0, step: float = 2.0) -> DataFrame:
    """Share of all observations by direction sector and speed step."""
    ok = df.where(F.col(direction).isNotNull() & F.col(speed).isNotNull())
    n = one_row(ok, n=F.count(F.lit(1)))["n"]
    g = ok.groupBy(
        (F.floor(F.pmod(F.col(direction), F.lit(360.0)) / width) * width).alias("direction"),
        (F.floor(F.col(speed) / step) * step).alias("speed"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.col("n") / n * 100)


def daily_weather(df: DataFrame, ts: str, rain: str, temp: str, rad: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.to_date(ts).alias("date")).agg(
        F.sum(rain).alias("rain"), F.avg(temp).alias("temp"), F.avg(rad).alias("radiation")
    )


def cumulative_rain(daily: DataFrame, by: Sequence[str] = (), value: str = "rain") -> DataFrame:
    """Running sum over the dates of a daily table; a partition holds one station's calendar days."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn("cumulative", F.sum(value).over(w))


def monthly_pivot(df: DataFrame, ts: str, value: str) -> DataFrame:
    """year x month mean as twelve columns."""
    return (
        df.groupBy(F.year(ts).alias("year")).pivot("m", list(range(1, 13))).avg(value)
        if "m" in df.columns
        else monthly_pivot(df.withColumn("m", F.month(ts)), ts, value)
    )


def seasonal_stats(df: DataFrame, ts: str, rain: str, cols: Sequence[str], mode: str = "astronomical") -> DataFrame:
    """Mean rain and quartiles of other measures per season."""
    from ..functions.classify import season_south

    s = df.withColumn("season", season_south(F.col(ts), mode))
    q = quartiles_by(s, ["season"], cols)
    rain_mean = s.groupBy("season").agg(F.avg(rain).alias("mean_rain"))
    return join_on(q, rain_mean, ["season"])


def kde_bandwidth(n: Column, dims: int = 2) -> Column:
    """Scott factor."""
    return F.pow(n, F.lit(-1.0 / (dims + 4)))


def class_shares(df: DataFrame, key: str, cls: str) -> DataFrame:
    """Share of each class inside each key ``(key, cls, n, share)``."""
    g = df.groupBy(key, cls).agg(F.count(F.lit(1)).alias("n"))
    t = df.groupBy(key).agg(F.count(F.lit(1)).alias("_t"))
    return join_on(g, t, [key]).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def natural_summary(df: DataFrame, area: str, classes: Sequence[str]) -> DataFrame:
    return quality_report(df.select(area, *classes), classes, [area])


def multi_geometry_kind(geom_type: T.StringType | str = "geom_type") -> Column:
    return F.col(geom_type) if isinstance(geom_type, str) else geom_type


def entropy_row(counts: DataFrame, c: str) -> DataFrame:
    return _diversity_from(counts, [], c)


LN = math.log
ring_area = G.ring_area
