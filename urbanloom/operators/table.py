"""Column cleaning, casting, validation, imputation, outliers and de-duplication."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import lookups as L
from ..functions.classify import clip01, map_class, minmax, normalise_text
from ..scale import exact_quantiles, join_on, one_row, quantile_row, with_position

Rule = tuple[str, float | None, float | None]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


# ---- names and types ------------------------------------------------------------------------------


def clean_columns(df: DataFrame, spaces: str | None = None) -> DataFrame:
    """Drop ``Unnamed`` columns, strip and lower-case the rest; ``spaces`` replaces inner blanks."""
    out = []
    for c in df.columns:
        if "Unnamed" in c:
            continue
        name = c.strip().lower()
        out.append(F.col(f"`{c}`").alias(name.replace(" ", spaces) if spaces else name))
    return df.select(*out)


def rename_by_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Canonical names, only where the target is still absent."""
    names = set(df.columns)
    todo = {}
    for old, new in mapping.items():
        if old in names and new not in names:
            todo[old] = new
            names.discard(old)
            names.add(new)
    return df.withColumnsRenamed(todo)


# --- fixed values: weather header names and census header names -----------------------------------
WEATHER_NAMES = {
    "DATA (YYYY-MM-DD)": "date",
    "HORA (UTC)": "time_utc",
    "PRECIPITAÇÃO TOTAL, HORÁRIO (MM)": "precipitation_mm",
    "PRECIPITACAO TOTAL, HORARIO (MM)": "precipitation_mm",
    "PRESSAO ATMOSFERICA AO NIVEL DA ESTACAO, HORARIA (MB)": "pressure_mb",
    "PRESSÃO ATMOSFERICA AO NIVEL DA ESTACAO, HORARIA (MB)": "pressure_mb",
    "RADIACAO GLOBAL (KJ/M²)": "radiation_kjm2",
    "RADIAÇÃO GLOBAL (KJ/M²)": "radiation_kjm2",
    "TEMPERATURA DO AR - BULBO SECO, HORARIA (°C)": "temperature_c",
    "TEMPERATURA DO AR - BULBO SECO, HORÁRIA (°C)": "temperature_c",
    "UMIDADE RELATIVA DO AR, HORARIA (%)": "humidity_pct",
    "UMIDADE RELATIVA DO AR, HORÁRIA (%)": "humidity_pct",
    "VENTO, DIREÇÃO HORARIA (GR) (° (GR))": "wind_direction_deg",
    "VENTO, DIREÇÃO HORÁRIA (GR) (° (GR))": "wind_direction_deg",
    "VENTO, VELOCIDADE HORARIA (M/S)": "wind_speed_ms",
    "VENTO, VELOCIDADE HORÁRIA (M/S)": "wind_speed_ms",
    "LATITUDE": "latitude",
    "LONGITUDE": "longitude",
    "ALTITUDE": "altitude_m",
}
CENSUS_NAMES = {
    "CD_GEOCODI": "CD_SETOR", "CD_GEOCODIG": "CD_SETOR", "GEOCODIGO": "CD_SETOR",
    "CD_GEOCODB": "CD_GEOCODM", "NM_MUNICIP": "NM_MUNIC", "NOME_MUNIC": "NM_MUNIC",
    "Shape_Area": "AREA_KM2", "AREA": "AREA_KM2",
    "NOME_DISTRITO": "NM_DISTRI", "NOME_SUBDISTRITO": "NM_SUBDIST",
}


def rename_weather(df: DataFrame) -> DataFrame:
    """Accent variants of the station headers become the canonical weather names."""
    keep = [c for c in df.columns if "Unnamed" not in c]
    upper = df.select(*[F.col(f"`{c}`").alias(c.strip().upper()) for c in keep])
    return rename_by_map(upper, WEATHER_NAMES)


WEATHER_COLUMNS = [
    "date", "time_utc", "latitude", "longitude", "altitude_m", "temperature_c", "humidity_pct",
    "pressure_mb", "wind_speed_ms", "wind_direction_deg", "precipitation_mm", "radiation_kjm2",
]


def select_relevant(df: DataFrame, include_radiation: bool = False) -> DataFrame:
    """Declared weather columns plus station metadata; an error when none is present."""
    wanted = [c for c in WEATHER_COLUMNS if include_radiation or c != "radiation_kjm2"]
    wanted += ["region", "state", "station", "wmo_code"]
    found = [c for c in wanted if c in df.columns]
    if not found:
        raise ValueError("no essential weather column in the table")
    return df.select(*found)


def to_number(c: Column) -> Column:
    """Decimal comma to dot, then numeric; anything else is NULL."""
    return F.regexp_replace(c, ",", ".").try_cast("double")


def cast_by_spec(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Cast columns to double, int, date or timestamp by name; bad values become NULL."""
    cols = {}
    for name, kind in spec.items():
        if name not in df.columns:
            continue
        c = F.col(name)
        if kind in ("double", "int", "bigint"):
            v = to_number(c) if isinstance(df.schema[name].dataType, T.StringType) else c.try_cast("double")
            cols[name] = v.try_cast(kind)
        elif kind == "date":
            cols[name] = F.coalesce(c.try_cast("date"), F.try_to_timestamp(c, F.lit("yyyy/MM/dd")).cast("date"))
        else:
            cols[name] = c.try_cast(kind)
    return df.withColumns(cols)


def parse_dates(df: DataFrame, word: str = "Data") -> DataFrame:
    """``<col>_datetime`` for every column whose name contains ``word``."""
    return df.withColumns({f"{c}_datetime": F.col(c).try_cast("timestamp") for c in df.columns if word in c})


def find_columns_by_keyword(df: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Candidate columns ranked by positive coverage ``(column, n, positive, min, max)``."""
    cols = [c for c in df.columns if any(k in c.lower() for k in keywords)]
    cols = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("e")).select("e.*")
    return long.groupBy("column").agg(
        F.count("v").alias("n"), F.count_if(F.col("v") > 0).alias("positive"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )


def best_column(df: DataFrame, keywords: Sequence[str]) -> str | None:
    """Name of the best covered candidate (one row comes back to the driver)."""
    top = find_columns_by_keyword(df, keywords).orderBy(F.desc("positive"), "column").first()
    return top["column"] if top else None


def flag_copy(df: DataFrame, cols: Sequence[str], suffix: str = "original") -> DataFrame:
    return df.withColumns({f"{c}_{suffix}": F.col(c) for c in cols})


# ---- ranges and domains ---------------------------------------------------------------------------


def _outside(c: Column, lo, hi) -> Column:
    cond = F.lit(False)
    if lo is not None:
        cond = cond | (c < lo)
    if hi is not None:
        cond = cond | (c > hi)
    return cond


def null_out_of_range(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Values outside [min, max] become NULL."""
    return df.withColumns(
        {n: F.when(~_outside(F.col(n), lo, hi), F.col(n)) for n, lo, hi in rules if n in df.columns}
    )


def clamp_out_of_range(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """NULL becomes 0, other values are clamped to [min, max]."""
    cols = {}
    for n, lo, hi in rules:
        v = F.col(n)
        if lo is not None:
            v = F.greatest(v, F.lit(float(lo)))
        if hi is not None:
            v = F.least(v, F.lit(float(hi)))
        cols[n] = F.when(F.col(n).isNull(), F.lit(0.0)).otherwise(v)
    return df.withColumns(cols)


def count_corrections(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """How many values ``clamp_out_of_range`` changes, per column."""
    aggs = [F.count_if(F.col(n).isNull() | _outside(F.col(n), lo, hi)).alias(n) for n, lo, hi in rules]
    wide = df.agg(*aggs)
    return wide.unpivot([], [n for n, _, _ in rules], "column", "corrections")


def require_keys(df: DataFrame, keys: Sequence[str], area: str | None = None, rings: str | None = None) -> DataFrame:
    """Drop rows without keys; a missing area (km2) is measured from the geometry."""
    out = df.dropna(subset=list(keys))
    if area and rings:
        out = out.withColumn(area, F.coalesce(F.col(area), G.polygon_area(rings) / 1e6))
    return out


def validate_domain(df: DataFrame, col: str, domain: Sequence[str] = L.NATURAL_TYPES, default: str = "other") -> DataFrame:
    """Values outside the domain become ``default``; ``<col>_invalid`` marks them."""
    ok = F.col(col).isin(list(domain))
    return df.withColumn(f"{col}_invalid", ~F.coalesce(ok, F.lit(False))).withColumn(
        col, F.when(ok, F.col(col)).otherwise(F.lit(default))
    )


def validate_coords(df: DataFrame, lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """``coord_valida`` marks positions inside the national bounding box."""
    bad = (F.col(lat) < -33) | (F.col(lat) > 5) | (F.col(lon) < -74) | (F.col(lon) > -34)
    return df.withColumn("coord_valida", ~F.coalesce(bad, F.lit(False)))


def assert_no_empty(df: DataFrame, geom: str) -> DataFrame:
    """Fails the job at the first empty geometry."""
    check = F.assert_true(F.coalesce(F.size(geom) > 0, F.lit(False)), F.lit("empty geometry in layer"))
    return df.where(check.isNull())


def fill_label(df: DataFrame, col: str, default: str = "Desconhecida") -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(default)))


def fill_number(df: DataFrame, col: str, default: float = 0.0) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col).try_cast("double"), F.lit(float(default))))


def clean_text(df: DataFrame, col: str, default: str = "unclassified") -> DataFrame:
    return df.withColumn(col, normalise_text(col, default))


# ---- imputation and outliers ----------------------------------------------------------------------


def impute(df: DataFrame, numeric: Sequence[str], text: Sequence[str] = (), flag_only: Sequence[str] = ()) -> DataFrame:
    """Median for numbers, ``Não informado`` for text, presence flags for coordinates."""
    cols = {}
    for c in numeric:
        median = F.get(quantile_row(df, c, [0.5]), 0)
        cols[f"{c}_imputado"] = F.col(c).isNull()
        cols[c] = F.coalesce(F.col(c).cast("double"), median)
    for c in text:
        cols[f"{c}_imputado"] = F.col(c).isNull()
        cols[c] = F.coalesce(F.col(c), F.lit("Não informado"))
    for c in flag_only:
        cols[f"{c}_ausente"] = F.col(c).isNull()
    return df.withColumns(cols)


def impute_positive_median(df: DataFrame, col: str, mask: Column | None = None) -> DataFrame:
    """Missing or non-positive values of the masked rows take the median of its positive values."""
    mask = F.lit(True) if mask is None else mask
    valid = df.where(mask & (F.col(col) > 0))
    median = F.get(quantile_row(valid, col, [0.5]), 0)
    bad = mask & (F.col(col).isNull() | (F.col(col) <= 0))
    return df.withColumn(col, F.when(bad, median).otherwise(F.col(col).cast("double")))


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as ``(*by, column, v)`` rows, one scan."""
    return df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("e")).select(*by, "e.column", "e.v")


def outlier_fences(df: DataFrame, cols: Sequence[str], k: float = 3.0, min_values: int = 0) -> DataFrame:
    """``(column, q1, q3, lower, upper)`` from exact quartiles."""
    q = exact_quantiles(_long(df, cols), "v", [0.25, 0.75], by=["column"]).where(F.col("n") > min_values)
    q1, q3 = F.get("q", 0), F.get("q", 1)
    return q.select(
        "column", q1.alias("q1"), q3.alias("q3"), (q1 - k * (q3 - q1)).alias("lower"), (q3 + k * (q3 - q1)).alias("upper")
    )


def outliers_iqr(df: DataFrame, cols: Sequence[str], k: float = 3.0, min_values: int = 0) -> DataFrame:
    """Per column: fences, outlier count, percentage of rows, value range."""
    long = _long(df, cols)
    fences = outlier_fences(df, cols, k, min_values)
    # one fence row per named column: bounded by the argument list
    return (
        long.join(F.broadcast(fences), "column")
        .groupBy("column", "lower", "upper")
        .agg(
            F.count_if((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))).alias("outliers"),
            F.count(F.lit(1)).alias("n_rows"), F.min("v").alias("min"), F.max("v").alias("max"),
        )
        .withColumn("pct", F.col("outliers") / F.col("n_rows") * 100)
        .drop("n_rows")
    )


def clip_outliers(df: DataFrame, cols: Sequence[str], k: float = 3.0) -> DataFrame:
    """Adds ``<col>_outlier`` and the clipped copy ``<col>_limitado``."""
    out = {}
    for c in cols:
        q = quantile_row(df, c, [0.25, 0.75])
        q1, q3 = F.get(q, 0), F.get(q, 1)
        lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        out[f"{c}_outlier"] = (F.col(c) < lo) | (F.col(c) > hi)
        out[f"{c}_limitado"] = F.when(F.col(c).isNotNull(), F.greatest(lo, F.least(hi, F.col(c))))
    return df.withColumns(out)


def trim_quantile(df: DataFrame, col: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    q = quantile_row(df, col, [low, high])
    return df.where((F.col(col) >= F.get(q, 0)) & (F.col(col) <= F.get(q, 1)))


# ---- geometry cleaning ----------------------------------------------------------------------------


def repair_polygons(df: DataFrame, ring: str) -> DataFrame:
    """Drop null rings, repair, drop what is still invalid."""
    return df.where(F.col(ring).isNotNull()).withColumn(ring, G.repair_ring(ring)).where(F.col(ring).isNotNull())


def repair_lines(df: DataFrame, line: str) -> DataFrame:
    fixed = df.where(F.col(line).isNotNull()).withColumn(line, G.dedupe_vertices(line))
    return fixed.where(F.size(line) >= 2)


def make_valid_chain(df: DataFrame, ring: str, tolerance: float = 0.01) -> DataFrame:
    """Repair, else simplify and repair, else hull; ``repair_step`` names the step that worked."""
    from .hulls import ring_hull

    second = F.when(F.col("_a").isNull(), G.repair_ring(G.simplify(ring, tolerance)))
    out = df.withColumn("_a", G.repair_ring(ring)).withColumn("_b", second)
    # Python gets only the rings that nothing else repaired
    out = out.withColumn("_h", ring_hull(F.when(F.coalesce("_a", "_b").isNull(), F.col(ring))))
    third_ok = F.when((F.size("_h") >= 4) & (G.ring_area("_h") > 0), F.col("_h"))
    out = out.withColumn("_h", third_ok)
    step = (
        F.when(F.col("_a").isNotNull(), "repaired").when(F.col("_b").isNotNull(), "simplified")
        .when(F.col("_h").isNotNull(), "hull").otherwise("dropped")
    )
    return out.withColumn("repair_step", step).withColumn(ring, F.coalesce("_a", "_b", "_h")).drop("_a", "_b", "_h")


def dedup_geometry(df: DataFrame, geom: str, order: str) -> DataFrame:
    """Exact duplicate geometries keep the row with the lowest ``order`` value."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return (
        df.groupBy(F.to_json(F.struct(geom)).alias("_g")).agg(F.min_by(row, F.col(order)).alias("r")).select("r.*")
    )


def first_in_group(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row of each group by ``order`` (a partial aggregate, not a window)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def best_in_group(df: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """Row with the highest score per group, lowest ``tie`` on equal scores."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t")))
    return df.groupBy(*keys).agg(pick.alias("r")).select(*keys, "r.*")


def fill_from_raw(df: DataFrame, raw: DataFrame, col: str, key: str, coords: Sequence[str], order: str) -> DataFrame:
    """Missing ``col`` from the raw table by key, else by exact coordinates (last raw row wins)."""
    usable = raw.where(F.col(col).isNotNull())
    by_key = usable.groupBy(key).agg(F.max_by(col, order).alias("_k"))
    by_pos = usable.groupBy(*coords).agg(F.max_by(col, order).alias("_p"))
    out = df.join(by_key, key, "left").join(by_pos, list(coords), "left")
    return out.withColumn(col, F.coalesce(F.col(col), F.col("_k"), F.col("_p"))).drop("_k", "_p")


def identify_residential(df: DataFrame) -> DataFrame:
    """``is_residential`` by keyword over the known columns; all rows when none matches."""
    from ..functions.classify import contains_any

    cond = F.lit(False)
    for c in L.RESIDENTIAL_COLUMNS:
        if c in df.columns:
            cond = cond | F.coalesce(contains_any(F.lower(F.col(c).cast("string")), L.RESIDENTIAL_KEYWORDS), F.lit(False))
    flagged = df.withColumn("is_residential", cond)
    some = one_row(flagged, n=F.count_if("is_residential"))["n"]
    return flagged.withColumn("is_residential", F.col("is_residential") | (some == 0))


# ---- normalisation and bins that need the data ----------------------------------------------------


def minmax_norm(df: DataFrame, cols: Sequence[str], constant: float = 0.0, suffix: str = "_norm") -> DataFrame:
    s = one_row(df, **{f"lo_{c}": F.min(c) for c in cols}, **{f"hi_{c}": F.max(c) for c in cols})
    return df.withColumns({f"{c}{suffix}": minmax(c, s[f"lo_{c}"], s[f"hi_{c}"], constant) for c in cols})


def max_norm(df: DataFrame, cols: Sequence[str], suffix: str = "_norm", scale: float = 1.0) -> DataFrame:
    s = one_row(df, **{c: F.max(c) for c in cols})
    return df.withColumns(
        {f"{c}{suffix}": F.when(s[c] > 0, F.col(c) / s[c] * scale).otherwise(F.lit(0.0)) for c in cols}
    )


def zscore(df: DataFrame, cols: Sequence[str], ddof: int = 1, suffix: str = "_z") -> DataFrame:
    from ..functions.classify import zscore as z

    sd = F.stddev_samp if ddof else F.stddev_pop
    s = one_row(df, **{f"m_{c}": F.avg(c) for c in cols}, **{f"s_{c}": sd(c) for c in cols})
    return df.withColumns({f"{c}{suffix}": z(c, s[f"m_{c}"], s[f"s_{c}"]) for c in cols})


def robust_index(df: DataFrame, col: str, low: float = 0.01, high: float = 0.99, name: str = "density_index") -> DataFrame:
    """Clipped (x-q01)/(q99-q01) over positive values; other rows are 0."""
    q = quantile_row(df.where(F.col(col) > 0), col, [low, high])
    v = clip01((F.col(col) - F.get(q, 0)) / (F.get(q, 1) - F.get(q, 0)))
    return df.withColumn(name, F.when(F.col(col) > 0, v).otherwise(F.lit(0.0)))


def bin_quantile(df: DataFrame, col: str, name: str, labels: Sequence[str], probs: Sequence[float] = (0.25, 0.75),
                 inclusive_top: bool = True, default: str = "Indeterminado") -> DataFrame:
    """Labels from low to high; the middle class holds both quantiles when ``inclusive_top``."""
    q = quantile_row(df, col, list(probs))
    out = F.when(F.col(col).isNull(), F.lit(default))
    for i, label in enumerate(labels[:-1]):
        edge = F.get(q, i)
        last = i == len(labels) - 2
        cond = F.col(col) <= edge if (last and inclusive_top) else F.col(col) < edge
        out = out.when(cond, F.lit(label))
    return df.withColumn(name, out.otherwise(F.lit(labels[-1])))


def quantile_classes(df: DataFrame, col: str, k: int = 5, name: str = "quantile_class") -> DataFrame:
    """Equal-count class number 1..k."""
    q = quantile_row(df, col, [i / k for i in range(1, k)])
    cls = F.lit(1)
    for i in range(k - 1):
        cls = cls + F.when(F.col(col) > F.get(q, i), 1).otherwise(0)
    return df.withColumn(name, F.when(F.col(col).isNotNull(), cls))


def bin_unique_quantile(df: DataFrame, col: str, mask: Column, name: str, labels: Sequence[str]) -> DataFrame:
    """Edges at int(q*(n-1)) of the sorted distinct masked values; fixed edges if they are not unique."""
    values = df.where(mask & F.col(col).isNotNull()).select(F.col(col).alias("_v")).distinct()
    n = one_row(values, n=F.count(F.lit(1)))["n"]
    wanted = [F.floor(F.lit(q) * (n - 1)) for q in (0.0, 0.2, 0.4, 0.6, 0.8)] + [n - 1]
    placed = with_position(values, ["_v"], "_pos")
    e = one_row(placed, **{f"e{i}": F.max(F.when(F.col("_pos") - 1 == w, F.col("_v"))) for i, w in enumerate(wanted)})
    c = F.col(col)
    edges = [e[f"e{i}"] for i in range(6)]
    distinct = F.lit(True)
    for a, b in zip(edges[:-1], edges[1:]):
        distinct = distinct & (a < b)
    ranked = F.when(c < edges[1], labels[0])
    for i in (2, 3, 4):
        ranked = ranked.when(c < edges[i], labels[i - 1])
    fixed = F.when(c <= 0.01, labels[0]).when(c <= 0.1, labels[1]).when(c <= 0.2, labels[2]).when(c <= 0.3, labels[3])
    out = F.when(F.coalesce(n, F.lit(0)) < 5, F.lit("Indeterminada")).otherwise(
        F.when(distinct, ranked.otherwise(labels[4])).otherwise(fixed.otherwise(labels[4]))
    )
    return df.withColumn(name, out)


def percentile_rank(df: DataFrame, col: str, name: str = "percentile") -> DataFrame:
    """Percentile of score, mean rank of ties, 0-100."""
    from ..scale import with_running_total

    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = with_running_total(counts, ["_v"], "_c", "_le")
    n = one_row(df, n=F.count(col))["n"]
    score = (F.col("_le") - F.col("_c") + F.col("_le") + 1) * 50.0 / n
    return df.join(run, df[col] == run["_v"], "left").withColumn(name, score).drop("_v", "_c", "_le")


def top_fraction_flag(df: DataFrame, col: str, order: Sequence[str], fraction: float = 0.1, name: str = "top") -> DataFrame:
    """Flags the int(n*fraction) largest rows."""
    k = F.floor(one_row(df, n=F.count(F.lit(1)))["n"] * fraction)
    placed = with_position(df, [F.desc_nulls_last(col), *order], "_pos")
    return placed.withColumn(name, F.col("_pos") <= k).drop("_pos")


def top_k(df: DataFrame, col: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(col), tie).limit(k)


def top_quantile(df: DataFrame, col: str, q: float = 0.95) -> DataFrame:
    edge = F.get(quantile_row(df, col, [q]), 0)
    return df.where(F.col(col) > edge)


def every_kth(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Stride sampling in a given order: positions 1, k+1, 2k+1, ..."""
    return with_position(df, order, "_pos").where((F.col("_pos") - 1) % k == 0).drop("_pos")


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Repeatable random sample of n rows."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def ratio_features(df: DataFrame, layer: str) -> DataFrame:
    """Guarded ratios and differences per layer, where the input columns exist."""
    eps = 1e-6

    def r(a, b):
        return F.col(a) / (F.col(b) + eps)

    uses = [f"USO{y}_norm" for y in (2000, 2010, 2012, 2014, 2016, 2018)]
    if layer == "contours":
        mean = one_row(df, m=F.avg("elevation"))["m"]
        return df.withColumns({
            "diff_elev_mean": F.col("elevation") - mean, "ratio_elev_mean": F.col("elevation") / (mean + eps),
        })
    table = {
        "hydro": lambda: {
            "slope_norm": r("elevation_norm", "cotrecho_norm"),
            "flow_potential": F.col("nustrahler_norm") * (1 - F.col("elevation_norm")),
            "elev_deviation": F.col("elevation") - F.col("elevation_norm") * 1000.0,
            "length_to_level_ratio": r("cotrecho_norm", "nunivotto_norm"),
        },
        "waterway": lambda: {
            f"is_{w}": (F.lower("waterway") == w).cast("int") for w in ("stream", "river", "canal")
        },
        "sectors": lambda: {
            "area_perimetro_ratio": r("area_km2", "perimetro_km"),
            "pop_density_calc": r("est_populacao", "area_km2"),
        },
        "land_trend": lambda: {
            "trend_uso": F.col("USO2018_norm") - F.col("USO2000_norm"),
            "media_uso_norm": sum(F.coalesce(F.col(u), F.lit(0.0)) for u in uses)
            / sum(F.col(u).isNotNull().cast("int") for u in uses),
        },
        "schools": lambda: {
            "total_alunos_norm": F.col("alunos_manha_norm") + F.col("alunos_tarde_noite_norm"),
            "ratio_alunos": r("alunos_manha_norm", "alunos_tarde_noite_norm"),
        },
        "priority": lambda: {
            "building_type_code": map_class("building_type", {"educational": 1, "public": 2, "health": 3}, 0)
        },
        "telecom": lambda: {
            "diff_freq": F.col("FreqTxMHz_norm") - F.col("FreqRxMHz_norm"),
            "ratio_freq": r("FreqTxMHz_norm", "FreqRxMHz_norm"),
            "indice_tecnico": (F.col("GanhoAntena_norm") + F.col("PotenciaTransmissorWatts_norm")) / 2,
        },
        "telecom_density": lambda: {"ratio_densidade_potencia": r("densidade_media_norm", "potencia_media_norm")},
        "roads": lambda: {
            "delta_elev_norm": F.col("elevation_max_norm") - F.col("elevation_min_norm"),
            "ratio_elev_mean": r("elevation_mean_norm", "elevation_norm"),
            "ratio_comprimento_importancia": r("comprimento_km_norm", "importancia_via_norm"),
        },
        "railways": lambda: {"log_elevation_norm": F.log(F.col("elevation_norm") + eps)},
        "weather_points": lambda: {
            "dif_elevacao_norm": F.col("z_norm") - F.col("elevacao_base_norm"),
            "ratio_elevacao": r("z_norm", "elevacao_base_norm"),
        },
    }
    return df.withColumns(table[layer]())


def union_layers(*layers: DataFrame) -> DataFrame:
    """Concatenate frames with differing columns."""
    out = layers[0]
    for d in layers[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def group_share(df: DataFrame, keys: Sequence[str], weight: str, name: str = "share") -> DataFrame:
    """Weight over the group's total (pre-aggregated, then joined back)."""
    total = df.groupBy(*keys).agg(F.sum(weight).alias("_t"))
    return join_on(df, total, keys).withColumn(name, F.when(F.col("_t") > 0, F.col(weight) / F.col("_t"))).drop("_t")


_SAFE = re.compile(r"[^0-9A-Za-z_]+")


def safe_name(value: str) -> str:
    return _SAFE.sub("_", value).strip("_").lower()
