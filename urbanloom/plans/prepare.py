"""Cleaning of whole layers: area filter, names, ranges, geometry, attributes. One lazy plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import lookups as L
from ..functions import tags
from ..functions.classify import ecological_importance, map_class
from ..operators import profile as P
from ..operators import table as T
from ..operators.spatial import filter_aoi, line_meets_polygon, polygons_meet, with_box


def _aoi(df: DataFrame, aoi: DataFrame | None, coords: str, test, key: str, size: float, on_empty: str) -> DataFrame:
    """``aoi`` carries ``rings`` and box columns."""
    if aoi is None:
        return df
    cols = df.columns
    return filter_aoi(with_box(df, coords), aoi, test, size, key, on_empty).select(*cols)


def prepare_lines(df: DataFrame, key: str, layer: str = "roads", aoi: DataFrame | None = None, size: float = 1000.0, on_empty: str = "empty") -> DataFrame:
    """Roads or railways: names, repair, length, sinuosity, class or tag columns, ranges."""
    d = T.clean_columns(df)
    d = _aoi(d, aoi, "coords", line_meets_polygon("l_coords", "r_rings"), key, size, on_empty)
    d = T.repair_lines(d, "coords")
    if layer == "roads":  # roads check the columns they came with; railways check after measuring
        d = T.null_out_of_range(d, L.RANGES["roads"])
    d = d.withColumns({"length_km": G.line_length("coords") / 1000, "sinuosity": G.sinuosity("coords")})
    if layer == "roads":
        return d.withColumn("road_class", map_class("highway", L.ROAD_CLASS, "other"))
    d = d.withColumns({
        "gauge_mm": tags.tag_value("other_tags", "gauge").try_cast("double"),
        "electrified": F.coalesce(tags.tag_value("other_tags", "electrified"), F.lit("unknown")),
        "operator": tags.tag_value("other_tags", "operator"), "service": tags.tag_value("other_tags", "service"),
    })
    return T.null_out_of_range(d, L.RANGES["railways"])


def prepare_roads(df: DataFrame, key: str, **kw) -> DataFrame:
    return prepare_lines(df, key, "roads", **kw)


def prepare_railways(df: DataFrame, key: str, **kw) -> DataFrame:
    return prepare_lines(df, key, "railways", **kw)


def prepare_buildings(df: DataFrame, key: str, aoi: DataFrame | None = None, size: float = 1000.0, on_empty: str = "empty") -> DataFrame:
    """Repair, area, perimeter, clipped compactness, height and levels from tags, building class."""
    d = T.clean_columns(df)
    if aoi is not None:
        d = d.withColumn("rings", F.array("ring"))
        d = _aoi(d, aoi, "ring", polygons_meet("l_rings", "r_rings"), key, size, on_empty).drop("rings")
    d = T.repair_polygons(d, "ring")
    d = d.withColumns({"area_m2": G.ring_area("ring"), "perimeter_m": G.line_length("ring")})
    d = d.withColumn("compactness_index", G.compactness("area_m2", "perimeter_m", "unit"))
    if "other_tags" in d.columns:
        d = d.withColumns({"height": tags.height_from_tags("other_tags"), "levels": tags.levels_from_tags("other_tags")})
    d = T.null_out_of_range(d, L.RANGES["buildings"])
    return d.withColumn("building_class", map_class("building", L.BUILDING_CLASS, "unclassified"))


def prepare_landuse(df: DataFrame, key: str, aoi: DataFrame | None = None, size: float = 1000.0, on_empty: str = "empty") -> DataFrame:
    """Repair, km2 and km measures, compactness capped at 1, land category."""
    d = T.clean_columns(df)
    if aoi is not None:
        d = d.withColumn("rings", F.array("ring"))
        d = _aoi(d, aoi, "ring", polygons_meet("l_rings", "r_rings"), key, size, on_empty).drop("rings")
    d = T.repair_polygons(d, "ring")
    d = d.withColumns({"area_km2": G.ring_area("ring") / 1e6, "perimeter_km": G.line_length("ring") / 1000})
    d = d.withColumn("compactness", G.compactness("area_km2", "perimeter_km", "top"))
    d = T.null_out_of_range(d, L.RANGES["landuse"])
    return d.withColumn("land_category", map_class("landuse", L.LAND_CATEGORY, "other"))


def prepare_natural(df: DataFrame, key: str) -> DataFrame:
    """Blank-free names, domain check, repair chain, hectares, shape index, ecological importance."""
    d = T.clean_columns(df, spaces="_")
    if "natural" in d.columns and "type" not in d.columns:
        d = d.withColumn("type", F.col("natural"))
    d = T.validate_domain(d, "type")
    if "protected" in d.columns:
        d = d.withColumn("protected", F.coalesce(F.col("protected").try_cast("boolean"), F.lit(False)))
    d = T.make_valid_chain(d, "ring").where(F.col("ring").isNotNull())
    d = d.withColumns({"area_ha": G.ring_area("ring") / 10000, "perimeter_m": G.line_length("ring")})
    d = d.withColumn("shape_index", G.shape_index(F.col("area_ha") * 10000, "perimeter_m"))
    return d.withColumn("ecological_importance", ecological_importance("area_ha", "shape_index"))


def prepare_hydro(layers: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Per layer: names, ranges, repair of lines or rings."""
    out = {}
    for n, df in layers.items():
        d = T.null_out_of_range(T.clean_columns(df), L.RANGES["hydro"])
        if "coords" in d.columns:
            d = T.repair_lines(d, "coords")
        elif "ring" in d.columns:
            d = T.repair_polygons(d, "ring")
        out[n] = d
    return out


def hydro_report(layers: dict[str, DataFrame]) -> DataFrame:
    """Rows per layer; a layer without rows is reported as ``empty``."""
    parts = [
        d.agg(F.count(F.lit(1)).alias("features")).select(F.lit(n).alias("layer"), "features", F.when(F.col("features") == 0, "empty").otherwise("ok").alias("status"))
        for n, d in sorted(layers.items())
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prepare_census(df: DataFrame, aoi: DataFrame | None = None, size: float = 1000.0) -> DataFrame:
    """Canonical names, keys required, area from geometry, perimeter, compactness, densities."""
    d = T.rename_by_map(df, T.CENSUS_NAMES)
    if "AREA_KM2" not in d.columns:
        d = d.withColumn("AREA_KM2", F.lit(None).cast("double"))
    keys = [k for k in ("CD_SETOR", "CD_GEOCODM") if k in d.columns]
    d = d.withColumn("rings", F.array("ring"))
    d = T.require_keys(d, keys, "AREA_KM2", "rings")
    d = _aoi(d, aoi, "ring", polygons_meet("l_rings", "r_rings"), "CD_SETOR", size, "empty")
    d = d.withColumn("PERIMETER_KM", G.line_length("ring") / 1000)
    d = d.withColumn("COMPACTNESS", G.compactness("AREA_KM2", "PERIMETER_KM"))
    if "POP" in d.columns:
        d = d.withColumn("DENS_POP", F.col("POP") / F.col("AREA_KM2"))
    if "DOM" in d.columns:
        d = d.withColumn("DENS_DOM", F.col("DOM") / F.col("AREA_KM2"))
    return d.drop("rings")


def prepare_weather(df: DataFrame, include_radiation: bool = False) -> DataFrame:
    """Canonical names, numbers and dates, valid ranges, declared columns."""
    d = T.rename_weather(df)
    spec = {c: "double" for c, _, _ in L.RANGES["weather"]}
    spec.update({"altitude_m": "double", "date": "date"})
    d = T.cast_by_spec(d, spec)
    return T.select_relevant(T.null_out_of_range(d, L.RANGES["weather"]), include_radiation)


TELECOM_NUMBERS = ["AlturaAntena", "FreqTxMHz", "FreqRxMHz", "GanhoAntena", "PotenciaTransmissorWatts"]


def prepare_telecom(df: DataFrame, k: float = 3.0) -> DataFrame:
    """Numbers, coordinate check, imputation with flags, clipped outliers, dates."""
    nums = [c for c in TELECOM_NUMBERS if c in df.columns]
    coords = [c for c in ("Latitude", "Longitude") if c in df.columns]
    d = T.cast_by_spec(df, {c: "double" for c in nums + coords})
    d = T.flag_copy(d, [*coords, *nums])
    if len(coords) == 2:
        d = T.validate_coords(d)
    text = [c for c in T.text_columns(d) if not c.startswith("Data")]
    d = T.impute(d, nums, text, coords)
    d = T.clip_outliers(d, nums, k)
    return T.parse_dates(d)


def layer_report(df: DataFrame, classes: list[str], numeric: list[str]) -> DataFrame:
    return P.quality_report(df.select(*[c for c in df.columns if c in {*classes, *numeric}]), classes, numeric)
