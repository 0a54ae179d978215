"""Layer readers and writers: Parquet layers, WKT or lon/lat tables, bundles, reports."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.features import numeric_matrix


def layer_names(path: str) -> list[str]:
    """Sub-folders or Parquet files directly below a folder, by name."""
    out = []
    for n in sorted(os.listdir(path)):
        full = os.path.join(path, n)
        if n.endswith(".parquet") or (os.path.isdir(full) and not n.startswith(("_", "."))):
            out.append(n)
    return out


def read_layer(spark: SparkSession, path: str, words: tuple[str, ...] = ("road", "via")) -> DataFrame:
    """One layer: the sub-layer named after one of ``words`` or the first; null ``highway`` is ``unknown``."""
    target = path
    if os.path.isdir(path) and not any(f.endswith(".parquet") and os.path.isfile(os.path.join(path, f)) and f.startswith("part-") for f in os.listdir(path)):
        names = layer_names(path)
        hit = next((n for n in names if any(w in n.lower() for w in words)), names[0] if names else None)
        if hit:
            target = os.path.join(path, hit)
    df = spark.read.parquet(target)
    return df.fillna({"highway": "unknown"}) if "highway" in df.columns else df


def read_wkt_table(spark: SparkSession, path: str, wkt: str = "geometry", sep: str = ",") -> DataFrame:
    """CSV with a WKT column or lon/lat columns as a layer with ``coords``."""
    df = spark.read.csv(path, header=True, sep=sep)
    if wkt in df.columns:
        return df.withColumn("coords", G.from_wkt(F.col(wkt)))
    if {"lon", "lat"} <= set(df.columns):
        return df.withColumn("coords", F.array(G.point(F.col("lon").try_cast("double"), F.col("lat").try_cast("double"))))
    raise ValueError("table has neither a WKT column nor lon/lat columns")


def short_name(layer: str) -> str:
    """Text after the last dot, without a file suffix."""
    base = layer[: -len(".parquet")] if layer.endswith(".parquet") else layer
    return base.rsplit(".", 1)[-1]


def load_layer_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every layer of a folder (lazy), keyed by short name."""
    return {short_name(n): spark.read.parquet(os.path.join(path, n)) for n in layer_names(path)}


def read_raster_table(spark: SparkSession, path: str, nodata: float | None = None) -> DataFrame:
    from ..operators.raster import mask_nodata

    return mask_nodata(spark.read.parquet(path).select("row", "col", F.col("value").cast("double")), nodata)


def write_layer(df: DataFrame, path: str, layer: str, stamp: bool = False) -> str:
    name = f"{layer}_{time.strftime('%Y%m%d_%H%M%S')}" if stamp else layer
    out = os.path.join(path, name)
    df.write.mode("overwrite").parquet(out)
    return out


def write_layers(layers: dict[str, DataFrame], path: str) -> dict[str, str]:
    return {n: write_layer(d, path, n) for n, d in layers.items()}


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """CSV sink without nested (geometry) columns."""
    flat = [f.name for f in df.schema.fields if not f.dataType.simpleString().startswith(("array", "struct", "map"))]
    df.select(*flat).write.mode("overwrite").csv(path, sep=sep, header=True)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_features_numeric(df: DataFrame, path: str) -> None:
    numeric_matrix(df).write.mode("overwrite").parquet(path)


def to_wkt(df: DataFrame, geom: str, kind: str = "LINESTRING", name: str = "wkt") -> DataFrame:
    return df.withColumn(name, G.to_wkt(geom, kind))
