"""Hourly weather files: eight header lines ``KEY:;value``, then a ``;`` table with decimal commas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.table import WEATHER_NAMES, select_relevant

HEADER_LINES = 8
# --- fixed values: header keys of the station block -----------------------------------------------
STATION_KEYS = {"REGIAO": "region", "UF": "state", "ESTACAO": "station", "CODIGO (WMO)": "wmo_code",
                "LATITUDE": "latitude", "LONGITUDE": "longitude", "ALTITUDE": "altitude_m"}
NUMBERS = ["precipitation_mm", "pressure_mb", "radiation_kjm2", "temperature_c", "humidity_pct", "wind_direction_deg", "wind_speed_ms"]


def number(c: Column) -> Column:
    """Thousands dot and decimal comma to a number."""
    return F.regexp_replace(F.regexp_replace(c, r"\.", ""), ",", ".").try_cast("double")


def read_weather(spark: SparkSession, path: str, include_radiation: bool = True, recursive: bool = False,
                 glob: str | None = None) -> DataFrame:
    """All weather files below a path in one scan, station block broadcast to the rows of its file.

    Files are read whole per row (a station-year is under a megabyte), so header and body stay together
    without any shuffle.
    """
    r = spark.read
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    raw = r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("l"))
    head = F.slice("l", 1, HEADER_LINES)

    def station(key: str) -> Column:
        hit = F.get(F.filter(head, lambda s: F.startswith(F.upper(F.trim(s)), F.lit(key + ":"))), 0)
        return F.trim(F.get(F.split(hit, ";"), 1))

    meta = {name: station(k) for k, name in STATION_KEYS.items()}
    for n in ("latitude", "longitude", "altitude_m"):
        meta[n] = F.regexp_replace(meta[n], ",", ".").try_cast("double")
    names = F.transform(F.split(F.element_at("l", HEADER_LINES + 1), ";"), lambda c: F.upper(F.trim(c)))
    body = raw.select("file", *[c.alias(n) for n, c in meta.items()], names.alias("names"),
                      F.explode(F.slice(F.col("l"), HEADER_LINES + 2, F.greatest(F.size("l") - HEADER_LINES - 1, F.lit(0)))).alias("line"))
    body = body.where(F.trim("line") != "").withColumn("v", F.split("line", ";"))
    by_name: dict[str, list[str]] = {}
    for old, new in WEATHER_NAMES.items():
        by_name.setdefault(new, []).append(old)

    def value(new: str) -> Column:
        got = F.coalesce(*[F.get("v", F.when(F.array_position("names", old) > 0, (F.array_position("names", old) - 1).cast("int"))) for old in by_name[new]])
        return F.when(F.trim(got) != "", F.trim(got))

    cols = {n: number(value(n)) for n in NUMBERS}
    date = F.coalesce(value("date").try_cast("date"), F.try_to_timestamp(value("date"), F.lit("yyyy/MM/dd")).cast("date"))
    out = body.select("file", date.alias("date"), value("time_utc").alias("time_utc"), *meta.keys(), *[c.alias(n) for n, c in cols.items()])
    return select_relevant(out, include_radiation)


def read_weather_dir(spark: SparkSession, path: str, include_radiation: bool = True) -> DataFrame:
    """Every station file below a folder (names contain INMET and end in .CSV)."""
    return read_weather(spark, path, include_radiation, recursive=True, glob="*INMET*.CSV")
