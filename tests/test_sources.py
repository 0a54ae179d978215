"""Readers, writers, the weather stream and the directory profile on small files."""

import os

from pyspark.sql import functions as F

from urbanloom.functions import geometry as G
from urbanloom.plans.enrich import profile_directory
from urbanloom.sources import layers as LY
from urbanloom.sources import tables as TB
from urbanloom.sources import weather as W
from urbanloom.streaming import daily_stream

HEAD = "REGIAO:;SE\nUF:;SP\nESTACAO:;CENTRO\nCODIGO (WMO):;A713\nLATITUDE:;-23,42\nLONGITUDE:;-47,58\nALTITUDE:;609\nDATA DE FUNDACAO:;2006\n"
COLS = "DATA (YYYY-MM-DD);HORA (UTC);PRECIPITAÇÃO TOTAL, HORÁRIO (mm);RADIACAO GLOBAL (KJ/m²);TEMPERATURA DO AR - BULBO SECO, HORARIA (°C);\n"


def test_weather_files(spark, tmp_path):
    for i, n in enumerate(("INMET_A.CSV", "sub/INMET_B.CSV", "other.csv")):
        f = tmp_path / n
        f.parent.mkdir(exist_ok=True)
        f.write_text(HEAD + COLS + f"2024-01-0{i + 1};0000 UTC;1,5;1.234,5;20,25;\n2024/01/0{i + 1};0100 UTC;;;21;\n", encoding="utf-8")
    rows = W.read_weather_dir(spark, str(tmp_path)).orderBy("date", "time_utc").collect()
    assert len(rows) == 4
    r = rows[0]
    assert (r["precipitation_mm"], r["radiation_kjm2"], r["temperature_c"], r["latitude"], r["station"], r["region"]) == (1.5, 1234.5, 20.25, -23.42, "CENTRO", "SE")
    assert rows[1]["precipitation_mm"] is None and str(rows[1]["date"]) == "2024-01-01"


def test_tables(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("a;b,c;d\n1;2,5;x\n", encoding="utf-8")
    assert TB.read_csv_best_delimiter(spark, str(f)).columns == ["a", "b,c", "d"]
    g = tmp_path / "b.csv"
    g.write_bytes("nome|preço\ncafé|1\n".encode("latin1"))
    d = TB.read_csv_sniff(spark, str(g))
    assert d.columns == ["nome", "preço"] and d.first()["nome"] == "café"
    n = TB.numeric_guess(TB.read_csv_best_delimiter(spark, str(f)))
    assert n.first()["b,c"] == 2.5


def test_layers(spark, tmp_path):
    base = str(tmp_path / "bundle")
    roads = spark.createDataFrame([(1, None), (2, "primary")], "id long, highway string").withColumn("coords", F.array(G.point(F.lit(0.0), F.lit(0.0)), G.point(F.col("id"), F.lit(1.5))))
    LY.write_layers({"city.buildings": roads.drop("highway"), "city.roads": roads}, base)
    assert sorted(r["highway"] for r in LY.read_layer(spark, base).collect()) == ["primary", "unknown"]
    assert set(LY.load_layer_bundle(spark, base)) == {"buildings", "roads"}
    LY.to_wkt(roads, "coords").select("id", F.col("wkt").alias("geometry")).write.csv(str(tmp_path / "w"), header=True)
    back = LY.read_wkt_table(spark, str(tmp_path / "w"))
    assert {(r["id"], r["c"]["x"]) for r in back.select("id", F.get("coords", 1).alias("c")).collect()} == {("1", 1.0), ("2", 2.0)}
    LY.write_csv(roads, str(tmp_path / "csv"))
    LY.write_report(roads.groupBy().count(), str(tmp_path / "rep"))
    LY.write_features_numeric(roads, str(tmp_path / "num"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, sep=";").columns == ["id", "highway"]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    d = spark.createDataFrame([("2024-01-01 01:00:00", 1.0, 20.0, 5.0), ("2024-01-01 02:00:00", 2.0, 22.0, 7.0), ("2024-01-09 00:00:00", 9.0, 1.0, 1.0)], "ts string, rain double, temp double, rad double").withColumn("ts", F.to_timestamp("ts"))
    d.write.parquet(src)
    q = daily_stream(spark, src, d.schema, "ts", "rain", "temp", "rad").writeStream.format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = [(str(r["date"]), r["rain"], r["temp"]) for r in spark.table("daily").collect()]
    assert ("2024-01-01", 3.0, 21.0) in got


def test_directory_profile(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "b.csv").write_text("x;y\n1;\n", encoding="utf-8")
    (tmp_path / "c.tif").write_text("no")
    got = {r["file"]: (r["status"], r["rows"]) for r in profile_directory(spark, str(tmp_path)).collect()}
    assert got == {"a.parquet": ("processed", 3), "b.csv": ("processed", 1), "c.tif": ("skipped", None)}
    assert os.path.exists(tmp_path / "c.tif")
