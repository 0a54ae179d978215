"""The given tables seen as urban layers: stations, buildings, zones, sectors, roads, networks, raster.

Every shape is a projection of whole tables with integer arithmetic, so both engines derive identical
values and the work grows with the tables. ``VIEWS`` holds the same shapes as SQL.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.raster import Affine
from ..operators.spatial import with_box

KINDS = {"ECONOMY": "house", "STANDARD": "residential", "SMALL": "apartments", "MEDIUM": "commercial", "LARGE": "industrial", "PROMO": "school"}
LANDUSE = ["residential", "commercial", "industrial", "education", "forest", "mixed", "park", "government_public"]
HIGHWAYS = ["motorway", "primary", "secondary", "tertiary", "residential", "service", "cycleway", "steps"]
FREQS = [700.0, 850.0, 1800.0, 2100.0, 2600.0]

AFFINE = Affine(0.0, 10000.0, 100.0)


def _pick(values: list, index: str) -> str:
    """SQL list lookup by a 0-based expression."""
    return f"([{', '.join(repr(v) for v in values)}])[CAST({index} AS INTEGER) + 1]"


def _px(k: str) -> str:
    return f"CAST((({k} % 10007) * ({k} % 10007) * 7 + {k} * 7919) % 10007 AS DOUBLE)"


def _py(k: str) -> str:
    return f"CAST((({k} % 10009) * ({k} % 10009) * 13 + {k} * 104729) % 10009 AS DOUBLE)"


VIEWS = {
    "v_stations": f"""SELECT s_suppkey AS erb, {_px('s_suppkey')} AS x, {_py('s_suppkey')} AS y,
        'OP' || CAST(s_nationkey % 4 AS VARCHAR) AS operator, CAST(5 + s_suppkey % 36 AS DOUBLE) AS watts,
        CAST(10 + s_suppkey % 9 AS DOUBLE) AS gain, {_pick(FREQS, 's_suppkey % 5')} AS freq,
        CASE WHEN s_suppkey % 29 <> 0 THEN CAST((s_suppkey * 37) % 360 AS DOUBLE) END AS azimuth FROM supplier""",
    "v_customers": f"SELECT c_custkey AS id, {_px('c_custkey')} AS x, {_py('c_custkey')} AS y, c_mktsegment AS segment, c_acctbal AS bal, c_nationkey AS sector FROM customer",
    "v_bld": f"""SELECT id, x0, y0, x0 + w AS x1, y0 + h AS y1, w, h, w * h AS area, 2 * (w + h) AS perimeter, x0 + w / 2 AS x, y0 + h / 2 AS y,
        kind, height, levels, landuse FROM (SELECT p_partkey AS id, {_px('p_partkey')} AS x0, {_py('p_partkey')} AS y0,
        CAST(p_size + 4 AS DOUBLE) AS w, CAST(p_partkey % 30 + 6 AS DOUBLE) AS h,
        CASE p_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} END AS kind,
        3 + (p_partkey % 40) * 0.75::DOUBLE AS height, CAST(1 + p_partkey % 13 AS DOUBLE) AS levels,
        CASE WHEN p_size % 10 <> 0 THEN {_pick(LANDUSE, 'p_size % 8')} END AS landuse FROM part)""",
    "v_zones": f"""SELECT zone, x0, y0, x0 + w AS x1, y0 + h AS y1, w * h AS area, 2 * (w + h) AS perimeter, x0 + w / 2 AS x, y0 + h / 2 AS y, landuse, level
        FROM (SELECT s_suppkey AS zone, CAST((s_suppkey * 6151) % 9001 AS DOUBLE) AS x0, CAST((s_suppkey * 3571) % 9001 AS DOUBLE) AS y0,
        CAST(400 + (s_suppkey % 7) * 100 AS DOUBLE) AS w, CAST(300 + (s_suppkey % 5) * 150 AS DOUBLE) AS h,
        {_pick(LANDUSE, 's_nationkey % 8')} AS landuse, CAST(1 + s_suppkey % 3 AS INTEGER) AS level FROM supplier)""",
    "v_sectors": """SELECT n_nationkey AS sector, CAST((n_nationkey % 5) * 2002 AS DOUBLE) AS x0, CAST((n_nationkey // 5) * 2002 AS DOUBLE) AS y0,
        CAST((n_nationkey % 5) * 2002 + 2002 AS DOUBLE) AS x1, CAST((n_nationkey // 5) * 2002 + 2002 AS DOUBLE) AS y1,
        CAST(2002 * 2002 AS DOUBLE) AS area, CAST(500 + n_nationkey * 137 AS DOUBLE) AS pop, n_regionkey AS region FROM nation""",
    # concave shapes as rectangles that touch: zones without their upper right quarter, sectors with a hole
    "v_ells": """SELECT zone, x0, y0, x1, (y0 + y1) / 2 AS y1 FROM v_zones
        UNION ALL SELECT zone, x0, (y0 + y1) / 2, (x0 + x1) / 2, y1 FROM v_zones""",
    "v_frames": """SELECT sector, x0, y0, x1, y0 + 600.5 AS y1 FROM v_sectors UNION ALL SELECT sector, x0, y0 + 1400.5, x1, y1 FROM v_sectors
        UNION ALL SELECT sector, x0, y0 + 600.5, x0 + 500.5, y0 + 1400.5 FROM v_sectors
        UNION ALL SELECT sector, x0 + 1500.5, y0 + 600.5, x1, y0 + 1400.5 FROM v_sectors""",
    "v_roads": f"""SELECT o_orderkey AS road, list_transform(range(2 + o_orderkey % 4), lambda i: struct_pack(
        x := {_px('o_orderkey')} + 20 * i + (o_custkey * (i + 1)) % 17, y := {_py('o_orderkey')} + (o_custkey * (i + 3)) % 50)) AS c,
        {_pick(HIGHWAYS, 'o_custkey % 8')} AS highway, o_custkey AS cust FROM orders""",
    "v_segs": """SELECT road, highway, CAST(i AS INTEGER) AS seg, c[i].x AS ax, c[i].y AS ay, c[i + 1].x AS qx, c[i + 1].y AS qy
        FROM (SELECT road, highway, c, unnest(range(1, len(c))) AS i FROM v_roads)""",
    "v_roadlen": "SELECT road, highway, sum(sqrt((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay))) AS len FROM v_segs GROUP BY road, highway",
    "v_streets": f"""SELECT p_partkey * 2 + j AS street, p_partkey AS src, p_partkey + 10 * (CASE j WHEN 0 THEN p_size ELSE (p_partkey * 7) % 11 + 1 END) AS dst,
        {_pick(HIGHWAYS, 'p_size % 8')} AS highway, p_size % 8 AS code FROM part, (SELECT unnest([0, 1]) AS j)""",
    "v_simple": "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(street) AS street, arg_max(code, street) AS code, arg_max(highway, street) AS highway FROM v_streets GROUP BY 1, 2",
    "v_both": "SELECT src, dst FROM v_simple UNION ALL SELECT dst, src FROM v_simple",
    "v_reaches": "SELECT p_partkey AS reach, p_partkey AS src, p_partkey + 50 * p_size AS dst, CAST(1 + p_size % 7 AS DOUBLE) AS strahler, p_retailprice AS length FROM part",
    "v_cells": "SELECT CAST(o_orderkey // 100 AS INTEGER) AS \"row\", CAST(o_orderkey % 100 AS INTEGER) AS col, 500 + o_totalprice / 1000 AS value FROM orders",
    "v_weather": """SELECT event_id, ts, CAST(user_id % 5 AS INTEGER) AS station, CASE WHEN event_type IN ('view', 'click') THEN value / 100 ELSE 0.0::DOUBLE END AS rain,
        15 + (event_id * 37 % 200) / 10.0::DOUBLE AS temp, CAST((event_id * 29) % 3500 AS DOUBLE) AS rad,
        CAST((event_id * 53) % 360 AS DOUBLE) AS wind_dir, value / 10 AS wind_speed FROM events""",
    "v_dirty": """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 17 <> 0 THEN l_extendedprice END AS price, CASE WHEN l_suppkey % 13 <> 0 THEN l_quantity END AS qty,
        l_tax, CASE WHEN l_partkey % 11 <> 0 THEN l_returnflag END AS flag, l_linestatus FROM lineitem""",
}


class Shapes:
    """Lazy access to the tables and the layers derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.dir, f"{name}.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @staticmethod
    def _x(k: Column) -> Column:
        return (((k % 10007) * (k % 10007) * 7 + k * 7919) % 10007).cast("double")

    @staticmethod
    def _y(k: Column) -> Column:
        return (((k % 10009) * (k % 10009) * 13 + k * 104729) % 10009).cast("double")

    @staticmethod
    def _of(values: list, index: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))

    def stations(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.supplier.select(
            k.alias("erb"), self._x(k).alias("x"), self._y(k).alias("y"),
            F.concat(F.lit("OP"), (F.col("s_nationkey") % 4).cast("string")).alias("operator"),
            (5 + k % 36).cast("double").alias("watts"), (10 + k % 9).cast("double").alias("gain"),
            self._of(FREQS, k % 5).alias("freq"), F.when(k % 29 != 0, ((k * 37) % 360).cast("double")).alias("azimuth"),
        )

    def customers(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.customer.select(
            k.alias("id"), self._x(k).alias("x"), self._y(k).alias("y"), F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("sector"),
        )

    def buildings(self) -> DataFrame:
        k, size = F.col("p_partkey"), F.col("p_size")
        kind = F.when(F.lit(False), F.lit(""))
        for a, b in KINDS.items():
            kind = kind.when(F.col("p_type") == a, F.lit(b))
        b = self.part.select(
            k.alias("id"), self._x(k).alias("minx"), self._y(k).alias("miny"), (size + 4).cast("double").alias("w"), (k % 30 + 6).cast("double").alias("h"),
            kind.alias("kind"), (3 + (k % 40) * 0.75).alias("height"), (1 + k % 13).cast("double").alias("levels"),
            F.when(size % 10 != 0, self._of(LANDUSE, size % 8)).alias("landuse"),
        )
        b = b.withColumns({"maxx": F.col("minx") + F.col("w"), "maxy": F.col("miny") + F.col("h")})
        return b.withColumns({
            "area": F.col("w") * F.col("h"), "perimeter": 2 * (F.col("w") + F.col("h")), "x": F.col("minx") + F.col("w") / 2,
            "y": F.col("miny") + F.col("h") / 2, "ring": G.rectangle("minx", "miny", "maxx", "maxy"),
        }).withColumn("rings", F.array("ring"))

    def zones(self) -> DataFrame:
        k = F.col("s_suppkey")
        z = self.supplier.select(
            k.alias("zone"), ((k * 6151) % 9001).cast("double").alias("minx"), ((k * 3571) % 9001).cast("double").alias("miny"),
            (400 + (k % 7) * 100).cast("double").alias("w"), (300 + (k % 5) * 150).cast("double").alias("h"),
            self._of(LANDUSE, F.col("s_nationkey") % 8).alias("landuse"), (1 + k % 3).cast("int").alias("level"),
        )
        z = z.withColumns({"maxx": F.col("minx") + F.col("w"), "maxy": F.col("miny") + F.col("h")})
        return z.withColumns({
            "area": F.col("w") * F.col("h"), "perimeter": 2 * (F.col("w") + F.col("h")), "x": F.col("minx") + F.col("w") / 2,
            "y": F.col("miny") + F.col("h") / 2, "ring": G.rectangle("minx", "miny", "maxx", "maxy"),
        }).withColumn("rings", F.array("ring"))

    def sectors(self) -> DataFrame:
        n = F.col("n_nationkey")
        s = self.nation.select(
            n.alias("sector"), ((n % 5) * 2002).cast("double").alias("minx"), (F.floor(n / 5) * 2002).cast("double").alias("miny"),
            (500 + n * 137).cast("double").alias("pop"), F.col("n_regionkey").alias("region"),
        )
        s = s.withColumns({"maxx": F.col("minx") + 2002, "maxy": F.col("miny") + 2002, "area": F.lit(2002.0 * 2002.0)})
        return s.withColumn("ring", G.rectangle("minx", "miny", "maxx", "maxy")).withColumn("rings", F.array("ring"))

    def ells(self) -> DataFrame:
        """Zones without their upper right quarter."""
        mx, my = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
        corners = [("minx", "miny"), ("maxx", "miny"), ("maxx", my), (mx, my), (mx, "maxy"), ("minx", "maxy"), ("minx", "miny")]
        return self.zones().select("zone", F.array(F.array(*[G.point(x, y) for x, y in corners])).alias("rings"))

    def frames(self) -> DataFrame:
        """Sectors with a hole."""
        hole = G.rectangle(F.col("minx") + 500.5, F.col("miny") + 600.5, F.col("minx") + 1500.5, F.col("miny") + 1400.5)
        return self.sectors().select("sector", F.array("ring", F.reverse(hole)).alias("rings"))

    def roads(self) -> DataFrame:
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        coords = F.transform(
            F.sequence(F.lit(0), (1 + o % 4).cast("int")),
            lambda i: G.point(self._x(o) + 20 * i + (c * (i + 1)) % 17, self._y(o) + (c * (i + 3)) % 50),
        )
        return self.orders.select(o.alias("road"), coords.alias("coords"), self._of(HIGHWAYS, c % 8).alias("highway"), c.alias("cust"))

    def boxed_roads(self) -> DataFrame:
        return with_box(self.roads(), "coords")

    def streets(self) -> DataFrame:
        k = F.col("p_partkey")
        e = self.part.select("p_partkey", "p_size", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
        step = F.when(F.col("j") == 0, F.col("p_size")).otherwise((k * 7) % 11 + 1)
        return e.select(
            (k * 2 + F.col("j")).alias("street"), k.alias("src"), (k + 10 * step).alias("dst"),
            self._of(HIGHWAYS, F.col("p_size") % 8).alias("highway"), (F.col("p_size") % 8).alias("code"),
        )

    def street_lines(self) -> DataFrame:
        """Streets as two-vertex lines between node places."""
        s = self.streets()
        a = G.point(self._x(F.col("src")), self._y(F.col("src")))
        b = G.point(self._x(F.col("dst")), self._y(F.col("dst")))
        return s.select("street", "highway", F.array(a, b).alias("coords"))

    def reaches(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("reach"), F.col("p_partkey").alias("src"), (F.col("p_partkey") + 50 * F.col("p_size")).alias("dst"),
            (1 + F.col("p_size") % 7).cast("double").alias("strahler"), F.col("p_retailprice").alias("length"),
        )

    def cells(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.orders.select(
            F.floor(o / 100).cast("int").alias("row"), (o % 100).cast("int").alias("col"), (500 + F.col("o_totalprice") / 1000).alias("value")
        )

    def weather(self) -> DataFrame:
        e = F.col("event_id")
        return self.events.select(
            "event_id", "ts", (F.col("user_id") % 5).cast("int").alias("station"),
            F.when(F.col("event_type").isin("view", "click"), F.col("value") / 100).otherwise(0.0).alias("rain"),
            (15 + (e * 37 % 200) / 10.0).alias("temp"), ((e * 29) % 3500).cast("double").alias("rad"),
            ((e * 53) % 360).cast("double").alias("wind_dir"), (F.col("value") / 10).alias("wind_speed"),
        )

    def dirty(self) -> DataFrame:
        return self.lineitem.select(
            "l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 17 != 0, F.col("l_extendedprice")).alias("price"),
            F.when(F.col("l_suppkey") % 13 != 0, F.col("l_quantity")).alias("qty"), "l_tax",
            F.when(F.col("l_partkey") % 11 != 0, F.col("l_returnflag")).alias("flag"), "l_linestatus",
        )
