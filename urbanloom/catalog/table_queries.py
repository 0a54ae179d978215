"""Queries over plain tables: casting, validation, imputation, profiles, aggregates, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import formulas as FM
from ..functions import lookups as L
from ..functions import tags
from ..operators import features as FE
from ..operators import profile as P
from ..operators import table as T
from ..scale import with_running_total
from ..sources import weather as W
from .registry import query
from .shapes import Shapes


def _case(col: str, mapping: dict, default: str | None) -> str:
    body = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {body} {'' if default is None else f'ELSE {default!r} '}END"


def _bins(col: str, name: str, incl: bool = False, left: bool = False) -> str:
    edges, labels = L.BINS[name]
    out = []
    for i, lab in enumerate(labels):
        a, b = edges[i], edges[i + 1]
        lo = f"{col} >= {a}" if (left or (incl and i == 0)) else f"{col} > {a}"
        hi = "" if b == L.INF else (f" AND {col} < {b}" if left else f" AND {col} <= {b}")
        lo = f"{col} IS NOT NULL" if a == -L.INF else lo
        out.append(f"WHEN {lo}{hi} THEN '{lab}'")
    return "CASE " + " ".join(out) + " END"


def _words(col: str, words: dict, null: str | None, default: str | None) -> str:
    out = [f"WHEN {col} IS NULL THEN '{null}'"] if null else []
    for lab, ws in words.items():
        out.append("WHEN " + " OR ".join(f"contains(lower({col}), '{w}')" for w in ws) + f" THEN '{lab}'")
    return "CASE " + " ".join(out) + (f" ELSE '{default}'" if default else "") + " END"


# ---- names, casting ---------------------------------------------------------------------------------


@query("clean_columns", "r_name n_total", "SELECT r_name, count(*) AS n_total FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def clean_columns(s: Shapes):
    d = s.region.withColumnsRenamed({"r_name": " R_Name "}).withColumn("Unnamed: 0", F.lit(1))
    d = T.clean_columns(d)
    return d.join(s.nation, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n_total"))


@query("rename_by_map", "CD_SETOR NM_MUNIC", "SELECT CAST(n_nationkey AS VARCHAR) AS CD_SETOR, n_name AS NM_MUNIC FROM nation")
def rename_by_map(s: Shapes):
    raw = s.nation.select(F.col("n_nationkey").cast("string").alias("CD_GEOCODI"), F.col("n_name").alias("NM_MUNICIP"))
    return T.rename_by_map(raw, T.CENSUS_NAMES)


@query("rename_weather", "temperature_c:4 wind_speed_ms:4 n", "SELECT round(temp, 0) AS temperature_c, avg(wind_speed) AS wind_speed_ms, count(*) AS n FROM v_weather GROUP BY 1")
def rename_weather(s: Shapes):
    w = s.weather().select(
        F.col("temp").alias("Temperatura do Ar - Bulbo Seco, Horaria (°C)"), F.col("wind_speed").alias(" VENTO, VELOCIDADE HORARIA (m/s) "),
        F.lit(0).alias("Unnamed: 19"),
    )
    r = T.rename_weather(w)
    return r.groupBy(F.round("temperature_c", 0).alias("temperature_c")).agg(F.avg("wind_speed_ms").alias("wind_speed_ms"), F.count(F.lit(1)).alias("n"))


@query("select_relevant", "station n temperature_c:6", "SELECT station, count(*) AS n, sum(temp) AS temperature_c FROM v_weather GROUP BY station")
def select_relevant(s: Shapes):
    w = T.select_relevant(s.weather().select("station", F.col("temp").alias("temperature_c"), F.col("rad").alias("radiation_kjm2"), "event_id"))
    assert "radiation_kjm2" not in w.columns
    return w.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sum("temperature_c").alias("temperature_c"))


@query("cast_by_spec", "l_orderkey price:6 n_bad", """SELECT l_orderkey, sum(CASE WHEN l_partkey % 7 <> 0 THEN l_extendedprice END) AS price,
    count(*) FILTER (l_partkey % 7 = 0) AS n_bad FROM lineitem GROUP BY l_orderkey""")
def cast_by_spec(s: Shapes):
    text = F.when(F.col("l_partkey") % 7 == 0, F.lit("n/d")).otherwise(F.regexp_replace(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), r"\.", ","))
    d = T.cast_by_spec(s.lineitem.select("l_orderkey", text.alias("price")), {"price": "double"})
    return d.groupBy("l_orderkey").agg(F.sum("price").alias("price"), F.count_if(F.col("price").isNull()).alias("n_bad"))


@query("parse_dates", "yr n", "SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS n FROM orders GROUP BY 1")
def parse_dates(s: Shapes):
    d = T.parse_dates(s.orders.select(F.col("o_orderdate").cast("string").alias("DataPedido")))
    return d.groupBy(F.year("DataPedido_datetime").alias("yr")).agg(F.count(F.lit(1)).alias("n"))


@query("find_columns_by_keyword", "column n positive min:4 max:4", """SELECT 'c_acctbal' AS "column", count(c_acctbal) AS n, count(*) FILTER (c_acctbal > 0) AS positive,
    min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer
    UNION ALL SELECT 'c_custkey', count(*), count(*) FILTER (c_custkey > 0), CAST(min(c_custkey) AS DOUBLE), max(c_custkey) FROM customer""")
def find_columns_by_keyword(s: Shapes):
    return T.find_columns_by_keyword(s.customer, ["bal", "custkey"])


@query("flag_copy", "l_orderkey l_linenumber price price_original", "SELECT l_orderkey, l_linenumber, price, price AS price_original FROM v_dirty")
def flag_copy(s: Shapes):
    return T.flag_copy(s.dirty(), ["price"])


# ---- validation --------------------------------------------------------------------------------------


@query("null_out_of_range", "l_orderkey l_extendedprice l_quantity", """SELECT l_orderkey, CASE WHEN l_extendedprice <= 50000 AND l_extendedprice >= 2000 THEN l_extendedprice END AS l_extendedprice,
    CASE WHEN l_quantity >= 5 THEN l_quantity END AS l_quantity FROM lineitem""")
def null_out_of_range(s: Shapes):
    return T.null_out_of_range(s.lineitem, [("l_extendedprice", 2000, 50000), ("l_quantity", 5, None)])


@query("clamp_out_of_range", "l_orderkey l_linenumber price qty", """SELECT l_orderkey, l_linenumber, CASE WHEN price IS NULL THEN 0 ELSE least(greatest(price, 2000), 50000) END AS price,
    CASE WHEN qty IS NULL THEN 0 ELSE greatest(qty, 5) END AS qty FROM v_dirty""")
def clamp_out_of_range(s: Shapes):
    return T.clamp_out_of_range(s.dirty(), [("price", 2000, 50000), ("qty", 5, None)])


@query("count_corrections", "column corrections", """SELECT 'price' AS "column", count(*) FILTER (price IS NULL OR price < 2000 OR price > 50000) AS corrections FROM v_dirty
    UNION ALL SELECT 'qty', count(*) FILTER (qty IS NULL OR qty < 5) FROM v_dirty""")
def count_corrections(s: Shapes):
    return T.count_corrections(s.dirty(), [("price", 2000, 50000), ("qty", 5, None)])


@query("require_keys", "id landuse area_km2:8", "SELECT id, landuse, CASE WHEN id % 3 <> 0 THEN area / 1e6 ELSE area / 1e6 END AS area_km2 FROM v_bld WHERE landuse IS NOT NULL")
def require_keys(s: Shapes):
    b = s.buildings().withColumn("area_km2", F.when(F.col("id") % 3 != 0, F.col("area") / 1e6))
    return T.require_keys(b, ["landuse"], "area_km2", "rings")


@query("validate_domain", "type type_invalid n", """SELECT CASE WHEN landuse IN ('forest', 'park') THEN landuse ELSE 'other' END AS type,
    NOT coalesce(landuse IN ('forest', 'park'), false) AS type_invalid, count(*) AS n FROM v_bld GROUP BY ALL""")
def validate_domain(s: Shapes):
    d = T.validate_domain(s.buildings().select(F.col("landuse").alias("type")), "type")
    return d.groupBy("type", "type_invalid").agg(F.count(F.lit(1)).alias("n"))


@query("validate_coords", "erb coord_valida", "SELECT erb, NOT (x / 100 - 90 < -33 OR x / 100 - 90 > 5 OR y / 100 - 100 < -74 OR y / 100 - 100 > -34) AS coord_valida FROM v_stations")
def validate_coords(s: Shapes):
    return T.validate_coords(s.stations().select("erb", (F.col("x") / 100 - 90).alias("Latitude"), (F.col("y") / 100 - 100).alias("Longitude")))


@query("assert_no_empty", "n", "SELECT count(*) AS n FROM v_roads WHERE len(c) > 0")
def assert_no_empty(s: Shapes):
    return T.assert_no_empty(s.roads(), "coords").agg(F.count(F.lit(1)).alias("n"))


@query("impute", "l_orderkey l_linenumber price:4 qty:4 flag price_imputado flag_imputado", """SELECT l_orderkey, l_linenumber, coalesce(price, (SELECT median(price) FROM v_dirty)) AS price,
    coalesce(qty, (SELECT median(qty) FROM v_dirty)) AS qty, coalesce(flag, 'Não informado') AS flag, price IS NULL AS price_imputado, flag IS NULL AS flag_imputado FROM v_dirty""")
def impute(s: Shapes):
    return T.impute(s.dirty(), ["price", "qty"], ["flag"])


@query("impute_positive_median", "c_custkey c_acctbal:4", """SELECT c_custkey, CASE WHEN c_acctbal <= 0 AND c_mktsegment <> 'BUILDING' THEN (SELECT median(c_acctbal) FROM customer
    WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING') ELSE c_acctbal END AS c_acctbal FROM customer""")
def impute_positive_median(s: Shapes):
    return T.impute_positive_median(s.customer, "c_acctbal", F.col("c_mktsegment") != "BUILDING")


_FENCE = """SELECT '{c}' AS "column", q1 - {k} * (q3 - q1) AS lower, q3 + {k} * (q3 - q1) AS upper, (SELECT count(*) FROM {t} WHERE {c} < q1 - {k} * (q3 - q1) OR {c} > q3 + {k} * (q3 - q1)) AS outliers,
    (SELECT min({c}) FROM {t}) AS min, (SELECT max({c}) FROM {t}) AS max, (SELECT count(*) FROM {t}) AS n FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})"""


@query("outliers_iqr", "column lower:4 upper:4 outliers min max pct:6", f"""SELECT *, outliers / n * 100 AS pct FROM ({_FENCE.format(c='value', k=3, t='events')})""")
def outliers_iqr(s: Shapes):
    return T.outliers_iqr(s.events, ["value"], 3.0)


@query("outliers_iqr_narrow", "column lower:4 upper:4 outliers min max pct:6",
       f"SELECT *, outliers / n * 100 AS pct FROM ({_FENCE.format(c='price', k=1.5, t='v_dirty')} UNION ALL {_FENCE.format(c='qty', k=1.5, t='v_dirty')})")
def outliers_iqr_narrow(s: Shapes):
    return T.outliers_iqr(s.dirty(), ["price", "qty"], 1.5, min_values=10)


@query("clip_outliers", "event_id value_outlier value_limitado:4", """SELECT event_id, value < lo OR value > hi AS value_outlier, least(greatest(value, lo), hi) AS value_limitado FROM events,
    (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))""")
def clip_outliers(s: Shapes):
    return T.clip_outliers(s.events, ["value"], 1.5)


@query("trim_quantile", "event_id value", "SELECT event_id, value FROM events WHERE value >= (SELECT quantile_cont(value, 0.01) FROM events) AND value <= (SELECT quantile_cont(value, 0.99) FROM events)")
def trim_quantile(s: Shapes):
    return T.trim_quantile(s.events, "value")


@query("fill_label", "flag amount:4 n", "SELECT coalesce(flag, 'Desconhecida') AS flag, sum(coalesce(qty, 0)) AS amount, count(*) AS n FROM v_dirty GROUP BY 1")
def fill_label(s: Shapes):
    d = T.fill_number(T.fill_label(s.dirty(), "flag"), "qty")
    return d.groupBy("flag").agg(F.sum("qty").alias("amount"), F.count(F.lit(1)).alias("n"))


@query("normalise_text", "word n", """SELECT CASE WHEN l_partkey % 11 = 0 THEN 'unclassified' WHEN l_partkey % 13 = 0 THEN 'unclassified' ELSE lower(l_returnflag) END AS word, count(*) AS n FROM lineitem GROUP BY 1""")
def normalise_text(s: Shapes):
    raw = F.when(F.col("l_partkey") % 11 == 0, F.lit(" NaN ")).when(F.col("l_partkey") % 13 != 0, F.concat(F.lit("  "), "l_returnflag"))
    d = T.clean_text(s.lineitem.select(raw.alias("word")), "word")
    return d.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("filter_mask", "id segment bal", "SELECT id, segment, bal FROM v_customers WHERE segment = 'BUILDING' AND bal > 0")
def filter_mask(s: Shapes):
    return s.customers().where((F.col("segment") == "BUILDING") & (F.col("bal") > 0))


@query("fill_from_raw", "event_id value:4", """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value ELSE coalesce(k, p) END AS value FROM events
    LEFT JOIN (SELECT event_id AS kid, value AS k FROM events WHERE event_id % 10 <> 0) ON event_id = kid
    LEFT JOIN (SELECT user_id AS u, event_type AS t, arg_max(value, event_id) AS p FROM events WHERE event_id % 10 <> 0 GROUP BY ALL) ON user_id = u AND event_type = t""")
def fill_from_raw(s: Shapes):
    e = s.events.select("event_id", "user_id", "event_type", "value")
    raw = e.withColumnRenamed("event_id", "ord").withColumn("event_id", F.when(F.col("ord") % 10 != 0, F.col("ord"))).where(F.col("event_id").isNotNull())
    return T.fill_from_raw(e.withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value"))), raw, "value", "event_id", ["user_id", "event_type"], "ord")


@query("identify_residential", "kind is_residential n", "SELECT kind, kind IN ('house', 'residential', 'apartments') OR coalesce(landuse = 'residential', false) AS is_residential, count(*) AS n FROM v_bld GROUP BY ALL")
def identify_residential(s: Shapes):
    d = T.identify_residential(s.buildings().select("kind", F.col("kind").alias("building"), "landuse"))
    return d.groupBy("kind", "is_residential").agg(F.count(F.lit(1)).alias("n"))


@query("first_in_group", "o_custkey o_orderkey o_totalprice", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def first_in_group(s: Shapes):
    return T.first_in_group(s.orders, ["o_custkey"], "o_orderkey")


@query("best_in_group", "l_suppkey l_orderkey l_extendedprice", """SELECT l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey) AS r FROM lineitem) WHERE r = 1""")
def best_in_group(s: Shapes):
    return T.best_in_group(s.lineitem.select("l_suppkey", "l_orderkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice", "l_orderkey")


# ---- classification and scalars ---------------------------------------------------------------------------


@query("map_class_road", "highway road_class road_class_enriched road_category n", f"""SELECT highway, {_case('highway', L.ROAD_CLASS, 'other')} AS road_class,
    {_case('highway', L.ROAD_CLASS_ENRICHED, 'Local')} AS road_class_enriched, {_case('highway', L.ROAD_CATEGORY, 'other')} AS road_category, count(*) AS n FROM v_roads GROUP BY ALL""")
def map_class_road(s: Shapes):
    return s.roads().groupBy("highway").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "road_class": C.map_class("highway", L.ROAD_CLASS, "other"), "road_class_enriched": C.map_class("highway", L.ROAD_CLASS_ENRICHED, "Local"),
        "road_category": C.map_class("highway", L.ROAD_CATEGORY, "other"),
    })


@query("map_class_building", "id building_class land_category", f"""SELECT id, {_case('kind', L.BUILDING_CLASS, 'unclassified')} AS building_class,
    {_case('landuse', L.LAND_CATEGORY, 'other')} AS land_category FROM v_bld""")
def map_class_building(s: Shapes):
    return s.buildings().select("id", C.map_class("kind", L.BUILDING_CLASS, "unclassified").alias("building_class"), C.map_class("landuse", L.LAND_CATEGORY, "other").alias("land_category"))


@query("map_by_substring", "id category", f"SELECT id, {_words('landuse', L.LAND_KEYWORDS, 'unknown', 'other')} AS category FROM v_bld")
def map_by_substring(s: Shapes):
    return s.buildings().select("id", C.map_by_substring("landuse", L.LAND_KEYWORDS).alias("category"))


@query("simple_classes", "id building_class landuse_class impervious_pct", """SELECT *, CASE landuse_class WHEN 'residential' THEN 70.0 WHEN 'commercial' THEN 90.0 WHEN 'industrial' THEN 80.0 WHEN 'green_area' THEN 10.0
    WHEN 'agricultural' THEN 20.0 ELSE 50.0 END::DOUBLE AS impervious_pct FROM (SELECT id, CASE WHEN kind IN ('house', 'residential', 'apartments') THEN 'residential' WHEN kind = 'commercial' THEN 'commercial'
    WHEN kind = 'industrial' THEN 'industrial' WHEN kind = 'school' THEN 'education' ELSE 'other' END AS building_class, CASE WHEN landuse IS NULL THEN 'unknown' WHEN landuse IN ('residential', 'commercial', 'industrial', 'education') THEN landuse
    WHEN landuse IN ('forest', 'park') THEN 'green_area' ELSE 'other' END AS landuse_class FROM v_bld)""")
def simple_classes(s: Shapes):
    d = s.buildings().select("id", C.simple_building_class("kind").alias("building_class"), C.simple_landuse_class("landuse").alias("landuse_class"))
    return d.withColumn("impervious_pct", C.impervious_pct("landuse_class"))


@query("simple_road_class", "road road_class", """SELECT road, CASE WHEN highway IN ('motorway', 'primary') THEN 'primary' WHEN highway IN ('secondary', 'tertiary', 'residential', 'service') THEN highway ELSE 'other' END AS road_class FROM v_roads""")
def simple_road_class(s: Shapes):
    return s.roads().select("road", C.simple_road_class("highway").alias("road_class"))


@query("bin_right", "c_custkey area_type", f"SELECT c_custkey, {_bins('(c_custkey % 23)', 'telecom_area')} AS area_type FROM customer")
def bin_right(s: Shapes):
    return s.customer.select("c_custkey", C.named_bin(F.col("c_custkey") % 23, "telecom_area").alias("area_type"))


@query("bin_right_incl", "c_custkey slope_class", f"SELECT c_custkey, {_bins('(c_custkey % 37)', 'road_slope', incl=True)} AS slope_class FROM customer")
def bin_right_incl(s: Shapes):
    return s.customer.select("c_custkey", C.named_bin(F.col("c_custkey") % 37, "road_slope", "incl").alias("slope_class"))


@query("bin_left", "l_orderkey l_linenumber length_category", f"SELECT l_orderkey, l_linenumber, coalesce({_bins('(price / 50)', 'road_length', left=True)}, 'desconhecido') AS length_category FROM v_dirty")
def bin_left(s: Shapes):
    return s.dirty().select("l_orderkey", "l_linenumber", C.named_bin(F.col("price") / 50, "road_length", "left").alias("length_category"))


@query("bin_equal", "bin low:4 count", "SELECT CAST(b AS INTEGER) AS bin, b * 50.0 AS low, coalesce(n, 0) AS count FROM range(20) r(b) LEFT JOIN (SELECT least(floor(value / 50), 19) AS k, count(*) AS n FROM events WHERE value >= 0 AND value <= 1000 GROUP BY 1) ON k = b")
def bin_equal(s: Shapes):
    return P.histogram(s.events, "value", 20, 0, 1000)


@query("bin_quantile", "o_orderkey road_class", """SELECT o_orderkey, CASE WHEN o_totalprice < q[1] THEN 'Local' WHEN o_totalprice < q[2] THEN 'Secundária' WHEN o_totalprice < q[3] THEN 'Coletora' ELSE 'Arterial' END AS road_class
    FROM orders, (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders)""")
def bin_quantile(s: Shapes):
    return T.bin_quantile(s.orders, "o_totalprice", "road_class", ["Local", "Secundária", "Coletora", "Arterial"], (0.25, 0.5, 0.75), inclusive_top=False)


@query("quantile_classes", "c_custkey quantile_class", """SELECT c_custkey, CAST(1 + (c_acctbal > q[1])::INT + (c_acctbal > q[2])::INT + (c_acctbal > q[3])::INT + (c_acctbal > q[4])::INT AS INTEGER) AS quantile_class
    FROM customer, (SELECT quantile_cont(c_acctbal, [0.2, 0.4, 0.6, 0.8]) AS q FROM customer)""")
def quantile_classes(s: Shapes):
    return T.quantile_classes(s.customer, "c_acctbal")


@query("bin_unique_quantile", "l_orderkey l_linenumber qty cls", """WITH d AS (SELECT qty AS v, row_number() OVER (ORDER BY qty) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT qty FROM v_dirty WHERE qty > 2)),
    e AS (SELECT max(v) FILTER (i = floor(0.2 * (n - 1))) AS e1, max(v) FILTER (i = floor(0.4 * (n - 1))) AS e2, max(v) FILTER (i = floor(0.6 * (n - 1))) AS e3, max(v) FILTER (i = floor(0.8 * (n - 1))) AS e4 FROM d)
--final
SELECT l_orderkey, l_linenumber, qty, CASE WHEN qty < e1 THEN 'Muito baixa' WHEN qty < e2 THEN 'Baixa' WHEN qty < e3 THEN 'Média' WHEN qty < e4 THEN 'Alta' ELSE 'Muito alta' END AS cls FROM v_dirty, e""")
def bin_unique_quantile(s: Shapes):
    return T.bin_unique_quantile(s.dirty(), "qty", F.col("qty") > 2, "cls", ["Muito baixa", "Baixa", "Média", "Alta", "Muito alta"])


@query("select_first", "zone importance age riparian", """SELECT zone, CASE WHEN a > 100 AND si < 1.5 THEN 'very_high' WHEN a > 100 OR si < 1.5 THEN 'high' WHEN a > 10 AND si < 2 THEN 'medium' WHEN a > 1 THEN 'low' ELSE 'very_low' END AS importance,
    CASE WHEN hi < 0.35 THEN 'Antiga/Plana' WHEN hi <= 0.6 THEN 'Madura/Equilibrada' ELSE 'Jovem/Montanhosa' END AS age,
    CASE WHEN d <= 30 THEN 'Zona Ripária Imediata' WHEN d <= 100 THEN 'Zona Ripária Próxima' WHEN d <= 200 THEN 'Zona Ripária Estendida' ELSE 'Fora da Zona Ripária' END AS riparian
    FROM (SELECT zone, area / 10000 AS a, perimeter / (2 * sqrt(pi() * area)) AS si, (zone % 10) / 10.0 AS hi, (zone * 13) % 300 AS d FROM v_zones)""")
def select_first(s: Shapes):
    z = s.zones()
    from ..functions.geometry import shape_index

    return z.select(
        "zone", C.ecological_importance(F.col("area") / 10000, shape_index("area", "perimeter")).alias("importance"),
        C.basin_age((F.col("zone") % 10) / 10.0).alias("age"), C.riparian_zone((F.col("zone") * 13) % 300).alias("riparian"),
    )


@query("score_class", "c_custkey level dq", """SELECT c_custkey, CASE WHEN v < 0.2 THEN 'Baixa' WHEN v < 0.4 THEN 'Média-Baixa' WHEN v < 0.6 THEN 'Média' WHEN v < 0.8 THEN 'Alta' ELSE 'Crítica' END AS level,
    CASE WHEN v * 4 <= 0.5 THEN 0.2 WHEN v * 4 <= 1.5 THEN 0.4 WHEN v * 4 <= 2.5 THEN 0.6 WHEN v * 4 <= 3.5 THEN 0.8 ELSE 1.0 END::DOUBLE AS dq FROM (SELECT c_custkey, (c_custkey % 101) / 100.0::DOUBLE AS v FROM customer)""")
def score_class(s: Shapes):
    v = (F.col("c_custkey") % 101) / 100.0
    return s.customer.select("c_custkey", C.score_class(v).alias("level"), C.drainage_quality(v * 4).alias("dq"))


@query("app_zone", "app band n", f"""SELECT CASE WHEN d <= 30 THEN 'APP 30m (córregos até 10m)' WHEN d <= 50 THEN 'APP 50m (rios 10-50m)' WHEN d <= 100 THEN 'APP 100m (rios 50-200m)' WHEN d <= 200 THEN 'APP 200m (rios 200-600m)'
    WHEN d <= 500 THEN 'APP 500m (rios >600m)' ELSE 'Fora de APP' END AS app, {_bins('d', 'hydro_distance')} AS band, count(*) AS n FROM (SELECT l_extendedprice / 150 AS d FROM lineitem) GROUP BY ALL""")
def app_zone(s: Shapes):
    d = s.lineitem.select((F.col("l_extendedprice") / 150).alias("d"))
    return d.groupBy(C.app_zone("d").alias("app"), C.named_bin("d", "hydro_distance").alias("band")).agg(F.count(F.lit(1)).alias("n"))


def _tags(s: Shapes):
    k = F.col("p_partkey")
    t = F.concat_ws(
        ",", F.when(k % 3 != 0, F.concat(F.lit('"height"=>"'), F.col("p_size"), F.lit(' m"'))),
        F.when(k % 4 != 0, F.concat(F.lit('"building:levels"=>"'), (k % 9 + 1), F.lit('"'))), F.concat(F.lit('"operator"=>"'), "p_brand", F.lit('"')),
        F.when(k % 5 == 0, F.lit('"bridge"=>"yes"')), F.when(k % 2 == 0, F.concat(F.lit('"service"=>"'), F.when(k % 6 == 0, "yard").when(k % 8 == 0, "siding").otherwise("spur"), F.lit('"'))),
        F.when(k % 7 == 0, F.lit('"usage"=>"main"')),
    )
    return s.part.select(k.alias("id"), t.alias("other_tags"), F.when(k % 10 != 0, C.map_class("p_type", {"ECONOMY": "house", "STANDARD": "yes", "SMALL": "apartments", "MEDIUM": "church"})).alias("building"))


@query("tag_value", "id operator levels height bridge n_tags", """SELECT p_partkey AS id, p_brand AS operator, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 9 + 1 AS DOUBLE) END AS levels,
    CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS height, p_partkey % 5 = 0 AS bridge,
    CAST(1 + (p_partkey % 3 <> 0)::INT + (p_partkey % 4 <> 0)::INT + (p_partkey % 5 = 0)::INT + (p_partkey % 2 = 0)::INT + (p_partkey % 7 = 0)::INT AS INTEGER) AS n_tags FROM part""")
def tag_value(s: Shapes):
    return _tags(s).select(
        "id", tags.tag_value("other_tags", "operator").alias("operator"), tags.levels_from_tags("other_tags").alias("levels"),
        tags.height_from_tags("other_tags").alias("height"), tags.has_tag("other_tags", "bridge").alias("bridge"), F.size(tags.tag_map("other_tags")).alias("n_tags"),
    )


@query("fill_height_levels", "id h lv", """SELECT id, coalesce(h0, l0 * 3, CASE b WHEN 'house' THEN 4 WHEN 'apartments' THEN 12 WHEN 'church' THEN 8 ELSE 3 END) AS h,
    coalesce(l0, ceil(h0 / 3), CASE b WHEN 'apartments' THEN 4 ELSE 1 END) AS lv FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS h0,
    CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 9 + 1 AS DOUBLE) END AS l0, CASE WHEN p_partkey % 10 <> 0 THEN CASE p_type WHEN 'ECONOMY' THEN 'house' WHEN 'SMALL' THEN 'apartments' WHEN 'MEDIUM' THEN 'church' END END AS b FROM part)""")
def fill_height_levels(s: Shapes):
    d = _tags(s).withColumns({"height": F.lit(None).cast("double"), "levels": F.lit(None).cast("double")})
    h, lv = tags.fill_height_levels("height", "levels", "other_tags", "building")
    return d.select("id", h.alias("h"), lv.alias("lv"))


@query("railway_class", "id cls", """SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'principal' WHEN p_partkey % 6 = 0 THEN 'pátio' WHEN p_partkey % 8 = 0 THEN 'desvio' WHEN p_partkey % 2 = 0 THEN 'serviço' ELSE 'outro' END AS cls FROM part""")
def railway_class(s: Shapes):
    return _tags(s).select("id", C.railway_class(tags.tag_value("other_tags", "usage"), tags.tag_value("other_tags", "service")).alias("cls"))


@query("season_south", "season reference_season n", """SELECT CASE WHEN md >= 1222 THEN 'Verão' WHEN md >= 923 THEN 'Primavera' WHEN md >= 621 THEN 'Inverno' WHEN md >= 320 THEN 'Outono' ELSE 'Verão' END AS season,
    CASE WHEN md >= 923 THEN 'Primavera' WHEN md >= 621 THEN 'Inverno' WHEN md >= 320 THEN 'Outono' ELSE 'Verão' END AS reference_season, count(*) AS n FROM (SELECT month(o_orderdate) * 100 + day(o_orderdate) AS md FROM orders) GROUP BY ALL""")
def season_south(s: Shapes):
    return s.orders.groupBy(C.season_south("o_orderdate").alias("season"), C.season_south("o_orderdate", "reference").alias("reference_season")).agg(F.count(F.lit(1)).alias("n"))


@query("date_parts", "yr mon name n", "SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mon, strftime(o_orderdate, '%b') AS name, count(*) AS n FROM orders GROUP BY ALL")
def date_parts(s: Shapes):
    d = F.col("o_orderdate")
    return s.orders.groupBy(F.year(d).alias("yr"), F.month(d).alias("mon"), F.date_format(d, "MMM").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("minmax_norm", "c_custkey c_acctbal_norm:9", "SELECT c_custkey, (c_acctbal - lo) / (hi - lo) AS c_acctbal_norm FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def minmax_norm(s: Shapes):
    return T.minmax_norm(s.customer, ["c_acctbal"])


@query("max_norm", "c_custkey c_acctbal_norm:9", "SELECT c_custkey, c_acctbal / (SELECT max(c_acctbal) FROM customer) AS c_acctbal_norm FROM customer")
def max_norm(s: Shapes):
    return T.max_norm(s.customer, ["c_acctbal"])


@query("robust_index", "event_id density_index:9", """SELECT event_id, CASE WHEN value > 0 THEN greatest(0, least(1, (value - q[1]) / (q[2] - q[1]))) ELSE 0 END AS density_index FROM events, (SELECT quantile_cont(value, [0.01, 0.99]) AS q FROM events WHERE value > 0)""")
def robust_index(s: Shapes):
    return T.robust_index(s.events, "value")


@query("zscore", "c_custkey c_acctbal_z:8 c_acctbal_p:8", "SELECT c_custkey, (c_acctbal - m) / sd AS c_acctbal_z, (c_acctbal - m) / sp AS c_acctbal_p FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd, stddev_pop(c_acctbal) AS sp FROM customer)")
def zscore(s: Shapes):
    return T.zscore(T.zscore(s.customer, ["c_acctbal"]), ["c_acctbal"], ddof=0, suffix="_p")


@query("weighted_index", "l_orderkey l_linenumber idx:9", """SELECT l_orderkey, l_linenumber, 0.4 * (l_quantity - 1) / 49 + 0.4 * (l_tax - t0) / (t1 - t0) + 0.2 * (l_extendedprice - e0) / (e1 - e0) AS idx FROM lineitem,
    (SELECT min(l_tax) AS t0, max(l_tax) AS t1, min(l_extendedprice) AS e0, max(l_extendedprice) AS e1 FROM lineitem)""")
def weighted_index(s: Shapes):
    d = T.minmax_norm(s.lineitem, ["l_quantity", "l_tax", "l_extendedprice"])
    return d.withColumn("idx", C.weighted_index({"l_quantity_norm": 0.4, "l_tax_norm": 0.4, "l_extendedprice_norm": 0.2}))


@query("ratio_features", "sector area_perimetro_ratio:8 pop_density_calc:8", "SELECT sector, area / 1e6 / (8.008 + 1e-6) AS area_perimetro_ratio, pop / (area / 1e6 + 1e-6) AS pop_density_calc FROM v_sectors")
def ratio_features(s: Shapes):
    d = s.sectors().select("sector", (F.col("area") / 1e6).alias("area_km2"), F.lit(8.008).alias("perimetro_km"), F.col("pop").alias("est_populacao"))
    return T.ratio_features(d, "sectors")


@query("ratio_features_contours", "row col diff_elev_mean:6 ratio_elev_mean:8", 'SELECT "row", col, value - m AS diff_elev_mean, value / (m + 1e-6) AS ratio_elev_mean FROM v_cells, (SELECT avg(value) AS m FROM v_cells)')
def ratio_features_contours(s: Shapes):
    return T.ratio_features(s.cells().withColumnRenamed("value", "elevation"), "contours")


@query("encode_vulnerability", "v code n", "SELECT v, CAST(CASE WHEN contains(lower(v), 'ideal') THEN 1 WHEN contains(lower(v), 'sem cobertura') THEN -1 ELSE 0 END AS INTEGER) AS code, count(*) AS n FROM (SELECT (['Ideal', 'Sem cobertura', 'Alta'])[CAST(c_custkey % 3 AS INTEGER) + 1] AS v FROM customer) GROUP BY ALL")
def encode_vulnerability(s: Shapes):
    d = s.customer.select(Shapes._of(["Ideal", "Sem cobertura", "Alta"], F.col("c_custkey") % 3).alias("v"))
    return d.groupBy("v", C.encode_vulnerability("v").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("eirp_dbm", "erb e:8 filled:8", "SELECT erb, 10 * log10(watts * 1000) + gain AS e, 10 * log10(CASE WHEN azimuth IS NOT NULL THEN watts ELSE 1 END * 1000) + gain AS filled FROM v_stations")
def eirp_dbm(s: Shapes):
    return s.stations().select("erb", FM.eirp_dbm("watts", "gain").alias("e"), FM.eirp_dbm(F.when(F.col("azimuth").isNotNull(), F.col("watts")), "gain", fill=True).alias("filled"))


@query("coverage_radius_km", "erb r:8 plain:8 area:8", """SELECT erb, least(base / (1 + 18.0 / 10), least(20, 25000 / freq)) AS r, least(base, 50) AS plain, pi() * least(base / 2.8, least(20, 25000 / freq)) ** 2 * 120 / 360 AS area
    FROM (SELECT erb, freq, 10 ** ((10 * log10(watts * 1000) + gain + 100 - 32.44 - 20 * log10(freq)) / 20) AS base FROM v_stations)""")
def coverage_radius_km(s: Shapes):
    e = FM.eirp_dbm("watts", "gain")
    r = FM.coverage_radius_km(e, "freq")
    return s.stations().select("erb", r.alias("r"), FM.coverage_radius_km(e, "freq", variant="plain").alias("plain"), FM.sector_area_km2(r).alias("area"))


@query("speed_travel_time", "road speed minutes:8", f"""SELECT road, speed, coalesce(len / 1000 / (speed / 60.0), 60) AS minutes FROM (SELECT road, len, CAST(CASE {_case('highway', L.ROAD_CATEGORY, 'other')} WHEN 'motorway' THEN 100 WHEN 'trunk' THEN 80 WHEN 'primary' THEN 60
    WHEN 'secondary' THEN 50 WHEN 'tertiary' THEN 40 WHEN 'residential' THEN 30 WHEN 'other' THEN 20 ELSE 30 END AS INTEGER) AS speed FROM v_roadlen)""")
def speed_travel_time(s: Shapes):
    from ..functions.geometry import line_length

    speed, minutes = FM.travel_minutes(line_length("coords"), C.map_class("highway", L.ROAD_CATEGORY, "other"))
    return s.roads().select("road", speed.alias("speed"), minutes.alias("minutes"))


@query("occupancy_units", "id estimated_floors estimated_units occupancy_per_unit:8 estimated_bedrooms occupancy_per_bedroom:8", """SELECT id, floors AS estimated_floors, units AS estimated_units, pop / units AS occupancy_per_unit, beds AS estimated_bedrooms,
    CASE WHEN pop / (beds * units) > 0 AND pop / (beds * units) <= 10 THEN pop / (beds * units) END AS occupancy_per_bedroom FROM (SELECT *, CAST(CASE WHEN area * floors / units < 40 THEN 1 WHEN area * floors / units < 70 THEN 2 WHEN area * floors / units < 100 THEN 3 ELSE 4 END AS INTEGER) AS beds
    FROM (SELECT *, CASE WHEN round_even(area * floors / 60, 0) <= 0 THEN 1.0 ELSE round_even(area * floors / 60, 0) END AS units FROM (SELECT id, area, CAST(greatest(1, floor(height / 3)) AS INTEGER) AS floors, id % 50 AS pop FROM v_bld)))""")
def occupancy_units(s: Shapes):
    return s.buildings().select("id", *[c.alias(n) for n, c in FM.occupancy_units("area", "height", F.col("id") % 50).items()])


@query("stream_power_index", "reach spi:6 potential", """SELECT reach, spi, CASE WHEN spi < q[1] THEN 'Baixo Potencial Erosivo' WHEN spi <= q[2] THEN 'Médio Potencial Erosivo' ELSE 'Alto Potencial Erosivo' END AS potential FROM (SELECT reach, 2 ** strahler * tan(atan(length / 100 / 100)) AS spi FROM v_reaches),
    (SELECT quantile_cont(2 ** strahler * tan(atan(length / 100 / 100)), [0.25, 0.75]) AS q FROM v_reaches)""")
def stream_power_index(s: Shapes):
    from ..operators.hydro import stream_power, strahler_normalise

    d = strahler_normalise(s.reaches().withColumn("slope_pct", F.col("length") / 100))
    return stream_power(d).select("reach", F.col("stream_power_index").alias("spi"), F.col("erosion_potential").alias("potential"))


@query("topographic_wetness_index", "zone hi:8 twi:6", """SELECT zone, hi, CASE WHEN hi <> 0 THEN ln(area / tan(greatest(atan(80 / (2 * sqrt(area / pi()))) * (1 + hi), 0.001))) END AS twi FROM (SELECT zone, area, (zone % 21) / 20.0::DOUBLE AS hi FROM v_zones)""")
def topographic_wetness_index(s: Shapes):
    hi = FM.hypsometric_integral(500 + (F.col("zone") % 21) * 4.0, F.lit(500.0), F.lit(580.0))
    return s.zones().select("zone", hi.alias("hi"), FM.topographic_wetness_index("area", F.lit(80.0), hi).alias("twi"))


@query("strahler_normalise", "ordem_txt strahler_order n", "SELECT ordem_txt, coalesce(TRY_CAST(ordem_txt AS DOUBLE), 1) AS strahler_order, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'x' WHEN p_partkey % 5 <> 0 THEN CAST(1 + p_size % 7 AS VARCHAR) END AS ordem_txt FROM part) GROUP BY ALL")
def strahler_normalise(s: Shapes):
    from ..operators.hydro import strahler_normalise as norm

    k = F.col("p_partkey")
    d = s.part.select(F.when(k % 9 == 0, F.lit("x")).when(k % 5 != 0, (1 + F.col("p_size") % 7).cast("string")).alias("ordem_txt"))
    return norm(d).groupBy("ordem_txt", "strahler_order").agg(F.count(F.lit(1)).alias("n"))


@query("aspect_direction", "direction n", """SELECT CASE WHEN a < 22.5 OR a >= 337.5 THEN 'Norte' WHEN a < 67.5 THEN 'Nordeste' WHEN a < 112.5 THEN 'Leste' WHEN a < 157.5 THEN 'Sudeste' WHEN a < 202.5 THEN 'Sul' WHEN a < 247.5 THEN 'Sudoeste' WHEN a < 292.5 THEN 'Oeste' ELSE 'Noroeste' END AS direction,
    count(*) AS n FROM (SELECT wind_dir AS a FROM v_weather) GROUP BY 1""")
def aspect_direction(s: Shapes):
    return s.weather().groupBy(C.aspect_direction("wind_dir").alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query("percentile_rank", "c_custkey percentile:8", """SELECT c_custkey, (rank() OVER (ORDER BY c_acctbal) - 1 + count(*) OVER (ORDER BY c_acctbal) + 1) * 50.0 / count(*) OVER () AS percentile FROM customer""")
def percentile_rank(s: Shapes):
    return T.percentile_rank(s.customer, "c_acctbal")


# ---- profiles ---------------------------------------------------------------------------------------------


def _describe(col: str, table: str) -> str:
    return f"""SELECT '{col}' AS "column", count({col}) AS "count", avg({col}) AS mean, stddev_samp({col}) AS std, min({col}) AS min, max({col}) AS max,
    (SELECT sum(({col} - m) ** 3) / count({col}) / (sum(({col} - m) ** 2) / count({col})) ** 1.5 FROM {table}, (SELECT avg({col}) AS m FROM {table})) AS skewness, kurtosis_pop({col}) AS kurtosis,
    quantile_cont({col}, 0.25) AS q1, median({col}) AS median, quantile_cont({col}, 0.75) AS q3, quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25) AS iqr FROM {table}"""


@query("describe_numeric", "column count mean:5 std:5 min max skewness:6 kurtosis:6 q1:5 median:5 q3:5 iqr:5", f"{_describe('price', 'v_dirty')} UNION ALL {_describe('qty', 'v_dirty')}")
def describe_numeric(s: Shapes):
    return P.describe_numeric(s.dirty(), ["price", "qty"])


@query("basic_stats", "column count min max mean:5 std:5 median:5", """SELECT 'price' AS "column", count(price) AS count, min(price) AS min, max(price) AS max, avg(price) AS mean, stddev_pop(price) AS std, median(price) AS median FROM v_dirty
    UNION ALL SELECT 'l_tax', count(l_tax), min(l_tax), max(l_tax), avg(l_tax), stddev_pop(l_tax), median(l_tax) FROM v_dirty""")
def basic_stats(s: Shapes):
    return P.basic_stats(s.dirty(), ["price", "l_tax"])


@query("column_profile", "column mean:5 std:5 min max count nulls null_pct:6 q1:5 median:5 q3:5", """SELECT 'qty' AS "column", avg(qty) AS mean, stddev_samp(qty) AS std, min(qty) AS min, max(qty) AS max, count(qty) AS count, count(*) - count(qty) AS nulls,
    (count(*) - count(qty)) / count(*) * 100 AS null_pct, quantile_cont(qty, 0.25) AS q1, median(qty) AS median, quantile_cont(qty, 0.75) AS q3 FROM v_dirty""")
def column_profile(s: Shapes):
    d = s.dirty().withColumn("qty", F.coalesce("qty", F.lit(float("inf"))))
    return P.column_profile(d, ["qty"])


_MISS = " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, (count(*) - count({c})) / count(*) * 100 AS pct, count(DISTINCT {c}) AS distinct_values FROM v_dirty"""
                           for c in ("l_orderkey", "l_linenumber", "price", "qty", "l_tax", "flag", "l_linestatus"))


@query("data_quality", "column missing pct:6 distinct_values total_missing columns_with_nulls duplicate_rows", f"""SELECT *, CAST(sum(missing) OVER () AS BIGINT) AS total_missing, count(*) FILTER (missing > 0) OVER () AS columns_with_nulls,
    (SELECT count(*) FROM v_dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v_dirty)) AS duplicate_rows FROM ({_MISS})""")
def data_quality(s: Shapes):
    return P.data_quality(s.dirty())


@query("missing_report", "column missing pct:6", f"SELECT * FROM ({_MISS})")
def missing_report(s: Shapes):
    return P.missing_report(s.dirty())


@query("completeness_score", "completeness_score:9", "SELECT 1 - (3 * count(*) - count(price) - count(qty) - count(flag)) / (count(*) * 7) AS completeness_score FROM v_dirty")
def completeness_score(s: Shapes):
    return P.completeness_score(s.dirty())


@query("value_counts", "l_shipdate count", "SELECT l_shipdate, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def value_counts(s: Shapes):
    return P.value_counts(s.lineitem, "l_shipdate")


@query("class_counts", "c_mktsegment count pct:6", "SELECT c_mktsegment, count(*) AS count, count(*) / (SELECT count(*) FROM customer) * 100 AS pct FROM customer GROUP BY 1")
def class_counts(s: Shapes):
    return P.class_counts(s.customer, "c_mktsegment")


@query("recommendations", "column recommendation", f"""SELECT "column", unnest(list_filter([CASE WHEN std > 0 AND (max - mean) / std > 3 THEN 'outliers' END, CASE WHEN abs(skewness) > 1 THEN 'skewed' END, CASE WHEN min = 0 THEN 'zero_minimum' END], lambda x: x IS NOT NULL)) AS recommendation
    FROM ({_describe('value', 'events')} UNION ALL {_describe('l_tax', 'v_dirty')})""")
def recommendations(s: Shapes):
    a = P.describe_numeric(s.events, ["value"]).unionByName(P.describe_numeric(s.dirty(), ["l_tax"]))
    return P.recommendations(a)


@query("spatial_stats", "n minx miny maxx maxy mean_x:5 mean_y:5 std_x:5 std_y:5 size_mean:5 size_std:5 size_min size_max spatial_distribution", """SELECT *, CASE WHEN (std_x + std_y) / 2 < (maxx - minx + maxy - miny) / 4 THEN 'clustered' ELSE 'dispersed' END AS spatial_distribution
    FROM (SELECT count(*) AS n, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, avg(x) AS mean_x, avg(y) AS mean_y, stddev_samp(x) AS std_x, stddev_samp(y) AS std_y, avg(area) AS size_mean, stddev_samp(area) AS size_std, min(area) AS size_min, max(area) AS size_max FROM v_bld)""")
def spatial_stats(s: Shapes):
    return P.spatial_stats(s.buildings(), "x", "y", "area")


_CAT = " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values,
    (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM customer ORDER BY v LIMIT 5)) AS samples FROM customer""" for c, t in (("c_custkey", "bigint"), ("c_nationkey", "int"), ("c_mktsegment", "string"), ("c_name", "string")))


@query("layer_catalog", "column type rows non_null distinct_values samples", _CAT)
def layer_catalog(s: Shapes):
    return P.layer_catalog(s.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_name"))


@query("quality_report", "section metric key value:5", """SELECT 'summary' AS section, 'rows' AS metric, 'all' AS key, CAST(count(*) AS DOUBLE) AS value FROM v_bld
    UNION ALL SELECT 'completeness', 'missing', 'landuse', CAST(count(*) - count(landuse) AS DOUBLE) FROM v_bld UNION ALL SELECT 'completeness', 'missing', 'area', CAST(count(*) - count(area) AS DOUBLE) FROM v_bld
    UNION ALL SELECT 'classes', 'landuse', landuse, CAST(count(*) AS DOUBLE) FROM v_bld GROUP BY landuse
    UNION ALL SELECT 'statistics', unnest(['count', 'min', 'max', 'mean', 'std', 'median']), 'area', unnest([count(area)::DOUBLE, min(area), max(area), avg(area), stddev_pop(area), median(area)]) FROM v_bld""")
def quality_report(s: Shapes):
    return P.quality_report(s.buildings().select("landuse", "area"), ["landuse"], ["area"])


@query("enrichment_report", "section metric key value:5", """SELECT 'retention' AS section, 'ratio' AS metric, 'all' AS key, count(*) / (SELECT count(*) FROM v_stations) AS value FROM v_stations WHERE azimuth IS NOT NULL
    UNION ALL SELECT 'new_columns', 'non_null', 'e', CAST(count(*) AS DOUBLE) FROM v_stations WHERE azimuth IS NOT NULL UNION ALL SELECT 'classes', 'operator', operator, CAST(count(*) AS DOUBLE) FROM v_stations WHERE azimuth IS NOT NULL GROUP BY operator
    UNION ALL SELECT 'statistics', unnest(['count', 'min', 'max', 'mean', 'std', 'median']), 'e', unnest([count(e)::DOUBLE, min(e), max(e), avg(e), stddev_pop(e), median(e)]) FROM (SELECT 10 * log10(watts * 1000) + gain AS e FROM v_stations WHERE azimuth IS NOT NULL)""")
def enrichment_report(s: Shapes):
    a = s.stations()
    return P.enrichment_report(a, a.where(F.col("azimuth").isNotNull()).withColumn("e", FM.eirp_dbm("watts", "gain")), ["e"], ["operator"])


@query("stats_by_type", "kind column count sum:4 mean:5 min max median:5", """SELECT kind, 'height' AS "column", count(*) AS count, sum(height) AS sum, avg(height) AS mean, min(height) AS min, max(height) AS max, median(height) AS median FROM v_bld GROUP BY kind HAVING count(*) > 10
    UNION ALL SELECT kind, 'area', count(*), sum(area), avg(area), min(area), max(area), median(area) FROM v_bld GROUP BY kind HAVING count(*) > 10""")
def stats_by_type(s: Shapes):
    return P.stats_by(s.buildings(), ["kind"], ["height", "area"], 10)


@query("class_length", "highway total:4", "SELECT highway, sum(len) / 1000 AS total FROM v_roadlen GROUP BY highway")
def class_length(s: Shapes):
    from ..functions.geometry import line_length

    return P.class_sum(s.roads().withColumn("km", line_length("coords") / 1000), "highway", "km")


@query("class_area", "landuse total:2", "SELECT landuse, sum(area) AS total FROM v_zones GROUP BY landuse")
def class_area(s: Shapes):
    return P.class_sum(s.zones(), "landuse", "area")


@query("top_n_plus_other", "p_brand total:2 pct:6", """SELECT CASE WHEN r <= 10 THEN p_brand ELSE 'outros' END AS p_brand, sum(a) AS total, sum(a) / (SELECT sum(p_retailprice) FROM part) * 100 AS pct FROM (SELECT p_brand, sum(p_retailprice) AS a, row_number() OVER (ORDER BY sum(p_retailprice) DESC, p_brand) AS r FROM part GROUP BY p_brand) GROUP BY 1""")
def top_n_plus_other(s: Shapes):
    return P.top_n_plus_other(s.part, "p_brand", "p_retailprice", 10)


@query("fragmentation_by_type", "p_brand n q1:5 median:5 q3:5", """SELECT p_brand, count(*) AS n, quantile_cont(p_retailprice, 0.25) AS q1, median(p_retailprice) AS median, quantile_cont(p_retailprice, 0.75) AS q3 FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 8) GROUP BY p_brand""")
def fragmentation_by_type(s: Shapes):
    return P.fragmentation_by_type(s.part, "p_brand", "p_retailprice", 8)


@query("morphology_quartiles", "kind column n q1:5 median:5 q3:5", """SELECT kind, 'area' AS "column", count(*) AS n, quantile_cont(area, 0.25) AS q1, median(area) AS median, quantile_cont(area, 0.75) AS q3 FROM v_bld GROUP BY kind
    UNION ALL SELECT kind, 'c', count(*), quantile_cont(c, 0.25), median(c), quantile_cont(c, 0.75) FROM (SELECT kind, 4 * pi() * area / perimeter ** 2 AS c FROM v_bld) GROUP BY kind""")
def morphology_quartiles(s: Shapes):
    from ..functions.geometry import compactness

    return P.quartiles_by(s.buildings().withColumn("c", compactness("area", "perimeter")), ["kind"], ["area", "c"])


@query("histogram", "bin low:6 count", """WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), h AS (SELECT CASE WHEN l_extendedprice = hi THEN 29 ELSE least(29, floor((l_extendedprice - lo) / ((hi - lo) / 30))) END AS b, count(*) AS n FROM lineitem, r GROUP BY 1)
--final
SELECT CAST(range AS INTEGER) AS bin, lo + range * (hi - lo) / 30 AS low, coalesce(n, 0) AS count FROM range(30), r LEFT JOIN h ON b = range""")
def histogram(s: Shapes):
    return P.histogram(s.lineitem, "l_extendedprice", 30)


@query("strahler_stats", "strahler count length_mean:5 length_std:5", "SELECT strahler, count(*) AS count, avg(length) AS length_mean, stddev_samp(length) AS length_std FROM v_reaches GROUP BY strahler")
def strahler_stats(s: Shapes):
    from ..operators.hydro import order_stats

    return order_stats(s.reaches(), "strahler", ["length"])


@query("diversity", "sector total shannon:8 simpson:8 dominance:8", """SELECT sector, CAST(sum(c) AS BIGINT) AS total, -sum(c / t * ln(c / t)) AS shannon, 1 - sum((c / t) ** 2) AS simpson, sum((c / t) ** 2) AS dominance FROM (SELECT sector, segment, count(*) AS c, sum(count(*)) OVER (PARTITION BY sector) AS t FROM v_customers GROUP BY sector, segment) GROUP BY sector""")
def diversity(s: Shapes):
    return P.diversity(s.customers(), ["sector"], "segment")


@query("landscape_metrics", "landuse num_patches total_area:3 mean_patch:5 largest_patch largest_patch_index:6 patch_density:9 area_pct:6", """SELECT landuse, count(*) AS num_patches, sum(area) AS total_area, avg(area) AS mean_patch, max(area) AS largest_patch, max(area) / sum(area) * 100 AS largest_patch_index, count(*) / (SELECT sum(area) FROM v_zones) AS patch_density, sum(area) / (SELECT sum(area) FROM v_zones) * 100 AS area_pct FROM v_zones GROUP BY landuse""")
def landscape_metrics(s: Shapes):
    return P.landscape_metrics(s.zones(), "landuse", "area")


@query("landscape_overall", "shannon:8 simpson:8 dominance:8 total_edge:3 edge_density:9 num_categories total_patches landscape_area:2", """SELECT -sum(a / t * ln(a / t)) AS shannon, 1 - sum((a / t) ** 2) AS simpson, sum((a / t) ** 2) AS dominance, sum(p) / 2 AS total_edge, sum(p) / 2 / max(t) AS edge_density, count(*) AS num_categories, CAST(sum(n) AS BIGINT) AS total_patches, max(t) AS landscape_area
    FROM (SELECT landuse, sum(area) AS a, sum(perimeter) AS p, count(*) AS n, (SELECT sum(area) FROM v_zones) AS t FROM v_zones GROUP BY landuse)""")
def landscape_overall(s: Shapes):
    return P.landscape_overall(s.zones(), "landuse", "area", "perimeter")


@query("crosstab", "kind landuse n row_share:8", """SELECT kind, landuse, n, n / max(CASE WHEN landuse = 'All' THEN n END) OVER (PARTITION BY kind) AS row_share FROM (SELECT CASE WHEN grouping(kind) = 0 THEN kind ELSE 'All' END AS kind, CASE WHEN grouping(landuse) = 0 THEN landuse ELSE 'All' END AS landuse, count(*) AS n FROM v_bld WHERE landuse IS NOT NULL GROUP BY CUBE (kind, landuse))""")
def crosstab(s: Shapes):
    return P.crosstab(s.buildings().select("kind", "landuse"), "kind", "landuse")


@query("two_level_counts", "c_nationkey c_mktsegment n", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def two_level_counts(s: Shapes):
    return P.two_level_counts(s.customer, "c_nationkey", "c_mktsegment")


@query("linreg", "slope:9 intercept:6 r:8 n", "SELECT regr_slope(height, levels) AS slope, regr_intercept(height, levels) AS intercept, corr(height, levels) AS r, regr_count(height, levels)::BIGINT AS n FROM v_bld")
def linreg(s: Shapes):
    return P.linreg(s.buildings(), "height", "levels")


_COR = ("l_quantity", "l_extendedprice", "l_discount")


@query("corr_matrix", "a b r:8", " UNION ALL ".join(f"SELECT '{p}' AS a, '{q}' AS b, corr({p}, {q}) AS r FROM lineitem" for p in _COR for q in _COR))
def corr_matrix(s: Shapes):
    return P.corr_matrix(s.lineitem, list(_COR))


@query("natural_summary", "section metric key value:4", """SELECT 'summary' AS section, 'rows' AS metric, 'all' AS key, CAST(count(*) AS DOUBLE) AS value FROM v_zones UNION ALL SELECT 'completeness', 'missing', unnest(['area', 'landuse']), 0.0::DOUBLE
    UNION ALL SELECT 'classes', 'landuse', landuse, CAST(count(*) AS DOUBLE) FROM v_zones GROUP BY landuse
    UNION ALL SELECT 'statistics', unnest(['count', 'min', 'max', 'mean', 'std', 'median']), 'area', unnest([count(area)::DOUBLE, min(area), max(area), avg(area), stddev_pop(area), median(area)]) FROM v_zones""")
def natural_summary(s: Shapes):
    return P.natural_summary(s.zones(), "area", ["landuse"])


@query("bbox_overlap_ratio", "overlap_area:3 overlap_ratio:9", """SELECT w * h AS overlap_area, w * h / (aa + ab - w * h) AS overlap_ratio FROM (SELECT least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab
    FROM (SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM v_bld) a, (SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM v_zones) b)""")
def bbox_overlap_ratio(s: Shapes):
    return P.bbox_overlap_ratio(s.buildings(), s.zones())


@query("building_density", "n built_km2:8 region_km2 buildings_per_km2:6 built_up_ratio:9", "SELECT count(*) AS n, sum(area) / 1e6 AS built_km2, 100.0::DOUBLE AS region_km2, count(*) / 100.0 AS buildings_per_km2, sum(area) / 1e6 / 100 AS built_up_ratio FROM v_bld")
def building_density(s: Shapes):
    return P.building_density(s.buildings(), "area", F.lit(100.0))


# ---- weather ------------------------------------------------------------------------------------------------


@query("daily_weather", "station date rain:6 temp:6 radiation:5", "SELECT station, CAST(ts AS DATE) AS date, sum(rain) AS rain, avg(temp) AS temp, avg(rad) AS radiation FROM v_weather GROUP BY ALL")
def daily_weather(s: Shapes):
    return P.daily_weather(s.weather(), "ts", "rain", "temp", "rad", ["station"])


@query("cumulative_rain", "station date rain:6 cumulative:5", "SELECT station, date, rain, sum(rain) OVER (PARTITION BY station ORDER BY date) AS cumulative FROM (SELECT station, CAST(ts AS DATE) AS date, sum(rain) AS rain FROM v_weather GROUP BY ALL)")
def cumulative_rain(s: Shapes):
    return P.cumulative_rain(P.daily_weather(s.weather(), "ts", "rain", "temp", "rad", ["station"]), ["station"])


@query("monthly_temp_pivot", "year jan:4 jul:4 dec:4", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) FILTER (month(o_orderdate) = 1) AS jan, avg(o_totalprice) FILTER (month(o_orderdate) = 7) AS jul, avg(o_totalprice) FILTER (month(o_orderdate) = 12) AS dec FROM orders GROUP BY 1")
def monthly_temp_pivot(s: Shapes):
    return P.monthly_pivot(s.orders, "o_orderdate", "o_totalprice").withColumnsRenamed({"1": "jan", "7": "jul", "12": "dec"})


@query("seasonal_stats", "season column n q1:5 median:5 q3:5 mean_rain:5", """WITH w AS (SELECT CASE WHEN md >= 1222 THEN 'Verão' WHEN md >= 923 THEN 'Primavera' WHEN md >= 621 THEN 'Inverno' WHEN md >= 320 THEN 'Outono' ELSE 'Verão' END AS season, rain, temp FROM (SELECT month(o_orderdate) * 100 + day(o_orderdate) AS md, o_totalprice AS temp, o_custkey AS rain FROM orders))
--final
SELECT season, 'temp' AS "column", count(*) AS n, quantile_cont(temp, 0.25) AS q1, median(temp) AS median, quantile_cont(temp, 0.75) AS q3, avg(rain) AS mean_rain FROM w GROUP BY season""")
def seasonal_stats(s: Shapes):
    return P.seasonal_stats(s.orders.select("o_orderdate", F.col("o_totalprice").alias("temp"), F.col("o_custkey").alias("rain")), "o_orderdate", "rain", ["temp"])


@query("wind_rose", "direction speed n pct:8", """SELECT floor(wind_dir / 10) * 10 AS direction, floor(wind_speed / 2) * 2 AS speed, count(*) AS n, count(*) / (SELECT count(*) FROM v_weather) * 100 AS pct FROM v_weather GROUP BY ALL""")
def wind_rose(s: Shapes):
    return P.wind_rose(s.weather(), "wind_dir", "wind_speed").withColumns({"direction": F.col("direction").cast("double"), "speed": F.col("speed").cast("double")})


@query("weather_number", "l_orderkey v:4 n", "SELECT l_orderkey, sum(l_extendedprice) AS v, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def weather_number(s: Shapes):
    c = F.col("l_extendedprice").cast("decimal(18,2)")
    text = F.concat(F.floor(c / 1000).cast("string"), F.lit("."), F.lpad((F.floor(c) % 1000).cast("string"), 3, "0"), F.lit(","), F.lpad((F.floor(c * 100) % 100).cast("string"), 2, "0"))
    return s.lineitem.select("l_orderkey", W.number(text).alias("v")).groupBy("l_orderkey").agg(F.sum("v").alias("v"), F.count("v").alias("n"))


# ---- windows, order, sampling, sets ------------------------------------------------------------------------------


@query("running_total", "o_orderkey running:2", "SELECT o_orderkey, sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey) AS running FROM orders")
def running_total(s: Shapes):
    return with_running_total(s.orders, ["o_orderdate", "o_orderkey"], "o_totalprice", "running")


@query("group_share", "id sector share:10", "SELECT id, sector, (bal + 1000) / sum(bal + 1000) OVER (PARTITION BY sector) AS share FROM v_customers")
def group_share(s: Shapes):
    return T.group_share(s.customers().withColumn("w", F.col("bal") + 1000), ["sector"], "w")


@query("top_fraction_flag", "c_custkey top", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) <= (SELECT floor(count(*) * 0.1) FROM customer) AS top FROM customer")
def top_fraction_flag(s: Shapes):
    return T.top_fraction_flag(s.customer, "c_acctbal", ["c_custkey"])


@query("top_k", "o_orderkey o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(s: Shapes):
    return T.top_k(s.orders, "o_totalprice", 10, "o_orderkey")


@query("top_quantile", "event_id value", "SELECT event_id, value FROM events WHERE value > (SELECT quantile_cont(value, 0.95) FROM events)")
def top_quantile(s: Shapes):
    return T.top_quantile(s.events, "value", 0.95)


@query("cumulative_cover", "p_brand count cumulative", "SELECT * FROM (SELECT p_brand, count(*) AS count, CAST(sum(count(*)) OVER (ORDER BY count(*) DESC, p_brand) AS BIGINT) AS cumulative FROM part GROUP BY p_brand) WHERE cumulative <= 0.9 * (SELECT count(*) FROM part)")
def cumulative_cover(s: Shapes):
    return P.cumulative_cover(s.part, "p_brand")


@query("every_kth", "o_orderkey", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE (r - 1) % 7 = 0")
def every_kth(s: Shapes):
    return T.every_kth(s.orders, ["o_orderdate", "o_orderkey"], 7)


@query("sample_n", "n distinct_n", "SELECT least(count(*), 100) AS n, least(count(*), 100) AS distinct_n FROM customer")
def sample_n(s: Shapes):
    return T.sample_n(s.customer, 100, "c_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("distinct_n"))


@query("union_layers", "id name bal", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_layers(s: Shapes):
    return T.union_layers(s.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal")), s.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


# ---- encodings, splits, metrics ---------------------------------------------------------------------------------


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("one_hot", "c_custkey seg_automobile seg_building seg_furniture seg_household seg_machinery", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{v}')::INTEGER AS seg_{v.lower()}" for v in _SEGMENTS) + " FROM customer")
def one_hot(s: Shapes):
    return FE.one_hot(s.customer, "c_mktsegment", _SEGMENTS, prefix="seg")


@query("one_hot_long", "c_custkey category value", "SELECT c_custkey, c_mktsegment AS category, 1 AS value FROM customer")
def one_hot_long(s: Shapes):
    return FE.one_hot_long(s.customer, "c_custkey", "c_mktsegment")


@query("ordinal_encode", "l_orderkey l_linenumber flag code", "SELECT l_orderkey, l_linenumber, flag, CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE -1 END::BIGINT AS code FROM v_dirty")
def ordinal_encode(s: Shapes):
    return FE.ordinal_encode(s.dirty(), "flag", "code")


@query("random_split", "split n", "SELECT * FROM (SELECT 'train' AS split, CAST(floor(count(*) * 0.7) AS BIGINT) AS n FROM customer UNION ALL SELECT 'val', CAST(floor(count(*) * 0.15) AS BIGINT) FROM customer UNION ALL SELECT 'test', CAST(count(*) - floor(count(*) * 0.7) - floor(count(*) * 0.15) AS BIGINT) FROM customer)")
def random_split(s: Shapes):
    return FE.split_sizes(FE.random_split(s.customer, "c_custkey"))


@query("stratified_split", "c_mktsegment split n", """SELECT c_mktsegment, unnest(['train', 'val', 'test']) AS split, unnest([floor(c * 0.6), floor(c * 0.2), c - floor(c * 0.6) - floor(c * 0.2)])::BIGINT AS n FROM (SELECT c_mktsegment, count(*)::DOUBLE AS c FROM customer GROUP BY 1)""")
def stratified_split(s: Shapes):
    return FE.split_sizes(FE.stratified_split(s.customer, "c_custkey", "c_mktsegment", 0.6, 0.2), ["c_mktsegment"])


@query("split_overlap", "overlap", "SELECT 0::BIGINT AS overlap")
def split_overlap(s: Shapes):
    d = FE.random_split(s.customer, "c_custkey")
    return FE.split_overlap(d.where("split = 'train'"), d.where("split = 'test'"), "c_custkey")


@query("class_weights", "kind n weight:9 root_weight:9", "SELECT kind, n, (1 / n) / sum(1 / n) OVER () AS weight, (1 / sqrt(n)) / sum(1 / sqrt(n)) OVER () AS root_weight FROM (SELECT kind, count(*) AS n FROM v_bld GROUP BY kind)")
def class_weights(s: Shapes):
    a = FE.class_weights(s.buildings(), "kind")
    return a.join(FE.class_weights(s.buildings(), "kind", root=True).select("kind", F.col("weight").alias("root_weight")), "kind")


def _predicted(s: Shapes):
    return s.lineitem.select((F.col("l_partkey") % 4).alias("label"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_partkey") % 4).otherwise(F.col("l_orderkey") % 5).alias("pred"))


@query("classification_report", "class precision:9 recall:9 f1:9 support", """WITH p AS (SELECT CAST(l_partkey % 4 AS VARCHAR) AS l, CAST(CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 4 ELSE l_orderkey % 5 END AS VARCHAR) AS p FROM lineitem),
    c AS (SELECT k, (SELECT count(*) FROM p WHERE l = k AND p.p = k) AS tp, (SELECT count(*) FROM p WHERE p.p = k) AS pr, (SELECT count(*) FROM p WHERE l = k) AS sup FROM (SELECT DISTINCT l AS k FROM p UNION SELECT DISTINCT p FROM p)),
    m AS (SELECT k, sup, tp, CASE WHEN pr > 0 THEN tp / pr ELSE 0 END AS pre, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rec FROM c), f AS (SELECT *, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END AS f1 FROM m)
--final
SELECT k AS class, pre AS precision, rec AS recall, f1, sup AS support FROM f UNION ALL SELECT 'accuracy', sum(tp) / sum(sup), sum(tp) / sum(sup), sum(tp) / sum(sup), CAST(sum(sup) AS BIGINT) FROM f
    UNION ALL SELECT 'macro avg', avg(pre), avg(rec), avg(f1), CAST(sum(sup) AS BIGINT) FROM f UNION ALL SELECT 'weighted avg', sum(pre * sup) / sum(sup), sum(rec * sup) / sum(sup), sum(f1 * sup) / sum(sup), CAST(sum(sup) AS BIGINT) FROM f""")
def classification_report(s: Shapes):
    return FE.classification_report(_predicted(s), "label", "pred")


@query("confusion", "label prediction n row_share:9", "SELECT l_partkey % 4 AS label, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 4 ELSE l_orderkey % 5 END AS prediction, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY label) AS row_share FROM lineitem GROUP BY label, prediction")
def confusion(s: Shapes):
    return FE.confusion(_predicted(s), "label", "pred")


@query("pca_2d", "n m1:6 m2:6 cov:6", "SELECT count(*) AS n, 0.0 AS m1, 0.0 AS m2, 0.0 AS cov FROM lineitem")
def pca_2d(s: Shapes):
    p = FE.pca_2d(s.lineitem, "l_orderkey", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return p.agg(F.count(F.lit(1)).alias("n"), F.avg("pc1").alias("m1"), F.avg("pc2").alias("m2"), F.covar_pop("pc1", "pc2").alias("cov"))


@query("features_numeric", "n width", "SELECT count(*) AS n, 8 AS width FROM lineitem")
def features_numeric(s: Shapes):
    from pyspark.ml.functions import vector_to_array

    m = FE.numeric_matrix(s.lineitem)
    return m.select(F.size(vector_to_array("features")).alias("width")).groupBy("width").agg(F.count(F.lit(1)).alias("n"))
