"""Queries for zoning, population, flood exposure and whole-layer compositions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import lookups as L
from ..operators import hydro as H
from ..operators import population as PO
from ..operators import profile as P
from ..operators import spatial as S
from ..operators import zoning as Z
from ..plans import enrich as EN
from ..plans import prepare as PR
from ..scale import cut_lineage
from .registry import query
from .shapes import AFFINE, Shapes
from .raster_queries import _CX, _CY, _GRAD, _NATURE, _ZC
from .table_queries import _bins, _case, _words

# ---- zoning -------------------------------------------------------------------------------------------------

_AMEN = "CASE WHEN id % 6 = 0 THEN 'library' WHEN id % 6 = 1 THEN 'bank' WHEN id % 6 = 2 THEN 'toilets' END"
_CAT = f"""SELECT id, kind, landuse, split_part(coalesce(b, a), '.', 1) AS cat0, nullif(split_part(coalesce(b, a), '.', 2), '') AS sub, b, a, u FROM (SELECT id, kind, landuse, {_case("(CASE WHEN id % 3 <> 0 THEN kind END)", L.BUILDING_FUNCTION, None)} AS b,
    {_case(f"({_AMEN})", L.AMENITY_FUNCTION, None)} AS a, {_case('lower(landuse)', L.LANDUSE_FUNCTION, None)} AS u FROM v_bld)"""
_FIN = f"""SELECT id, landuse, CASE WHEN b IS NOT NULL OR a IS NOT NULL THEN cat0 ELSE u END AS cat, CASE WHEN b IS NOT NULL OR a IS NOT NULL THEN sub END AS sub, CASE WHEN b IS NOT NULL THEN 'building' WHEN a IS NOT NULL THEN 'amenity' WHEN u IS NOT NULL THEN 'landuse' END AS src,
    CASE WHEN id % 3 <> 0 THEN kind END AS building FROM ({_CAT})"""
_CLS = f"SELECT *, coalesce(CASE WHEN cat IS NOT NULL THEN CASE WHEN sub IS NOT NULL THEN cat || '_' || sub ELSE cat END END, 'unclassified_' || building, 'other') AS cls FROM ({_FIN})"


def _categorized(s: Shapes) -> DataFrame:
    k = F.col("id")
    b = s.buildings().select("id", F.when(k % 3 != 0, F.col("kind")).alias("building"), "landuse",
                             F.when(k % 6 == 0, "library").when(k % 6 == 1, "bank").when(k % 6 == 2, "toilets").alias("amenity"))
    return Z.categorize_buildings(b)


@query("categorize_buildings", "id cat sub src", f"SELECT id, cat, sub, src FROM ({_FIN})")
def categorize_buildings(s: Shapes):
    return _categorized(s).withColumnsRenamed({"categoria_funcional": "cat", "subcategoria_funcional": "sub", "fonte_categoria": "src"})


@query("categorization_counts", "source n", f"SELECT coalesce(src, 'uncategorized') AS source, count(*) AS n FROM ({_FIN}) GROUP BY 1")
def categorization_counts(s: Shapes):
    return Z.categorization_counts(_categorized(s))


@query("finalize_class", "id building_class_enhanced", f"SELECT id, cls AS building_class_enhanced FROM ({_CLS})")
def finalize_class(s: Shapes):
    return Z.finalize_class(_categorized(s))


@query("validate_categorization", "building_match_rate:8 landuse_consistency_rate:8", f"""SELECT avg(contains(lower(cls), building)::INT) FILTER (building IS NOT NULL) AS building_match_rate, avg((contains(landuse, 'residential') AND contains(cls, 'residencial') OR contains(landuse, 'commercial') AND contains(cls, 'comercial')
    OR contains(landuse, 'industrial') AND contains(cls, 'industrial') OR contains(landuse, 'mixed') AND (contains(cls, 'residencial_misto') OR contains(cls, 'misto')))::INT) FILTER (landuse IS NOT NULL) AS landuse_consistency_rate FROM ({_CLS})""")
def validate_categorization(s: Shapes):
    return Z.validate_categorization(Z.finalize_class(_categorized(s)))


@query("categorization_coverage", "total categorized percent:6", f"SELECT count(*) AS total, count(cat) AS categorized, count(cat) / count(*) * 100 AS percent FROM ({_FIN})")
def categorization_coverage(s: Shapes):
    return Z.categorization_coverage(_categorized(s))


@query("sample_per_class", "building_class_enhanced n", f"SELECT cls AS building_class_enhanced, least(count(*), 5) AS n FROM ({_CLS}) GROUP BY cls")
def sample_per_class(s: Shapes):
    return Z.sample_per_class(Z.finalize_class(_categorized(s)), "building_class_enhanced", "id").groupBy("building_class_enhanced").agg(F.count(F.lit(1)).alias("n"))


_RULES = "(VALUES " + ", ".join(
    f"('{z}', '{lv}', {2 * i}, '{p}')" for i, (z, lv, ps) in enumerate(L.ZONING_RULES) for p in ps
) + ") rules(zone, level, pri, prefix)"
_ZONED = f"SELECT *, {_words('landuse', L.ZONE_WORDS, None, None)} AS zona FROM ({_CLS})"
_CONF = f"""SELECT c.id, c.cat, c.zona, CASE WHEN c.zona IS NOT NULL THEN coalesce(m.level, 'desconhecido') END AS nivel, CASE WHEN c.zona IS NULL THEN NULL WHEN m.level IN ('permitido', 'condicional') THEN 'conforme' WHEN m.level = 'proibido' THEN 'não conforme' ELSE 'não avaliado' END AS status,
    CASE WHEN c.zona IS NULL THEN NULL WHEN m.level IS NULL THEN 'sem regra aplicável definida' ELSE 'categoria funcional ''' || m.txt || ''' é ' || m.level || ' em zona ''' || c.zona || '''' END AS regra FROM ({_ZONED}) c LEFT JOIN (SELECT id, arg_min(level, o) AS level, arg_min(txt, o) AS txt FROM (SELECT id, rules.level, pri + k AS o, txt FROM (SELECT id, zona, cls AS txt, 0 AS k FROM ({_ZONED}) UNION ALL
    SELECT id, zona, split_part(cls, '_', 1), 1 FROM ({_ZONED}) WHERE contains(cls, '_')) t JOIN {_RULES} ON rules.zone = t.zona AND starts_with(t.txt, rules.prefix)) GROUP BY id) m ON m.id = c.id"""


def _conform(s: Shapes) -> DataFrame:
    return Z.zoning_conformity(Z.finalize_class(_categorized(s)), "landuse")


@query("zoning_conformity", "id zona nivel status regra", _CONF)
def zoning_conformity(s: Shapes):
    return _conform(s).withColumnsRenamed({"nivel_conformidade": "nivel", "conformidade_uso": "status", "regra_aplicada": "regra"})


@query("conformity_indices", "scope key total conforme nao_conforme indice_conformidade:8 cobertura:8", f"""SELECT *, CASE WHEN conforme + nao_conforme > 0 THEN conforme / (conforme + nao_conforme) END AS indice_conformidade, (conforme + nao_conforme) / total AS cobertura FROM (SELECT CASE WHEN grouping(cat) = 1 AND grouping(zona) = 1 THEN 'geral' WHEN grouping(cat) = 0 THEN 'categoria' ELSE 'zona' END AS scope,
    CASE WHEN grouping(cat) = 1 AND grouping(zona) = 1 THEN 'geral' WHEN grouping(cat) = 0 THEN cat ELSE zona END AS key, count(*) AS total, count(*) FILTER (status = 'conforme') AS conforme, count(*) FILTER (status = 'não conforme') AS nao_conforme FROM ({_CONF}) GROUP BY GROUPING SETS ((), (cat), (zona)))""")
def conformity_indices(s: Shapes):
    return Z.conformity_indices(_conform(s))


@query("conformity_hotspots", "zona cat n", f"SELECT * FROM (SELECT zona, cat, count(*) AS n FROM ({_CONF}) WHERE status = 'não conforme' GROUP BY ALL ORDER BY n DESC, zona, cat LIMIT 10)")
def conformity_hotspots(s: Shapes):
    return Z.conformity_hotspots(_conform(s)).withColumnRenamed("categoria_funcional", "cat")


@query("zone_nonconformity_rates", "zona rate:8 n", f"SELECT * FROM (SELECT zona, avg(coalesce(status = 'não conforme', false)::INT) AS rate, count(*) AS n FROM ({_CONF}) WHERE zona IS NOT NULL GROUP BY zona ORDER BY rate DESC, zona LIMIT 5)")
def zone_nonconformity_rates(s: Shapes):
    return Z.zone_nonconformity_rates(_conform(s))


@query("conformity_crosstab", "zona conformidade_uso n", f"SELECT CASE WHEN grouping(zona) = 0 THEN zona ELSE 'All' END AS zona, CASE WHEN grouping(status) = 0 THEN status ELSE 'All' END AS conformidade_uso, count(*) AS n FROM ({_CONF}) WHERE zona IS NOT NULL GROUP BY CUBE (zona, status)")
def conformity_crosstab(s: Shapes):
    return Z.conformity_crosstab(_conform(s))


# ---- population ------------------------------------------------------------------------------------------------


def _weighted(s: Shapes) -> DataFrame:
    c = s.customers().select("id", "sector", "bal", "segment").join(s.sectors().select("sector", "pop"), "sector")
    return c.withColumn("is_residential", F.col("segment") != "MACHINERY")


@query("distribution_strategy", "strategy rows", "SELECT 'area_height' AS strategy, count(*) AS rows FROM v_bld")
def distribution_strategy(s: Shapes):
    b = s.buildings().select("id", "area", "height")
    name, _ = PO.strategy_by_names(b)
    return b.agg(F.count(F.lit(1)).alias("rows")).withColumn("strategy", F.lit(name))


@query("distribution_weights", "id weight:6", """SELECT id, CASE WHEN segment <> 'MACHINERY' THEN CASE WHEN bal <= 0 THEN (SELECT median(bal) FROM v_customers WHERE bal > 0 AND segment <> 'MACHINERY') ELSE bal END ELSE 0 END AS weight FROM v_customers""")
def distribution_weights(s: Shapes):
    return PO.distribution_weights(_weighted(s), "area", "pop", area="bal")


_ALLOC = """WITH w AS (SELECT id, sector, pop, CASE WHEN bal > 0 THEN bal ELSE 0 END AS w FROM v_customers JOIN v_sectors USING (sector)), e AS (SELECT *, w / sum(w) OVER (PARTITION BY sector) * pop AS e FROM w), f AS (SELECT *, floor(e) AS f, row_number() OVER (PARTITION BY sector ORDER BY e - floor(e) DESC, id) AS r FROM e),
    a AS (SELECT id, sector, pop, CAST(f + CASE WHEN r <= round_even(pop - sum(f) OVER (PARTITION BY sector), 0) THEN 1 ELSE 0 END AS BIGINT) AS estimated_population FROM f)"""


def _allocated(s: Shapes) -> DataFrame:
    return PO.distribute_population(_weighted(s).withColumn("weight", F.when(F.col("bal") > 0, F.col("bal")).otherwise(0.0)), "sector", "pop", "id")


@query("distribute_population", "id sector estimated_population", f"{_ALLOC}\n--final\nSELECT id, sector, estimated_population FROM a")
def distribute_population(s: Shapes):
    return _allocated(s)


@query("allocation_check", "sector allocated census difference", "SELECT sector, CAST(max(pop) AS BIGINT) AS allocated, max(pop) AS census, 0.0::DOUBLE AS difference FROM v_customers JOIN v_sectors USING (sector) GROUP BY sector")
def allocation_check(s: Shapes):
    return PO.allocation_check(_allocated(s), "sector", "pop")


_DM = f"""SELECT id, kind, p, area, height, p / area AS d, p / (area * height) AS dv, p / units AS occ, {_bins('(p / area)', 'population_density', incl=True)} AS cls FROM (SELECT *, CASE WHEN round_even(area * greatest(1, floor(height / 3)) / 60, 0) <= 0 THEN 1 ELSE round_even(area * greatest(1, floor(height / 3)) / 60, 0) END AS units FROM (SELECT id, kind, area, height, (id % 23)::DOUBLE AS p FROM v_bld))"""


def _dense(s: Shapes) -> DataFrame:
    return PO.density_metrics(s.buildings().withColumn("estimated_population", (F.col("id") % 23).cast("double")))


@query("density_metrics", "id density_per_area:9 density_per_volume:9 occupancy_per_unit:7 density_class density_index:7", f"""WITH m AS ({_DM}), q AS (SELECT quantile_cont(d, [0.01, 0.99]) AS q FROM m WHERE d > 0)
--final
SELECT id, d AS density_per_area, dv AS density_per_volume, occ AS occupancy_per_unit, cls AS density_class, CASE WHEN d > 0 THEN greatest(0, least(1, (d - q[1]) / (q[2] - q[1]))) ELSE 0 END AS density_index FROM m, q""")
def density_metrics(s: Shapes):
    return _dense(s)


@query("density_by_type", "kind building_count total_population mean_population:6 mean_density_area:8 mean_occupancy:7 median_density_area:9", f"SELECT kind, count(*) AS building_count, sum(p) AS total_population, avg(p) AS mean_population, avg(d) AS mean_density_area, avg(occ) AS mean_occupancy, median(d) AS median_density_area FROM ({_DM}) WHERE p > 0 GROUP BY kind")
def density_by_type(s: Shapes):
    return PO.density_by_type(_dense(s), "kind")


@query("density_class_shares", "kind density_class n share:8", f"SELECT kind, cls AS density_class, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY kind) AS share FROM ({_DM}) WHERE cls IS NOT NULL GROUP BY kind, cls")
def density_class_shares(s: Shapes):
    return PO.density_class_shares(_dense(s), "kind")


_PH = "SELECT sector, t, pop, [" + ", ".join(
    "pop * CASE t " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in L.PRESENCE.items()) + f" ELSE {L.PRESENCE_DEFAULT[i]} END" for i in range(5)
) + f"] AS h FROM (SELECT sector, pop, {_bins('(pop * 3 / (area / 1e6))', 'census_area')} AS t FROM v_sectors)"


@query("population_by_hour", "sector tipo_area est_pop_pea:4 pop_atual_0800:4 pop_atual_2300:4 pop_variacao_max:4 pop_variacao_rel:8 categoria_variacao_pop", f"SELECT sector, t AS tipo_area, pop * 0.65 AS est_pop_pea, h[1] AS pop_atual_0800, h[5] AS pop_atual_2300, list_max(h) - list_min(h) AS pop_variacao_max, (list_max(h) - list_min(h)) / pop AS pop_variacao_rel, {_bins('round((list_max(h) - list_min(h)) / pop, 9)', 'variation')} AS categoria_variacao_pop FROM ({_PH})")
def population_by_hour(s: Shapes):
    d = s.sectors().withColumn("d3", F.col("pop") * 3)
    d = PO.estimate_population(d.withColumn("area_km2", F.col("area") / 1e6), "area_km2", "d3").withColumn("est_populacao", F.col("pop"))
    out = PO.population_by_hour(d, "tipo_area")
    return out.withColumn("categoria_variacao_pop", PO.named_bin(F.round("pop_variacao_rel", 9), "variation"))


_PROFILE_SQL = f"SELECT id, kind, {_words('kind', {f'{n}|{i}': w for i, t in enumerate((L.PROFILE_WORDS, L.USE_WORDS, L.PROFILE_FALLBACK)) for n, w in t.items()}, 'default', 'default')} AS p0 FROM v_bld"


@query("assign_profile", "kind temporal_profile n", f"SELECT kind, split_part(p0, '|', 1) AS temporal_profile, count(*) AS n FROM ({_PROFILE_SQL}) GROUP BY ALL")
def assign_profile(s: Shapes):
    return PO.assign_profile(s.buildings(), "kind").groupBy("kind", "temporal_profile").agg(F.count(F.lit(1)).alias("n"))


@query("use_column", "column n", "SELECT 'kind' AS \"column\", count(*) AS n FROM v_bld")
def use_column(s: Shapes):
    b = s.buildings().withColumn("type", F.lit("x"))
    return b.agg(F.count(F.lit(1)).alias("n")).withColumn("column", F.lit(PO.use_column(b, ["type", "kind"])))


def _rates(s: Shapes) -> DataFrame:
    """Hourly activity share of event types as occupancy profiles."""
    names = {"signup": "residential", "click": "commercial", "view": "industrial", "error": "school", "purchase": "default"}
    p = F.when(F.lit(False), F.lit(""))
    for k, v in names.items():
        p = p.when(F.col("event_type") == k, F.lit(v))
    e = s.events.select(p.alias("temporal_profile"), F.hour("ts").alias("hour"), F.floor(F.col("value")).alias("v"))
    g = e.groupBy("temporal_profile", "hour").agg(F.sum("v").alias("v"))
    return g.select("temporal_profile", "hour", (F.col("v") / 100000).alias("rate"))


_RATES = """SELECT CASE event_type WHEN 'signup' THEN 'residential' WHEN 'click' THEN 'commercial' WHEN 'view' THEN 'industrial' WHEN 'error' THEN 'school' ELSE 'default' END AS profile, CAST(hour(ts) AS INTEGER) AS hour, sum(floor(value)) / 100000 AS rate FROM events GROUP BY ALL"""
_HOURLY = f"""SELECT id, b.profile AS temporal_profile, hour, CASE WHEN id % 50 > 0 THEN (id % 50) * rate ELSE 0 END AS population FROM (SELECT id, split_part(p0, '|', 1) AS profile FROM ({_PROFILE_SQL})) b JOIN ({_RATES}) r ON r.profile = CASE WHEN b.profile IN (SELECT profile FROM ({_RATES})) THEN b.profile ELSE 'default' END"""


def _hourly(s: Shapes) -> DataFrame:
    b = PO.assign_profile(s.buildings(), "kind").withColumn("estimated_population", (F.col("id") % 50).cast("double"))
    return PO.hourly_occupancy(b, _rates(s), "id")


@query("hourly_occupancy", "id temporal_profile hour population:8", _HOURLY)
def hourly_occupancy(s: Shapes):
    return _hourly(s)


_TOTALS = f"SELECT hour, sum(population) AS total, coalesce(sum(population) FILTER (temporal_profile = 'residential'), 0) AS residential, coalesce(sum(population) FILTER (temporal_profile <> 'residential'), 0) AS other FROM ({_HOURLY}) GROUP BY hour"


@query("hourly_totals", "hour total:6 residential:6 other:6", _TOTALS)
def hourly_totals(s: Shapes):
    return PO.hourly_totals(_hourly(s))


@query("hourly_wide", "id population_h00:8 population_h12:8", f"SELECT id, sum(population) FILTER (hour = 0) AS population_h00, sum(population) FILTER (hour = 12) AS population_h12 FROM ({_HOURLY}) GROUP BY id")
def hourly_wide(s: Shapes):
    return PO.hourly_wide(_hourly(s), "id")


@query("active_periods", "start end length", f"SELECT min(hour) AS start, max(hour) AS \"end\", count(*) AS length FROM (SELECT hour, hour - row_number() OVER (ORDER BY hour) AS g FROM (SELECT *, median(total) OVER () AS m FROM ({_TOTALS})) WHERE total >= m) GROUP BY g")
def active_periods(s: Shapes):
    from ..scale import quantile_row

    t = cut_lineage(PO.hourly_totals(_hourly(s)))
    return PO.active_periods(t.where(F.col("total") >= F.get(quantile_row(t, "total", [0.5]), 0)))


@query("urban_pulse", "amplitude_abs:6 amplitude_pct:6 peak_hour valley_hour daytime_activity_index:8 night_activity_index:8 day_night_ratio:8 num_active_periods longest_active_period active_periods commuting_index:8", f"""WITH t AS MATERIALIZED ({_TOTALS}), r AS (SELECT min(hour) AS a, max(hour) AS b, count(*) AS n FROM (SELECT hour, hour - row_number() OVER (ORDER BY hour) AS g FROM t WHERE total >= 0.8 * (SELECT max(total) FROM t)) GROUP BY g)
--final
SELECT max(total) - min(total) AS amplitude_abs, (max(total) - min(total)) / max(total) * 100 AS amplitude_pct, arg_max(hour, total) AS peak_hour, arg_min(hour, total) AS valley_hour, avg(total) FILTER (hour >= 8 AND hour < 20) / avg(total) AS daytime_activity_index, avg(total) FILTER (hour < 8 OR hour >= 20) / avg(total) AS night_activity_index,
    avg(total) FILTER (hour >= 8 AND hour < 20) / avg(total) FILTER (hour < 8 OR hour >= 20) AS day_night_ratio, (SELECT count(*) FROM r) AS num_active_periods, (SELECT max(n) FROM r) AS longest_active_period, (SELECT string_agg(CASE WHEN n = 1 THEN printf('%02dh', a) ELSE printf('%02dh-%02dh', a, b) END, ', ' ORDER BY a) FROM r) AS active_periods, -corr(residential, other) AS commuting_index FROM t""")
def urban_pulse(s: Shapes):
    return PO.urban_pulse(cut_lineage(PO.hourly_totals(_hourly(s))))


@query("rank_types", "kind total_population rank", f"SELECT kind, sum(p) AS total_population, rank() OVER (ORDER BY sum(p) DESC) AS rank FROM ({_DM}) GROUP BY kind")
def rank_types(s: Shapes):
    from ..scale import with_position

    g = P.class_sum(_dense(s), "kind", "estimated_population", "total_population")
    return with_position(g, [F.desc("total_population"), "kind"], "rank")


@query("census_summary", "column count mean:6 std:6 min max median:6", """SELECT unnest(['est_populacao', 'densidade_pop', 'area_km2']) AS "column", count(*) AS count, unnest([avg(pop), avg(pop / a), avg(a)]) AS mean, unnest([stddev_samp(pop), stddev_samp(pop / a), stddev_samp(a)]) AS std, unnest([min(pop), min(pop / a), min(a)]) AS min, unnest([max(pop), max(pop / a), max(a)]) AS max, unnest([median(pop), median(pop / a), median(a)]) AS median
    FROM (SELECT pop, area / 1e6 AS a FROM v_sectors)""")
def census_summary(s: Shapes):
    return PO.census_summary(PO.estimate_population(s.sectors().withColumn("area_km2", F.col("area") / 1e6), "area_km2", "pop"))


_VUL = "SELECT sector, pop, area, vr, sd / max(sd) OVER () AS ir, 1 - cp AS ia FROM (SELECT sector, pop, area, (sector % 10) / 20.0::DOUBLE AS vr, (1 + sector % 7)::DOUBLE AS sd, (sector % 6) / 10.0::DOUBLE AS cp FROM v_sectors)"


def _vulnerable(s: Shapes) -> DataFrame:
    k = F.col("sector")
    d = s.sectors().select("sector", F.col("pop").alias("est_populacao"), (F.col("pop") / (F.col("area") / 1e6)).alias("densidade_pop"), ((k % 10) / 20.0).alias("pop_variacao_rel"), (1 + k % 7).cast("double").alias("elevation_std"), ((k % 6) / 10.0).alias("compacidade"))
    return PO.vulnerability(d)


@query("vulnerability", "sector indice_vulnerabilidade:9 categoria_vulnerabilidade", f"SELECT sector, v AS indice_vulnerabilidade, {_bins('v', 'fifths')} AS categoria_vulnerabilidade FROM (SELECT sector, vr * 0.3 + ir * 0.3 + ia * 0.4 AS v FROM ({_VUL}))")
def vulnerability(s: Shapes):
    return _vulnerable(s)


@query("evacuation_priority", "sector indice_prioridade_evacuacao:9 categoria_prioridade top_prioridade", f"""SELECT sector, p AS indice_prioridade_evacuacao, {_bins('p', 'fifths')} AS categoria_prioridade, row_number() OVER (ORDER BY p DESC, sector) <= floor(count(*) OVER () * 0.1) AS top_prioridade FROM (SELECT sector, pop / area / max(pop / area) OVER () * 0.25 + pop / max(pop) OVER () * 0.25 + (vr * 0.3 + ir * 0.3 + ia * 0.4) * 0.5 AS p FROM ({_VUL}))""")
def evacuation_priority(s: Shapes):
    return PO.evacuation_priority(cut_lineage(_vulnerable(s)), "sector")


# ---- flood exposure ------------------------------------------------------------------------------------------------

_OV = "(least(b.x1, z.x1) - greatest(b.x0, z.x0)) * (least(b.y1, z.y1) - greatest(b.y0, z.y0))"
_OVJ = "b.x0 < z.x1 AND z.x0 < b.x1 AND b.y0 < z.y1 AND z.y0 < b.y1"
_AFF = f"""SELECT s.sector, s.area, s.pop, coalesce(a1, 0) AS a1, coalesce(a2, 0) AS a2, coalesce(a3, 0) AS a3 FROM v_sectors s LEFT JOIN (SELECT sector, sum({_OV}) FILTER (level = 1) AS a1, sum({_OV}) FILTER (level = 2) AS a2, sum({_OV}) FILTER (level = 3) AS a3 FROM v_sectors b JOIN v_zones z ON {_OVJ} GROUP BY sector) o ON o.sector = s.sector"""


def _affected(s: Shapes) -> DataFrame:
    p = S.overlap_pairs(s.sectors().select("sector", "ring", *S.BOX), s.zones().select("zone", "level", "ring", *S.BOX), 1000.0)
    o = p.select(F.col("l_sector").alias("sector"), F.col("r_level").alias("level"), "overlap")
    return H.affected_population(o, s.sectors(), "sector", "level", "area", "pop")


@query("affected_population", "sector area_risco_alto_km2:7 pop_risco_medio:4 pop_risco_total:4 pct_area_risco:6 pct_pop_risco:6 nivel_risco_predominante", f"SELECT sector, a3 / 1e6 AS area_risco_alto_km2, pop * a2 / area AS pop_risco_medio, pop * (a1 + a2 + a3) / area AS pop_risco_total, (a1 + a2 + a3) / area * 100 AS pct_area_risco, (a1 + a2 + a3) / area * 100 AS pct_pop_risco, CASE WHEN a3 > 0 THEN 'Risco Alto' WHEN a2 > 0 THEN 'Risco Médio' WHEN a1 > 0 THEN 'Risco Baixo' ELSE 'Sem risco' END AS nivel_risco_predominante FROM ({_AFF})")
def affected_population(s: Shapes):
    return _affected(s)


@query("population_at_risk_totals", "pop_total pop_risco_total:3 pop_risco_alto:3 area_risco_alto_km2:6", f"SELECT sum(pop) AS pop_total, sum(pop * (a1 + a2 + a3) / area) AS pop_risco_total, sum(pop * a3 / area) AS pop_risco_alto, sum(a3) / 1e6 AS area_risco_alto_km2 FROM ({_AFF})")
def population_at_risk_totals(s: Shapes):
    return H.population_at_risk_totals(_affected(s), "pop")


_RISK = "SELECT b.id, b.x, b.y, CAST(coalesce(max(z.level), 0) AS INTEGER) AS r FROM v_bld b LEFT JOIN v_zones z ON b.x0 <= z.x1 AND z.x0 <= b.x1 AND b.y0 <= z.y1 AND z.y0 <= b.y1 GROUP BY ALL"


def _risky(s: Shapes) -> DataFrame:
    names = F.when(F.col("r_level") == 1, "Risco Baixo").when(F.col("r_level") == 2, "Risco Médio").otherwise("Risco Alto")
    h = S.spatial_pairs(s.buildings().select("id", "rings", *S.BOX), s.zones(), 500.0, S.polygons_meet()).select(F.col("l_id").alias("id"), F.col("r_level").alias("level"), names.alias("description"))
    return H.assign_risk(s.buildings(), h, "id")


@query("assign_risk", "id risco_inundacao nivel_risco", f"SELECT id, r AS risco_inundacao, (['Sem risco', 'Risco Baixo', 'Risco Médio', 'Risco Alto'])[r + 1] AS nivel_risco FROM ({_RISK})")
def assign_risk(s: Shapes):
    return _risky(s)


_SBR = f"SELECT s.sector, s.area, count(b.id) AS t, count(b.id) FILTER (r > 0) AS k FROM v_sectors s LEFT JOIN ({_RISK}) b ON b.x > s.x0 AND b.x < s.x1 AND b.y > s.y0 AND b.y < s.y1 GROUP BY ALL"


def _sector_risk(s: Shapes, sectors: DataFrame) -> DataFrame:
    pts = S.point_box(_risky(s).select("id", "x", "y", "risco_inundacao"))
    inside = S.spatial_pairs(pts, s.sectors(), 2002.0, S.point_within()).select(F.col("r_sector").alias("sector"), F.col("l_risco_inundacao").alias("risco_inundacao"))
    return H.sector_building_risk(sectors, inside, "sector", "area")


@query("sector_building_risk", "sector total_edificacoes edificacoes_em_risco dens_edif_risco:6 pct_edif_risco:6", f"SELECT sector, t AS total_edificacoes, k AS edificacoes_em_risco, k / (area / 1e6) AS dens_edif_risco, CASE WHEN t > 0 THEN k / t * 100 ELSE 0 END AS pct_edif_risco FROM ({_SBR})")
def sector_building_risk(s: Shapes):
    return _sector_risk(s, s.sectors())


@query("integrated_flood_risk", "sector indice_risco_integrado:6 categoria_risco", f"""WITH a AS (SELECT sector, (a1 + a2 + a3) / area * 100 AS p FROM ({_AFF})), b AS (SELECT sector, CASE WHEN t > 0 THEN k / t * 100 ELSE 0 END AS e FROM ({_SBR})), c AS (SELECT sector, 70 * p / max(p) OVER () + 30 * e / max(e) OVER () AS v FROM a JOIN b USING (sector))
--final
SELECT sector, v AS indice_risco_integrado, {_bins('round(v, 9)', 'flood_index')} AS categoria_risco FROM c""")
def integrated_flood_risk(s: Shapes):
    d = H.integrated_flood_risk(cut_lineage(_sector_risk(s, _affected(s))))
    return d.withColumn("categoria_risco", PO.named_bin(F.round("indice_risco_integrado", 9), "flood_index"))


# ---- whole layers ------------------------------------------------------------------------------------------------


@query("prepare_roads", "road length_km:7 sinuosity:7 road_class", f"SELECT r.road, len / 1000 AS length_km, len / nullif(sqrt((c[len(c)].x - c[1].x) ** 2 + (c[len(c)].y - c[1].y) ** 2), 0) AS sinuosity, {_case('r.highway', L.ROAD_CLASS, 'other')} AS road_class FROM v_roads r JOIN v_roadlen USING (road)")
def prepare_roads(s: Shapes):
    return PR.prepare_roads(s.roads().withColumnRenamed("highway", " Highway"), "road")


@query("prepare_railways", "road electrified operator gauge_mm length_km:7", "SELECT road, CASE WHEN road % 2 = 0 THEN 'contact_line' ELSE 'unknown' END AS electrified, CASE WHEN road % 3 = 0 THEN 'ALL' END AS operator, 1000.0::DOUBLE AS gauge_mm, len / 1000 AS length_km FROM v_roadlen")
def prepare_railways(s: Shapes):
    k = F.col("road")
    tags = F.concat_ws(",", F.lit('"gauge"=>"1000"'), F.when(k % 2 == 0, F.lit('"electrified"=>"contact_line"')), F.when(k % 3 == 0, F.lit('"operator"=>"ALL"')))
    return PR.prepare_railways(s.roads().withColumn("other_tags", tags), "road")


@query("prepare_buildings", "id area_m2 compactness_index:8 height levels building_class", f"SELECT id, area AS area_m2, 4 * pi() * area / perimeter ** 2 AS compactness_index, CASE WHEN id % 2 = 0 THEN 7.5 END::DOUBLE AS height, CASE WHEN id % 3 = 0 THEN 2 END::DOUBLE AS levels, {_case('kind', L.BUILDING_CLASS, 'unclassified')} AS building_class FROM v_bld")
def prepare_buildings(s: Shapes):
    k = F.col("id")
    tags = F.concat_ws(",", F.when(k % 2 == 0, F.lit('"height"=>"7.5 m"')), F.when(k % 3 == 0, F.lit('"building:levels"=>"2"')))
    return PR.prepare_buildings(s.buildings().select("id", F.col("kind").alias("building"), tags.alias("other_tags"), "ring"), "id")


@query("prepare_landuse", "zone area_km2:8 perimeter_km:6 compactness:8 land_category", f"SELECT zone, area / 1e6 AS area_km2, perimeter / 1000 AS perimeter_km, 4 * pi() * area / perimeter ** 2 AS compactness, {_case('landuse', L.LAND_CATEGORY, 'other')} AS land_category FROM v_zones WHERE landuse <> 'x' AND x0 <= 6000 AND y0 <= 6000")
def prepare_landuse(s: Shapes):
    aoi = s.spark.range(1).select(F.array(G.rectangle(F.lit(0.0), F.lit(0.0), F.lit(6000.0), F.lit(6000.0))).alias("rings")).withColumns({"minx": F.lit(0.0), "miny": F.lit(0.0), "maxx": F.lit(6000.0), "maxy": F.lit(6000.0)})
    return PR.prepare_landuse(s.zones().select("zone", "landuse", "ring"), "zone", aoi=aoi)


@query("prepare_natural", "zone type area_ha:6 shape_index:8 ecological_importance", "SELECT zone, CASE WHEN landuse IN ('forest', 'park') THEN landuse ELSE 'other' END AS type, a AS area_ha, si AS shape_index, CASE WHEN a > 100 AND si < 1.5 THEN 'very_high' WHEN a > 100 OR si < 1.5 THEN 'high' WHEN a > 10 AND si < 2 THEN 'medium' WHEN a > 1 THEN 'low' ELSE 'very_low' END AS ecological_importance FROM (SELECT *, area / 10000 AS a, perimeter / (2 * sqrt(pi() * area)) AS si FROM v_zones)")
def prepare_natural(s: Shapes):
    return PR.prepare_natural(s.zones().select(F.col("zone").alias("Zone"), F.col("landuse").alias("natural"), "ring"), "zone")


@query("prepare_hydro", "layer features status", "SELECT 'curso_dagua' AS layer, count(*) AS features, 'ok' AS status FROM v_roads UNION ALL SELECT 'ponto_drenagem', 0, 'empty'")
def prepare_hydro(s: Shapes):
    return PR.hydro_report(PR.prepare_hydro({"curso_dagua": s.roads(), "ponto_drenagem": s.stations().where(F.lit(False))}))


@query("prepare_census", "CD_SETOR AREA_KM2:6 PERIMETER_KM:6 COMPACTNESS:8 DENS_POP:6", "SELECT CAST(sector AS VARCHAR) AS CD_SETOR, area / 1e6 AS AREA_KM2, 8.008 AS PERIMETER_KM, 4 * pi() * (area / 1e6) / 8.008 ** 2 AS COMPACTNESS, pop / (area / 1e6) AS DENS_POP FROM v_sectors")
def prepare_census(s: Shapes):
    return PR.prepare_census(s.sectors().select(F.col("sector").cast("string").alias("CD_GEOCODI"), F.col("pop").alias("POP"), "ring"))


@query("prepare_weather", "date n temperature_c:6 wind", "SELECT CAST(ts AS DATE) AS date, count(*) AS n, sum(temp) AS temperature_c, count(*) FILTER (wind_speed * 5 <= 100) AS wind FROM v_weather GROUP BY 1")
def prepare_weather(s: Shapes):
    w = s.weather().select(F.to_date("ts").cast("string").alias("DATA (YYYY-MM-DD)"), F.regexp_replace(F.col("temp").cast("string"), r"\.", ",").alias("TEMPERATURA DO AR - BULBO SECO, HORARIA (°C)"), (F.col("wind_speed") * 5).alias("VENTO, VELOCIDADE HORARIA (m/s)"))
    p = PR.prepare_weather(w)
    return p.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("temperature_c").alias("temperature_c"), F.count("wind_speed_ms").alias("wind"))


@query("prepare_telecom", "erb GanhoAntena GanhoAntena_imputado coord_valida", "SELECT erb, CASE WHEN erb % 4 = 0 THEN (SELECT median(gain) FROM v_stations WHERE erb % 4 <> 0) ELSE gain END AS GanhoAntena, erb % 4 = 0 AS GanhoAntena_imputado, NOT (x / 100 - 90 < -33 OR x / 100 - 90 > 5 OR y / 100 - 100 < -74 OR y / 100 - 100 > -34) AS coord_valida FROM v_stations")
def prepare_telecom(s: Shapes):
    d = s.stations().select("erb", F.when(F.col("erb") % 4 != 0, F.col("gain")).alias("GanhoAntena"), F.regexp_replace(F.col("watts").cast("string"), r"\.", ",").alias("PotenciaTransmissorWatts"),
                            (F.col("x") / 100 - 90).alias("Latitude"), (F.col("y") / 100 - 100).alias("Longitude"), F.lit("2020-01-01").alias("DataValidade"))
    return PR.prepare_telecom(d)


@query("building_shape", "id area compactness_index:8 shape_complexity:8 elongation:8", "SELECT id, area, 4 * pi() * area / perimeter ** 2 AS compactness_index, 1.0 AS shape_complexity, greatest(w, h) / least(w, h) AS elongation FROM v_bld")
def building_shape(s: Shapes):
    return EN.building_shape(s.buildings().select("id", "ring", "height"))


@query("enrich_roads", "road length:6 slope_class road_class", f"SELECT road, len AS length, 'x' AS slope_class, {_case('highway', L.ROAD_CLASS_ENRICHED, 'Local')} AS road_class FROM v_roadlen")
def enrich_roads(s: Shapes):
    d = EN.enrich_roads(s.roads(), "road", s.cells(), AFFINE)
    ok = F.col("betweenness").isNotNull() & (F.col("connectivity") >= 2) & F.col("slope_class").isNotNull()
    return d.withColumn("slope_class", F.when(ok, "x"))


@query("enrich_landuse", "zone land_category size_category compactness_category elevation_category slope_category aspect_direction", f"""WITH e AS (SELECT zone, max(value) - min(value) AS span FROM ({_ZC}) GROUP BY zone), g AS (SELECT zone, avg(s) AS s, avg(a) AS a FROM v_zones z JOIN (SELECT "row", col, degrees(atan(sqrt(g_row * g_row + g_col * g_col))) AS s, (degrees(atan2(-g_row, g_col)) + 360) % 360 AS a FROM ({_GRAD})) ON {_CX} > x0 AND {_CX} < x1 AND {_CY} > y0 AND {_CY} < y1 GROUP BY zone)
--final
SELECT zone, {_words('landuse', L.LAND_KEYWORDS, 'unknown', 'other')} AS land_category, {_bins('area / 1e6', 'land_size')} AS size_category, {_bins('least(1, 4 * pi() * area / perimeter ** 2)', 'compactness')} AS compactness_category, {_bins('span', 'elevation_range')} AS elevation_category, {_bins('g.s', 'land_slope')} AS slope_category,
    CASE WHEN a IS NULL THEN 'Indefinido' WHEN a < 22.5 OR a >= 337.5 THEN 'Norte' WHEN a < 67.5 THEN 'Nordeste' WHEN a < 112.5 THEN 'Leste' WHEN a < 157.5 THEN 'Sudeste' WHEN a < 202.5 THEN 'Sul' WHEN a < 247.5 THEN 'Sudoeste' WHEN a < 292.5 THEN 'Oeste' ELSE 'Noroeste' END AS aspect_direction FROM v_zones LEFT JOIN e USING (zone) LEFT JOIN g USING (zone)""")
def enrich_landuse(s: Shapes):
    return EN.enrich_landuse(s.zones().select("zone", "landuse", "ring"), "zone", s.cells(), AFFINE, 500.0)


@query("enrich_natural", "zone relief_class ecological_protection_category", f"""{_NATURE}
--final
SELECT v_zones.zone, {_bins('(b - a)', 'relief')} AS relief_class, {_bins('coalesce(epi, 0)', 'eco')} AS ecological_protection_category FROM v_zones LEFT JOIN r ON r.zone = v_zones.zone""")
def enrich_natural(s: Shapes):
    return EN.enrich_natural(s.zones().select("zone", "ring"), "zone", s.cells(), AFFINE, 500.0)


@query("enrich_census", "sector categoria_tamanho tipo_area categoria_vulnerabilidade categoria_prioridade top_prioridade")
def enrich_census(s: Shapes):
    return EN.enrich_census(s.sectors().select("sector", "pop", "ring"), "sector", s.cells(), AFFINE, 2000.0, "pop")


@query("enrich_buildings", "id height levels cluster_id road_accessibility urban_typology centrality_class")
def enrich_buildings(s: Shapes):
    b = s.buildings().select("id", "ring", F.col("kind").alias("building"), F.col("height"), F.lit(None).cast("double").alias("levels"), F.lit(None).cast("string").alias("other_tags"))
    return EN.enrich_buildings(b, "id", s.roads(), "road", s.cells(), AFFINE)


@query("enrich_railways", "road railway_class nivel_importancia")
def enrich_railways(s: Shapes):
    k = F.col("street")
    tags = F.concat_ws(",", F.when(k % 2 == 0, F.lit('"usage"=>"main"')), F.when(k % 3 == 0, F.lit('"service"=>"yard"')))
    d = EN.enrich_railways(s.street_lines().withColumn("other_tags", tags), "street")
    return d.withColumnRenamed("street", "road")


@query("enrich_hydro", "layer n")
def enrich_hydro(s: Shapes):
    r = s.reaches()
    a = G.point(Shapes._x(F.col("src")), Shapes._y(F.col("src")))
    b = G.point(Shapes._x(F.col("dst")), Shapes._y(F.col("dst")))
    out = EN.enrich_hydro(r.select("reach", "strahler", F.array(a, b).alias("coords")), "reach", s.zones().select("zone", "ring"), "zone", s.cells(), AFFINE, 500.0)
    key = {"trecho_drenagem": "erosion_potential", "area_drenagem": "moisture_potential", "nodes": "type"}
    return reduce(DataFrame.unionByName, [d.agg(F.count(key[n]).alias("n")).select(F.lit(n).alias("layer"), "n") for n, d in out.items()])


@query("enrich_telecom", "layer n")
def enrich_telecom(s: Shapes):
    out = EN.enrich_telecom(s.stations(), "erb", "operator", hex_size=1500.0)
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("layer"), "n") for n, d in out.items()])


@query("quick_enrich_all", "layer n area:4", """SELECT 'buildings' AS layer, count(*) AS n, sum(area) AS area FROM v_bld UNION ALL SELECT 'landuse', count(*), sum(area) FROM v_zones UNION ALL SELECT 'roads', count(*), sum(len) FROM v_roadlen UNION ALL SELECT 'natural', count(*), sum(area) FROM v_zones""")
def quick_enrich_all(s: Shapes):
    out = EN.quick_enrich_all(s.buildings().select("id", "ring", F.col("kind").alias("building")), s.zones().select("zone", "ring", "landuse"), s.roads(), s.zones().select("zone", "ring"))
    size = {"buildings": F.col("area_m2"), "landuse": F.col("area_km2") * 1e6, "roads": F.col("length_km") * 1000, "natural": F.col("area_km2") * 1e6}
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("n"), F.sum(size[n]).alias("area")).select(F.lit(n).alias("layer"), "n", "area") for n, d in out.items()])


@query("road_features", "road length_category sinuosity_category road_category speed_kmh", f"""SELECT road, {_bins('len', 'road_length', left=True)} AS length_category, coalesce({_bins('coalesce(len / nullif(d, 0), 1e9)', 'road_sinuosity', left=True)}, 'desconhecido') AS sinuosity_category, {_case('highway', L.ROAD_CATEGORY, 'other')} AS road_category,
    CAST(CASE {_case('highway', L.ROAD_CATEGORY, 'other')} WHEN 'motorway' THEN 100 WHEN 'primary' THEN 60 WHEN 'secondary' THEN 50 WHEN 'tertiary' THEN 40 WHEN 'residential' THEN 30 ELSE 20 END AS INTEGER) AS speed_kmh FROM (SELECT r.road, r.highway, len, sqrt((c[len(c)].x - c[1].x) ** 2 + (c[len(c)].y - c[1].y) ** 2) AS d FROM v_roads r JOIN v_roadlen USING (road))""")
def road_features(s: Shapes):
    return EN.road_features(s.roads())


@query("prepare_road_graph", "node degree:9 betweenness:9 closeness:9 split")
def prepare_road_graph(s: Shapes):
    nodes, _ = EN.prepare_road_graph(s.street_lines(), "street", 1.0)
    return nodes


@query("layer_catalog_sectors", "column type rows non_null distinct_values", """SELECT 'sector' AS "column", 'int' AS type, count(*) AS rows, count(*) AS non_null, count(DISTINCT sector) AS distinct_values FROM v_sectors UNION ALL SELECT 'pop', 'double', count(*), count(*), count(DISTINCT pop) FROM v_sectors""")
def layer_catalog_sectors(s: Shapes):
    return P.layer_catalog(s.sectors().select("sector", "pop"))
