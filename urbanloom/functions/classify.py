"""Class maps, bins, ordered conditions and normalisation expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L
from .geometry import _c


def map_class(col, mapping: Mapping, default=None, lower: bool = False) -> Column:
    """Dictionary lookup with a default for missing keys and NULL input."""
    key = F.lower(_c(col)) if lower else _c(col)
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    hit = F.try_element_at(table, key)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def contains_any(col: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def map_by_substring(col, words: Mapping[str, Sequence[str]], null="unknown", default="other") -> Column:
    """First category one of whose words occurs in the lower-cased value."""
    text = F.lower(_c(col).cast("string"))
    out = F.when(text.isNull() | (text == ""), F.lit(null))
    for label, ws in words.items():
        out = out.when(contains_any(text, ws), F.lit(label))
    return out.otherwise(F.lit(default))


def _bins(col, edges, labels, lower_open: bool, include_lowest: bool) -> Column:
    c = _c(col)
    out = None
    for i, label in enumerate(labels):
        a, b = float(edges[i]), float(edges[i + 1])
        if lower_open:
            low = c >= a if (include_lowest and i == 0) else c > a
            cond = low & (c <= b)
        else:
            cond = (c >= a) & (c < b)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def bin_right(col, edges, labels) -> Column:
    """(a, b] intervals; the lowest edge itself and anything outside give NULL."""
    return _bins(col, edges, labels, True, False)


def bin_right_incl(col, edges, labels) -> Column:
    """(a, b] intervals with the lowest edge included."""
    return _bins(col, edges, labels, True, True)


def bin_left(col, edges, labels, missing: str | None = "desconhecido") -> Column:
    """[a, b) intervals; NULL becomes ``missing``."""
    out = _bins(col, edges, labels, False, False)
    return out if missing is None else F.coalesce(out, F.lit(missing))


def named_bin(col, name: str, how: str = "right") -> Column:
    edges, labels = L.BINS[name]
    return {"right": bin_right, "incl": bin_right_incl, "left": bin_left}[how](col, edges, labels)


def select_first(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the first true condition."""
    out = None
    for cond, label in rules:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def ladder(col, cuts: Sequence[float], labels: Sequence[str], closed: str = "lt") -> Column:
    """Threshold ladder: below (lt) or up to (le) each cut, last label above all cuts."""
    c = _c(col)
    out = None
    for cut, label in zip(cuts, labels):
        cond = c < cut if closed == "lt" else c <= cut
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def score_class(score) -> Column:
    """Railway importance level."""
    return ladder(score, [0.2, 0.4, 0.6, 0.8], ["Baixa", "Média-Baixa", "Média", "Alta", "Crítica"])


def drainage_quality(density) -> Column:
    c = _c(density)
    return (
        F.when(c <= 0.5, 0.2).when(c <= 1.5, 0.4).when(c <= 2.5, 0.6).when(c <= 3.5, 0.8).otherwise(1.0)
    )


def app_zone(distance) -> Column:
    """Protected-strip class of a distance to water."""
    return ladder(
        distance,
        [30, 50, 100, 200, 500],
        ["APP 30m (córregos até 10m)", "APP 50m (rios 10-50m)", "APP 100m (rios 50-200m)",
         "APP 200m (rios 200-600m)", "APP 500m (rios >600m)", "Fora de APP"],
        closed="le",
    )


def aspect_direction(deg) -> Column:
    c = _c(deg)
    names = ["Nordeste", "Leste", "Sudeste", "Sul", "Sudoeste", "Oeste"]
    out = F.when(c.isNull(), F.lit("Indefinido")).when((c < 22.5) | (c >= 337.5), F.lit("Norte"))
    for i, n in enumerate(names):
        out = out.when(c < 67.5 + 45 * i, F.lit(n))
    return out.otherwise(F.lit("Noroeste"))


def season_south(date, mode: str = "astronomical") -> Column:
    """Southern-hemisphere season; ``reference`` keeps late December in spring."""
    d = _c(date)
    md = F.month(d) * 100 + F.dayofmonth(d)
    out = F.when(md >= 1222, F.lit("Verão")) if mode == "astronomical" else F.when(F.lit(False), F.lit("Verão"))
    return (
        out.when(md >= 923, F.lit("Primavera")).when(md >= 621, F.lit("Inverno"))
        .when(md >= 320, F.lit("Outono")).otherwise(F.lit("Verão"))
    )


def railway_class(usage, service) -> Column:
    u, s = _c(usage), _c(service)
    return (
        F.when(u == "main", "principal").when(u == "branch", "ramal").when(s == "yard", "pátio")
        .when(s == "siding", "desvio").when(s.isNotNull(), "serviço").otherwise("outro")
    )


def simple_building_class(col) -> Column:
    c = _c(col)
    return select_first(
        [
            (c.isNull(), "unknown"),
            (c.isin("house", "residential", "apartments", "detached"), "residential"),
            (c.isin("commercial", "retail", "office", "supermarket"), "commercial"),
            (c.isin("industrial", "warehouse", "factory"), "industrial"),
            (c.isin("school", "university", "college", "kindergarten"), "education"),
            (c.isin("hospital", "clinic", "healthcare"), "healthcare"),
        ],
        "other",
    )


def simple_landuse_class(col) -> Column:
    c = _c(col)
    return select_first(
        [
            (c.isNull(), "unknown"),
            (c.isin("residential", "apartment"), "residential"),
            (c.isin("retail", "commercial"), "commercial"),
            (c.isin("industrial", "warehouse"), "industrial"),
            (c.isin("education", "university", "school"), "education"),
            (c.isin("forest", "grass", "meadow", "park"), "green_area"),
            (c.isin("farmland", "farm", "farmyard"), "agricultural"),
        ],
        "other",
    )


def simple_road_class(col) -> Column:
    c = _c(col)
    return select_first(
        [
            (c.isin("motorway", "trunk", "primary"), "primary"),
            (c == "secondary", "secondary"),
            (c == "tertiary", "tertiary"),
            (c.isin("residential", "living_street"), "residential"),
            (c.isin("service", "track"), "service"),
        ],
        "other",
    )


def impervious_pct(landuse_class) -> Column:
    fixed = {"residential": 70.0, "commercial": 90.0, "industrial": 80.0, "green_area": 10.0, "agricultural": 20.0}
    return map_class(landuse_class, fixed, 50.0)


def ecological_importance(area_ha, shape) -> Column:
    a, s = _c(area_ha), _c(shape)
    return select_first(
        [
            ((a > 100) & (s < 1.5), "very_high"),
            ((a > 100) | (s < 1.5), "high"),
            ((a > 10) & (s < 2.0), "medium"),
            (a > 1, "low"),
        ],
        "very_low",
    )


def basin_age(hi) -> Column:
    c = _c(hi)
    return select_first(
        [(c < 0.35, "Antiga/Plana"), ((c >= 0.35) & (c <= 0.6), "Madura/Equilibrada"), (c > 0.6, "Jovem/Montanhosa")],
        "Indeterminada",
    )


def riparian_zone(distance) -> Column:
    c = _c(distance)
    return select_first(
        [
            (c <= 30, "Zona Ripária Imediata"),
            (c <= 100, "Zona Ripária Próxima"),
            (c <= 200, "Zona Ripária Estendida"),
            (c > 200, "Fora da Zona Ripária"),
        ],
        "Indeterminado",
    )


def cluster_class(kind, density, diversity) -> Column:
    k, d, v = _c(kind), _c(density), _c(diversity)
    home, trade = k.isin("house", "residential"), k.isin("commercial", "retail", "office")
    return select_first(
        [
            (home & (d < 0.3), "Residencial de baixa densidade"),
            (home & (d < 0.6), "Residencial de média densidade"),
            (home & (d >= 0.6), "Residencial de alta densidade"),
            ((k == "apartments") & (d > 0.4), "Conjunto de apartamentos"),
            (trade & (v > 0.5), "Centro comercial misto"),
            (trade, "Área comercial especializada"),
            (k == "industrial", "Área industrial"),
            (k.isin("school", "university"), "Complexo educacional"),
            (k == "hospital", "Complexo de saúde"),
            (v > 0.7, "Área de uso misto"),
        ],
        "Agrupamento genérico",
    )


_FIVE = ["Muito baixa", "Baixa", "Média", "Alta", "Muito alta"]


def five_steps(col, cuts: Sequence[float], labels=_FIVE, default="Indeterminada") -> Column:
    c = _c(col)
    rules = [(c < k, n) for k, n in zip(cuts, labels)] + [(c >= cuts[-1], labels[-1])]
    return select_first(rules, default)


def urban_typology(count, bcr, density) -> Column:
    n, b, d = _c(count), _c(bcr), _c(density)
    return select_first(
        [
            (n == 0, "Não urbanizado"),
            (b < 0.1, "Espaço aberto"),
            ((b < 0.3) & (d < 5), "Suburbano de baixa densidade"),
            ((b < 0.3) & (d >= 5), "Residencial de média densidade"),
            ((b >= 0.3) & (b < 0.5), "Urbano de média densidade"),
            (b >= 0.5, "Urbano de alta densidade"),
        ],
        "Indeterminado",
    )


def urban_compactness(bcr, far) -> Column:
    b, f = _c(bcr), _c(far)
    rules = [((b < x) & (f < y), n) for x, y, n in zip((0.2, 0.4, 0.6, 0.8), (0.5, 1.0, 2.0, 4.0), _FIVE)]
    return select_first([*rules, ((b >= 0.8) | (f >= 4.0), _FIVE[-1])], "Indeterminada")


def encode_vulnerability(text) -> Column:
    t = F.lower(_c(text))
    return F.when(F.contains(t, F.lit("ideal")), 1).when(F.contains(t, F.lit("sem cobertura")), -1).otherwise(0)


def normalise_text(col, default: str = "unclassified") -> Column:
    t = F.trim(F.lower(_c(col).cast("string")))
    return F.when(t.isNull() | t.isin("nan", "none", "", "<na>", "null"), F.lit(default)).otherwise(t)


def minmax(col, low, high, constant: float = 0.0) -> Column:
    c, lo, hi = _c(col), _c(low), _c(high)
    return F.when(hi > lo, (c - lo) / (hi - lo)).otherwise(F.when(c.isNotNull(), F.lit(float(constant))))


def max_norm(col, high) -> Column:
    return F.when(_c(high) > 0, _c(col) / _c(high)).otherwise(F.lit(0.0))


def zscore(col, mean, sd) -> Column:
    return (_c(col) - _c(mean)) / F.when(_c(sd) == 0, F.lit(1.0)).otherwise(_c(sd))


def weighted_index(weights: Mapping[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [_c(k) * float(w) for k, w in weights.items()])


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def use_profile(col) -> Column:
    """Occupancy profile of a use value: specific words, use category, prefix fallback, default."""
    t = F.lower(_c(col).cast("string"))
    out = F.when(t.isNull(), F.lit("default"))
    for table in (L.PROFILE_WORDS, L.USE_WORDS, L.PROFILE_FALLBACK):
        for label, words in table.items():
            out = out.when(contains_any(t, words), F.lit(label))
    return out.otherwise(F.lit("default"))
