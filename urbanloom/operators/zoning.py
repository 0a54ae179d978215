"""Functional categories of buildings and their conformity with zoning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.classify import contains_any, map_class
from .profile import crosstab


def categorize_buildings(df: DataFrame, building: str = "building", amenity: str | None = "amenity", landuse: str | None = "landuse") -> DataFrame:
    """Category, subcategory and source: building tag, then amenity, then land use.

    A land-use category keeps its full path in ``categoria_funcional`` (no subcategory).
    """
    cols = set(df.columns)
    b = map_class(building, L.BUILDING_FUNCTION) if building in cols else F.lit(None).cast("string")
    a = map_class(amenity, L.AMENITY_FUNCTION) if amenity in cols else F.lit(None).cast("string")
    u = map_class(landuse, L.LANDUSE_FUNCTION, lower=True) if landuse in cols else F.lit(None).cast("string")
    path = F.coalesce(b, a)
    return df.withColumns({
        "categoria_funcional": F.coalesce(F.split_part(path, F.lit("."), F.lit(1)), u),
        "subcategoria_funcional": F.split_part(path, F.lit("."), F.lit(2)),
        "fonte_categoria": F.when(b.isNotNull(), "building").when(a.isNotNull(), "amenity").when(u.isNotNull(), "landuse"),
    })


def categorization_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("fonte_categoria", F.lit("uncategorized")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def finalize_class(df: DataFrame, existing: str | None = None, building: str = "building") -> DataFrame:
    """``category_sub``, existing class, ``unclassified_<building>``, ``other``."""
    cat, sub = F.col("categoria_funcional"), F.col("subcategoria_funcional")
    full = F.when(cat.isNotNull(), F.when(sub.isNotNull(), F.concat_ws("_", cat, sub)).otherwise(cat))
    own = F.col(existing) if existing else F.lit(None).cast("string")
    un = F.when(F.col(building).isNotNull(), F.concat(F.lit("unclassified_"), F.col(building)))
    return df.withColumn("building_class_enhanced", F.coalesce(full, own, un, F.lit("other")))


# --- fixed values: words expected in the class of each land use ------------------------------------
EXPECTED = {
    "residential": ["residencial"], "commercial": ["comercial"], "industrial": ["industrial"],
    "institutional": ["institucional"], "mixed": ["residencial_misto", "misto"],
}


def validate_categorization(df: DataFrame, building: str = "building", landuse: str = "landuse") -> DataFrame:
    """Share of rows whose class repeats the building tag, and of rows agreeing with their land use."""
    cls, b, u = F.lower("building_class_enhanced"), F.lower(building), F.lower(landuse)
    ok = reduce(lambda p, q: p | q, [F.contains(u, F.lit(k)) & contains_any(cls, ws) for k, ws in EXPECTED.items()])
    both = cls.isNotNull()
    return df.agg(
        F.avg(F.when(both & b.isNotNull(), F.contains(cls, b).cast("double"))).alias("building_match_rate"),
        F.avg(F.when(both & u.isNotNull(), ok.cast("double"))).alias("landuse_consistency_rate"),
    )


def categorization_coverage(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count("categoria_funcional").alias("categorized"),
        (F.count("categoria_funcional") / F.count(F.lit(1)) * 100).alias("percent"),
    )


def sample_per_class(df: DataFrame, cls: str, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """Up to n rows of every class in a repeatable random order (salted first, then merged)."""
    from pyspark.sql import Window

    h = df.withColumns({"_h": F.xxhash64(F.col(key), F.lit(seed)), "_s": F.pmod(F.xxhash64(F.col(key)), F.lit(64))})
    part = h.withColumn("_r", F.row_number().over(Window.partitionBy(cls, "_s").orderBy("_h", key))).where(F.col("_r") <= n)
    out = part.withColumn("_r", F.row_number().over(Window.partitionBy(cls).orderBy("_h", key))).where(F.col("_r") <= n)
    return out.drop("_h", "_s", "_r")


def zone_of(landuse) -> Column:
    """Zone of a land-use text: words contained in it, then texts contained in a word."""
    t = F.lower(F.col(landuse) if isinstance(landuse, str) else landuse)
    out = F.when(t.isNull(), F.lit(None).cast("string"))
    for zone, words in L.ZONE_WORDS.items():
        out = out.when(contains_any(t, words), F.lit(zone))
    for zone, words in L.ZONE_WORDS.items():
        out = out.when(reduce(lambda a, b: a | b, [F.contains(F.lit(w), t) for w in words]), F.lit(zone))
    return out


def zoning_conformity(df: DataFrame, landuse: str, cls: str = "building_class_enhanced") -> DataFrame:
    """Conformity, level and rule text: full class then main class, allowed before conditional before forbidden."""
    zone, c = F.col("_zone"), F.col(cls)
    main = F.when(F.contains(c, F.lit("_")), F.split_part(c, F.lit("_"), F.lit(1)))
    by_zone: dict[str, list[Column]] = {}
    for z, lv, prefixes in L.ZONING_RULES:
        rule = F.struct(F.lit(lv).alias("level"), F.array(*[F.lit(p) for p in prefixes]).alias("prefixes"))
        by_zone.setdefault(z, []).append(rule)
    table = F.create_map(*[x for z, rules in by_zone.items() for x in (F.lit(z), F.array(*rules))])

    def starts(text: Column, prefixes: Column) -> Column:
        return F.coalesce(F.exists(prefixes, lambda p: F.startswith(text, p)), F.lit(False))

    tried = F.transform(F.try_element_at(table, zone), lambda r: F.struct(
        r["level"].alias("level"), F.when(starts(c, r["prefixes"]), c).when(starts(main, r["prefixes"]), main).alias("used")))
    both = zone.isNotNull() & c.isNotNull()
    out = df.withColumn("_zone", zone_of(landuse)).withColumn("_hit", F.get(F.filter(tried, lambda r: r["used"].isNotNull()), 0))
    out = out.withColumns({
        "nivel_conformidade": F.when(both, F.coalesce("_hit.level", F.lit("desconhecido"))), "_used": F.col("_hit.used"),
    }).drop("_hit")
    lv = F.col("nivel_conformidade")
    status = F.when(lv.isin("permitido", "condicional"), "conforme").when(lv == "proibido", "não conforme").when(lv.isNotNull(), "não avaliado")
    rule = F.when(
        F.col("_used").isNotNull(),
        F.concat(F.lit("categoria funcional '"), F.col("_used"), F.lit("' é "), lv, F.lit(" em zona '"), zone, F.lit("'")),
    ).when(lv.isNotNull(), "sem regra aplicável definida")
    return out.withColumns({"conformidade_uso": status, "regra_aplicada": rule}).withColumnRenamed("_zone", "zona").drop("_used")


def conformity_indices(df: DataFrame, category: str = "categoria_funcional", zone: str = "zona") -> DataFrame:
    """Evaluated share, conforming and non-conforming share: overall, per category and per zone."""
    st = F.col("conformidade_uso")
    ok, bad = F.count_if(st == "conforme"), F.count_if(st == "não conforme")
    cut = df.groupingSets([[], [category], [zone]], category, zone).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("total"), ok.alias("conforme"), bad.alias("nao_conforme"),
    )
    scope = F.when(F.col("_g") == 3, "geral").when(F.col("_g") == 1, "categoria").otherwise("zona")
    key = F.when(F.col("_g") == 3, "geral").when(F.col("_g") == 1, F.col(category)).otherwise(F.col(zone))
    n = F.col("conforme") + F.col("nao_conforme")
    return cut.select(
        scope.alias("scope"), key.alias("key"), "total", "conforme", "nao_conforme",
        F.when(n > 0, F.col("conforme") / n).alias("indice_conformidade"), (n / F.col("total")).alias("cobertura"),
    )


def conformity_hotspots(df: DataFrame, category: str = "categoria_funcional", zone: str = "zona", k: int = 10) -> DataFrame:
    """Zone and category pairs with most non-conforming buildings."""
    bad = df.where(F.col("conformidade_uso") == "não conforme")
    return bad.groupBy(zone, category).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), zone, category).limit(k)


def zone_nonconformity_rates(df: DataFrame, zone: str = "zona", k: int = 5) -> DataFrame:
    g = df.where(F.col(zone).isNotNull()).groupBy(zone).agg(
        F.avg((F.col("conformidade_uso") == "não conforme").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n")
    )
    return g.orderBy(F.desc("rate"), zone).limit(k)


def conformity_crosstab(df: DataFrame, zone: str = "zona") -> DataFrame:
    return crosstab(df, zone, "conformidade_uso")
