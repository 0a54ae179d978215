"""Hand-computed micro cases for geometry, projections and classification."""

import math

import pytest
from pyspark.sql import functions as F

from urbanloom.functions import classify as C
from urbanloom.functions import crs
from urbanloom.functions import formulas as FM
from urbanloom.functions import geometry as G
from urbanloom.functions import tags


def line(*pts):
    return F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in pts])


def values(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_lines(spark):
    a = line((0, 0), (3, 4), (3, 0))
    loop = line((0, 0), (1, 0), (0, 0))
    r = values(
        spark, length=G.line_length(a), sin=G.sinuosity(a), null=G.sinuosity(loop), one=G.sinuosity(loop, "one"),
        inf=G.sinuosity(loop, "inf"), zero=G.sinuosity(loop, "zero"), curv=G.curvature(line((0, 0), (1, 0), (1, 1))),
        east=G.bearing(line((0, 0), (1, 0))), south=G.bearing(line((0, 0), (0, -1))),
    )
    assert (r.length, r.sin, r.null, r.one, r.inf, r.zero) == (9.0, 3.0, None, 1.0, math.inf, 0.0)
    assert r.curv == pytest.approx(math.pi / 4)
    assert (r.east, r.south) == (90.0, 180.0)


def test_square(spark):
    sq = G.rectangle(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(4.0))
    other = G.rectangle(F.lit(2.0), F.lit(2.0), F.lit(6.0), F.lit(6.0))
    rings = F.array(sq)
    r = values(
        spark, area=G.ring_area(sq), per=G.line_length(sq), comp=G.compactness(G.ring_area(sq), G.line_length(sq)),
        shape=G.shape_index(G.ring_area(sq), G.line_length(sq)), inside=G.point_in_polygon(F.lit(1.0), F.lit(1.0), rings),
        out=G.point_in_polygon(F.lit(5.0), F.lit(1.0), rings), edge=G.point_in_polygon(F.lit(4.0), F.lit(1.0), rings),
        touch=G.point_in_polygon(F.lit(4.0), F.lit(1.0), rings, True), overlap=G.overlap_area(sq, other),
    )
    assert (r.area, r.per, r.overlap) == (16.0, 16.0, 4.0)
    assert r.comp == pytest.approx(math.pi / 4)
    assert r.shape == pytest.approx(1.128379, abs=1e-6)
    assert (r.inside, r.out, r.edge, r.touch) == (True, False, False, True)


def test_concave_clip(spark):
    ell = line((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0))
    box = G.rectangle(F.lit(0.5), F.lit(0.5), F.lit(5.0), F.lit(5.0))
    assert values(spark, a=G.overlap_area(ell, box)).a == pytest.approx(0.5 * 3.5 + 0.5 * 3.0)


def test_utm(spark):
    # on the central meridian the easting is the false easting; one degree of meridian arc is known
    p = crs.to_utm(F.lit(-45.0), F.lit(-23.0))
    e = crs.to_utm(F.lit(-45.0), F.lit(0.0))
    back = crs.from_utm(p["x"], p["y"])
    r = values(spark, x=p["x"], y=p["y"], y0=e["y"], lon=back["x"], lat=back["y"])
    assert r.x == pytest.approx(500000.0, abs=1e-6)
    assert r.y0 == pytest.approx(10_000_000.0, abs=1e-6)
    # meridian arc from the equator to 23 degrees on GRS80, scaled by 0.9996
    arc = _meridian_arc(math.radians(23.0))
    assert 10_000_000.0 - r.y == pytest.approx(0.9996 * arc, abs=1e-3)
    assert (r.lon, r.lat) == (pytest.approx(-45.0, abs=1e-10), pytest.approx(-23.0, abs=1e-10))


def _meridian_arc(phi, steps=20000):
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    h = phi / steps
    f0 = lambda t: a * (1 - e2) / (1 - e2 * math.sin(t) ** 2) ** 1.5
    return h / 3 * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * f0(i * h) for i in range(steps + 1))


def test_bins(spark):
    d = spark.createDataFrame([(0.0,), (3.0,), (4.0,), (16.0,)], "v double")
    got = [r[0] for r in d.select(C.named_bin("v", "telecom_area")).collect()]
    assert got == [None, "RURAL", "SUBURBANA", "URBANA_DENSA"]
    d = spark.createDataFrame([(50.0,), (49.9,), (None,)], "v double")
    assert [r[0] for r in d.select(C.named_bin("v", "road_length", "left")).collect()] == ["curto", "muito_curto", "desconhecido"]


def test_tags_and_heights(spark):
    t = F.lit('"height"=>"12 m","building:levels"=>"3"')
    none = F.lit(None).cast("string")
    num = F.lit(None).cast("double")
    h1, l1 = tags.fill_height_levels(num, F.lit(3.0), none, F.lit("yes"))
    h2, l2 = tags.fill_height_levels(F.lit(10.0), num, none, F.lit("yes"))
    h3, l3 = tags.fill_height_levels(num, num, none, F.lit("house"))
    h4, l4 = tags.fill_height_levels(num, num, none, F.lit("yes"))
    r = values(spark, h=tags.height_from_tags(t), lv=tags.levels_from_tags(t), h1=h1, l2=l2, h3=h3, l3=l3, h4=h4, l4=l4, l1=l1, h2=h2)
    assert (r.h, r.lv, r.h1, r.l2, r.h3, r.l3, r.h4, r.l4) == (12.0, 3.0, 9.0, 4.0, 4.0, 1.0, 3.0, 1.0)


def test_formulas(spark):
    r = values(spark, e=FM.eirp_dbm(F.lit(20.0), F.lit(17.0)))
    assert r.e == pytest.approx(60.0103, abs=1e-4)


def test_seasons(spark):
    d = spark.createDataFrame([("2024-01-05",), ("2024-03-20",), ("2024-07-01",), ("2024-10-01",), ("2024-12-25",)], "d string").select(F.to_date("d").alias("d"))
    got = [tuple(r) for r in d.select(C.season_south("d"), C.season_south("d", "reference")).collect()]
    assert [g[0] for g in got] == ["Verão", "Outono", "Inverno", "Primavera", "Verão"]
    assert got[-1][1] == "Primavera"
