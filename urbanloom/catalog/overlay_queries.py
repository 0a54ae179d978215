"""Concave polygons, holes and crossing rings: shared areas, clipped polygons and lines, repaired areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import overlay as O
from .registry import query
from .shapes import Shapes

_SHARED = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_CROSS = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"


@query("overlap_area_concave", "sector zone overlap:3", f"SELECT sector, zone, sum({_SHARED}) AS overlap FROM v_frames a JOIN v_ells b ON {_CROSS} GROUP BY sector, zone")
def overlap_area_concave(s: Shapes):
    return O.overlap_area_join(s.frames(), s.ells(), "sector", "zone", 1000.0)


@query("overlapping_ells", "zone other overlap:3", f"SELECT a.zone, b.zone AS other, sum({_SHARED}) AS overlap FROM v_ells a JOIN v_ells b ON a.zone <> b.zone AND {_CROSS} GROUP BY a.zone, b.zone")
def overlapping_ells(s: Shapes):
    other = s.ells().withColumnRenamed("zone", "other")
    return O.overlap_area_join(s.ells(), other, "zone", "other", 500.0).where("zone <> other")


@query("clip_concave", "id area:4", f"SELECT id, sum({_SHARED}) AS area FROM v_bld a JOIN v_frames b ON {_CROSS} GROUP BY id")
def clip_concave(s: Shapes):
    c = O.clip(s.buildings().select("id", "rings"), s.frames(), "id", 1000.0)
    return c.select("id", F.aggregate("parts", F.lit(0.0), lambda a, p: a + G.polygon_area(p)).alias("area"))


def _inside(a: str, q: str, lo: str, hi: str) -> tuple[str, str]:
    """First and last place on a segment between two bounds of one axis."""
    p0, p1 = f"({lo} - {a}) / nullif({q} - {a}, 0)", f"({hi} - {a}) / nullif({q} - {a}, 0)"
    level = f"WHEN {a} = {q} THEN CASE WHEN {a} BETWEEN {lo} AND {hi} THEN"
    return f"CASE {level} 0 ELSE 2 END ELSE least({p0}, {p1}) END", f"CASE {level} 1 ELSE -1 END ELSE greatest({p0}, {p1}) END"


_TX, _TY = _inside("ax", "qx", "x0", "x1"), _inside("ay", "qy", "y0", "y1")


@query("clip_lines", "road pieces length:4", f"""WITH hit AS (
        SELECT road, seg - 1 + t0 AS u0, seg - 1 + t1 AS u1
        FROM (SELECT road, seg, greatest(0, {_TX[0]}, {_TY[0]}) AS t0, least(1, {_TX[1]}, {_TY[1]}) AS t1 FROM v_segs, v_frames
              WHERE least(ax, qx) <= x1 AND greatest(ax, qx) >= x0 AND least(ay, qy) <= y1 AND greatest(ay, qy) >= y0) WHERE t1 > t0
    ), told AS (SELECT *, max(u1) OVER (PARTITION BY road ORDER BY u0, u1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hit),
    run AS (SELECT *, sum(CASE WHEN before IS NULL OR u0 > before + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY road ORDER BY u0, u1 ROWS UNBOUNDED PRECEDING) AS piece FROM told),
    piece AS (SELECT road, piece, min(u0) AS u0, max(u1) AS u1 FROM run GROUP BY road, piece)
--final
    SELECT road, count(DISTINCT piece) AS pieces, sum((least(u1, seg) - greatest(u0, seg - 1)) * sqrt((qx - ax) ** 2 + (qy - ay) ** 2)) AS length
    FROM piece JOIN v_segs USING (road) WHERE u0 < seg AND u1 > seg - 1 GROUP BY road""")
def clip_lines(s: Shapes):
    c = O.clip_lines(s.roads().select("road", "coords"), s.frames(), "road", 1000.0)
    return c.groupBy("road").agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("length"))


@query("make_valid_bowtie", "zone both:4 left:4 parts", "SELECT zone, area / 2 AS \"both\", area / 4 AS \"left\", 4 AS parts FROM v_zones")
def make_valid_bowtie(s: Shapes):
    corners = [("minx", "miny"), ("maxx", "maxy"), ("maxx", "miny"), ("minx", "maxy"), ("minx", "miny")]
    z = s.zones().select("zone", F.array(F.array(*[G.point(x, y) for x, y in corners])).alias("rings"))
    both = O.valid_parts(z, "rings").select("zone", F.col("area").alias("both"), F.size("parts").alias("parts"))
    left = O.valid_parts(z, "rings", "positive").select("zone", F.col("area").alias("left"))
    return both.join(left, "zone")
