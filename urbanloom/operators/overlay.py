"""Overlay of any simple polygons, concave ones and ones with holes included.

A polygon is cut at the heights of its vertices into trapezoids whose left and right sides are parts of its own edges
(``G.trapezoids``). The trapezoids of both layers are exploded to rows, meet by grid cell, and each pair is solved in
closed form: shared area, or the stretch of a segment inside. Areas are sums over pairs and stretches are merged along
their line, so the work of a large polygon spreads over many tasks and only sums come together again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .spatial import box_pairs, explode_segments

EPS = 1e-9  # two stretches of a line that come this close, in segments, are one


def explode_trapezoids(df: DataFrame, rings: str, keep: Sequence[str], rule: str = "simple") -> DataFrame:
    """One row per trapezoid ``t`` of the polygons, with its box; a null or flat polygon has none."""
    t = df.select(*keep, F.explode(G.trapezoids(rings, rule)).alias("t"))
    xs = [G.side_x(F.col(f"t.{s}"), F.col(f"t.{y}")) for s in ("left", "right") for y in ("y0", "y1")]
    return t.withColumns({"minx": F.least(*xs), "maxx": F.greatest(*xs), "miny": F.col("t.y0"), "maxy": F.col("t.y1")})


def _upright() -> Column:
    """Both sides of the trapezoid ``t`` are upright."""
    def upright(side: str) -> Column:
        return G.side_x(F.col(f"t.{side}"), F.col("t.y0")) == G.side_x(F.col(f"t.{side}"), F.col("t.y1"))

    return upright("left") & upright("right")


def overlap_area_join(left: DataFrame, right: DataFrame, key: str, right_key: str, size: float, rings: str = "rings",
                      right_rings: str | None = None) -> DataFrame:
    """``(key, right_key, overlap)`` of all pairs of polygons that share an area.

    Trapezoids with upright sides are the rectangles of their boxes; pairs of these take differences of their bounds.
    """
    a = explode_trapezoids(left, rings, [key])
    b = explode_trapezoids(right, right_rings or rings, [right_key])
    box = ["minx", "miny", "maxx", "maxy"]
    plain = _upright()
    sides = [F.least(f"l_max{c}", f"r_max{c}") - F.greatest(f"l_min{c}", f"r_min{c}") for c in "xy"]
    names = [F.col(f"l_{key}").alias(key), F.col(f"r_{right_key}").alias(right_key)]
    flat = box_pairs(a.where(plain).select(key, *box), b.where(plain).select(right_key, *box), size).select(
        *names, F.when((sides[0] > 0) & (sides[1] > 0), sides[0] * sides[1]).otherwise(0.0).alias("overlap"))
    p = flat
    for one, two in ((a.where(plain), b.where(~plain)), (a.where(~plain), b)):
        p = p.unionByName(box_pairs(one, two, size).select(*names, G.trapezoid_overlap(F.col("l_t"), F.col("r_t")).alias("overlap")))
    return p.where(F.col("overlap") > 0).groupBy(key, right_key).agg(F.sum("overlap").alias("overlap"))


def clip(df: DataFrame, area: DataFrame, key: str, size: float, rings: str = "rings", area_rings: str | None = None) -> DataFrame:
    """Polygons cut to an area: ``(key, parts, area)``.

    ``parts`` is a multi-polygon of convex rings that tile what is left. The area's polygons may be concave and have
    holes; they must not overlap one another. Polygons outside the area are dropped.
    """
    a = explode_trapezoids(df, rings, [key])
    b = explode_trapezoids(area, area_rings or rings, [])
    p = box_pairs(a, b, size).select(
        F.col(f"l_{key}").alias(key), "l_t", "r_t", G.trapezoid_overlap(F.col("l_t"), F.col("r_t")).alias("_a")
    ).where(F.col("_a") > 0)
    piece = G.clip_ring(G.trapezoid_ring(F.col("l_t")), G.trapezoid_ring(F.col("r_t")))
    closed = G.let(piece, lambda r: F.concat(r, F.slice(r, 1, 1)))
    return p.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(closed)), lambda r: F.array(r)).alias("parts"), F.sum("_a").alias("area")
    )


def clip_lines(lines: DataFrame, area: DataFrame, key: str, size: float, coords: str = "coords", rings: str = "rings") -> DataFrame:
    """Lines cut to an area: one row ``(key, piece, coords, length)`` per stretch inside, numbered from the start.

    The area's polygons may be concave, have holes, touch or overlap. Stretches of no length are dropped.
    """
    segs = explode_segments(lines, coords, [key])
    b = explode_trapezoids(area, rings, [])
    s = G.segment_in_trapezoid("l_ax", "l_ay", "l_bx", "l_by", F.col("r_t"))
    inside = box_pairs(segs, b, size).select(F.col(f"l_{key}").alias(key), F.col("l_seg").alias("seg"), s.alias("s"))
    inside = inside.where(F.col("s.t1") > F.col("s.t0")).select(
        key, (F.col("seg") + F.col("s.t0")).alias("u0"), (F.col("seg") + F.col("s.t1")).alias("u1")
    )
    order = Window.partitionBy(key).orderBy("u0", "u1")
    before = F.max("u1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("u0") > before + EPS), 1).otherwise(0)
    runs = inside.withColumn("_new", new).withColumn("piece", F.sum("_new").over(order)).groupBy(key, "piece").agg(
        F.min("u0").alias("u0"), F.max("u1").alias("u1")
    )
    made = runs.join(lines.select(key, F.col(coords).alias("_c")), key).select(key, "piece", _stretch("_c", "u0", "u1").alias(coords))
    return made.withColumn("length", G.line_length(coords))


def _stretch(c: str, u0: str, u1: str) -> Column:
    """Part of a line between two places, counted in segments."""
    c, u0, u1 = F.col(c), F.col(u0), F.col(u1)

    def at(u: Column) -> Column:
        i = F.least(F.floor(u), F.size(c) - 2).cast("int")
        a, b, t = F.get(c, i), F.get(c, i + 1), u - i
        return G.point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"]))

    first, last = F.floor(u0 + EPS) + 1, F.ceil(u1 - EPS) - 1
    inner = F.when(last >= first, F.slice(c, (first + 1).cast("int"), (last - first + 1).cast("int")))
    return F.concat(F.array(at(u0)), F.coalesce(F.transform(inner, lambda p: G.point(p["x"], p["y"])), F.array().cast(G.LINE)), F.array(at(u1)))


def valid_parts(df: DataFrame, rings: str, rule: str = "evenodd") -> DataFrame:
    """Polygons whose rings may cross themselves or each other, as tilings: adds ``parts`` and ``area``.

    Rings are split at all crossings. ``evenodd`` keeps what an odd number of rings surrounds (a bow-tie keeps both
    wings, a doubled lap becomes a hole); ``nonzero`` keeps what any ring winds around; ``positive`` keeps what is wound
    around counter-clockwise.
    """
    t = G.trapezoids(rings, rule)
    made = df.withColumn("_t", t)
    parts = F.transform("_t", lambda x: F.array(G.trapezoid_ring(x)))
    area = F.aggregate("_t", F.lit(0.0), lambda s, x: s + G.trapezoid_area(x))
    return made.withColumns({"parts": parts, "area": area}).drop("_t")
