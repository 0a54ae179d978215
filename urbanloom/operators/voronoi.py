"""Voronoi cells by a descent through a pyramid of cells, with a short list per place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..scale import cut_lineage

_NEAR = "array<struct<d:double,x:double,y:double>>"
_DEEPEST = 50  # halvings of the extent beyond which a double tells no more cells apart
_SMALL = 4096  # rows of a level that may be broadcast; a level has at most 4**level


def voronoi_cells(points: DataFrame, key: str, pad: float = 10_000.0) -> DataFrame:
    """``(key, x, y, ring, neighbours, area_km2)``: the Voronoi cell of every distinct place in the padded extent.

    A place cuts its ring only if it lies nearer to some vertex than the ring's own place does. So a pyramid cell
    matters only if its bounds meet one of the circles around the vertices. Each pyramid cell carries its count, its
    tight bounds and one of its places; those places cut the ring first, which shrinks the circles, and only cells that
    still meet a circle are opened. No circle then holds a whole cell, so the list of a place is a few cells per level,
    however dense the area beside it. The descent starts from the 25 cells around a place; places whose circles reach
    beyond these start at the root. It ends where no cell is left to open, so the rings are exact.

    Coincident places count once, under their lowest key; rows without a coordinate are left out; one place gets the
    whole extent and no neighbour.
    """
    p = cut_lineage(points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min(key).alias(key)))
    b = p.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")).first()
    x0, y0, n = b["x0"] or 0.0, b["y0"] or 0.0, b["n"]
    x1, y1 = b["x1"] or 0.0, b["y1"] or 0.0
    side = max(x1 - x0, y1 - y0) or 1.0
    start = int(math.log(max(n, 4) / 4, 16)) * 2  # a round goes down two levels

    def at(c: str, low: float, level: int) -> Column:
        return F.least(F.floor((F.col(c) - low) / side * 2.0**level), F.lit(2**level - 1)).cast("bigint")

    def cells(level: int) -> DataFrame:
        place = F.struct("x", "y")
        ids = {"ix": at("x", x0, level), "iy": at("y", y0, level)}
        if level >= _DEEPEST:
            box = [F.col("x").alias("a"), F.col("y").alias("b"), F.col("x").alias("c"), F.col("y").alias("d")]
            return p.withColumns(ids).select("ix", "iy", F.lit(1).cast("bigint").alias("n"), place.alias("rep"), *box)
        out = p.withColumns(ids).groupBy("ix", "iy").agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by(place, F.struct(_middle("x", "ix", x0, side, level) + _middle("y", "iy", y0, side, level), "x", "y")).alias("rep"),
            F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"),
        )
        return F.broadcast(out) if 4**level <= _SMALL else out

    cut = _cutter(key)
    child = F.explode(F.flatten(F.transform("open", lambda c: F.array(*[
        F.struct((4 * c["ix"] + i).alias("ix"), (4 * c["iy"] + j).alias("iy")) for i in range(4) for j in range(4)]))))
    # first look: one place from each of the 25 cells around
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)]))
    box = F.slice(G.rectangle(x0 - pad, y0 - pad, x1 + pad, y1 + pad), 1, 4)
    own = p.select(key, "x", "y", box.alias("ring"), F.array().cast(_NEAR).alias("nb"), grid.alias("o"))
    own = own.withColumns({"ix": at("x", x0, start) + F.col("o.i"), "iy": at("y", y0, start) + F.col("o.j")}).drop("o")
    state = cut(own.join(cells(start), ["ix", "iy"]))
    width = side / 2.0**start
    inside = F.lit(True)
    for c, low in (("x", x0), ("y", y0)):
        i = at(c, low, start)
        least = F.array_min(F.transform("ring", lambda v: v[c] - _reach(v)))  # noqa: B023 - called at once
        most = F.array_max(F.transform("ring", lambda v: v[c] + _reach(v)))  # noqa: B023
        inside = inside & ((i <= 2) | (least >= low + (i - 2) * width)) & ((i >= 2**start - 3) | (most <= low + (i + 3) * width))
    root = F.array(F.struct(F.lit(0).cast("bigint").alias("ix"), F.lit(0).cast("bigint").alias("iy")))
    state = cut_lineage(state.withColumn("far", ~inside).withColumn("open", F.when(inside, F.col("open")).otherwise(root)))

    done, level = state.where(F.size("open") == 0), 0
    wait, state = state.where(~F.col("far") & (F.size("open") > 0)), state.where(F.col("far") & (F.size("open") > 0))
    while True:
        if level == start:
            state, wait = state.unionByName(wait), None
        if not state.isEmpty():
            level += 2
            rows = state.withColumn("o", child).select(key, "x", "y", "ring", "nb", F.col("o.ix").alias("ix"), F.col("o.iy").alias("iy"))
            after = cut_lineage(cut(rows.join(cells(level), ["ix", "iy"])).withColumn("far", F.lit(True)))
            done = done.unionByName(after.where(F.size("open") == 0))
            state = after.where(F.size("open") > 0)
        elif wait is not None:
            level = start
        else:
            break
    return done.select(key, "x", "y", "ring", F.size("nb").cast("bigint").alias("neighbours"), (G.open_ring_area("ring") / 1e6).alias("area_km2"))


def _middle(c: str, i: str, low: float, side: float, level: int) -> Column:
    """Squared offset from the middle of the cell."""
    off = F.col(c) - (low + (F.col(i) + 0.5) * (side / 2.0**level))
    return off * off


def _reach(v: Column) -> Column:
    """Distance of a vertex from its place: the radius of its circle."""
    return G.hypot2(v["x"] - F.col("x"), v["y"] - F.col("y"))


def _meets(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether some place in the bounds could be nearer to a vertex of the ring than its own place."""

    def hit(v):
        dx = F.greatest(a - v["x"], v["x"] - c, F.lit(0.0))
        dy = F.greatest(b - v["y"], v["y"] - d, F.lit(0.0))
        return G.hypot2(dx, dy) < _reach(v) * (1 - 1e-12)

    return F.exists("ring", hit)


def _cutter(key: str):
    """One level as a function of rows of place and cell: rings cut by the places the met cells carry; ``open`` are the
    cells that still may hold more. The columns are the same on all levels and are built once."""
    met = F.when(_meets(F.col("a"), F.col("b"), F.col("c"), F.col("d")), F.struct("ix", "iy", "n", "rep", "a", "b", "c", "d")).alias("met")
    px, py = F.col("x"), F.col("y")
    new = F.array_sort(F.filter(F.transform("met", lambda m: F.struct(
        G.hypot2(m["rep"]["x"] - px, m["rep"]["y"] - py).alias("d"), m["rep"]["x"].alias("x"), m["rep"]["y"].alias("y"))), lambda q: q["d"] > 0))

    def cut(ring, q):
        def side(v):  # positive on the own side of the bisector
            return (q["x"] - px) * ((q["x"] + px) / 2 - v["x"]) + (q["y"] - py) * ((q["y"] + py) / 2 - v["y"])

        # a bisector farther than every vertex cannot cut
        reach = F.array_max(F.transform(ring, _reach))
        return F.when(q["d"] > 2 * reach, ring).otherwise(G.cut_half_plane(ring, side))

    def touches(q):
        even = F.filter("ring", lambda v: F.abs(_reach(v) - G.hypot2(v["x"] - q["x"], v["y"] - q["y"])) <= 1e-6 * (1 + q["d"]))
        return F.size(even) >= 2

    own = F.struct("x", "y", "ring", "nb").alias("own")
    ring = F.aggregate("new", F.col("ring"), cut)
    near = F.filter(F.array_union("nb", "new"), touches).alias("nb")
    still = F.filter("met", lambda m: (m["n"] > 1) & _meets(m["a"], m["b"], m["c"], m["d"]))
    ids = F.transform(still, lambda m: F.struct(m["ix"].alias("ix"), m["iy"].alias("iy"))).alias("open")
    gather = F.first("own").alias("own"), F.collect_list("met").alias("met")

    def level(rows: DataFrame) -> DataFrame:
        got = rows.select(key, own, met).groupBy(key).agg(*gather).select(key, "own.*", "met")
        return got.withColumn("new", new).withColumn("ring", ring).select(key, "x", "y", "ring", near, ids)

    return level
