"""Planar geometry as Catalyst expressions over nested arrays.

A line or ring is ``ARRAY<STRUCT<x DOUBLE, y DOUBLE>>``; a polygon is an array of rings (outer ring
first, closed); a multi geometry is an array of parts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
POLYGON = f"array<{LINE}>"


def let(value: Column, fn) -> Column:
    """Binds ``value`` once for ``fn``; repeated use inside a lambda would evaluate it again."""
    return F.get(F.transform(F.array(value), fn), 0)


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def _c(v) -> Column:
    if isinstance(v, str):
        return F.col(v)
    return v if isinstance(v, Column) else F.lit(v)


def rectangle(x0, y0, x1, y1) -> Column:
    """Closed counter-clockwise ring of an axis-aligned box."""
    x0, y0, x1, y1 = map(_c, (x0, y0, x1, y1))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def hypot2(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def first_point(c) -> Column:
    return F.get(_c(c), 0)


def last_point(c) -> Column:
    c = _c(c)
    return F.when(F.size(c) > 0, F.element_at(c, -1))


def segments(c) -> Column:
    """Consecutive vertex pairs ``ARRAY<STRUCT<ax, ay, bx, by>>``."""
    c = _c(c)
    n = F.size(c)
    return F.zip_with(
        F.slice(c, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(c, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")),
    )


def line_length(c) -> Column:
    return F.aggregate(
        segments(c), F.lit(0.0), lambda s, e: s + hypot2(e["bx"] - e["ax"], e["by"] - e["ay"])
    )


def straight_length(c) -> Column:
    a, b = first_point(c), last_point(c)
    return hypot2(b["x"] - a["x"], b["y"] - a["y"])


def signed_ring_area(ring) -> Column:
    return F.aggregate(
        segments(ring), F.lit(0.0), lambda s, e: s + (e["ax"] * e["by"] - e["bx"] * e["ay"])
    ) / 2


def ring_area(ring) -> Column:
    return F.abs(signed_ring_area(ring))


def polygon_area(rings) -> Column:
    """Outer ring area minus the holes."""
    rings = _c(rings)
    total = F.aggregate(rings, F.lit(0.0), lambda s, r: s + ring_area(r))
    return F.when(F.size(rings) > 0, 2 * ring_area(F.get(rings, 0)) - total)


def polygon_perimeter(rings) -> Column:
    return F.aggregate(_c(rings), F.lit(0.0), lambda s, r: s + line_length(r))


def ring_centroid(ring) -> Column:
    """Area centroid of one ring; the mean vertex when the area is zero."""
    ring = _c(ring)
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(s, e):
        k = e["ax"] * e["by"] - e["bx"] * e["ay"]
        return F.struct(
            (s["a"] + k).alias("a"),
            (s["x"] + (e["ax"] + e["bx"]) * k).alias("x"),
            (s["y"] + (e["ay"] + e["by"]) * k).alias("y"),
        )

    def mean(f):
        return F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[f]) / F.size(ring)

    return F.aggregate(
        segments(ring),
        start,
        step,
        lambda s: F.when(s["a"] != 0, point(s["x"] / (3 * s["a"]), s["y"] / (3 * s["a"]))).otherwise(
            point(mean("x"), mean("y"))
        ),
    )


def line_bbox(c) -> Column:
    """``STRUCT<minx, miny, maxx, maxy>`` of a vertex array."""
    c = _c(c)
    xs, ys = F.transform(c, lambda p: p["x"]), F.transform(c, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
    )


def compactness(area, perimeter, clip: str = "none") -> Column:
    """4*pi*A/P**2; ``clip`` is none, unit (into [0, 1]) or top (values above 1 become 1)."""
    v = 4 * math.pi * _c(area) / (_c(perimeter) * _c(perimeter))
    v = F.when(_c(perimeter) > 0, v)
    if clip == "unit":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) + v * 0
    if clip == "top":
        return F.when(v > 1, F.lit(1.0)).otherwise(v)
    return v


def shape_index(area, perimeter) -> Column:
    return F.when(_c(area) > 0, _c(perimeter) / (2 * F.sqrt(math.pi * _c(area))))


def sinuosity(c, closed: str = "null") -> Column:
    """Length over straight distance; ``closed`` lines give null, one, inf or zero."""
    value = {"null": F.lit(None).cast("double"), "one": F.lit(1.0), "inf": F.lit(float("inf")), "zero": F.lit(0.0)}
    return let(straight_length(c), lambda d: F.when(d > 0, line_length(c) / d).when(d == 0, value[closed]))


def multi_sinuosity(parts, mode: str = "longest", closed: str = "one") -> Column:
    """Sinuosity of a multi-line: of its longest part, the length-weighted mean, or the constant 1."""
    parts = _c(parts)
    if mode == "one":
        return F.lit(1.0)
    if mode == "longest":
        return sinuosity(longest_part(parts), closed)
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + line_length(p))
    weighted = F.aggregate(
        parts, F.lit(0.0), lambda s, p: s + F.coalesce(sinuosity(p, closed), F.lit(0.0)) * line_length(p)
    )
    return F.when(total > 0, weighted / total)


def curvature(c) -> Column:
    """Sum of turning angles over length (rad per unit); 0 below three vertices."""
    c = _c(c)
    segs = segments(c)
    n = F.size(segs)
    turns = F.zip_with(
        F.slice(segs, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(segs, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: _turn(a, b),
    )
    total = F.aggregate(turns, F.lit(0.0), lambda s, t: s + t)
    return let(line_length(c), lambda length: F.when((F.size(c) < 3) | (length <= 0), F.lit(0.0)).otherwise(total / length))


def _turn(a, b) -> Column:
    ux, uy, vx, vy = a["bx"] - a["ax"], a["by"] - a["ay"], b["bx"] - b["ax"], b["by"] - b["ay"]
    nu, nv = hypot2(ux, uy), hypot2(vx, vy)
    cos = (ux * vx + uy * vy) / (nu * nv)
    return F.when((nu > 0) & (nv > 0), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))).otherwise(0.0)


def point_density(c) -> Column:
    length = line_length(c)
    return F.when(length > 0, F.size(_c(c)) / length).otherwise(0.0)


def bearing(c) -> Column:
    """Compass bearing in degrees from the first to the last vertex."""
    a, b = first_point(c), last_point(c)
    return F.pmod(F.degrees(F.atan2(b["x"] - a["x"], b["y"] - a["y"])) + 360, F.lit(360.0))


def axis_angle(c) -> Column:
    """Angle of the start-end vector in [0, 180) degrees."""
    a, b = first_point(c), last_point(c)
    return F.pmod(F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])), F.lit(180.0))


def longest_part(parts) -> Column:
    best = F.array_max(F.transform(_c(parts), lambda p: F.struct(line_length(p).alias("k"), p.alias("g"))))
    return best["g"]


def largest_part(parts) -> Column:
    """Largest polygon (array of rings) of a multi-polygon."""
    best = F.array_max(F.transform(_c(parts), lambda p: F.struct(polygon_area(p).alias("k"), p.alias("g"))))
    return best["g"]


def line_merge(parts) -> Column:
    """Parts that chain end-to-start become one line; otherwise the longest part."""
    parts = _c(parts)
    start = F.struct(F.get(parts, 0).alias("g"), F.lit(True).alias("ok"))

    def step(s, p):
        touches = last_point(s["g"]) == first_point(p)
        return F.struct(
            F.when(touches, F.concat(s["g"], F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))))
            .otherwise(s["g"]).alias("g"),
            (s["ok"] & touches).alias("ok"),
        )

    merged = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, step)
    return F.when(F.size(parts) == 1, F.get(parts, 0)).when(merged["ok"], merged["g"]).otherwise(
        longest_part(parts)
    )


def repair_ring(ring) -> Column:
    """Drop repeated vertices, close the ring, orient it counter-clockwise; NULL below a triangle."""

    def close(clean):
        return F.when(first_point(clean) == last_point(clean), clean).otherwise(F.concat(clean, F.array(first_point(clean))))

    def orient(closed):
        return let(signed_ring_area(closed), lambda a: F.when(
            (F.size(closed) >= 4) & (a != 0), F.when(a < 0, F.reverse(closed)).otherwise(closed)))

    return let(let(dedupe_vertices(_c(ring)), close), orient)


def dedupe_vertices(c) -> Column:
    c = _c(c)
    return F.filter(c, lambda p, i: (i == 0) | (p != F.get(c, i - 1)))


def simplify(c, tolerance: float = 0.01) -> Column:
    """Drop interior vertices closer than ``tolerance`` to the chord of their neighbours."""
    c = _c(c)
    n = F.size(c)

    def keep(p, i):
        a, b = F.get(c, i - 1), F.get(c, i + 1)
        return (i == 0) | (i == n - 1) | (
            point_segment_distance(p["x"], p["y"], a["x"], a["y"], b["x"], b["y"]) > tolerance
        )

    return F.filter(c, keep)


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    d2 = dx * dx + dy * dy
    t = F.when(d2 > 0, ((px - ax) * dx + (py - ay) * dy) / d2).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return hypot2(px - (ax + t * dx), py - (ay + t * dy))


def point_line_distance(px, py, c) -> Column:
    px, py = _c(px), _c(py)
    return F.array_min(
        F.transform(segments(c), lambda e: point_segment_distance(px, py, e["ax"], e["ay"], e["bx"], e["by"]))
    )


def on_ring(px, py, ring) -> Column:
    px, py = _c(px), _c(py)
    return F.exists(
        segments(ring),
        lambda e: (
            ((e["bx"] - e["ax"]) * (py - e["ay"]) == (e["by"] - e["ay"]) * (px - e["ax"]))
            & (px >= F.least(e["ax"], e["bx"])) & (px <= F.greatest(e["ax"], e["bx"]))
            & (py >= F.least(e["ay"], e["by"])) & (py <= F.greatest(e["ay"], e["by"]))
        ),
    )


def _odd_crossings(px, py, ring) -> Column:
    def crosses(e):
        at = (e["bx"] - e["ax"]) * (py - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]
        return ((e["ay"] > py) != (e["by"] > py)) & (px < at)

    return F.size(F.filter(segments(ring), crosses)) % 2 == 1


def point_in_polygon(px, py, rings, boundary: bool = False) -> Column:
    """Even-odd test over all rings; ``boundary`` decides points exactly on a ring."""
    px, py, rings = _c(px), _c(py), _c(rings)
    inside = F.aggregate(rings, F.lit(False), lambda s, r: s != _odd_crossings(px, py, r))
    touch = F.exists(rings, lambda r: on_ring(px, py, r))
    return F.when(touch, F.lit(boundary)).otherwise(inside)


def is_box(rings, minx, miny, maxx, maxy) -> Column:
    """Whether a polygon is the rectangle of its box: one closed ring of four axis-parallel sides."""
    ring = F.get(_c(rings), 0)
    p = [F.get(ring, i) for i in range(5)]
    turn = [
        reduce(lambda u, v: u & v, [p[i][a] == p[i + 1][a] if i % 2 == k else p[i][b] == p[i + 1][b] for i in range(4)])
        for k, a, b in ((0, "y", "x"), (1, "y", "x"))
    ]
    box = reduce(lambda u, v: u & v, [
        (F.least(p[0][c], p[2][c]) == _c(lo)) & (F.greatest(p[0][c], p[2][c]) == _c(hi)) & (_c(lo) < _c(hi))
        for c, lo, hi in (("x", minx, maxx), ("y", miny, maxy))
    ])
    whole = (F.size(_c(rings)) == 1) & (F.size(ring) == 5) & (p[0]["x"] == p[4]["x"]) & (p[0]["y"] == p[4]["y"])
    return F.coalesce(whole & box & (turn[0] | turn[1]), F.lit(False))


def _side(ax, ay, bx, by, px, py) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segments_intersect(a, b) -> Column:
    """Closed segment test on two ``STRUCT<ax, ay, bx, by>``."""
    o1 = _side(a["ax"], a["ay"], a["bx"], a["by"], b["ax"], b["ay"])
    o2 = _side(a["ax"], a["ay"], a["bx"], a["by"], b["bx"], b["by"])
    o3 = _side(b["ax"], b["ay"], b["bx"], b["by"], a["ax"], a["ay"])
    o4 = _side(b["ax"], b["ay"], b["bx"], b["by"], a["bx"], a["by"])
    boxes = (
        (F.least(a["ax"], a["bx"]) <= F.greatest(b["ax"], b["bx"]))
        & (F.least(b["ax"], b["bx"]) <= F.greatest(a["ax"], a["bx"]))
        & (F.least(a["ay"], a["by"]) <= F.greatest(b["ay"], b["by"]))
        & (F.least(b["ay"], b["by"]) <= F.greatest(a["ay"], a["by"]))
    )
    return boxes & (o1 * o2 <= 0) & (o3 * o4 <= 0)


def lines_intersect(c1, c2) -> Column:
    s2 = segments(c2)
    return F.exists(segments(c1), lambda a: F.exists(s2, lambda b: segments_intersect(a, b)))


def polygons_intersect(r1, r2) -> Column:
    """Closed intersection test of two polygons (arrays of rings)."""
    r1, r2 = _c(r1), _c(r2)
    edge = F.exists(r1, lambda a: F.exists(r2, lambda b: lines_intersect(a, b)))
    p1, p2 = F.get(F.get(r1, 0), 0), F.get(F.get(r2, 0), 0)
    # containment is the cheap test, so it goes first
    return (
        point_in_polygon(p1["x"], p1["y"], r2, True)
        | point_in_polygon(p2["x"], p2["y"], r1, True)
        | edge
    )


def line_intersects_polygon(c, rings) -> Column:
    c, rings = _c(c), _c(rings)
    p = F.get(c, 0)
    return point_in_polygon(p["x"], p["y"], rings, True) | F.exists(rings, lambda r: lines_intersect(c, r))


def cut_half_plane(poly: Column, side) -> Column:
    """Open ring cut to where ``side(vertex) >= 0``."""

    def emit(s):
        p, q, sp, sq = s["p"], s["q"], s["sp"], s["sq"]
        t = sp / (sp - sq)
        cross = point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
        return (
            F.when((sp >= 0) & (sq >= 0), F.array(q))
            .when((sp >= 0) & (sq < 0), F.array(cross))
            .when((sp < 0) & (sq >= 0), F.array(cross, q))
            .otherwise(F.array().cast(LINE))
        )

    here = F.transform(poly, lambda v: F.struct(point(v["x"], v["y"]).alias("q"), side(v).alias("sq")))

    def pairs(h):
        before = F.concat(F.slice(h, -1, 1), F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))))
        return F.zip_with(before, h, lambda a, b: F.struct(a["q"].alias("p"), a["sq"].alias("sp"), b["q"].alias("q"), b["sq"].alias("sq")))

    cut = let(here, lambda h: F.flatten(F.transform(pairs(h), emit)))
    return F.when(F.size(poly) == 0, poly).otherwise(cut)


def clip_ring(subject, convex) -> Column:
    """Subject ring cut by a convex counter-clockwise ring (half-plane by half-plane)."""
    start = F.slice(_c(subject), 1, F.greatest(F.size(_c(subject)) - 1, F.lit(0)))  # open ring

    def cut(poly, e):
        ex, ey = e["bx"] - e["ax"], e["by"] - e["ay"]

        def side(p):
            return ex * (p["y"] - e["ay"]) - ey * (p["x"] - e["ax"])

        return cut_half_plane(poly, side)

    return F.aggregate(segments(convex), start, cut)


def open_ring_area(c) -> Column:
    """Area of a ring without its closing vertex, measured from the first one: a ring without width has exactly none."""

    def area(r):
        o = F.get(r, 0)
        near = F.transform(r, lambda p: point(p["x"] - o["x"], p["y"] - o["y"]))
        return let(near, lambda n: ring_area(F.concat(n, F.slice(n, 1, 1))))

    return let(_c(c), lambda r: F.when(F.size(r) < 3, F.lit(0.0)).otherwise(area(r)))


def overlap_area(ring, convex) -> Column:
    """Area shared by a simple ring and a convex counter-clockwise ring."""
    return open_ring_area(clip_ring(ring, convex))


def segment_in_disc_length(ax, ay, bx, by, cx, cy, r) -> Column:
    """Length of a segment inside a disc."""
    ax, ay, bx, by, cx, cy, r = map(_c, (ax, ay, bx, by, cx, cy, r))
    dx, dy, fx, fy = bx - ax, by - ay, ax - cx, ay - cy
    a = dx * dx + dy * dy
    b = 2 * (fx * dx + fy * dy)
    c = fx * fx + fy * fy - r * r
    disc = b * b - 4 * a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    t0 = F.greatest(F.lit(0.0), (-b - root) / (2 * a))
    t1 = F.least(F.lit(1.0), (-b + root) / (2 * a))
    return F.when((a > 0) & (disc > 0) & (t1 > t0), (t1 - t0) * F.sqrt(a)).otherwise(0.0)


def line_points(c, count) -> Column:
    """``count`` equally spaced points from start to end: ``ARRAY<STRUCT<seq, x, y>>``."""
    c, count = _c(c), _c(count)
    start = F.struct(F.lit(0.0).alias("d"), F.array().cast("array<struct<s0:double,s1:double,ax:double,ay:double,bx:double,by:double>>").alias("l"))

    def step(s, e):
        w = hypot2(e["bx"] - e["ax"], e["by"] - e["ay"])
        row = F.struct(
            s["d"].alias("s0"), (s["d"] + w).alias("s1"),
            e["ax"].alias("ax"), e["ay"].alias("ay"), e["bx"].alias("bx"), e["by"].alias("by"),
        )
        return F.struct((s["d"] + w).alias("d"), F.concat(s["l"], F.array(row)).alias("l"))

    def place(hit, d):
        t = F.when(hit["s1"] > hit["s0"], F.least(F.lit(1.0), (d - hit["s0"]) / (hit["s1"] - hit["s0"]))).otherwise(0.0)
        return let(t, lambda t: point(hit["ax"] + t * (hit["bx"] - hit["ax"]), hit["ay"] + t * (hit["by"] - hit["ay"])))

    def locate(m, i):
        def at(d):
            hit = F.coalesce(F.get(F.filter(m["l"], lambda e: (e["s1"] >= d) & (e["s1"] > e["s0"])), 0), F.element_at(m["l"], -1))
            return let(let(hit, lambda h: place(h, d)), lambda p: F.struct(i.cast("int").alias("seq"), p["x"].alias("x"), p["y"].alias("y")))

        return let(m["d"] * i / F.greatest(count - 1, F.lit(1)), at)

    span = F.sequence(F.lit(0), count.cast("int") - 1)
    return let(F.aggregate(segments(c), start, step), lambda m: F.transform(span, lambda i: locate(m, i)))


def samples_by_resolution(length, resolution) -> Column:
    """max(10, int(length / (0.8 * resolution))) points."""
    return F.greatest(F.lit(10), (_c(length) / (0.8 * _c(resolution))).cast("int"))


def samples_by_step(length, step: float = 10.0) -> Column:
    """max(2, int(length / step)) points."""
    return F.greatest(F.lit(2), (_c(length) / step).cast("int"))


def coverage_sector(lon, lat, azimuth, radius_km, opening: float = 120.0, steps: int = 30,
                    latitude_scaled: bool = False, min_radius: float = 0.0) -> Column:
    """Wedge polygon ring in degrees; ``latitude_scaled`` applies cos(lat) to the latitude offset."""
    lon, lat, azimuth, r = map(_c, (lon, lat, azimuth, radius_km))
    mid = F.radians(F.pmod(90 - azimuth, F.lit(360.0)))
    half = math.radians(opening) / 2
    cos = F.cos(F.radians(lat))

    def arc(i):
        a = mid - half + i * (2 * half / steps)
        dx, dy = r * F.cos(a) / 111.32, r * F.sin(a) / 111.32
        return point(lon + dx, lat + dy / cos) if latitude_scaled else point(lon + dx / cos, lat + dy)

    ring = F.concat(
        F.array(point(lon, lat)), F.transform(F.sequence(F.lit(0), F.lit(steps)), arc), F.array(point(lon, lat))
    )
    return F.when((r > min_radius) & azimuth.isNotNull(), ring)


def local_ring(ring) -> Column:
    """Ring coordinates relative to its centroid."""
    ring = _c(ring)
    c = ring_centroid(ring)
    return F.transform(ring, lambda p: point(p["x"] - c["x"], p["y"] - c["y"]))


def line_buffer_area(length, d: float) -> Column:
    """Area of a straight line buffered by ``d``: 2dL + pi d**2."""
    return 2 * d * _c(length) + math.pi * d * d


def to_wkt(c, kind: str = "LINESTRING") -> Column:
    """WKT text of a point struct, vertex array or polygon; NULL stays NULL."""
    c = _c(c)

    def pts(a):
        return F.concat_ws(", ", F.transform(a, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))))

    if kind == "POINT":
        body = F.concat_ws(" ", c["x"].cast("string"), c["y"].cast("string"))
    elif kind == "POLYGON":
        body = F.concat_ws(", ", F.transform(c, lambda r: F.concat(F.lit("("), pts(r), F.lit(")"))))
    else:
        body = pts(c)
    return F.when(c.isNotNull(), F.concat(F.lit(f"{kind} ("), body, F.lit(")")))


def from_wkt(text) -> Column:
    """Vertices of a WKT POINT, LINESTRING or single-ring POLYGON."""
    text = _c(text)
    num = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    xs = F.regexp_extract_all(text, F.lit(num + r"\s+-?[0-9.]+"), F.lit(1))
    ys = F.regexp_extract_all(text, F.lit(r"-?[0-9.]+(?:[eE][-+]?[0-9]+)?\s+" + num), F.lit(1))
    return F.zip_with(xs, ys, lambda x, y: point(x.cast("double"), y.cast("double")))


# trapezoids ----------------------------------------------------------------------------------------


def side_x(e, y) -> Column:
    """Place of a rising edge at height ``y``; exact at its ends."""
    along = (y - e["ay"]) / (e["by"] - e["ay"])
    return F.when(y == e["ay"], e["ax"]).when(y == e["by"], e["bx"]).otherwise(e["ax"] + (e["bx"] - e["ax"]) * along)


def _rising(rings) -> Column:
    """Edges that are not level, from their lower to their upper end; ``up`` is 1 where that is the ring's way."""
    edges = F.filter(F.flatten(F.transform(rings, segments)), lambda e: e["ay"] != e["by"])
    return F.transform(edges, lambda e: F.when(e["ay"] < e["by"], F.struct(e["ax"], e["ay"], e["bx"], e["by"], F.lit(1).alias("up"))).otherwise(
        F.struct(e["bx"].alias("ax"), e["by"].alias("ay"), e["ax"].alias("bx"), e["ay"].alias("by"), F.lit(-1).alias("up"))))


def _crossing_heights(edges) -> Column:
    """Heights at which two of the edges cross inside both."""

    def height(a, b):
        rx, ry, sx, sy = a["bx"] - a["ax"], a["by"] - a["ay"], b["bx"] - b["ax"], b["by"] - b["ay"]
        under = rx * sy - ry * sx
        t = ((b["ax"] - a["ax"]) * sy - (b["ay"] - a["ay"]) * sx) / under
        u = ((b["ax"] - a["ax"]) * ry - (b["ay"] - a["ay"]) * rx) / under
        return F.when((under != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1), a["ay"] + t * ry)

    met = F.transform(edges, lambda a, i: F.transform(F.slice(edges, i + 2, F.size(edges)), lambda b: height(a, b)))
    return F.filter(F.flatten(met), lambda y: y.isNotNull())


def trapezoids(rings, rule: str = "simple") -> Column:
    """A polygon (array of rings) as trapezoids ``STRUCT<y0, y1, left, right>`` between rising edges of its own.

    ``simple`` rings do not cross; holes are told by counting. Other rules split at crossings first: ``evenodd``,
    ``nonzero`` and ``positive`` keep what has an odd, a non-zero, a positive winding number. Slabs between vertex
    heights are searched in groups, so n edges take about n * sqrt(n) steps where most are short (n * n pairs for
    crossings).
    """
    if rule not in ("simple", "evenodd", "nonzero", "positive"):
        raise ValueError(f"unknown rule {rule}")

    def cut(edges) -> Column:
        ends = F.flatten(F.transform(edges, lambda e: F.array(e["ay"], e["by"])))
        if rule != "simple":
            ends = F.concat(ends, _crossing_heights(edges))
        return let(F.array_sort(F.array_distinct(ends)), lambda ys: groups(edges, ys))

    def groups(edges, ys) -> Column:
        slabs = F.size(ys) - 1
        wide = F.greatest(F.ceil(F.sqrt(F.greatest(slabs, F.lit(1)))).cast("int"), F.lit(1))
        starts = F.when(slabs > 0, F.sequence(F.lit(0), slabs - 1, wide)).otherwise(F.array().cast("array<int>"))

        def group(k) -> Column:
            top = F.least(k + wide, slabs)
            near = F.filter(edges, lambda e: (e["ay"] < F.get(ys, top)) & (e["by"] > F.get(ys, k)))
            return let(near, lambda es: F.flatten(F.transform(F.sequence(k, top - 1), lambda i: slab(es, F.get(ys, i), F.get(ys, i + 1)))))

        return F.flatten(F.transform(starts, group))

    def slab(edges, y0, y1) -> Column:
        through = F.filter(edges, lambda e: (e["ay"] <= y0) & (e["by"] >= y1))
        placed = F.array_sort(F.transform(through, lambda e: F.struct(side_x(e, (y0 + y1) / 2).alias("x"), e.alias("e"))))
        return let(placed, lambda hits: spans(hits, y0, y1))

    def between(hits, i, y0, y1) -> Column:
        def edge(k):
            e = F.get(hits, k)["e"]
            return F.struct(e["ax"].alias("ax"), e["ay"].alias("ay"), e["bx"].alias("bx"), e["by"].alias("by"))

        return F.struct(y0.alias("y0"), y1.alias("y1"), edge(i).alias("left"), edge(i + 1).alias("right"))

    def spans(hits, y0, y1) -> Column:
        n = F.size(hits)
        if rule in ("simple", "evenodd"):
            firsts = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: (i % 2 == 0) & (i + 1 < n))
        else:
            # winding number right of each edge: falling edges turn counter-clockwise on their right
            turns = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.struct(i.alias("i"), F.aggregate(
                F.slice(hits, 1, i + 1), F.lit(0), lambda s, h: s - h["e"]["up"]).alias("w")))
            kept = F.filter(turns, lambda t: ((t["w"] != 0) if rule == "nonzero" else (t["w"] > 0)) & (t["i"] + 1 < n))
            firsts = F.transform(kept, lambda t: t["i"])
        return F.transform(firsts, lambda i: between(hits, i, y0, y1))

    return let(_rising(_c(rings)), cut)


def trapezoid_ring(t) -> Column:
    """Closed counter-clockwise ring of a trapezoid."""
    lo, hi = t["y0"], t["y1"]
    a, b = point(side_x(t["left"], lo), lo), point(side_x(t["right"], lo), lo)
    c, d = point(side_x(t["right"], hi), hi), point(side_x(t["left"], hi), hi)
    return F.array(a, b, c, d, a)


def trapezoid_area(t) -> Column:
    mid = (t["y0"] + t["y1"]) / 2
    return (side_x(t["right"], mid) - side_x(t["left"], mid)) * (t["y1"] - t["y0"])


def trapezoid_overlap(a, b) -> Column:
    """Area shared by two trapezoids: the width is linear between the heights at which two sides meet."""
    lo, hi = F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"])

    def meet(p, q):
        d0, d1 = side_x(p, lo) - side_x(q, lo), side_x(p, hi) - side_x(q, hi)
        return F.when(d0 * d1 < 0, lo + (hi - lo) * d0 / (d0 - d1)).otherwise(lo)

    def width(y):
        return F.greatest(
            F.lit(0.0),
            F.least(side_x(a["right"], y), side_x(b["right"], y)) - F.greatest(side_x(a["left"], y), side_x(b["left"], y)),
        )

    heights = F.array_sort(F.array(
        lo, hi, meet(a["left"], b["left"]), meet(a["right"], b["right"]), meet(a["left"], b["right"]), meet(a["right"], b["left"])
    ))
    area = let(heights, lambda ys: F.aggregate(
        F.sequence(F.lit(0), F.lit(4)), F.lit(0.0),
        lambda s, i: s + (F.get(ys, i + 1) - F.get(ys, i)) * width((F.get(ys, i) + F.get(ys, i + 1)) / 2),
    ))
    return F.when(hi > lo, area).otherwise(0.0)


def segment_in_trapezoid(ax, ay, bx, by, t) -> Column:
    """Stretch ``STRUCT<t0, t1>`` of a segment inside a closed trapezoid; empty where ``t1 < t0``."""
    ax, ay, bx, by = map(_c, (ax, ay, bx, by))

    def side(e, x, y):
        return x - e["ax"] - (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"])

    limits = F.array(*[F.struct(p.alias("p"), q.alias("q")) for p, q in (
        (ay - t["y0"], by - t["y0"]), (t["y1"] - ay, t["y1"] - by),
        (side(t["left"], ax, ay), side(t["left"], bx, by)), (-side(t["right"], ax, ay), -side(t["right"], bx, by)),
    )])
    start = F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"))

    def cut(s, c):
        p, q = c["p"], c["q"]
        at = p / (p - q)
        return F.struct(
            F.when((p < 0) & (q < 0), F.lit(2.0)).when((p < 0) & (q >= 0), F.greatest(s["t0"], at)).otherwise(s["t0"]).alias("t0"),
            F.when((p >= 0) & (q < 0), F.least(s["t1"], at)).otherwise(s["t1"]).alias("t1"),
        )

    return F.aggregate(limits, start, cut)
