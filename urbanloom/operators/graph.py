"""Networks as node and edge tables: building, components, contraction, snapping, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..scale import cut_lineage, drop_table, one_row, round_table, table_path, with_position
from .spatial import cell, nearest_join

# ---- building -------------------------------------------------------------------------------------


def node_key(p: Column) -> Column:
    """Stable 64-bit id of an exact coordinate."""
    return F.xxhash64(p["x"], p["y"])


def line_endpoints(lines: DataFrame, key: str, coords: str, keep: Sequence[str] = ()) -> DataFrame:
    """Edges between exact end coordinates with length and both positions."""
    a, b = G.first_point(coords), G.last_point(coords)
    return lines.where(F.size(coords) >= 2).select(
        F.col(key), *keep, node_key(a).alias("src"), node_key(b).alias("dst"), G.line_length(coords).alias("length"),
        a["x"].alias("src_x"), a["y"].alias("src_y"), b["x"].alias("dst_x"), b["y"].alias("dst_y"),
    )


def simple_edges(edges: DataFrame, order: str, keep: Sequence[str] = (), last: bool = True, loops: bool = True) -> DataFrame:
    """One edge per undirected pair: the last (or first) feature by ``order`` wins."""
    e = edges.select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), order, *[k for k in keep if k != order]
    )
    if not loops:
        e = e.where(F.col("src") != F.col("dst"))
    pick = F.max_by if last else F.min_by
    rest = F.struct(order, *[k for k in keep if k != order])
    return e.groupBy("src", "dst").agg(pick(rest, F.col(order)).alias("r")).select("src", "dst", "r.*")


def build_line_graph(lines: DataFrame, key: str, coords: str, keep: Sequence[str] = ()) -> DataFrame:
    """Simple undirected graph of line ends; parallel lines collapse to the last feature."""
    e = line_endpoints(lines, key, coords, keep)
    return simple_edges(e, key, ["length", *keep])


def build_vertex_graph(lines: DataFrame, key: str, coords: str) -> DataFrame:
    """Edges between consecutive vertices, weighted with the whole line length."""
    s = lines.select(key, G.line_length(coords).alias("weight"), F.explode(G.segments(coords)).alias("e"))
    e = s.select(key, "weight", F.xxhash64("e.ax", "e.ay").alias("src"), F.xxhash64("e.bx", "e.by").alias("dst"))
    return simple_edges(e, key, ["weight"])


def build_id_graph(df: DataFrame, origin: str, target: str, weight: str) -> DataFrame:
    """Directed edges straight from id columns."""
    return df.select(F.col(origin).alias("src"), F.col(target).alias("dst"), F.col(weight).alias("weight"))


def build_road_graph(lines: DataFrame, key: str, coords: str, keep: Sequence[str] = ()) -> DataFrame:
    """No self-loops, first parallel line wins, largest component only (of equal ones that with the smallest key)."""
    e = cut_lineage(simple_edges(line_endpoints(lines, key, coords, keep), key, ["length", *keep], last=False, loops=False))
    cc = cut_lineage(connected_components(e))
    named = e.join(cc, e["src"] == cc["node"]).drop("node")
    first = named.groupBy("component").agg(F.min(key).alias("first")).join(component_sizes(cc), "component")
    top = first.orderBy(F.desc("size"), "first").limit(1).select("component")
    return named.join(F.broadcast(top), "component", "left_semi").drop("component")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def distinct_nodes(lines: DataFrame, key: str, coords: str) -> DataFrame:
    """Unique end coordinates with dense ids 0..n-1 in coordinate order."""
    p = lines.select(F.explode(F.array(G.first_point(coords), G.last_point(coords))).alias("p")).select("p.x", "p.y").distinct()
    return with_position(p, ["x", "y"], "node").withColumn("node", F.col("node") - 1)


def network_starts(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).subtract(edges.select(F.col("dst").alias("node")))


def network_ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("node")).subtract(edges.select(F.col("src").alias("node")))


def node_id_ranges(nodes: DataFrame, layer: str) -> DataFrame:
    """Contiguous id interval per layer, layers in name order (one row per layer)."""
    from pyspark.sql import Window

    counts = nodes.groupBy(layer).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(layer).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("end_id", F.sum("n").over(w)).withColumn("start_id", F.col("end_id") - F.col("n"))


# ---- components -----------------------------------------------------------------------------------


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` with the smallest node id as label.

    Alternates two star contractions until the edge set is stable: O(log n) rounds, each a partial
    minimum and one equi-join, checkpointed so a lost executor costs one round.
    """
    all_nodes = nodes_of(edges) if nodes is None else nodes_of(edges).unionByName(nodes.select("node")).distinct()
    e = edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).distinct()
    e = cut_lineage(e)
    mark = None
    while True:  # the two contractions only ever lower labels, so the edge set settles
        # link every larger neighbour of a node to the node's smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        up = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        up = up.distinct()
        # link the smaller neighbours of a node to their minimum
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, round_table(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        drop_table(last)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return all_nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def component_sizes(cc: DataFrame) -> DataFrame:
    return cc.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the largest component (lowest label on ties)."""
    cc = connected_components(edges)
    top = component_sizes(cc).orderBy(F.desc("size"), "component").limit(1)
    keep = cc.join(F.broadcast(top), "component", "left_semi").select(F.col("node").alias("src"))
    return edges.join(keep, "src", "left_semi")


# ---- degree and summaries -------------------------------------------------------------------------


def degree(edges: DataFrame) -> DataFrame:
    """Undirected degree (a loop counts twice)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    d = degree(edges)
    n = one_row(d, n=F.count(F.lit(1)))["n"]
    return d.withColumn("degree_centrality", F.when(n > 1, F.col("degree") / (n - 1)).otherwise(F.lit(1.0)))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return degree(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def graph_summary(edges: DataFrame, cc: DataFrame | None = None) -> DataFrame:
    """One row: size, density, degrees, components, fragmentation, isolates."""
    cc = connected_components(edges) if cc is None else cc
    d = degree(edges)
    sizes = component_sizes(cc)
    c = one_row(sizes, c=F.count(F.lit(1)), top=F.max("size"), n=F.sum("size"), s2=F.sum(F.col("size") * F.col("size")))
    g = one_row(d, hi=F.max("degree"), tot=F.sum("degree"), k=F.count(F.lit(1)))
    n = c["n"]
    return edges.agg(F.count(F.lit(1)).alias("edges")).select(
        n.alias("nodes"), "edges", (2 * F.col("edges") / (n * (n - 1))).alias("density"),
        (g["tot"] / n).alias("avg_degree"), g["hi"].alias("max_degree"), c["c"].alias("components"),
        c["top"].alias("largest"), (c["top"] / n).alias("largest_share"), (n - g["k"]).alias("isolated"),
        (1 - c["s2"] / (n * n)).alias("fragmentation"), (n * n / c["s2"]).alias("effective_components"),
    )


def top_component_sizes(cc: DataFrame, k: int = 10) -> DataFrame:
    return component_sizes(cc).orderBy(F.desc("size"), "component").limit(k)


def alpha_beta_gamma(edges: DataFrame, length: str = "length", area_km2: Column | None = None) -> DataFrame:
    """Connectivity indices, length and intersection density."""
    cc = connected_components(edges)
    c = one_row(component_sizes(cc), c=F.count(F.lit(1)), n=F.sum("size"), top=F.max("size"))
    x = one_row(degree(edges), k=F.count_if(F.col("degree") > 2))["k"]
    n, e = c["n"], F.col("edges")
    out = edges.agg(F.count(F.lit(1)).alias("edges"), (F.sum(length) / 1000).alias("length_km")).select(
        n.alias("nodes"), "edges", "length_km", c["c"].alias("components"), c["top"].alias("largest_nodes"),
        (c["top"] / n * 100).alias("largest_pct"), x.alias("intersections"),
        F.when(n >= 3, (e - n + c["c"]) / (2 * n - 5)).otherwise(0.0).alias("alpha"),
        (e / n).alias("beta"), F.when(n > 2, e / (3 * (n - 2))).otherwise(0.0).alias("gamma"),
    )
    if area_km2 is not None:
        out = out.withColumns({
            "length_density": F.col("length_km") / area_km2, "intersection_density": F.col("intersections") / area_km2,
        })
    return out


def check_topology(edges: DataFrame) -> DataFrame:
    """Components, disconnected parts (c-1), intersections (degree above 2)."""
    cc = connected_components(edges)
    x = one_row(degree(edges), k=F.count_if(F.col("degree") > 2))["k"]
    return component_sizes(cc).agg(F.count(F.lit(1)).alias("components")).select(
        "components", (F.col("components") - 1).alias("disconnected_segments"), x.alias("intersections")
    )


def incident(edges: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """(node, feature) incidences of both edge ends."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node"), key, *keep)


def intersections(edges: DataFrame, key: str) -> DataFrame:
    """Nodes of degree above 2 with their kind and the features meeting there."""
    d = incident(edges, key).groupBy("node").agg(
        F.count(F.lit(1)).alias("degree"), F.min(key).alias("first_feature"), F.max(key).alias("last_feature")
    )
    kind = F.when(F.col("degree") == 3, "junction").when(F.col("degree") == 4, "crossroad").otherwise("complex")
    return d.where(F.col("degree") > 2).withColumn("type", kind)


def intersection_members(edges: DataFrame, key: str) -> DataFrame:
    """Long form of the connected feature ids: one row per (intersection node, feature)."""
    keep = degree(edges).where(F.col("degree") > 2).select("node")
    return incident(edges, key).join(keep, "node", "left_semi").distinct()


def stream_nodes(edges: DataFrame, key: str) -> DataFrame:
    """Springs, outlets and junctions by endpoint use count."""
    ends = edges.select("src", "dst", key).select(
        F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("s")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("s")))).alias("p"), key
    ).select("p.node", "p.s", key)
    g = ends.groupBy("node").agg(
        F.count(F.lit(1)).alias("uses"), F.sum("s").alias("starts"), F.min(key).alias("first_feature")
    )
    kind = F.when((F.col("uses") == 1) & (F.col("starts") == 1), "spring").when(F.col("uses") == 1, "outlet").otherwise("junction")
    return g.withColumn("type", kind)


def stream_indices(nodes: DataFrame) -> DataFrame:
    """Counts, bifurcation ratio and connectivity index of stream nodes."""
    g = nodes.agg(
        F.count_if(F.col("type") == "spring").alias("springs"), F.count_if(F.col("type") == "outlet").alias("outlets"),
        F.count_if(F.col("type") == "junction").alias("junctions"),
    )
    s, o, j = F.col("springs"), F.col("outlets"), F.col("junctions")
    return g.withColumns({
        "bifurcation_ratio": F.when(j + o > 0, (s + j) / (j + o)).otherwise(0.0),
        "connectivity_index": j / F.greatest(s, F.lit(1)),
    })


def rail_key_points(edges: DataFrame, key: str, name: str) -> DataFrame:
    """Crossings (degree above 2) and terminals (degree 1) with the number of distinct line names."""
    d = incident(edges, key, [name])
    pairs = d.groupBy("node", name).agg(F.count(F.lit(1)).alias("c"))
    g = pairs.groupBy("node").agg(F.sum("c").alias("degree"), F.count(name).alias("names"), F.min(name).alias("first_name"))
    kind = F.when(F.col("degree") > 2, "crossing").when(F.col("degree") == 1, "terminal")
    return g.withColumn("type", kind).where(F.col("type").isNotNull())


def feature_connectivity(edges: DataFrame, key: str) -> DataFrame:
    """degree(start) + degree(end) per feature."""
    d = degree(edges)
    a = d.select(F.col("node").alias("src"), F.col("degree").alias("_a"))
    b = d.select(F.col("node").alias("dst"), F.col("degree").alias("_b"))
    return edges.join(a, "src").join(b, "dst").select(key, (F.col("_a") + F.col("_b")).alias("connectivity"))


def edge_class_pairs(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges counted by the classes of their ends (unordered)."""
    a = classes.select(F.col("node").alias("src"), F.col("class").alias("ca"))
    b = classes.select(F.col("node").alias("dst"), F.col("class").alias("cb"))
    j = edges.join(a, "src").join(b, "dst")
    return j.groupBy(F.least("ca", "cb").alias("class_a"), F.greatest("ca", "cb").alias("class_b")).agg(F.count(F.lit(1)).alias("edges"))


def bidirectional_edges(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return edges.select("src", "dst", *rest).unionByName(back)


def avg_clustering(edges: DataFrame) -> DataFrame:
    """Mean local clustering; triangles are found from the lower-degree end of every edge."""
    e = simple_edges(edges.withColumn("_k", F.lit(0)), "_k", loops=False).select("src", "dst")
    d = degree(e)
    a = d.select(F.col("node").alias("src"), F.col("degree").alias("da"))
    b = d.select(F.col("node").alias("dst"), F.col("degree").alias("db"))
    o = e.join(a, "src").join(b, "dst")
    flip = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("src") > F.col("dst")))
    o = o.select(
        F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("p"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("q")
    )
    # out-degree in this orientation is at most sqrt(2m), so the wedge join cannot explode on a hub
    wedge = o.select("p", F.col("q").alias("a")).join(o.select("p", F.col("q").alias("b")), "p").where(F.col("a") < F.col("b"))
    und = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    tri = wedge.join(und, ["a", "b"])
    t = tri.select(F.explode(F.array("p", "a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    loc = d.join(t, "node", "left").withColumn(
        "c", F.when(F.col("degree") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    )
    return loc.agg(F.avg("c").alias("avg_clustering"), (F.coalesce(F.sum("t"), F.lit(0)) / 3).cast("bigint").alias("triangles"))


# ---- merging, snapping, contraction ---------------------------------------------------------------


def close_pairs(points: DataFrame, key: str, tol: float) -> DataFrame:
    """Pairs of distinct places within ``tol`` (key of the first point of each place), id1 < id2."""
    # a place looks to the cells on its right within ``tol``, a little more for rounding: about three of width 2 * tol
    p = points.groupBy("x", "y").agg(F.min(key).alias(key))
    size, reach = 2 * tol, 1.001 * tol
    a = p.select(F.col(key).alias("_a"), "x", "y", F.explode(F.sequence(cell("x", size), cell(F.col("x") + reach, size))).alias("cx"))
    a = a.withColumn("cy", F.explode(F.sequence(cell(F.col("y") - reach, size), cell(F.col("y") + reach, size))))
    b = p.select(F.col(key).alias("_b"), F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x", size).alias("cx"), cell("y", size).alias("cy"))
    d = G.hypot2(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    right = (F.col("x") < F.col("x2")) | ((F.col("x") == F.col("x2")) & (F.col("y") < F.col("y2")))
    return a.join(b, ["cx", "cy"]).where(right & (d <= tol) & (F.col("_a") != F.col("_b"))).select(F.least("_a", "_b").alias("id1"), F.greatest("_a", "_b").alias("id2"), d.alias("distance"))


def place_clusters(points: DataFrame, key: str, tol: float) -> DataFrame:
    """``(key, cluster)``: transitive closure of places within ``tol``; same place, same cluster."""
    first = points.groupBy("x", "y").agg(F.min(key).alias("_rep"))
    pairs = close_pairs(points, key, tol).select(F.col("id1").alias("src"), F.col("id2").alias("dst"))
    cc = connected_components(pairs, first.select(F.col("_rep").alias("node")))
    rep = points.join(first, ["x", "y"]).select(key, "_rep")
    return rep.join(cc.select(F.col("node").alias("_rep"), F.col("component").alias("cluster")), "_rep").select(key, "cluster")


def merge_nodes(nodes: DataFrame, edges: DataFrame, tol: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Nodes closer than ``tol`` become one; edges are remapped and collapsed loops removed."""
    cl = cut_lineage(place_clusters(nodes, "node", tol))
    a = cl.select(F.col("node").alias("src"), F.col("cluster").alias("_s"))
    b = cl.select(F.col("node").alias("dst"), F.col("cluster").alias("_d"))
    e = edges.join(a, "src").join(b, "dst").drop("src", "dst").withColumnsRenamed({"_s": "src", "_d": "dst"})
    n = nodes.join(cl, "node").groupBy(F.col("cluster").alias("node")).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("merged")
    )
    return n, e.where(F.col("src") != F.col("dst"))


def snap_topology(lines: DataFrame, key: str, coords: str, tol: float = 1.0, target: str = "centroid") -> DataFrame:
    """End points within ``tol`` move to their cluster's centroid (or lowest point); collapsed lines go."""
    a, b = G.first_point(coords), G.last_point(coords)
    ends = lines.select(F.explode(F.array(a, b)).alias("p")).select("p.x", "p.y").distinct()
    ends = ends.withColumn("node", F.xxhash64("x", "y"))
    cl = place_clusters(ends, "node", tol)
    j = ends.join(cl, "node")
    pos = F.struct(F.avg("x").alias("x"), F.avg("y").alias("y")) if target == "centroid" else F.min(F.struct("x", "y"))
    centre = j.groupBy("cluster").agg(pos.alias("c"))
    move = cut_lineage(j.join(centre, "cluster").select("node", "c"))
    s = move.select(F.col("node").alias("_s"), F.col("c").alias("_sc"))
    d = move.select(F.col("node").alias("_d"), F.col("c").alias("_dc"))
    keyed = lines.withColumns({"_s": node_key(a), "_d": node_key(b)})
    moved = keyed.join(s, "_s").join(d, "_d")
    body = F.slice(F.col(coords), 2, F.greatest(F.size(coords) - 2, F.lit(0)))
    out = moved.withColumn(coords, F.concat(F.array("_sc"), body, F.array("_dc"))).drop("_s", "_d", "_sc", "_dc")
    return out.where(G.line_length(coords) > 0)


def snap_within(lines: DataFrame, key: str, coords: str, tol: float = 1e-5) -> DataFrame:
    """Tolerance-matched endpoints as edges (cluster ids in place of coordinates)."""
    a, b = G.first_point(coords), G.last_point(coords)
    ends = lines.select(F.explode(F.array(a, b)).alias("p")).select("p.x", "p.y").distinct().withColumn("node", F.xxhash64("x", "y"))
    cl = cut_lineage(place_clusters(ends, "node", tol))
    e = lines.select(key, node_key(a).alias("_s"), node_key(b).alias("_d"), G.line_length(coords).alias("length"))
    s = cl.select(F.col("node").alias("_s"), F.col("cluster").alias("src"))
    d = cl.select(F.col("node").alias("_d"), F.col("cluster").alias("dst"))
    return e.join(s, "_s").join(d, "_d").select(key, "src", "dst", "length")


build_tolerant_graph = snap_within


def contract_degree2(edges: DataFrame, key: str, length: str = "length") -> DataFrame:
    """Maximal chains of degree-2 nodes become one edge: summed length, first edge's key, edge count.

    Closed rings without a junction keep their smallest node. Edges that are not merged all stay, parallel ones too;
    a contracted chain is dropped where such an edge, or a chain with a smaller key, joins the same two nodes.
    """
    e = edges.select("src", "dst", key, length)
    d = degree(e)
    inner = d.where(F.col("degree") == 2).select("node")
    # chain id of an edge: the component of its inner nodes
    touch = e.select(F.explode(F.array("src", "dst")).alias("node"), key).join(inner, "node", "left_semi")
    links = touch.groupBy("node").agg(F.min(key).alias("src"), F.max(key).alias("dst"))
    cc = connected_components(links.select("src", "dst"), e.select(F.col(key).alias("node")))
    chained = cut_lineage(e.join(cc, F.col(key) == F.col("node")).drop("node").withColumnRenamed("component", "chain"))
    ends = chained.select("chain", F.explode(F.array("src", "dst")).alias("node")).join(inner, "node", "left_anti")
    pair = ends.groupBy("chain").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n"))
    g = chained.groupBy("chain").agg(
        F.sum(length).alias(length), F.min(key).alias(key), F.count(F.lit(1)).alias("merged"), F.min("src").alias("_m"),
    )
    out = g.join(pair, "chain", "left").select(
        F.coalesce("a", "_m").alias("src"), F.coalesce("b", "_m").alias("dst"), key, length, "merged"
    )
    ends = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    kept = out.where(F.col("merged") == 1)
    chains = out.where(F.col("merged") > 1).groupBy(*ends).agg(F.min_by(F.struct(key, length, "merged"), F.col(key)).alias("r"))
    new = chains.select("src", "dst", "r.*").join(kept.select(*ends).distinct(), ["src", "dst"], "left_anti")
    return kept.unionByName(new)


def drainage_digraph(segments: DataFrame, nodes: DataFrame, key: str, coords: str) -> DataFrame:
    """Directed edges to the nearest node of each segment end."""
    a, b = G.first_point(coords), G.last_point(coords)
    ends = segments.select(key, F.explode(F.array(
        F.struct(F.lit(0).alias("e"), a["x"].alias("x"), a["y"].alias("y")), F.struct(F.lit(1).alias("e"), b["x"].alias("x"), b["y"].alias("y")),
    )).alias("p")).select(F.struct(F.col(key), F.col("p.e")).alias("id"), "p.x", "p.y")
    places = ends.select("x", "y").distinct().withColumn("place", F.xxhash64("x", "y"))
    near = nearest_join(places, nodes, "place", "node")
    hit = ends.withColumn("place", F.xxhash64("x", "y")).join(near, "place")
    return hit.groupBy(F.col(f"id.{key}").alias(key)).agg(
        F.max(F.when(F.col("id.e") == 0, F.col("node"))).alias("src"), F.max(F.when(F.col("id.e") == 1, F.col("node"))).alias("dst")
    )


def flow_accumulation(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """acc(v) = [v is a source] + sum(acc(u) * w(u, v)) on an acyclic network; an error if it has a cycle.

    Nodes with one way out form trees. Values go down a tree by doubling jumps, in as many rounds as the logarithm of its
    height. Where nodes part, each edge out of one is led on through the tree below it, to the next node that parts or
    ends; on this smaller network values are pushed level by level, a node passing its value on once all edges into it
    have delivered. Every edge is used once there, braided networks make no extra rows; rounds: the most partings on a path.
    """
    e = cut_lineage(edges.groupBy("src", "dst").agg(F.max(weight).cast("double").alias("w")))
    ways = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to"), F.min("w").alias("w"))
    single = round_table(ways.where("n = 1").select("node", "to", "w"))
    parting = round_table(ways.where("n > 1").select("node"))
    fed = e.select(F.col("dst").alias("node")).distinct().withColumn("fed", F.lit(True))
    start = round_table(nodes_of(e).join(fed, "node", "left").select("node", F.when(F.col("fed"), 0.0).otherwise(1.0).alias("x")))
    if parting.isEmpty():
        return _down_trees(single, start).withColumnRenamed("x", "acc")
    ends = _tree_ends(single)
    roots = start.join(single, "node", "left_anti")
    above = start.where("x > 0").join(ends, "node").groupBy(F.col("end").alias("node")).agg(F.sum("w").alias("more"))
    base = round_table(roots.join(above, "node", "left").select("node", (F.col("x") + F.coalesce("more", F.lit(0.0))).alias("x")))
    fork = e.join(parting.withColumnRenamed("node", "src"), "src", "left_semi")
    led = fork.join(ends.select(F.col("node").alias("dst"), "end", F.col("w").alias("on")), "dst", "left")
    led = led.groupBy("src", F.coalesce("end", "dst").alias("dst")).agg(F.sum(F.col("w") * F.coalesce("on", F.lit(1.0))).alias("w"))
    acc = _by_levels(round_table(led), base)
    into = fork.join(acc.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("acc")).alias("more"))
    inner = start.join(single, "node", "left_semi").join(into, "node", "left")
    trees = _down_trees(single, round_table(inner.select("node", (F.col("x") + F.coalesce("more", F.lit(0.0))).alias("x"))))
    return acc.unionByName(trees.withColumnRenamed("x", "acc"))


def _down_trees(jump: DataFrame, value: DataFrame) -> DataFrame:
    """``(node, x)``: each node's x and that of all nodes above it, times the weights on the way.

    ``jump`` is ``(node, to, w)``, one way out per node; after round k a node has met all within 2**k steps above it, and
    its jump is 2**k steps long.
    """
    longest, steps = jump.count(), 1
    while not jump.isEmpty():
        if steps > longest:
            raise ValueError("the network has a cycle")
        more = jump.join(value, "node").groupBy(F.col("to").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("more"))
        met = round_table(value.join(more, "node", "left").select("node", (F.col("x") + F.coalesce("more", F.lit(0.0))).alias("x")))
        on = jump.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("w").alias("_w"))
        ahead = round_table(jump.join(on, "to").select("node", F.col("_to").alias("to"), (F.col("w") * F.col("_w")).alias("w")))
        if steps > 1:  # the first jumps are the caller's
            drop_table(jump)
        drop_table(value)
        jump, value, steps = ahead, met, 2 * steps
    return value


def _tree_ends(jump: DataFrame) -> DataFrame:
    """``(node, end, w)``: the node without a jump that each node's jumps lead to, and the product of their weights."""
    way, longest, steps, first = jump, jump.count(), 1, True
    while True:
        on = way.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("w").alias("_w"))
        ahead = round_table(way.join(on, "to", "left").select(
            "node", F.coalesce("_to", "to").alias("to"), (F.col("w") * F.coalesce("_w", F.lit(1.0))).alias("w"), F.col("_to").isNotNull().alias("open")))
        if not first:
            drop_table(way)
        way, steps, first = ahead, 2 * steps, False
        if way.where("open").isEmpty():
            return way.select("node", F.col("to").alias("end"), "w")
        if steps > 2 * longest:
            raise ValueError("the network has a cycle")


def _by_levels(e: DataFrame, base: DataFrame) -> DataFrame:
    """``(node, acc)``: ``base`` x plus what all edges ``(src, dst, w)`` deliver, pushed level by level."""
    spark = e.sparkSession
    need = round_table(e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("need")).join(base, "node"))
    ready = round_table(base.join(need, "node", "left_anti").select("node", F.col("x").alias("acc")))
    done = table_path(spark)
    schema = ready.schema
    part = None
    while not ready.isEmpty():
        ready.write.mode("append").parquet(done)
        sent = ready.join(e, ready["node"] == e["src"]).select(
            F.col("dst").alias("node"), (F.col("w") * F.col("acc")).alias("got"), F.lit(1).cast("bigint").alias("n"))
        waiting = sent if part is None else part.unionByName(sent)
        waiting = waiting.groupBy("node").agg(F.sum("got").alias("got"), F.sum("n").alias("n")).join(need, "node")
        state = round_table(waiting)
        last_ready, last_part = ready, part
        ready = round_table(state.where(F.col("n") == F.col("need")).select("node", (F.col("x") + F.col("got")).alias("acc")))
        part = round_table(state.where(F.col("n") < F.col("need")).select("node", "got", "n"))
        for t in (last_ready, last_part, state):
            drop_table(t)
    acc = spark.read.schema(schema).parquet(done) if part is not None else ready
    if acc.count() < base.count():
        raise ValueError("the network has a cycle")
    return acc


def communities(edges: DataFrame) -> DataFrame:
    """Label propagation to a fixed point: each node takes the commonest neighbour label, smallest on ties.

    A node moves only if another label is strictly commoner around it than its own, and only if it comes first (by a
    hash of node and round) among the neighbours that want to move too. So every move adds edges that join equal
    labels, and the rounds end by themselves, without a cap, at a labelling that no node wants to leave.
    """
    both = cut_lineage(bidirectional_edges(edges.where(F.col("src") != F.col("dst")).select("src", "dst")).distinct())
    lab = cut_lineage(both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    done = 0
    while True:
        done += 1
        votes = both.join(lab, both["dst"] == lab["node"]).groupBy("src", "label").agg(F.count(F.lit(1)).alias("c"))
        cur = lab.select(F.col("node").alias("src"), F.col("label").alias("old"))
        best = votes.join(cur, "src").groupBy("src").agg(
            F.min(F.struct((-F.col("c")).alias("c"), "label")).alias("b"),
            F.coalesce(F.max(F.when(F.col("label") == F.col("old"), F.col("c"))), F.lit(0)).alias("own"),
        ).where(-F.col("b.c") > F.col("own"))
        want = round_table(best.select("src", F.col("b.label").alias("to"), F.xxhash64("src", F.lit(done)).alias("turn")))
        rival = want.select(F.col("src").alias("dst"), F.struct("turn", F.col("src").alias("id")).alias("other"))
        first = both.join(rival, "dst").groupBy("src").agg(F.min("other").alias("other"))
        moves = want.join(first, "src", "left").where(
            F.col("other").isNull() | (F.struct("turn", F.col("src").alias("id")) < F.col("other"))
        ).select(F.col("src").alias("node"), "to")
        if want.isEmpty():
            return lab.withColumnRenamed("label", "community")
        last, lab = lab, round_table(lab.join(moves, "node", "left").select("node", F.coalesce("to", "label").alias("label")))
        drop_table(last)
        drop_table(want)


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Newman modularity of a partition."""
    e = edges.where(F.col("src") != F.col("dst"))
    m = one_row(e, m=F.count(F.lit(1)))["m"]
    a = labels.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    b = labels.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    inside = e.join(a, "src").join(b, "dst").where(F.col("ca") == F.col("cb")).groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("l"))
    deg = degree(e).join(labels, "node").groupBy("community").agg(F.sum("degree").alias("d"))
    j = deg.join(inside, "community", "left")
    return j.agg(
        F.count(F.lit(1)).alias("communities"),
        F.sum(F.coalesce("l", F.lit(0)) / m - F.pow(F.col("d") / (2 * m), 2)).alias("modularity"),
    )


def largest_component_subgraph(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (with their columns) and edges of the largest component under dense ids 0..n-1."""
    cc = cut_lineage(connected_components(edges, nodes.select("node")))
    top = component_sizes(cc).orderBy(F.desc("size"), "component").limit(1)
    keep = cc.join(F.broadcast(top), "component", "left_semi").select("node")
    placed = with_position(keep, ["node"], "new_id").withColumn("new_id", F.col("new_id") - 1)
    n = nodes.join(placed, "node")
    a = placed.select(F.col("node").alias("src"), F.col("new_id").alias("_s"))
    b = placed.select(F.col("node").alias("dst"), F.col("new_id").alias("_d"))
    e = edges.join(a, "src").join(b, "dst").drop("src", "dst").withColumnsRenamed({"_s": "src", "_d": "dst"})
    return n, e


def node_classes(edges: DataFrame, code: str, mode: str = "min", default: int | None = None) -> DataFrame:
    """Node label from its incident edges: lowest code, or the commonest (smallest on ties)."""
    inc = edges.select(F.explode(F.array("src", "dst")).alias("node"), F.col(code).alias("c"))
    if mode == "min":
        g = inc.groupBy("node").agg(F.min("c").alias("class"))
    else:
        cnt = inc.where(F.col("c").isNotNull()).groupBy("node", "c").agg(F.count(F.lit(1)).alias("k"))
        g = cnt.groupBy("node").agg(F.min(F.struct((-F.col("k")).alias("k"), "c")).alias("m")).select("node", F.col("m.c").alias("class"))
    return g if default is None else g.withColumn("class", F.coalesce("class", F.lit(default)))
