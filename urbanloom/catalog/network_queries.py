"""Queries on the street, drainage and road networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import centrality as CE
from ..operators import community as CO
from ..operators import features as FE
from ..operators import graph as GR
from ..operators import hydro as H
from ..operators import profile as P
from ..operators import telecom as TE
from ..scale import cut_lineage
from .registry import query
from .shapes import Shapes, _px, _py

_NODES = "SELECT DISTINCT unnest([src, dst]) AS node FROM v_streets"
_CC = f"""reach(a, b) AS (SELECT node, node FROM ({_NODES}) UNION SELECT reach.a, e.dst FROM reach JOIN v_both e ON e.src = reach.b WHERE reach.a <= e.dst),
    cc AS (SELECT b AS node, min(a) AS component FROM reach GROUP BY b)"""
_DEG = "SELECT node, count(*) AS degree FROM (SELECT unnest([src, dst]) AS node FROM v_simple) GROUP BY node"
_BFS = f"""bfs(s, v, d) USING KEY (s, v) AS (SELECT node, node, 0 FROM ({_NODES}) UNION SELECT b.s, e.dst, min(b.d) + 1 FROM bfs b JOIN v_both e ON e.src = b.v LEFT JOIN recurring.bfs r ON r.s = b.s AND r.v = e.dst WHERE r.v IS NULL GROUP BY b.s, e.dst)"""


def _simple(s: Shapes):
    return GR.simple_edges(s.streets(), "street", ["street", "code", "highway"])


@query("build_line_graph", "edges length:3", f"""WITH l AS (SELECT street, {_px('src')} AS ax, {_py('src')} AS ay, {_px('dst')} AS qx, {_py('dst')} AS qy FROM v_streets), k AS (SELECT least((ax, ay), (qx, qy)) AS p, greatest((ax, ay), (qx, qy)) AS q, arg_max(sqrt((qx - ax) ** 2 + (qy - ay) ** 2), street) AS len FROM l GROUP BY 1, 2)
--final
SELECT count(*) AS edges, sum(len) AS length FROM k""")
def build_line_graph(s: Shapes):
    return GR.build_line_graph(s.street_lines(), "street", "coords").agg(F.count(F.lit(1)).alias("edges"), F.sum("length").alias("length"))


@query("simple_edges", "src dst street code", "SELECT src, dst, street, code FROM v_simple")
def simple_edges(s: Shapes):
    return _simple(s)


@query("build_vertex_graph", "edges", "SELECT count(*) AS edges FROM (SELECT DISTINCT least((ax, ay), (qx, qy)) AS p, greatest((ax, ay), (qx, qy)) AS q FROM v_segs)")
def build_vertex_graph(s: Shapes):
    return GR.build_vertex_graph(s.roads(), "road", "coords").agg(F.count(F.lit(1)).alias("edges"))


@query("build_id_graph", "src dst weight", "SELECT src, dst, length AS weight FROM v_reaches")
def build_id_graph(s: Shapes):
    return GR.build_id_graph(s.reaches(), "src", "dst", "length")


@query("build_road_graph", "street length:3", f"""WITH RECURSIVE l AS (SELECT street, {_px('src')} AS ax, {_py('src')} AS ay, {_px('dst')} AS qx, {_py('dst')} AS qy FROM v_streets), k AS (SELECT least((ax, ay), (qx, qy)) AS p, greatest((ax, ay), (qx, qy)) AS q, min(street) AS street, arg_min(sqrt((qx - ax) ** 2 + (qy - ay) ** 2), street) AS length FROM l WHERE (ax, ay) <> (qx, qy) GROUP BY 1, 2),
    t AS (SELECT unnest([p, q]) AS node, street FROM k), e AS MATERIALIZED (SELECT DISTINCT a.street AS a, b.street AS b FROM t a JOIN t b USING (node) WHERE a.street <> b.street),
    cc(n, c) USING KEY (n) AS (SELECT street, street FROM k UNION SELECT e.b, min(cc.c) FROM cc JOIN e ON e.a = cc.n JOIN recurring.cc r ON r.n = e.b WHERE cc.c < r.c GROUP BY e.b),
    big AS (SELECT c FROM (SELECT c, node FROM cc JOIN t ON t.street = n) GROUP BY c ORDER BY count(DISTINCT node) DESC, c LIMIT 1)
--final
SELECT street, length FROM k JOIN cc ON n = street WHERE c = (SELECT c FROM big)""")
def build_road_graph(s: Shapes):
    return GR.build_road_graph(s.street_lines(), "street", "coords")


@query("build_tolerant_graph", "edges nodes", "SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT DISTINCT unnest([(c[1].x, c[1].y), (c[len(c)].x, c[len(c)].y)]) AS p FROM v_roads)) AS nodes FROM v_roads")
def build_tolerant_graph(s: Shapes):
    e = cut_lineage(GR.build_tolerant_graph(s.roads(), "road", "coords", 1e-5))
    return e.agg(F.count(F.lit(1)).alias("edges")).withColumn("nodes", GR.nodes_of(e).agg(F.count(F.lit(1)).alias("n")).scalar())


@query("merge_nodes", "nodes edges", """WITH RECURSIVE p AS MATERIALIZED (SELECT erb, x, y FROM v_stations), l AS (SELECT a.erb AS a, b.erb AS b FROM p a JOIN p b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 160000), r(a, b) AS (SELECT erb, erb FROM p UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), c AS (SELECT b AS node, min(a) AS cl FROM r GROUP BY b)
--final
SELECT (SELECT count(DISTINCT cl) FROM c) AS nodes, count(*) AS edges FROM (SELECT a.erb AS src, a.erb + 1 AS dst FROM p a) JOIN c u ON u.node = src JOIN c v ON v.node = dst WHERE u.cl <> v.cl""")
def merge_nodes(s: Shapes):
    p = s.stations().select(F.col("erb").alias("node"), "x", "y")
    e = p.select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    n, e2 = GR.merge_nodes(p, e, 400.0)
    return e2.agg(F.count(F.lit(1)).alias("edges")).withColumn("nodes", n.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("snap_topology", "road ax:4 ay:4 qx:4 qy:4", """WITH RECURSIVE p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY p) AS id, p.x AS x, p.y AS y FROM (SELECT DISTINCT unnest([c[1], c[len(c)]]) AS p FROM v_roads)),
    o AS (SELECT id, x, y, floor(x / 5) + i AS cx, floor(y / 5) + j AS cy FROM p, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
    l AS MATERIALIZED (SELECT o.id AS a, p.id AS b FROM o JOIN p ON floor(p.x / 5) = cx AND floor(p.y / 5) = cy WHERE o.id <> p.id AND (o.x - p.x) ** 2 + (o.y - p.y) ** 2 <= 25),
    cc(n, c) USING KEY (n) AS (SELECT id, id FROM p UNION SELECT l.b, min(cc.c) FROM cc JOIN l ON l.a = cc.n JOIN recurring.cc r ON r.n = l.b WHERE cc.c < r.c GROUP BY l.b),
    m AS (SELECT c, avg(x) AS mx, avg(y) AS my FROM cc JOIN p ON id = n GROUP BY c), z AS (SELECT x, y, mx, my FROM cc JOIN p ON id = n JOIN m USING (c))
--final
SELECT road, a.mx AS ax, a.my AS ay, b.mx AS qx, b.my AS qy FROM v_roads v JOIN z a ON a.x = v.c[1].x AND a.y = v.c[1].y JOIN z b ON b.x = v.c[len(v.c)].x AND b.y = v.c[len(v.c)].y WHERE len(list_distinct(list_concat([{'x': a.mx, 'y': a.my}], v.c[2:len(v.c) - 1], [{'x': b.mx, 'y': b.my}]))) > 1""")
def snap_topology(s: Shapes):
    a, b = G.first_point("coords"), G.last_point("coords")
    return GR.snap_topology(s.roads(), "road", "coords", 5.0).select(
        "road", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("qx"), b["y"].alias("qy"))


@query("distinct_nodes", "nodes lo hi", "SELECT count(*) AS nodes, 0::BIGINT AS lo, count(*) - 1 AS hi FROM (SELECT DISTINCT unnest([(c[1].x, c[1].y), (c[len(c)].x, c[len(c)].y)]) AS p FROM v_roads)")
def distinct_nodes(s: Shapes):
    return GR.distinct_nodes(s.roads(), "road", "coords").agg(F.count_distinct("node").alias("nodes"), F.min("node").alias("lo"), F.max("node").alias("hi"))


@query("network_starts_ends", "kind n", "SELECT 'starts' AS kind, count(*) AS n FROM (SELECT src FROM v_reaches EXCEPT SELECT dst FROM v_reaches) UNION ALL SELECT 'ends', count(*) FROM (SELECT dst FROM v_reaches EXCEPT SELECT src FROM v_reaches) UNION ALL SELECT 'nodes', count(DISTINCT n) FROM (SELECT unnest([src, dst]) AS n FROM v_reaches)")
def network_starts_ends(s: Shapes):
    r = s.reaches()
    parts = [("starts", GR.network_starts(r)), ("ends", GR.network_ends(r)), ("nodes", GR.nodes_of(r))]
    out = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("node_id_ranges", "landuse start_id end_id", "SELECT landuse, CAST(sum(n) OVER (ORDER BY landuse) - n AS BIGINT) AS start_id, CAST(sum(n) OVER (ORDER BY landuse) AS BIGINT) AS end_id FROM (SELECT landuse, count(*) AS n FROM v_zones GROUP BY 1)")
def node_id_ranges(s: Shapes):
    return GR.node_id_ranges(s.zones(), "landuse")


@query("connected_components", "node component", f"WITH RECURSIVE {_CC}\n--final\nSELECT * FROM cc")
def connected_components(s: Shapes):
    return GR.connected_components(s.streets())


@query("graph_summary", "nodes edges density:9 avg_degree:8 max_degree components largest largest_share:8 isolated fragmentation:8 effective_components:6", f"""WITH RECURSIVE {_CC}, z AS (SELECT component, count(*) AS k FROM cc GROUP BY 1), d AS ({_DEG})
--final
SELECT *, 2 * edges / (nodes * (nodes - 1)) AS density, 2 * edges / nodes AS avg_degree, largest / nodes AS largest_share, 0::BIGINT AS isolated FROM (SELECT CAST(sum(k) AS BIGINT) AS nodes, (SELECT count(*) FROM v_simple) AS edges, (SELECT max(degree) FROM d) AS max_degree, count(*) AS components, max(k) AS largest, 1 - sum(k * k) / sum(k) ** 2 AS fragmentation, sum(k) ** 2 / sum(k * k) AS effective_components FROM z)""")
def graph_summary(s: Shapes):
    return GR.graph_summary(cut_lineage(_simple(s)))


@query("top_component_sizes", "component size", f"WITH RECURSIVE {_CC}\n--final\nSELECT * FROM (SELECT component, count(*) AS size FROM cc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)")
def top_component_sizes(s: Shapes):
    return GR.top_component_sizes(GR.connected_components(s.streets()))


@query("alpha_beta_gamma", "nodes edges components intersections alpha:9 beta:9 gamma:9 length_km:6", f"""WITH RECURSIVE {_CC}, d AS ({_DEG})
--final
SELECT *, (edges - nodes + components) / (2 * nodes - 5) AS alpha, edges / nodes AS beta, edges / (3 * (nodes - 2)) AS gamma FROM (SELECT (SELECT count(*) FROM cc) AS nodes, count(*) AS edges, (SELECT count(DISTINCT component) FROM cc) AS components, (SELECT count(*) FROM d WHERE degree > 2) AS intersections, CAST(sum(street) AS DOUBLE) / 1000 AS length_km FROM v_simple)""")
def alpha_beta_gamma(s: Shapes):
    return GR.alpha_beta_gamma(cut_lineage(_simple(s)), "street")


@query("check_topology", "components disconnected_segments intersections", f"WITH RECURSIVE {_CC}, d AS ({_DEG})\n--final\nSELECT count(DISTINCT component) AS components, count(DISTINCT component) - 1 AS disconnected_segments, (SELECT count(*) FROM d WHERE degree > 2) AS intersections FROM cc")
def check_topology(s: Shapes):
    return GR.check_topology(cut_lineage(_simple(s)))


@query("degree_centrality", "node degree degree_centrality:9", f"SELECT node, degree, degree / (count(*) OVER () - 1) AS degree_centrality FROM ({_DEG})")
def degree_centrality(s: Shapes):
    return GR.degree_centrality(_simple(s))


@query("degree_distribution", "degree nodes", f"SELECT degree, count(*) AS nodes FROM ({_DEG}) GROUP BY degree")
def degree_distribution(s: Shapes):
    return GR.degree_distribution(_simple(s))


@query("intersections", "node degree type first_feature last_feature", "SELECT node, count(*) AS degree, CASE count(*) WHEN 3 THEN 'junction' WHEN 4 THEN 'crossroad' ELSE 'complex' END AS type, min(street) AS first_feature, max(street) AS last_feature FROM (SELECT unnest([src, dst]) AS node, street FROM v_simple) GROUP BY node HAVING count(*) > 2")
def intersections(s: Shapes):
    return GR.intersections(_simple(s), "street")


@query("intersection_members", "node street", f"SELECT DISTINCT node, street FROM (SELECT unnest([src, dst]) AS node, street FROM v_simple) JOIN ({_DEG}) USING (node) WHERE degree > 2")
def intersection_members(s: Shapes):
    return GR.intersection_members(_simple(s), "street")


_SN = "SELECT node, uses, CASE WHEN uses = 1 AND starts = 1 THEN 'spring' WHEN uses = 1 THEN 'outlet' ELSE 'junction' END AS type, first_feature FROM (SELECT node, count(*) AS uses, sum(s) AS starts, min(reach) AS first_feature FROM (SELECT src AS node, 1 AS s, reach FROM v_reaches UNION ALL SELECT dst, 0, reach FROM v_reaches) GROUP BY node)"


@query("stream_nodes", "node uses type first_feature", _SN)
def stream_nodes(s: Shapes):
    return GR.stream_nodes(s.reaches(), "reach")


@query("stream_indices", "springs outlets junctions bifurcation_ratio:8 connectivity_index:8", f"SELECT *, (springs + junctions) / (junctions + outlets) AS bifurcation_ratio, junctions / greatest(springs, 1) AS connectivity_index FROM (SELECT count(*) FILTER (type = 'spring') AS springs, count(*) FILTER (type = 'outlet') AS outlets, count(*) FILTER (type = 'junction') AS junctions FROM ({_SN}))")
def stream_indices(s: Shapes):
    return GR.stream_indices(GR.stream_nodes(s.reaches(), "reach"))


@query("rail_key_points", "node degree names first_name type", "SELECT node, count(*) AS degree, count(DISTINCT highway) AS names, min(highway) AS first_name, CASE WHEN count(*) > 2 THEN 'crossing' ELSE 'terminal' END AS type FROM (SELECT unnest([src, dst]) AS node, highway FROM v_simple) GROUP BY node HAVING count(*) <> 2")
def rail_key_points(s: Shapes):
    return GR.rail_key_points(_simple(s), "street", "highway")


@query("feature_connectivity", "street connectivity", f"SELECT street, a.degree + b.degree AS connectivity FROM v_simple JOIN ({_DEG}) a ON a.node = src JOIN ({_DEG}) b ON b.node = dst")
def feature_connectivity(s: Shapes):
    return GR.feature_connectivity(_simple(s), "street")


@query("bidirectional_edges", "src dst street", "SELECT src, dst, street FROM v_simple UNION ALL SELECT dst, src, street FROM v_simple")
def bidirectional_edges(s: Shapes):
    return GR.bidirectional_edges(_simple(s).select("src", "dst", "street"))


@query("avg_clustering", "avg_clustering:9 triangles", f"""WITH d AS ({_DEG}), t AS (SELECT a.src AS n, count(*) / 2 AS t FROM v_both a JOIN v_both b ON a.dst = b.src JOIN v_both c ON b.dst = c.src AND c.dst = a.src GROUP BY a.src)
--final
SELECT avg(CASE WHEN degree > 1 THEN 2 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END) AS avg_clustering, CAST(coalesce(sum(t), 0) / 3 AS BIGINT) AS triangles FROM d LEFT JOIN t ON t.n = d.node""")
def avg_clustering(s: Shapes):
    return GR.avg_clustering(_simple(s))


def _dependencies(k: int | None) -> str:
    """Common tables for hop betweenness from k sampled sources, or all: path counts ``sg``, dependencies ``y``."""
    return f"""src AS (SELECT node FROM ({_NODES}) ORDER BY md5(CAST(node AS VARCHAR) || ':42'), node LIMIT {"NULL" if k is None else k}),
    bk(s, v, d) USING KEY (s, v) AS (SELECT node, node, 0 FROM src UNION SELECT b.s, e.dst, min(b.d) + 1 FROM bk b JOIN v_both e ON e.src = b.v LEFT JOIN recurring.bk r ON r.s = b.s AND r.v = e.dst WHERE r.v IS NULL GROUP BY b.s, e.dst),
    dag AS MATERIALIZED (SELECT DISTINCT a.s, a.v AS u, b.v AS t FROM bk a JOIN v_both e ON e.src = a.v JOIN bk b ON b.s = a.s AND b.v = e.dst AND b.d = a.d + 1),
    sg(s, v, n) AS (SELECT node, node, 1.0::DOUBLE FROM src UNION ALL SELECT g.s, dag.t, sum(g.n) FROM sg g JOIN dag ON dag.s = g.s AND dag.u = g.v GROUP BY ALL),
    h(s, v, x) AS (SELECT s, v, 1 / n FROM sg UNION ALL SELECT h.s, dag.u, sum(h.x) FROM h JOIN dag ON dag.s = h.s AND dag.t = h.v GROUP BY ALL),
    y AS (SELECT s, v, sum(x) AS y FROM h GROUP BY ALL), n AS (SELECT count(*) AS n FROM ({_NODES}))"""


def _betweenness_sql(k: int | None) -> str:
    return f"""WITH RECURSIVE {_dependencies(k)}, b AS (SELECT v, sum(n * y - 1) AS x FROM sg JOIN y USING (s, v) WHERE s <> v GROUP BY v)
--final
SELECT node, coalesce(x, 0) / ((n - 1) * (n - 2) * {"n" if k is None else k} / n) AS betweenness FROM ({_NODES}) LEFT JOIN b ON b.v = node, n"""


@query("betweenness", "node betweenness:9", _betweenness_sql(None))
def betweenness(s: Shapes):
    return CE.betweenness(_simple(s))


@query("edge_betweenness", "street betweenness:9", f"""WITH RECURSIVE {_dependencies(None)}, c AS (SELECT least(dag.u, dag.t) AS a, greatest(dag.u, dag.t) AS b, sum(sg.n * y.y) AS x FROM dag JOIN sg ON sg.s = dag.s AND sg.v = dag.u JOIN y ON y.s = dag.s AND y.v = dag.t GROUP BY 1, 2), e AS (SELECT street, x FROM v_simple JOIN c ON c.a = least(src, dst) AND c.b = greatest(src, dst))
--final
SELECT street, coalesce(x, 0) / (n * (n - 1)) AS betweenness FROM v_streets LEFT JOIN e USING (street), n""")
def edge_betweenness(s: Shapes):
    return CE.line_betweenness(s.streets().withColumn("length", F.lit(1.0)), "street", None)


@query("betweenness_sampled", "node betweenness:9", _betweenness_sql(100))
def betweenness_sampled(s: Shapes):
    return CE.betweenness(_simple(s), k=100)


def _weighted(e):
    return e.withColumn("length", (F.col("street") % 97 + 1).cast("double"))


# all sources with weights: distances by relaxation, path counts and dependencies summed over paths of all lengths
_WEIGHTED = f"""vw AS (SELECT src, dst, CAST(street % 97 + 1 AS DOUBLE) AS w FROM v_simple UNION ALL SELECT dst, src, CAST(street % 97 + 1 AS DOUBLE) FROM v_simple),
    bk(s, v, d) USING KEY (s, v) AS (SELECT node, node, 0.0::DOUBLE FROM ({_NODES}) UNION SELECT b.s, e.dst, min(b.d + e.w) FROM bk b JOIN vw e ON e.src = b.v LEFT JOIN recurring.bk r ON r.s = b.s AND r.v = e.dst WHERE r.v IS NULL OR b.d + e.w < r.d GROUP BY b.s, e.dst),
    dag AS MATERIALIZED (SELECT a.s, a.v AS u, b.v AS t FROM bk a JOIN vw e ON e.src = a.v JOIN bk b ON b.s = a.s AND b.v = e.dst AND b.d = a.d + e.w),
    walk(s, v, n) AS (SELECT node, node, 1.0::DOUBLE FROM ({_NODES}) UNION ALL SELECT g.s, dag.t, sum(g.n) FROM walk g JOIN dag ON dag.s = g.s AND dag.u = g.v GROUP BY ALL),
    sg AS MATERIALIZED (SELECT s, v, sum(n) AS n FROM walk GROUP BY ALL),
    h(s, v, x) AS (SELECT s, v, 1 / n FROM sg UNION ALL SELECT h.s, dag.u, sum(h.x) FROM h JOIN dag ON dag.s = h.s AND dag.t = h.v GROUP BY ALL),
    y AS MATERIALIZED (SELECT s, v, sum(x) AS y FROM h GROUP BY ALL), n AS (SELECT count(*) AS n FROM ({_NODES}))"""


@query("betweenness_exact", "node betweenness:9", f"""WITH RECURSIVE {_WEIGHTED}, b AS (SELECT v, sum(n * y - 1) AS x FROM sg JOIN y USING (s, v) WHERE s <> v GROUP BY v)
--final
SELECT node, coalesce(x, 0) / ((n - 1) * (n - 2)) AS betweenness FROM ({_NODES}) LEFT JOIN b ON b.v = node, n""")
def betweenness_exact(s: Shapes):
    return CE.betweenness(_weighted(_simple(s)), "length")


@query("edge_betweenness_exact", "street betweenness:9", f"""WITH RECURSIVE {_WEIGHTED}, c AS (SELECT least(dag.u, dag.t) AS a, greatest(dag.u, dag.t) AS b, sum(sg.n * y.y) AS x FROM dag JOIN sg ON sg.s = dag.s AND sg.v = dag.u JOIN y ON y.s = dag.s AND y.v = dag.t GROUP BY 1, 2), e AS (SELECT street, x FROM v_simple JOIN c ON c.a = least(src, dst) AND c.b = greatest(src, dst))
--final
SELECT street, coalesce(x, 0) / (n * (n - 1)) AS betweenness FROM v_streets LEFT JOIN e USING (street), n""")
def edge_betweenness_exact(s: Shapes):
    return CE.line_betweenness(_weighted(s.streets()), "street", "length")


@query("betweenness_within", "node betweenness bound sources")
def betweenness_within(s: Shapes):
    # values within 0.05 of the exact ones, with probability 0.9 for all nodes together
    return CE.betweenness_within(_simple(s), 0.05, 0.9)


@query("closeness", "node closeness:9", f"""WITH RECURSIVE {_BFS}
--final
SELECT s AS node, CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d) * (count(*) - 1) / ((SELECT count(*) FROM ({_NODES})) - 1) ELSE 0 END AS closeness FROM bfs GROUP BY s""")
def closeness(s: Shapes):
    return CE.closeness(_simple(s))


@query("eccentricities", "node eccentricity reach distance_sum", f"WITH RECURSIVE {_BFS}\n--final\nSELECT s AS node, CAST(max(d) AS DOUBLE) AS eccentricity, CAST(count(*) AS DOUBLE) AS reach, CAST(sum(d) AS DOUBLE) AS distance_sum FROM bfs GROUP BY s")
def eccentricities(s: Shapes):
    return CE.eccentricities(_simple(s))


@query("path_summary", "diameter radius avg_path_length:8 center_size periphery_size", f"""WITH RECURSIVE {_BFS}, e AS (SELECT s, max(d) AS e, count(*) AS r, sum(d) AS t FROM bfs GROUP BY s)
--final
SELECT CAST(max(e) AS DOUBLE) AS diameter, CAST(min(e) AS DOUBLE) AS radius, sum(t) / sum(r - 1) AS avg_path_length, count(*) FILTER (e = (SELECT min(e) FROM e)) AS center_size, count(*) FILTER (e = (SELECT max(e) FROM e)) AS periphery_size FROM e""")
def path_summary(s: Shapes):
    return CE.path_summary(CE.eccentricities(_simple(s)))


@query("communities", "node settled", f"SELECT DISTINCT unnest([src, dst]) AS node, true AS settled FROM v_simple WHERE src <> dst")
def communities(s: Shapes):
    # settled: no label is commoner around a node than its own
    e = cut_lineage(_simple(s).where(F.col("src") != F.col("dst")).select("src", "dst"))
    c = GR.communities(e)
    around = GR.bidirectional_edges(e).join(c.select(F.col("node").alias("dst"), F.col("community").alias("label")), "dst")
    votes = around.groupBy("src", "label").agg(F.count(F.lit(1)).alias("n")).join(c.select(F.col("node").alias("src"), "community"), "src")
    own = F.coalesce(F.max(F.when(F.col("label") == F.col("community"), F.col("n"))), F.lit(0))
    return votes.groupBy(F.col("src").alias("node")).agg((F.max("n") <= own).alias("settled"))


@query("community_labels", "node community")
def community_labels(s: Shapes):
    return GR.communities(_simple(s))


@query("community_modularity", "communities modularity:8")
def community_modularity(s: Shapes):
    e = cut_lineage(_simple(s))
    return GR.modularity(e, GR.communities(e))


@query("louvain", "node community modularity:8")
def louvain(s: Shapes):
    labels, levels = CO.louvain(_simple(s))
    return labels.withColumn("modularity", levels.agg(F.max("modularity")).scalar())


@query("modularity", "communities modularity:8", f"""WITH l AS (SELECT node, node % 10 AS c FROM ({_NODES})), d AS (SELECT c, sum(degree) AS d FROM ({_DEG}) JOIN l USING (node) GROUP BY c), i AS (SELECT a.c, count(*) AS l FROM v_simple JOIN l a ON a.node = src JOIN l b ON b.node = dst WHERE a.c = b.c GROUP BY a.c), m AS (SELECT count(*) AS m FROM v_simple)
--final
SELECT count(*) AS communities, sum(coalesce(l, 0) / m - (d / (2 * m)) ** 2) AS modularity FROM d LEFT JOIN i USING (c), m""")
def modularity(s: Shapes):
    e = _simple(s)
    return GR.modularity(e, GR.nodes_of(e).withColumn("community", F.col("node") % 10))


@query("contract_degree2", "src dst street length:3 merged", f"""WITH RECURSIVE i AS (SELECT node FROM ({_DEG}) WHERE degree = 2), t AS (SELECT unnest([src, dst]) AS node, street FROM v_simple), l AS (SELECT min(street) AS a, max(street) AS b FROM t JOIN i USING (node) GROUP BY node), lb AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    cc(n, c) USING KEY (n) AS (SELECT street, street FROM v_simple UNION SELECT lb.b, min(cc.c) FROM cc JOIN lb ON lb.a = cc.n JOIN recurring.cc r ON r.n = lb.b WHERE cc.c < r.c GROUP BY lb.b),
    e AS (SELECT c AS chain, street, src, dst FROM cc JOIN v_simple ON street = n), z AS (SELECT chain, min(node) AS a, max(node) AS b FROM (SELECT chain, unnest([src, dst]) AS node FROM e) WHERE node NOT IN (SELECT node FROM i) GROUP BY chain),
    g AS (SELECT coalesce(a, m) AS src, coalesce(b, m) AS dst, street, merged FROM (SELECT chain, min(street) AS street, count(*) AS merged, min(src) AS m FROM e GROUP BY chain) LEFT JOIN z USING (chain)), k AS (SELECT * FROM g WHERE merged = 1)
--final
SELECT src, dst, street, CAST(merged AS DOUBLE) AS length, merged FROM k UNION ALL SELECT src, dst, min(street), CAST(arg_min(merged, street) AS DOUBLE), arg_min(merged, street) FROM g WHERE merged > 1 AND (least(src, dst), greatest(src, dst)) NOT IN (SELECT (least(src, dst), greatest(src, dst)) FROM k) GROUP BY src, dst""")
def contract_degree2(s: Shapes):
    return GR.contract_degree2(cut_lineage(_simple(s).withColumn("length", F.lit(1.0))), "street")


@query("drainage_digraph", "reach src dst", f"""WITH g AS (SELECT reach, {_px('src')} AS ax, {_py('src')} AS ay, {_px('dst')} AS qx, {_py('dst')} AS qy FROM v_reaches), a AS (SELECT reach, arg_min(erb, ((ax - x) ** 2 + (ay - y) ** 2, erb)) AS src FROM g, v_stations GROUP BY reach), b AS (SELECT reach, arg_min(erb, ((qx - x) ** 2 + (qy - y) ** 2, erb)) AS dst FROM g, v_stations GROUP BY reach)
--final
SELECT reach, src, dst FROM a JOIN b USING (reach)""")
def drainage_digraph(s: Shapes):
    a = G.point(Shapes._x(F.col("src")), Shapes._y(F.col("src")))
    b = G.point(Shapes._x(F.col("dst")), Shapes._y(F.col("dst")))
    seg = s.reaches().select("reach", F.array(a, b).alias("coords"))
    return GR.drainage_digraph(seg, s.stations().select(F.col("erb").alias("node"), "x", "y"), "reach", "coords")


@query("flow_accumulation", "node acc:9", """WITH RECURSIVE e AS (SELECT src, dst, max(strahler) / 7 AS w FROM v_reaches GROUP BY ALL), p(a, v, w) AS (SELECT src, src, 1.0::DOUBLE FROM (SELECT DISTINCT src FROM e WHERE src NOT IN (SELECT dst FROM e)) UNION ALL SELECT p.a, e.dst, p.w * e.w FROM p JOIN e ON e.src = p.v)
--final
SELECT v AS node, sum(w) AS acc FROM p GROUP BY v""")
def flow_accumulation(s: Shapes):
    return GR.flow_accumulation(s.reaches().withColumn("weight", F.col("strahler") / 7))


@query("edge_class_pairs", "class_a class_b edges", "SELECT least(src % 5, dst % 7) AS class_a, greatest(src % 5, dst % 7) AS class_b, count(*) AS edges FROM (SELECT * FROM v_simple) GROUP BY ALL")
def edge_class_pairs(s: Shapes):
    e = _simple(s)
    # ends carry separate classes through disjoint node names
    named = e.select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst"))
    n = GR.nodes_of(named)
    half = F.floor(F.col("node") / 2)
    return GR.edge_class_pairs(named, n.select("node", F.when(F.col("node") % 2 == 0, half % 5).otherwise(half % 7).alias("class")))


@query("node_classes", "node cls common", """WITH i AS (SELECT unnest([src, dst]) AS node, code FROM v_simple), m AS (SELECT node, code, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, code) AS r FROM i GROUP BY node, code)
--final
SELECT i.node, min(i.code) AS cls, any_value(m.code) AS common FROM i JOIN m ON m.node = i.node AND r = 1 GROUP BY i.node""")
def node_classes(s: Shapes):
    e = _simple(s)
    a = GR.node_classes(e, "code", "min", 8).withColumnRenamed("class", "cls")
    return a.join(GR.node_classes(e, "code", "most_common").withColumnRenamed("class", "common"), "node")


@query("node_features", "node degree missing total:4", f"SELECT node, CAST(degree AS DOUBLE) AS degree, 0.0::DOUBLE AS missing, degree AS total FROM ({_DEG})")
def node_features(s: Shapes):
    n = FE.node_features(GR.degree(_simple(s)).withColumn("missing", F.lit(None).cast("double")), ["degree", "missing", "absent"])
    v = FE.feature_vector(n, "node", ["degree", "missing"])
    return v.withColumn("total", F.aggregate("features", F.lit(0.0), lambda a, b: a + b))


@query("edge_features", "src dst code", "SELECT src, dst, CAST(code AS DOUBLE) AS code FROM v_simple")
def edge_features(s: Shapes):
    return FE.edge_features(_simple(s), ["code", "absent"])


@query("neighbour_aggregate", "node degree degree_h1:8 degree_h2:8", f"""WITH d AS ({_DEG}), h1 AS (SELECT a.src AS node, avg(degree) AS h FROM v_both a JOIN d ON d.node = a.dst GROUP BY 1), h2 AS (SELECT a.src AS node, avg(h) AS h FROM v_both a JOIN h1 ON h1.node = a.dst GROUP BY 1)
--final
SELECT d.node, degree, h1.h AS degree_h1, h2.h AS degree_h2 FROM d JOIN h1 USING (node) JOIN h2 ON h2.node = d.node""")
def neighbour_aggregate(s: Shapes):
    e = cut_lineage(_simple(s))
    return FE.neighbour_aggregate(e, GR.degree(e), ["degree"], 2)


@query("node_classifier", "n predicted")
def node_classifier(s: Shapes):
    e = cut_lineage(_simple(s))
    f = FE.neighbour_aggregate(e, GR.degree(e), ["degree"], 2).join(GR.node_classes(e, "code"), "node")
    p = FE.fit_node_classifier(FE.random_split(f, "node"), ["degree", "degree_h1", "degree_h2"], "class")
    return p.agg(F.count(F.lit(1)).alias("n"), F.count("prediction").alias("predicted"))


@query("largest_component_subgraph", "nodes edges lo hi", f"""WITH RECURSIVE {_CC}, t AS (SELECT component FROM cc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), n AS (SELECT node FROM cc WHERE component = (SELECT component FROM t))
--final
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM v_simple WHERE src IN (SELECT node FROM n)) AS edges, 0::BIGINT AS lo, (SELECT count(*) FROM n) - 1 AS hi""")
def largest_component_subgraph(s: Shapes):
    e = cut_lineage(_simple(s))
    n, e2 = GR.largest_component_subgraph(e, GR.nodes_of(e))
    return n.agg(F.count(F.lit(1)).alias("nodes"), F.min("new_id").alias("lo"), F.max("new_id").alias("hi")).withColumn("edges", e2.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("graph_dataset_profile", "section key value:6", f"""WITH d AS ({_DEG}), c AS (SELECT node, min(code) AS c FROM (SELECT unnest([src, dst]) AS node, code FROM v_simple) GROUP BY node)
--final
SELECT 'nodes' AS section, 'count' AS key, CAST(count(*) AS DOUBLE) AS value FROM d UNION ALL SELECT 'edges', 'count', CAST(count(*) AS DOUBLE) FROM v_simple UNION ALL SELECT 'labels', CAST(c AS VARCHAR), CAST(count(*) AS DOUBLE) FROM c GROUP BY c
    UNION ALL SELECT 'features', unnest(['degree:mean', 'degree:std', 'degree:min', 'degree:max']), unnest([avg(degree), stddev_samp(degree), min(degree), max(degree)]) FROM d""")
def graph_dataset_profile(s: Shapes):
    e = cut_lineage(_simple(s))
    return FE.graph_dataset_profile(GR.degree(e).join(GR.node_classes(e, "code"), "node"), e, ["degree"], "class")


@query("centrality_stats", "column count min max mean:6 std:6 median:6", f"""SELECT 'degree' AS "column", count(*) AS count, CAST(min(degree) AS DOUBLE) AS min, CAST(max(degree) AS DOUBLE) AS max, avg(degree) AS mean, stddev_pop(degree) AS std, median(degree) AS median FROM ({_DEG})""")
def centrality_stats(s: Shapes):
    return P.basic_stats(GR.degree(_simple(s)), ["degree"])


@query("graph_recommendations", "recommendation", f"WITH RECURSIVE {_CC}\n--final\nSELECT 'disconnected' AS recommendation WHERE (SELECT count(DISTINCT component) FROM cc) > 1")
def graph_recommendations(s: Shapes):
    return P.graph_recommendations(GR.graph_summary(cut_lineage(_simple(s))))


@query("rail_importance", "street pontuacao_importancia:8 nivel_importancia", """SELECT street, v AS pontuacao_importancia, CASE WHEN v < 0.2 THEN 'Baixa' WHEN v < 0.4 THEN 'Média-Baixa' WHEN v < 0.6 THEN 'Média' WHEN v < 0.8 THEN 'Alta' ELSE 'Crítica' END AS nivel_importancia FROM (SELECT street, 0.4::DOUBLE * ((street % 101) / 100.0::DOUBLE) + 0.3::DOUBLE * ((src % 11) / 10.0::DOUBLE) + (0.3::DOUBLE * (dst + 1)::DOUBLE) / (max(dst) OVER () + 1)::DOUBLE AS v FROM v_streets)""")
def rail_importance(s: Shapes):
    d = s.streets().withColumns({"betweenness": (F.col("street") % 101) / 100.0, "degree_centrality": (F.col("src") % 11) / 10.0, "length_km": (F.col("dst") + 1).cast("double")})
    return TE.rail_importance(d)


@query("road_quality_metrics", "pct_straight:6 pct_winding:6 slope_mean:6 pct_high_slope:6 intersections_per_km2:6 avg_intersection_degree:6", f"""SELECT avg((v < 1.05)::INT) * 100 AS pct_straight, avg((v > 1.2)::INT) * 100 AS pct_winding, avg(p) AS slope_mean, avg((p > 8)::INT) * 100 AS pct_high_slope, (SELECT count(*) FROM ({_DEG}) WHERE degree > 2) / 100 AS intersections_per_km2, (SELECT avg(degree) FROM ({_DEG}) WHERE degree > 2) AS avg_intersection_degree
    FROM (SELECT 1 + (o_orderkey % 60) / 100.0::DOUBLE AS v, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 20 END AS p FROM orders)""")
def road_quality_metrics(s: Shapes):
    r = s.orders.select((1 + (F.col("o_orderkey") % 60) / 100.0).alias("sinuosity"), F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey") % 20).alias("slope_pct"))
    return TE.road_quality_metrics(r, GR.intersections(_simple(s), "street"), F.lit(100.0))


@query("drainage_density", "layer length_km:6 density:8", """WITH a AS (SELECT 'roads' AS layer, sum(len) / 1000 AS length_km FROM v_roadlen)
--final
SELECT layer, length_km, length_km / ((SELECT (max(greatest(ax, qx)) - min(least(ax, qx))) * (max(greatest(ay, qy)) - min(least(ay, qy))) FROM v_segs) / 1e6) AS density FROM (SELECT * FROM a UNION ALL SELECT 'total', length_km FROM a)""")
def drainage_density(s: Shapes):
    return H.drainage_density({"roads": s.roads()}, "coords")


@query("drainage_pattern", "dendritic_score:8 parallel_score:8 rectangular_score:8 pattern confidence:8", """WITH a AS (SELECT least(17, floor(((degrees(atan2(c[len(c)].y - c[1].y, c[len(c)].x - c[1].x)) + 180) % 180) / 10)) AS b, count(*) AS n FROM v_roads GROUP BY 1), p AS (SELECT r.range AS b, coalesce(n, 0) / (SELECT sum(n) FROM a) AS p FROM range(18) r LEFT JOIN a ON a.b = r.range), s AS (SELECT 1 - stddev_pop(p) * 10 AS d, max(p) * 2 AS l, sum(p) FILTER (b IN (0, 9)) * 1.5 AS r FROM p)
--final
SELECT d AS dendritic_score, l AS parallel_score, r AS rectangular_score, CASE WHEN d >= l AND d >= r AND d >= 0 THEN 'dendrítico' WHEN l >= r AND l >= 0 THEN 'paralelo' WHEN r >= 0 THEN 'retangular' ELSE 'radial' END AS pattern, least(1, greatest(d, l, r, 0)) AS confidence FROM s""")
def drainage_pattern(s: Shapes):
    return H.drainage_pattern(s.roads(), "coords")


@query("water_quality_indices", "mean_sinuosity:8 high_sinuosity_pct:6 sinuosity_quality:8 drainage_quality connectivity_quality:8", """SELECT avg(v) AS mean_sinuosity, avg((v > 1.5)::INT) * 100 AS high_sinuosity_pct, avg((v > 1.5)::INT) * 0.7 + (1 - avg((v < 1.05)::INT)) * 0.3 AS sinuosity_quality, 0.6::DOUBLE AS drainage_quality, greatest(0, least(1, (1 - 10 / 1000.0) * 0.4 + 0.001 * 3 + 0.4 * 0.3)) AS connectivity_quality FROM (SELECT 1 + (o_orderkey % 60) / 100.0::DOUBLE AS v FROM orders)""")
def water_quality_indices(s: Shapes):
    r = s.orders.select((1 + (F.col("o_orderkey") % 60) / 100.0).alias("v"))
    q = H.connectivity_quality(F.lit(10), F.lit(0.001), F.lit(400), F.lit(1000))
    return H.water_quality_indices(r, "v", F.lit(2.0), q)
