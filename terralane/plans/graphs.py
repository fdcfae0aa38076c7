"""Queries over networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralane.operators import networks as N
from terralane.operators.checkpoints import cut

from .fixtures import NATIONS, TRADE, nations, table, trade

R = F.round
C = F.col

BASE = f"WITH {NATIONS}, {TRADE}"
#: Cheapest ways by rounds of relaxation; the node count bounds the rounds.
PATHS = f"""WITH RECURSIVE {NATIONS}, {TRADE}, walk AS (
  SELECT id AS source, id AS node, 0.0::DOUBLE AS distance, 0 AS hops FROM nodes
  UNION
  SELECT source, node, distance, hops FROM (
    SELECT w.source, h.dst AS node, w.distance + h.weight AS distance, w.hops + 1 AS hops,
           row_number() OVER (PARTITION BY w.source, h.dst ORDER BY w.distance + h.weight, w.hops) AS k
    FROM walk w JOIN half h ON h.src = w.node WHERE w.hops < 12
  ) WHERE k = 1
), paths AS (
  SELECT source, node, min(distance) AS distance, arg_min(hops, distance) AS hops FROM walk GROUP BY 1, 2
)"""


def _paths(spark, sf):
    half = cut(N.both_ways(trade(spark, sf)))
    return N.shortest_paths(half, nations(spark, sf).select("id"))


def n04_shortest_paths(spark, sf):
    return _paths(spark, sf).select("source", "node", R("distance", 6).alias("distance"))


def n05_shortest_path(spark, sf):
    half = cut(N.both_ways(trade(spark, sf)))
    one = N.shortest_paths(half, nations(spark, sf).where("id = 0").select("id"))
    return one.select("node", R("distance", 6).alias("distance"))


def n06_astar(spark, sf):
    half = N.both_ways(trade(spark, sf))
    pairs = nations(spark, sf).select(C("id").alias("source"), ((C("id") * 7 + 3) % 25).alias("target"))
    found = N.astar(nations(spark, sf), half, pairs, exact=True)
    return found.select("source", "target", "exists", R("distance", 6).alias("distance"))


def n07_greedy(spark, sf):
    half = N.both_ways(trade(spark, sf))
    pairs = nations(spark, sf).select(C("id").alias("source"), ((C("id") * 7 + 3) % 25).alias("target"))
    return N.astar(nations(spark, sf), half, pairs, greedy=10).select("source", "target", "exists", "distance")


def n09_components(spark, sf):
    return N.components(nations(spark, sf), trade(spark, sf))


def n10_clustering_coefficient(spark, sf):
    c = N.clustering_coefficient(nations(spark, sf), trade(spark, sf))
    return c.select("id", R("coefficient", 9).alias("coefficient"))


def n11_degrees(spark, sf):
    return N.degrees(nations(spark, sf), trade(spark, sf))


def n12_closeness(spark, sf):
    c = N.harmonic_closeness(nations(spark, sf), _paths(spark, sf))
    return c.select("id", R("closeness", 6).alias("closeness"))


def n13_hop_centrality(spark, sf):
    c = N.hop_centrality(nations(spark, sf), _paths(spark, sf))
    return c.select("id", R("centrality", 6).alias("centrality"))


def n14_betweenness(spark, sf):
    return N.betweenness(nations(spark, sf), _paths(spark, sf))


def a12_modularity(spark, sf):
    m = N.modularity(trade(spark, sf), nations(spark, sf).select("id", "community"))
    return m.select(R("modularity", 9).alias("modularity"))


def a13_community_weights(spark, sf):
    w = N.community_weights(trade(spark, sf), nations(spark, sf).select("id", "community"))
    return w.select("community", R("inner", 6).alias("inner"), R("outer", 6).alias("outer"))


def a16_roll_up_nodes(spark, sf):
    up, _ = N.roll_up(nations(spark, sf).drop("community"), trade(spark, sf), nations(spark, sf).select("id", "community"))
    return up.select("id", R("x", 6).alias("x"), R("y", 6).alias("y"), "n")


def a16_roll_up_arcs(spark, sf):
    _, arcs = N.roll_up(nations(spark, sf).drop("community"), trade(spark, sf), nations(spark, sf).select("id", "community"))
    return arcs


def n01_delete_nodes(spark, sf):
    gone = nations(spark, sf).where("id % 3 = 0").select("id")
    _, arcs = N.delete_nodes(nations(spark, sf), trade(spark, sf), gone)
    return arcs.select("src", "dst", "n")


def j10_resolve(spark, sf):
    r = N.resolve(nations(spark, sf), trade(spark, sf))
    return r.select("src", "dst", R("length", 6).alias("length"))


def j11_layer_network(spark, sf):
    segments = _layer(spark, sf)
    nodes, arcs = N.from_layer(segments)
    ends = arcs.join(nodes.select(C("id").alias("src"), C("x").alias("sx"), C("y").alias("sy")), "src").join(
        nodes.select(C("id").alias("dst"), C("x").alias("tx"), C("y").alias("ty")), "dst"
    )
    return ends.select("fid", "sx", "sy", "tx", "ty")


def _layer(spark, sf):
    p = table(spark, sf, "part")
    k = C("p_partkey")
    return p.select(
        k.alias("fid"),
        (k % 17).cast("double").alias("x1"),
        (k % 13).cast("double").alias("y1"),
        ((k * 3) % 17).cast("double").alias("x2"),
        ((k * 5) % 13).cast("double").alias("y2"),
    )


def j08_link_nearest(spark, sf):
    links = N.link_nearest(nations(spark, sf), 3, 8.0)
    return links.select("src", "dst", R("weight", 6).alias("weight"))


def j09_delaunay(spark, sf):
    return N.delaunay(nations(spark, sf))


def n15_girvan_newman(spark, sf):
    return N.girvan_newman(N.both_ways(trade(spark, sf)))


def n16_louvain(spark, sf):
    return N.louvain(N.both_ways(trade(spark, sf)))


def n19_similarity(spark, sf):
    n = nations(spark, sf).select("id", C("community").cast("string").alias("label"))
    a = trade(spark, sf)
    s = N.weisfeiler_lehman(n, a, n, a.where("src <> 1"))
    return s.select(R("similarity", 9).alias("similarity"))


def n20_directed(spark, sf):
    arcs = trade(spark, sf).withColumn("way", (C("src") + C("n")) % 4)
    return N.directed(arcs).select("src", "dst", R("weight", 6).alias("weight"))


def a18_random_walks(spark, sf):
    half = cut(N.both_ways(trade(spark, sf)))
    starts = nations(spark, sf).select(C("id").alias("walk"), "id")
    walks = N.random_walks(half, starts, steps=6)
    return walks.groupBy("node").agg(F.count("*").alias("visits"))


QUERIES = {
    "n01_delete_nodes": (
        n01_delete_nodes,
        f"{BASE} SELECT src, dst, n FROM arcs WHERE src % 3 <> 0 AND dst % 3 <> 0",
    ),
    "n04_shortest_paths": (n04_shortest_paths, f"{PATHS} SELECT source, node, round(distance, 6) AS distance FROM paths"),
    "n05_shortest_path": (n05_shortest_path, f"{PATHS} SELECT node, round(distance, 6) AS distance FROM paths WHERE source = 0"),
    "n06_astar": (
        n06_astar,
        f"{PATHS} SELECT n.id AS source, (n.id * 7 + 3) % 25 AS target, distance IS NOT NULL AS exists, round(distance, 6) AS distance "
        "FROM nodes n LEFT JOIN paths p ON p.source = n.id AND p.node = (n.id * 7 + 3) % 25",
    ),
    "n07_greedy": (n07_greedy, None),
    "n09_components": (
        n09_components,
        f"""WITH RECURSIVE {NATIONS}, {TRADE}, reach AS (
  SELECT id AS s, id AS d FROM nodes UNION SELECT r.s, h.dst FROM reach r JOIN half h ON r.d = h.src
) SELECT s AS id, min(d) AS component FROM reach GROUP BY 1""",
    ),
    "n10_clustering_coefficient": (
        n10_clustering_coefficient,
        f"""{BASE}, h AS (SELECT DISTINCT src, dst FROM half WHERE src <> dst), k AS (SELECT src AS id, count(*) AS k FROM h GROUP BY 1),
t AS (SELECT a.src AS id, count(*) AS n FROM h a JOIN h b ON a.src = b.src AND a.dst < b.dst JOIN h c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1)
SELECT nodes.id, round(CASE WHEN k >= 2 THEN 2.0 * coalesce(n, 0) / (k * (k - 1)) ELSE 0 END, 9) AS coefficient
FROM nodes LEFT JOIN k USING (id) LEFT JOIN t USING (id)""",
    ),
    "n11_degrees": (
        n11_degrees,
        f"""{BASE} SELECT id, (SELECT count(*) FROM arcs WHERE src = id OR dst = id) AS degree,
(SELECT count(*) FROM arcs WHERE src = id) AS out_degree, (SELECT count(*) FROM arcs WHERE dst = id) AS in_degree FROM nodes""",
    ),
    "n12_closeness": (
        n12_closeness,
        f"{PATHS} SELECT id, round(coalesce(c, -1), 6) AS closeness FROM nodes LEFT JOIN (SELECT source, sum(1 / distance) AS c "
        "FROM paths WHERE distance > 0 GROUP BY 1) ON source = id",
    ),
    "n13_hop_centrality": (
        n13_hop_centrality,
        f"{PATHS} SELECT id, round(coalesce(c, 0), 6) AS centrality FROM nodes LEFT JOIN (SELECT source, sum(power(0.5, hops)) AS c "
        "FROM paths WHERE hops > 0 GROUP BY 1) ON source = id",
    ),
    "n14_betweenness": (n14_betweenness, None),
    "n15_girvan_newman": (n15_girvan_newman, None),
    "n16_louvain": (n16_louvain, None),
    "n19_similarity": (
        n19_similarity,
        f"""{BASE}, l AS (SELECT id, CAST(community AS VARCHAR) AS label FROM nodes),
g(g) AS (VALUES (0), (1)),
f AS (SELECT g, h.src AS id, string_agg(l.label, ',' ORDER BY l.label) AS far FROM g, half h JOIN l ON l.id = h.dst
  WHERE g = 0 OR least(h.src, h.dst) <> 1 GROUP BY 1, 2),
m AS (SELECT g.g, md5(l.label || '|' || coalesce(far, '')) AS h FROM g CROSS JOIN l LEFT JOIN f ON f.g = g.g AND f.id = l.id),
c AS (SELECT h, count(*) FILTER (g = 0) AS n, count(*) FILTER (g = 1) AS m FROM m GROUP BY 1)
SELECT round(sum(least(n, m)) / sum(greatest(n, m)), 9) AS similarity FROM c""",
    ),
    "n20_directed": (
        n20_directed,
        f"""{BASE} SELECT src, dst, round(weight, 6) AS weight FROM arcs WHERE (src + n) % 4 IN (1, 2)
UNION ALL SELECT dst, src, round(weight, 6) FROM arcs WHERE (src + n) % 4 IN (1, 3)""",
    ),
    "a12_modularity": (
        a12_modularity,
        f"""{BASE}, j AS (SELECT a.community AS ca, b.community AS cb, weight FROM half JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst),
s AS (SELECT ca, sum(CASE WHEN ca = cb THEN weight ELSE 0 END) AS i, sum(weight) AS w FROM j GROUP BY 1)
SELECT round(sum(i) / sum(w) - sum(w * w) / (sum(w) * sum(w)), 9) AS modularity FROM s""",
    ),
    "a13_community_weights": (
        a13_community_weights,
        f"""{BASE}, j AS (SELECT a.community AS ca, b.community AS cb, weight FROM half JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst)
SELECT ca AS community, round(sum(CASE WHEN ca = cb THEN weight ELSE 0 END) / 2, 6) AS inner,
round(sum(CASE WHEN ca = cb THEN 0 ELSE weight END), 6) AS outer FROM j GROUP BY 1""",
    ),
    "a16_roll_up_nodes": (
        a16_roll_up_nodes,
        f"{BASE} SELECT community AS id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM nodes GROUP BY 1",
    ),
    "a16_roll_up_arcs": (
        a16_roll_up_arcs,
        f"""{BASE} SELECT a.community AS src, b.community AS dst, CAST(count(*) AS DOUBLE) AS weight FROM arcs
JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.community <> b.community GROUP BY 1, 2""",
    ),
    "a18_random_walks": (a18_random_walks, None),
    "j08_link_nearest": (
        j08_link_nearest,
        f"""WITH {NATIONS}, d AS (SELECT a.id AS src, b.id AS dst, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS w FROM nodes a, nodes b WHERE a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w, dst) AS k FROM d WHERE w <= 8)
SELECT src, dst, round(w, 6) AS weight FROM r WHERE k <= 3""",
    ),
    "j09_delaunay": (j09_delaunay, None),
    "j10_resolve": (
        j10_resolve,
        f"{BASE} SELECT src, dst, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6) AS length FROM arcs JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst",
    ),
    "j11_layer_network": (
        j11_layer_network,
        """WITH l AS (SELECT p_partkey AS fid, CAST(p_partkey % 17 AS DOUBLE) AS sx, CAST(p_partkey % 13 AS DOUBLE) AS sy,
CAST(p_partkey * 3 % 17 AS DOUBLE) AS tx, CAST(p_partkey * 5 % 13 AS DOUBLE) AS ty FROM part)
SELECT * FROM l WHERE NOT (sx = tx AND sy = ty)""",
    ),
}
