"""Queries of the graph operators, and their SQL.

g0: vertices and references of the graph tables, a multigraph with hubs; g1: suppliers that hand large orders on to each
other; g2: users by consecutive high-value sign-ups; g3: users by consecutive purchases, a multigraph with self-loops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphskein.graph import Graph
from graphskein.operators import betweenness as bt
from graphskein.operators import coarsening, community, links, louvain, measures, neighbours, paths, spectral, walks
from graphskein.plans.fixpoint import pregel
from graphskein.queries.tables import table

G0_V = "SELECT DISTINCT id FROM graph_vertex"
G0_E = "SELECT subject AS src, objectuid AS dst FROM (SELECT DISTINCT edge_id, subject, objectuid FROM dgraph_edge) WHERE subject IS NOT NULL AND objectuid IS NOT NULL"
G1_V = "SELECT s_suppkey AS id FROM supplier"
G1_E = "SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 45 AND b.l_quantity >= 45 AND a.l_suppkey <> b.l_suppkey"
G2_V = "SELECT DISTINCT user_id AS id FROM events"
G2_E = "SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY event_id) AS dst FROM events WHERE event_type = 'signup' AND value >= 100) t WHERE dst IS NOT NULL AND src <> dst"
G3_V = G2_V
G3_E = "SELECT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY event_id) AS dst FROM events WHERE event_type = 'purchase') t WHERE dst IS NOT NULL"


def g0(spark: SparkSession, d: str) -> Graph:
    e = table(spark, d, "dgraph_edge").select("edge_id", F.col("subject").alias("src"), F.col("objectuid").alias("dst")).distinct()
    return Graph(table(spark, d, "graph_vertex").select("id").distinct(), e.select("src", "dst"))


def g0_kinds(spark: SparkSession, d: str) -> Graph:
    v = table(spark, d, "graph_vertex").groupBy("id").agg(F.coalesce(F.min(F.lower(F.trim("kind"))), F.lit("")).alias("kind"))
    return Graph(v, g0(spark, d).edges)


def g1(spark: SparkSession, d: str) -> Graph:
    big = table(spark, d, "lineitem").where("l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_suppkey")
    a = big.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_suppkey").alias("src"))
    e = a.join(big.withColumnRenamed("l_suppkey", "dst"), ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct()
    return Graph(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), e)


def _handed_on(spark: SparkSession, d: str, condition: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    chosen = events.where(condition)  # a sequence over all events has one order, hence one window
    e = chosen.select(F.col("user_id").alias("src"), F.lead("user_id").over(Window.orderBy("event_id")).alias("dst")).where("dst is not null")
    return events.select(F.col("user_id").alias("id")).distinct(), e


def g2(spark: SparkSession, d: str) -> Graph:
    v, e = _handed_on(spark, d, "event_type = 'signup' and value >= 100")
    return Graph(v, e.where("src <> dst").distinct())


def g3(spark: SparkSession, d: str) -> Graph:
    return Graph(*_handed_on(spark, d, "event_type = 'purchase'"))


GRAPHS: dict[str, tuple[Callable, str, str]] = {"g0": (g0, G0_V, G0_E), "g1": (g1, G1_V, G1_E), "g2": (g2, G2_V, G2_E), "g3": (g3, G3_V, G3_E)}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _with(name: str, body: str, more: str = "", recursive: bool = False) -> str:
    _, v, e = GRAPHS[name]
    return f"WITH {'RECURSIVE ' * recursive}v AS MATERIALIZED ({v}), e AS MATERIALIZED ({e}){more} {body}"


def _add(key: str, graph: str, run: Callable[[Graph], DataFrame], body: str | None = None, more: str = "", recursive: bool = False) -> None:
    make = GRAPHS[graph][0]
    name = f"{key}_{graph}"
    QUERIES[name] = lambda spark, d: run(make(spark, d))
    if body:
        SQL[name] = _with(graph, body, more, recursive)


def _round(df: DataFrame, *names: str) -> DataFrame:
    """Rounded to six decimals; infinite values become null, as hashed columns need."""
    return df.withColumns({n: F.round(F.when(F.abs(F.col(n)) != float("inf"), F.col(n)), 6) for n in names})


# one and two hops
_NEAR = ", nb AS MATERIALIZED (SELECT DISTINCT src AS v, dst AS w FROM e), k AS MATERIALIZED (SELECT v, count(*) AS k FROM nb GROUP BY v)"
_NEAR_U = ", b2 AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), nb AS MATERIALIZED (SELECT DISTINCT src AS v, dst AS w FROM b2), k AS MATERIALIZED (SELECT v, count(*) AS k FROM nb GROUP BY v)"
_COMMON = _NEAR + ", p AS (SELECT DISTINCT src, dst FROM e), cn AS MATERIALIZED (SELECT p.src, p.dst, count(*) AS c, CASE WHEN min(coalesce(k.k, 2)) = 1 THEN NULL ELSE sum(CASE WHEN k.k > 1 THEN 1 / ln(k.k) ELSE 0 END) END AS aa FROM p JOIN nb x ON x.v = p.src JOIN nb y ON y.v = p.dst AND y.w = x.w LEFT JOIN k ON k.v = x.w GROUP BY p.src, p.dst)"
_COMMON_U = _NEAR_U + ", p AS (SELECT DISTINCT src, dst FROM b2), cn AS MATERIALIZED (SELECT p.src, p.dst, count(*) AS c FROM p JOIN nb x ON x.v = p.src JOIN nb y ON y.v = p.dst AND y.w = x.w GROUP BY p.src, p.dst)"
_BY_EDGE = "SELECT e.src, e.dst, {value} AS measure FROM e LEFT JOIN cn ON cn.src = e.src AND cn.dst = e.dst"
_CLUSTER = "SELECT v.id, round(coalesce(CASE WHEN k.k > 1 THEN s.s / (k.k * (k.k - 1)) END, 0), 6) AS measure FROM v LEFT JOIN k ON k.v = v.id LEFT JOIN (SELECT b.src, cast(sum(c) AS DOUBLE) AS s FROM {bag} b JOIN cn ON cn.src = b.src AND cn.dst = b.dst GROUP BY b.src) s ON s.src = v.id"
_EMBED = "SELECT v.id, round(coalesce(s.s / k.k, 0), 6) AS measure FROM v LEFT JOIN k ON k.v = v.id LEFT JOIN (SELECT e.src, sum(c / (ka.k + kb.k - c)) AS s FROM e JOIN cn ON cn.src = e.src AND cn.dst = e.dst JOIN k ka ON ka.v = e.src JOIN k kb ON kb.v = e.dst GROUP BY e.src) s ON s.src = v.id"
for _g in ("g0", "g3"):
    _add("common_neighbors", _g, measures.common_neighbors, _BY_EDGE.format(value="CAST(coalesce(c, 0) AS INTEGER)"), _COMMON)
    _add("adamic_adar", _g, lambda g: _round(measures.adamic_adar(g), "measure"), _BY_EDGE.format(value="round(CASE WHEN cn.src IS NULL THEN 0 ELSE aa END, 6)"), _COMMON)
    _add("clustering", _g, lambda g: _round(measures.clustering(g), "measure"), _CLUSTER.format(bag="e"), _COMMON)
    _add("clustering_undirected", _g, lambda g: _round(measures.clustering(g, undirected=True), "measure"), _CLUSTER.format(bag="b2"), _COMMON_U)
    _add("embeddedness", _g, lambda g: _round(measures.embeddedness(g), "measure"), _EMBED, _COMMON)
    _add(
        "neighborhood", _g, lambda g: _round(measures.neighborhood(g), "measure"),
        "SELECT v.id, round(coalesce(m, 0), 6) AS measure FROM v LEFT JOIN (SELECT e.src, avg(coalesce(o.k, 0)) AS m FROM e LEFT JOIN (SELECT src, count(*) AS k FROM e GROUP BY src) o ON o.src = e.dst GROUP BY e.src) x ON x.src = v.id",
    )
    _add("degree", _g, measures.degree, "SELECT v.id, CAST(i.n AS INTEGER) AS inDegree, CAST(o.n AS INTEGER) AS outDegree FROM v JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) i ON i.dst = v.id JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) o ON o.src = v.id")
    _add("degrees_all", _g, neighbours.degrees, "SELECT v.id, coalesce(i.n, 0) AS inDegree, coalesce(o.n, 0) AS outDegree FROM v LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) i ON i.dst = v.id LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) o ON o.src = v.id")
    _add("neighbour_pairs", _g, lambda g: neighbours.neighbour_pairs(g, undirected=True), "SELECT v, w FROM nb", _NEAR_U)
    _add(
        "freeman", _g, lambda g: _round(measures.freeman_table(g), "measure"),
        "SELECT round(sum(top - d) / max((n - 1.0) * (n - 2)), 6) AS measure FROM (SELECT d, max(d) OVER () AS top FROM (SELECT x, count(*) AS d FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e) GROUP BY x)), (SELECT count(*) AS n FROM v)",
    )
    _add("structural_similarity", _g, lambda g: _round(community.structural_similarity(g), "similarity"),
         "SELECT p.src, p.dst, round(coalesce(cn.c, 0) / sqrt(ka.k * kb.k), 6) AS similarity FROM (SELECT DISTINCT src, dst FROM e) p LEFT JOIN cn ON cn.src = p.src AND cn.dst = p.dst JOIN k ka ON ka.v = p.src JOIN k kb ON kb.v = p.dst", _COMMON_U)
_add("second_neighbours", "g2", neighbours.second_neighbours, "SELECT x.v AS id, x.w AS neighbour, y.w AS second FROM nb x LEFT JOIN nb y ON y.v = x.w", _NEAR)
_add("common_neighbors_undirected", "g3", lambda g: measures.common_neighbors(g, undirected=True), _BY_EDGE.format(value="CAST(coalesce(c, 0) AS INTEGER)"), _COMMON_U)

QUERIES["modularity_kind_g0"] = lambda spark, d: _round(measures.modularity_table(g0_kinds(spark, d), "kind"), "measure")
SQL["modularity_kind_g0"] = _with(
    "g0",
    "SELECT round(sum(f / m2 - (a / m2) * (a / m2)), 6) AS measure FROM (SELECT c, sum(CASE WHEN cs = cd THEN 1.0 ELSE 0 END) AS f, count(*) AS a FROM (SELECT cs AS c, cs, cd FROM t UNION ALL SELECT cd, cs, cd FROM t) GROUP BY c), (SELECT 2.0 * count(*) AS m2 FROM t)",
    ", c AS (SELECT id, coalesce(min(lower(trim(kind))), '') AS k FROM graph_vertex GROUP BY id), t AS MATERIALIZED (SELECT a.k AS cs, b.k AS cd FROM e JOIN c a ON a.id = e.src JOIN c b ON b.id = e.dst)",
)

# paths
_REACH = ", r(s, v, d) AS (SELECT id, id, 0 FROM v UNION SELECT r.s, e.dst, r.d + 1 FROM r JOIN e ON e.src = r.v WHERE r.d < 40), dist AS MATERIALIZED (SELECT s, v, min(d) AS d FROM r GROUP BY s, v)"
for _g in ("g1", "g2"):
    _add("closeness", _g, lambda g: _round(paths.closeness(g), "measure"), "SELECT v.id, round(coalesce(1.0 / sum(d), 0), 6) AS measure FROM v LEFT JOIN dist ON dist.s = v.id AND d > 0 GROUP BY v.id", _REACH, True)
    _add("harmonic", _g, lambda g: _round(paths.closeness(g, kind="harmonic", normalize=True), "measure"), "SELECT v.id, round(coalesce(sum(1.0 / d), 0) / max(n - 1), 6) AS measure FROM v CROSS JOIN (SELECT count(*) AS n FROM v) LEFT JOIN dist ON dist.s = v.id AND d > 0 GROUP BY v.id", _REACH, True)
    _add("path_lengths", _g, paths.path_lengths, "SELECT s AS id, v AS target, cast(d AS DOUBLE) AS distance FROM dist", _REACH, True)
    _add("path_lengths_batched", _g, lambda g: paths.path_lengths(g, batch=3), "SELECT s AS id, v AS target, cast(d AS DOUBLE) AS distance FROM dist", _REACH, True)
    _add("shortest_path_lists", _g, lambda g: paths.path_lengths(g, with_paths=True))
    _add("approximate_path_lengths", _g, coarsening.approximate_path_lengths)
    _add("current_flow_betweenness", _g, lambda g: bt.current_flow_betweenness(g))
_add("bfs", "g1", lambda g: paths.bfs(g, g.ids).select("source", "id", "distance"), "SELECT s AS source, v AS id, d AS distance FROM dist", _REACH, True)
_LANDMARKS = [7, 64]
_add("shortest_paths", "g0", lambda g: paths.shortest_paths(g, _LANDMARKS), "SELECT v.id, min(r.d) AS distance, r.s AS reference FROM v JOIN r ON r.v = v.id GROUP BY v.id, r.s",
     ", d AS MATERIALIZED (SELECT DISTINCT src, dst FROM e), r(s, v, d) AS (SELECT id, id, 0 FROM v WHERE id IN (7, 64) UNION SELECT r.s, d.src, r.d + 1 FROM r JOIN d ON d.dst = r.v WHERE r.d < 30)", True)
_add(
    "betweenness", "g1", lambda g: _round(bt.betweenness(g), "measure"),
    "SELECT v.id, round(coalesce(sum(x.sigma * y.sigma / z.sigma), 0) / max((n - 1) * (n - 2)), 6) AS measure FROM v CROSS JOIN n LEFT JOIN (sg x JOIN sg y ON x.v = y.s JOIN sg z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d AND x.v <> x.s AND x.v <> y.v) ON x.v = v.id GROUP BY v.id",
    ", und AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e), p(s, v, d) AS (SELECT id, id, 0 FROM v UNION SELECT p.s, und.b, p.d + 1 FROM p JOIN und ON und.a = p.v WHERE p.d < 10), dist AS MATERIALIZED (SELECT s, v, min(d) AS d FROM p GROUP BY s, v), sg(s, v, d, sigma) AS (SELECT id, id, 0, 1.0::DOUBLE FROM v UNION ALL SELECT sg.s, und.b, sg.d + 1, sum(sg.sigma) FROM sg JOIN und ON und.a = sg.v JOIN dist ON dist.s = sg.s AND dist.v = und.b AND dist.d = sg.d + 1 GROUP BY sg.s, und.b, sg.d), n AS (SELECT count(*)::DOUBLE AS n FROM v)",
    True,
)
QUERIES["betweenness_batched_g2"] = lambda spark, d: _round(bt.betweenness(g2(spark, d), "hua", batch=2), "measure")
SQL["betweenness_batched_g2"] = SQL["betweenness_g1"].replace(G1_V, G2_V).replace(G1_E, G2_E).replace("p.d < 10", "p.d < 40")


# rounds of a fixed number
def _page_rank(k: int, r: float, seeds: list[int] | None = None) -> tuple[str, str]:
    steps = ", o AS MATERIALIZED (SELECT src, count(*) AS n FROM e GROUP BY src), p0 AS MATERIALIZED (" + ("SELECT id, 1.0::DOUBLE AS r FROM v)" if seeds is None else f"SELECT id, id AS reference, 1.0::DOUBLE AS r FROM v WHERE id IN ({', '.join(map(str, seeds))}))")
    for i in range(k):
        if seeds is None:
            steps += f", p{i + 1} AS MATERIALIZED (SELECT v.id, {r} + {1 - r} * coalesce(sum(p.r / o.n), 0) AS r FROM v LEFT JOIN e ON e.dst = v.id LEFT JOIN p{i} p ON p.id = e.src LEFT JOIN o ON o.src = e.src GROUP BY v.id)"
        else:
            steps += f", p{i + 1} AS MATERIALIZED (SELECT id, reference, sum(r) AS r FROM (SELECT e.dst AS id, reference, {1 - r} * p.r / o.n AS r FROM p{i} p JOIN e ON e.src = p.id JOIN o ON o.src = e.src UNION ALL SELECT id, reference, {r} FROM p0) GROUP BY ALL)"
    if seeds is None:
        return steps, f"SELECT id, round(r * (SELECT count(*) / sum(r) FROM p{k}), 6) AS pagerank FROM p{k}"
    return steps, f"SELECT v.id, s.id AS reference, round(coalesce(p.r / t.t, 0), 6) AS pagerank FROM v CROSS JOIN (SELECT id FROM p0) s LEFT JOIN p{k} p ON p.id = v.id AND p.reference = s.id LEFT JOIN (SELECT reference, sum(r) AS t FROM p{k} GROUP BY reference) t ON t.reference = s.id"


def _eigenvector(k: int) -> tuple[str, str]:
    steps = ", x0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT count(*) FROM v) AS x FROM v)"
    for i in range(k):
        steps += f", y{i + 1} AS MATERIALIZED (SELECT v.id, coalesce(sum(x.x), 0) AS y FROM v LEFT JOIN e ON e.dst = v.id LEFT JOIN x{i} x ON x.id = e.src GROUP BY v.id), x{i + 1} AS MATERIALIZED (SELECT id, y / coalesce(nullif((SELECT sqrt(sum(y * y)) FROM y{i + 1}), 0), 1) AS x FROM y{i + 1})"
    return steps, f"SELECT id, round(x, 6) AS measure FROM x{k}"


def _hits(k: int) -> tuple[str, str]:
    steps = ", h0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT count(*) FROM v) AS a, 1.0 / (SELECT count(*) FROM v) AS h FROM v)"
    for i in range(k):
        steps += f", u{i + 1} AS MATERIALIZED (SELECT v.id, coalesce((SELECT sum(p.h) FROM e JOIN h{i} p ON p.id = e.src WHERE e.dst = v.id), 0) AS a, coalesce((SELECT sum(p.a) FROM e JOIN h{i} p ON p.id = e.dst WHERE e.src = v.id), 0) AS h FROM v), h{i + 1} AS MATERIALIZED (SELECT id, a / coalesce(nullif((SELECT max(a) FROM u{i + 1}), 0), 1) AS a, h / coalesce(nullif((SELECT max(h) FROM u{i + 1}), 0), 1) AS h FROM u{i + 1})"
    return steps, f"SELECT id, round(a / (SELECT sum(a) FROM h{k}), 6) AS authority, round(h / (SELECT sum(h) FROM h{k}), 6) AS hub FROM h{k}"


def _labels(k: int) -> tuple[str, str]:
    steps = ", b2 AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), l0 AS MATERIALIZED (SELECT id, id AS label FROM v)"
    for i in range(k):
        steps += f", l{i + 1} AS MATERIALIZED (SELECT l.id, coalesce(m.label, l.label) AS label FROM l{i} l LEFT JOIN (SELECT id, label FROM (SELECT b2.dst AS id, p.label, count(*) AS n FROM b2 JOIN l{i} p ON p.id = b2.src GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1) m ON m.id = l.id)"
    return steps, f"SELECT id, label FROM l{k}"


for _g, _k in (("g0", 10), ("g3", 20)):
    _more, _body = _page_rank(_k, 0.15)
    _add("page_rank", _g, lambda g, k=_k: _round(spectral.page_rank(g.without_dangling(), k), "pagerank"), _body.replace("FROM e ", "FROM e "), _more)
    _more, _body = _eigenvector(8)
    _add("eigenvector", _g, lambda g: _round(spectral.eigenvector(g, tol=-1.0, max_iter=8), "measure"), _body, _more)
    _more, _body = _hits(6)
    _add("hits", _g, lambda g: _round(spectral.hits(g, tol=-1.0, max_iter=6), "authority", "hub"), _body, _more)
    _more, _body = _labels(4)
    _add("label_propagation", _g, lambda g: community.label_propagation(g, 4), _body, _more)
_more, _body = _page_rank(8, 0.15, _LANDMARKS)
_add("personalized_page_rank", "g0", lambda g: _round(spectral.personalized_page_rank(g.without_dangling(), _LANDMARKS, 8), "pagerank"), _body, _more)
# the operators' own rounds and stops; those above are fixed so that SQL can unroll them
_more, _body = _page_rank(20, 0.15)
_add("page_rank_default", "g0", lambda g: _round(spectral.page_rank(g.without_dangling()), "pagerank"), _body, _more)
_more, _body = _page_rank(20, 0.15, _LANDMARKS)
_add("personalized_page_rank_default", "g0", lambda g: _round(spectral.personalized_page_rank(g.without_dangling(), _LANDMARKS), "pagerank"), _body, _more)
_add("hits_default", "g3", lambda g: _round(spectral.hits(g), "authority", "hub"))
for _name in ("page_rank_g0", "page_rank_g3", "personalized_page_rank_g0", "page_rank_default_g0", "personalized_page_rank_default_g0"):
    SQL[_name] = SQL[_name].replace("e AS MATERIALIZED (", "e AS MATERIALIZED (SELECT x.src, x.dst FROM (", 1).replace("), o AS", ") x JOIN v a ON a.id = x.src JOIN v b ON b.id = x.dst), o AS", 1)

# components and communities
_MIN_LABEL = ", l AS MATERIALIZED (SELECT src AS a, dst AS b FROM {links} UNION SELECT dst, src FROM {links}), g(id, c) USING KEY (id) AS (SELECT id, id FROM {ids} UNION SELECT l.b, min(g.c) FROM g JOIN l ON l.a = g.id JOIN recurring.g AS h ON h.id = l.b WHERE g.c < h.c GROUP BY l.b)"
for _g in ("g0", "g2"):
    _ids = "(SELECT id FROM v UNION SELECT src FROM e UNION SELECT dst FROM e)"
    _add("connected_components", _g, community.connected_components, "SELECT v.id, g.c AS component FROM v JOIN g ON g.id = v.id", _MIN_LABEL.format(links="e", ids=_ids), True)
    _sim = _COMMON_U + ", sim AS MATERIALIZED (SELECT p.src, p.dst FROM (SELECT DISTINCT src, dst FROM e) p JOIN cn ON cn.src = p.src AND cn.dst = p.dst JOIN k ka ON ka.v = p.src JOIN k kb ON kb.v = p.dst WHERE cn.c / sqrt(ka.k * kb.k) >= 0.1)"
    _add("pscan", _g, lambda g: community.pscan(g, 0.1), "SELECT v.id, g.c AS label FROM v JOIN g ON g.id = v.id", _sim + _MIN_LABEL.format(links="sim", ids=_ids), True)
    _add("louvain", _g, louvain.louvain)
_add("strongly_connected_components", "g2", lambda g: community.strongly_connected_components(g, 10_000), "SELECT v.id, coalesce(least(min(x.v), v.id), v.id) AS component FROM v LEFT JOIN (SELECT a.s, a.v FROM dist a JOIN dist b ON b.s = a.v AND b.v = a.s) x ON x.s = v.id GROUP BY v.id", _REACH, True)
_add("strongly_connected_components", "g0", lambda g: community.strongly_connected_components(g, 10))
_add("pscan_with_components", "g2", lambda g: community.pscan_with_components(g, 40)[0])
_add("coarse_labels", "g2", lambda g: coarsening.coarse_labels(g, undirected=True))
_add("coarse_edges", "g2", lambda g: coarsening.coarsen(g, undirected=True).edges)
_PREDICT = "SELECT a.v AS src, b.v AS dst FROM nb a JOIN nb b ON b.w = a.w AND a.v {order} b.v WHERE NOT EXISTS (SELECT 1 FROM {known} x WHERE x.src = a.v AND x.dst = b.v) GROUP BY a.v, b.v HAVING count(*) > 1"
_add("predict_links", "g2", lambda g: links.predict_links(g, threshold=1.0), _PREDICT.format(order="<>", known="e"), _NEAR)
_add("predict_links_undirected", "g2", lambda g: links.predict_links(g, threshold=1.0, undirected=True), _PREDICT.format(order="<", known="b2"), _NEAR_U)
_add("sample_by_walks", "g2", lambda g: walks.sample_by_walks(g, 3))
_add(
    "pregel_min_label", "g2",
    lambda g: pregel(g.vertices, g.edges, {"c": F.col("id")}, F.col("src_c"), None, F.min, lambda m, _: {"c": F.least("c", m)}, active=lambda _: F.col("src_c") < F.col("dst_c"), max_rounds=100),
    "SELECT s.v AS id, min(s.s) AS c FROM dist s GROUP BY s.v", _REACH, True,
)
