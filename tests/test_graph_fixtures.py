"""Three small graphs with values worked out by hand from the definitions."""

import math
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphskein.graph import Graph
from graphskein.operators import betweenness as bt
from graphskein.operators import coarsening, community, kernels, links, louvain, measures, neighbours, paths, spectral, walks

T1 = ([1, 2, 3, 4, 5], [(1, 2), (1, 3), (1, 4), (1, 5)])
T2 = ([1, 2, 3, 4, 5, 6], [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)])
T3 = ([1, 2, 3, 4, 5, 6, 7], [(1, 2), (1, 2), (2, 3), (3, 1), (1, 4), (4, 2), (5, 6)])


@pytest.fixture(scope="module")
def graphs(spark):
    made = {}
    for name, (v, e) in {"t1": T1, "t2": T2, "t3": T3, "none": ([1, 2], []), "loop": ([1, 2, 3], [(1, 1), (1, 2)])}.items():
        made[name] = Graph(spark.createDataFrame([(i,) for i in v], "id long"), spark.createDataFrame(e, "src long, dst long"))
    made["words"] = Graph(spark.createDataFrame([(chr(96 + i), i) for i in T2[0]], "id string, n int"), spark.createDataFrame([(chr(96 + a), chr(96 + b)) for a, b in T2[1]], "src string, dst string"))
    return made


def values(df, *names):
    return {r["id"]: tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def close(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=2e-6), k


def padded(g, some):
    return {i: some.get(i, 0.0) for i in g}


def test_freeman(graphs):
    for name, want in (("t1", 1.0), ("t2", 0.2), ("t3", 1 / 3), ("none", 0.0)):
        assert measures.freeman(graphs[name]) == pytest.approx(want)


def test_clustering_neighborhood_embeddedness(graphs):
    for op, want2, want3 in (
        (measures.clustering, {1: 0.5, 4: 0.5}, {1: 0.5}),
        (measures.neighborhood, {1: 1, 2: 1, 3: 2, 4: 0.5}, {1: 1, 2: 1, 3: 3, 4: 1}),
        (measures.embeddedness, {1: 0.25, 4: 0.25}, {1: 0.25}),
    ):
        close(values(op(graphs["t1"]), "measure"), padded(T1[0], {}))
        close(values(op(graphs["t2"]), "measure"), padded(T2[0], want2))
        close(values(op(graphs["t3"]), "measure"), padded(T3[0], want3))
        close(values(op(graphs["none"]), "measure"), {1: 0.0, 2: 0.0})


def test_edge_measures_keep_every_edge(graphs):
    got = sorted(tuple(r) for r in measures.common_neighbors(graphs["t3"]).collect())
    assert got == sorted([(a, b, int((a, b) == (1, 4))) for a, b in T3[1]])
    aa = {(r.src, r.dst): r.measure for r in measures.adamic_adar(graphs["t2"]).collect()}
    assert aa == {e: math.inf if e == (1, 2) else 0.0 for e in T2[1]}
    extra = Graph(graphs["t2"].vertices, graphs["t2"].edges.withColumn("measure", F.lit("x")).withColumn("k", F.lit(1)))
    assert sorted(measures.common_neighbors(extra).columns) == ["dst", "k", "measure", "src"]


def test_degrees(graphs):
    assert measures.degree(graphs["t1"]).count() == 0
    assert values(measures.degree(graphs["t3"]), "inDegree", "outDegree") == {1: (1, 3), 2: (3, 1), 3: (1, 1), 4: (1, 1)}
    assert values(neighbours.degrees(graphs["loop"]), "outDegree", "inDegree") == {1: (2, 1), 2: (0, 1), 3: (0, 0)}
    assert values(neighbours.degrees(graphs["loop"], undirected=True), "outDegree")[1] == 3
    assert values(neighbours.neighbour_sets(graphs["t3"]), "neighbours")[1] == [2, 4]
    assert values(neighbours.neighbour_sets(graphs["t3"], predicate=F.col("w") > 2), "neighbours")[1] == [4]


def test_closeness(graphs):
    close(values(paths.closeness(graphs["t1"]), "measure"), padded(T1[0], {1: 0.25}))
    close(values(paths.closeness(graphs["t2"]), "measure"), padded(T2[0], {1: 0.1, 2: 1 / 9, 3: 0.2, 4: 0.5, 5: 1.0}))
    close(values(paths.closeness(graphs["t2"], batch=3, kernel_edges=0), "measure"), padded(T2[0], {1: 0.1, 2: 1 / 9, 3: 0.2, 4: 0.5, 5: 1.0}))
    close(values(paths.closeness(graphs["t3"], kind="harmonic"), "measure"), padded(T3[0], {1: 2.5, 2: 11 / 6, 3: 2, 4: 11 / 6, 5: 1}))
    close(values(paths.closeness(graphs["words"]), "measure"), padded("abcdef", {"a": 0.1, "b": 1 / 9, "c": 0.2, "d": 0.5, "e": 1.0}))
    close(values(paths.closeness(graphs["t1"], normalize=True), "measure"), padded(T1[0], {1: 1.0}))
    with pytest.raises(ValueError):
        paths.closeness(graphs["t1"], kind="other")


def test_betweenness(graphs):
    close(values(bt.betweenness(graphs["t1"]), "measure"), padded(T1[0], {1: 1.0}))
    close(values(bt.betweenness(graphs["t2"], "hua", batch=2), "measure"), padded(T2[0], {3: 0.6, 4: 0.6}))
    close(values(bt.betweenness(graphs["t2"]), "measure"), padded(T2[0], {3: 0.6, 4: 0.6}))
    close(values(bt.betweenness(graphs["t3"], kernel_edges=0), "measure"), padded(T3[0], {1: 1 / 30, 2: 1 / 30}))
    close(values(bt.betweenness(graphs["t3"]), "measure"), padded(T3[0], {1: 1 / 30, 2: 1 / 30}))
    close(values(bt.betweenness(graphs["none"]), "measure"), {1: 0.0, 2: 0.0})
    with pytest.raises(ValueError):
        bt.betweenness(graphs["t1"], "other")


def test_batched_betweenness_is_searched_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(bt, "_dependencies", None)  # no joins for a small graph, in batches either
    n = 12
    # two rings, a bridge of parallel edges, a tail, an edge to an id without vertex, a vertex alone
    e = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (0, 2), (3, 4), (4, 3), (4, 5), (5, 6), (6, 7), (7, 4), (7, 8), (8, 9), (2, 99)]
    g = Graph(spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(e, "src long, dst long"))
    near = defaultdict(list)
    for a, b in e:
        near[a].append(b)
        near[b].append(a)
    dist, ways = {}, defaultdict(float)
    for s in list(near):
        dist[s, s], ways[s, s], queue = 0, 1.0, [s]
        for v in queue:
            for w in near[v]:
                if (s, w) not in dist:
                    dist[s, w] = dist[s, v] + 1
                    queue.append(w)
                if dist[s, w] == dist[s, v] + 1:
                    ways[s, w] += ways[s, v]
    want = dict.fromkeys(range(n), 0.0)
    for s, t in dist:
        for v in near:
            if s in want and v in want and v not in (s, t) and (s, v) in dist and (v, t) in dist and dist[s, v] + dist[v, t] == dist[s, t]:
                want[v] += ways[s, v] * ways[v, t] / ways[s, t] / ((n - 1) * (n - 2))
    close(values(bt.betweenness(g, "hua", batch=2), "measure"), want)


def test_current_flow(graphs):
    got = values(bt.current_flow_betweenness(graphs["t2"], flows=5, eps=1e-3, max_rounds=60), "measure")
    assert got.keys() == set(T2[0]) and all(x >= 0 for x in got.values())
    # all current between both halves passes 3 and 4
    assert min(got[3], got[4]) > max(got[i] for i in (1, 2, 5, 6))


def test_current_flow_stays_within_components(spark):
    # four paths of three, one edge and one vertex alone: only the middle of a path carries current
    e = [(10 * i + j, 10 * i + j + 1) for i in range(1, 5) for j in (1, 2)] + [(1, 2)]
    ids = sorted({x for pair in e for x in pair} | {99})
    g = Graph(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(e, "src long, dst long"))
    for kernel in (bt.KERNEL_EDGES, 0):
        close(values(bt.current_flow_betweenness(g, kernel_edges=kernel), "measure"), {i: float(i > 10 and i % 10 == 2) for i in ids})
    both = g.directed(True).select("src", "dst")
    drawn = bt.currents(both.select(F.col("src").alias("v")).distinct(), both, 7, 3).collect()
    assert all(r.s != r.t and r.s // 10 == r.t // 10 for r in drawn)
    assert {v: sum(r.n for r in drawn if r.s == v) for v in ids if v != 99} == {v: 7 for v in ids if v != 99}


def test_current_flow_by_kernel_and_by_joins(graphs):
    for name in ("t2", "t3", "words"):
        close(values(bt.current_flow_betweenness(graphs[name], flows=3), "measure"), values(bt.current_flow_betweenness(graphs[name], flows=3, kernel_edges=0), "measure"))
    for kernel in (bt.KERNEL_EDGES, 0):
        with pytest.raises(RuntimeError, match="2 rounds"):
            bt.current_flow_betweenness(graphs["t2"], max_rounds=2, kernel_edges=kernel)


def test_hops_of_sources_near_each_other_are_searched_together(spark, monkeypatch):
    monkeypatch.setattr(kernels, "TOGETHER", 7)
    # a long path with ways around and back, parallel edges, loops, pairs, vertices alone
    e = [(i, i + 1) for i in range(60)] + [(10, 14), (20, 17), (40, 30), (5, 5), (5, 6)] + [(100 + 2 * i, 101 + 2 * i) for i in range(5)]
    ids = [*range(63), *range(100, 110), 500]
    near = defaultdict(list)
    for a, b in e:
        near[a].append(b)
    want = {}
    for s in ids:
        want[s, s], queue = 0, [s]
        for v in queue:
            for w in near[v]:
                if (s, w) not in want:
                    want[s, w] = want[s, v] + 1
                    queue.append(w)
    for name, make in (("long", lambda i: i), ("string", lambda i: f"v{i}")):
        g = Graph(spark.createDataFrame([(make(i),) for i in ids], f"id {name}"), spark.createDataFrame([(make(a), make(b)) for a, b in e], f"src {name}, dst {name}"))
        rows = paths.path_lengths(g, batch=3).collect()
        assert len(rows) == len(want) and {(r.id, r.target): r.distance for r in rows} == {(make(s), make(v)): d for (s, v), d in want.items()}
        some = spark.createDataFrame([(make(i),) for i in (3, 12, 45, 104, 500)], f"id {name}")
        rows = paths.bfs(g, some, max_depth=4).collect()
        assert sorted((r.source, r.id, r.distance) for r in rows) == sorted((make(s), make(v), d) for (s, v), d in want.items() if s in (3, 12, 45, 104, 500) and d <= 4)
    alone = Graph(g.vertices, g.edges.limit(0))
    assert sorted((r.source, r.id, r.distance) for r in paths.bfs(alone, some).collect()) == sorted((r.id, r.id, 0) for r in some.collect())


def test_current_flow_reads_all_currents_from_columns_of_a_region(spark, monkeypatch):
    monkeypatch.setattr(kernels, "REGION_COLUMNS", 3)
    monkeypatch.setattr(kernels, "CURRENT_CELLS", 16)
    # a long path with a ring and a doubled edge, a ring of an even number, pairs
    e = [(i, i + 1) for i in range(70)] + [(30, 36), (50, 51), (7, 9)] + [(100, 101), (101, 102), (102, 103), (103, 100)] + [(200 + 2 * i, 201 + 2 * i) for i in range(4)]
    ids = sorted({x for pair in e for x in pair})
    g = Graph(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(e, "src long, dst long"))
    both = g.directed(True).select("src", "dst")
    runs = bt.currents(both.groupBy(F.col("src").alias("v")).count(), both, 4, 7).collect()
    at = {x: i for i, x in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for x, y in e:
        a[at[x], at[y]] += 1
        a[at[y], at[x]] += 1
    supply, deg = np.zeros((len(ids), len(runs))), a.sum(1)[:, None]
    for k, r in enumerate(runs):
        supply[at[r.s], k], supply[at[r.t], k] = 1, -1
    for eps in (0.1, 0.02):  # few rounds, after which the path is not reached to its ends, and more than a first region is made for
        p, reached, rounds = supply / deg / 2, supply != 0, 0
        while True:
            old, p = p, (a @ p + supply) / deg
            reached, rounds = reached | (a @ reached > 0), rounds + 1
            if np.abs(p - old).max() < eps:
                break
        assert rounds < 30 if eps == 0.1 else rounds > 70
        there, n = reached & (supply == 0), np.array([r.n for r in runs])
        through = np.einsum("vw,vwk->vk", a, np.abs(p[:, None] - p[None])) / 2
        want = (through * there) @ n / np.maximum(1, there @ n)
        close(values(bt.current_flow_betweenness(g, flows=4, eps=eps, max_rounds=rounds), "measure"), dict(zip(ids, want)))
        with pytest.raises(RuntimeError, match="rounds"):
            bt.current_flow_betweenness(g, flows=4, eps=eps, max_rounds=rounds - 1)


def test_current_flow_of_a_component_that_all_reach_has_a_column_per_vertex(spark, monkeypatch):
    monkeypatch.setattr(kernels, "WHOLE_VERTICES", 10)
    monkeypatch.setattr(kernels, "COLUMN_CELLS", 40 * 9)  # five sources at a time, and the four they end in
    monkeypatch.setattr(kernels, "BLOCK_EDGES", 16)
    reached, all_reached = [], kernels._all_reached
    monkeypatch.setattr(kernels, "_all_reached", lambda *a: reached.append(all_reached(*a)) or reached[-1])
    rng = np.random.default_rng(5)
    e = [(i, (i + 1) % 40) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(0, 40, (60, 2)) if a != b] + [(0, 1), (40, 3), (100, 101), (101, 102)]
    ids = sorted({x for pair in e for x in pair})
    g = Graph(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(e, "src long, dst long"))
    both = g.directed(True).select("src", "dst")
    runs = bt.currents(both.groupBy(F.col("src").alias("v")).count(), both, 4, 7).collect()
    large = sorted((r for r in runs if r.s <= 40), key=lambda r: r["at"])
    for i in range(36):
        ends = {x for r in large if i <= r["at"] < i + 5 for x in (r.s, r.t)}
        assert len(ends) <= 5 + 4
    at = {x: i for i, x in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for x, y in e:
        a[at[x], at[y]] += 1
        a[at[y], at[x]] += 1
    supply, deg, n = np.zeros((len(ids), len(runs))), a.sum(1)[:, None], np.array([r.n for r in runs])
    for k, r in enumerate(runs):
        supply[at[r.s], k], supply[at[r.t], k] = 1, -1
    p, there = supply / deg / 2, supply != 0
    while True:
        old, p, there = p, (a @ p + supply) / deg, there | (a @ there > 0)
        if np.abs(p - old).max() < 1e-3:
            break
    there &= supply == 0
    want = (np.einsum("vw,vwk->vk", a, np.abs(p[:, None] - p[None])) / 2 * there) @ n / np.maximum(1, there @ n)
    close(values(bt.current_flow_betweenness(g, flows=4), "measure"), dict(zip(ids, want)))
    assert [x.tolist() for x in reached] == [[True, False]]


def test_eigenvector(graphs):
    close(values(spectral.eigenvector(graphs["t1"]), "measure"), padded(T1[0], {}))
    close(values(spectral.eigenvector(graphs["t3"]), "measure"), padded(T3[0], {1: 0.37138, 2: 0.723036, 3: 0.518125, 4: 0.266162}))


def test_hits(graphs):
    close({k: v[0] for k, v in values(spectral.hits(graphs["t1"]), "authority", "hub").items()}, {1: 0, 2: 0.25, 3: 0.25, 4: 0.25, 5: 0.25})
    got = values(spectral.hits(graphs["t2"]), "authority", "hub")
    want = {1: (0, 0.309017), 2: (0.190983, 0.190983), 3: (0.309017, 0), 4: (0, 0.309017), 5: (0.190983, 0.190983), 6: (0.309017, 0)}
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=2e-6)
    assert values(spectral.hits(graphs["none"]), "authority", "hub") == {1: (0.0, 0.0), 2: (0.0, 0.0)}


def test_page_rank(graphs):
    close(values(spectral.page_rank(graphs["t1"]), "pagerank"), {1: 0.854701, 2: 1.036325, 3: 1.036325, 4: 1.036325, 5: 1.036325})
    close(values(spectral.page_rank(graphs["t3"]), "pagerank"), {1: 1.755804, 2: 1.84132, 3: 1.792754, 4: 0.726999, 5: 0.229383, 6: 0.424358, 7: 0.229383})
    got = spectral.personalized_page_rank(graphs["t2"], [1, 4], 10).groupBy("reference").agg(F.sum("pagerank").alias("s"), F.count("*").alias("n")).collect()
    assert {(r.reference, round(r.s, 9), r.n) for r in got} == {(1, 1.0, 6), (4, 1.0, 6)}
    with pytest.raises(TypeError):
        spectral.personalized_page_rank(graphs["t2"], [1.5])


def test_components(graphs):
    assert values(community.connected_components(graphs["t3"]), "component") == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}
    assert values(community.connected_components(graphs["none"]), "component") == {1: 1, 2: 2}
    assert set(values(community.connected_components(graphs["words"]), "component").values()) == {"a"}
    assert values(community.strongly_connected_components(graphs["t3"]), "component") == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7}
    assert values(community.strongly_connected_components(graphs["t2"]), "component") == {i: i for i in T2[0]}


def test_pscan(graphs):
    assert values(community.pscan(graphs["t2"], 0.1), "label") == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    half = community.pscan(graphs["t2"], 0.5)
    assert values(half, "label") == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}
    assert measures.modularity(Graph(half, graphs["t2"].edges), "label") == pytest.approx(0.030612, abs=1e-6)
    assert measures.modularity(graphs["t2"]) == 0.0
    alone = Graph(graphs["t1"].vertices.withColumn("c", F.col("id")), graphs["t1"].edges)
    assert measures.modularity(alone, "c") == pytest.approx(-0.3125)
    labels, cut = community.pscan_with_components(graphs["t2"], 4)
    assert len(set(values(labels, "label").values())) == 4 and 0.4 < cut < 0.5


def test_louvain(graphs):
    for name, want, q in (("t1", {i: 1 for i in T1[0]}, 0.0), ("t2", {1: 1, 2: 1, 3: 1, 4: 5, 5: 5, 6: 5}, 0.357143), ("t3", {1: 2, 2: 2, 3: 2, 4: 2, 5: 5, 6: 5, 7: 7}, 0.244898)):
        mapping, found = louvain.louvain_membership(graphs[name])
        assert values(mapping, "community") == want
        assert found == pytest.approx(q, abs=1e-6)
    assert values(louvain.louvain(graphs["t2"], reference_compat=True), "community") == {1: 1, 5: 5}
    assert values(louvain.louvain(graphs["none"]), "community") == {1: 1, 2: 2}


def test_label_propagation(graphs):
    def plain(v, e, rounds):
        now = {i: i for i in v}
        for _ in range(rounds):
            votes = {i: {} for i in v}
            for a, b in e:
                for x, y in ((a, b), (b, a)):
                    votes[y][now[x]] = votes[y].get(now[x], 0) + 1
            now = {i: min(votes[i], key=lambda c: (-votes[i][c], c)) if votes[i] else now[i] for i in v}
        return now

    for name, (v, e) in (("t2", T2), ("t3", T3)):
        assert values(community.label_propagation(graphs[name], 3), "label") == plain(v, e, 3)


def test_paths(graphs):
    rows = lambda df: sorted((r["id"], r["reference"], r["distance"]) for r in df.collect())
    assert rows(paths.shortest_paths(graphs["t1"], [1, 4])) == [(1, 1, 0), (1, 4, 1), (4, 4, 0)]
    assert rows(paths.shortest_paths(graphs["t2"], [1, 4])) == [(1, 1, 0), (1, 4, 2), (2, 4, 2), (3, 4, 1), (4, 4, 0)]
    assert rows(paths.shortest_paths(graphs["words"], ["a"])) == [("a", "a", 0)]
    for name in ("t3", "words", "loop"):
        g = graphs[name]
        both = [sorted((r.source, r.id, r.distance) for r in paths.bfs(g, g.ids, kernel_edges=k).collect()) for k in (0, 100)]
        assert both[0] == both[1]
        assert all(r[2] <= 1 for r in paths.bfs(g, g.ids, max_depth=1).collect())
    lists = {(r["id"], r["target"]): r["paths"] for r in paths.path_lengths(graphs["t2"], paths.by_id(6), with_paths=True).collect()}
    assert lists[(4, 6)] == [[6]] and lists[(1, 6)] == [[6, 4, 3]] and lists[(6, 6)] == [[]]
    assert values(paths.distances_to(graphs["t2"], 4), "distance") == {1: 2.0, 2: 2.0, 3: 1.0, 4: 0.0, 5: None, 6: None}


def test_batches_of_hops_are_searched_like_all_of_them(graphs, monkeypatch):
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "target", "distance").collect())
    for name in ("t2", "t3", "words"):
        assert rows(paths.path_lengths(graphs[name], batch=3, kernel_edges=0)) == rows(paths.path_lengths(graphs[name]))
    monkeypatch.setattr(paths, "_relax", None)  # neither rounds of joins nor their state
    for name in ("t2", "t3", "words"):
        assert rows(paths.path_lengths(graphs[name], batch=3)) == rows(paths.path_lengths(graphs[name]))


def test_all_shortest_paths_are_listed_without_rounds_of_joins(spark, monkeypatch):
    monkeypatch.setattr(paths, "_relax", None)
    monkeypatch.setattr(kernels, "BATCH_ROWS", 1)  # results are sent in parts
    rng = random.Random(3)
    e = {(rng.randrange(14), rng.randrange(14)) for _ in range(36)}
    g = Graph(spark.createDataFrame([(i,) for i in range(16)], "id long"), spark.createDataFrame(sorted(e), "src long, dst long"))
    want = {(i, i): [[]] for i in range(16)}
    for target in range(16):
        layer, seen = {target: [[]]}, {target}
        while layer:
            layer = {v: [[*p, u] for u in layer if (v, u) in e for p in layer[u]] for v in set(range(16)) - seen if any((v, u) in e for u in layer)}
            seen |= layer.keys()
            want |= {(v, target): sorted(p) for v, p in layer.items()}
    got = paths.path_lengths(g, with_paths=True).collect()
    assert {(r.id, r.target): sorted(r.paths) for r in got} == want and len(got) == len(want)
    assert all(r.distance == len(r.paths[0]) for r in got)


def test_listed_paths_go_on_from_those_of_the_layer_before(spark):
    n = 3000
    g = Graph(spark.range(n), spark.range(n - 1).selectExpr("id as src", "id + 1 as dst"))
    began = time.time()
    got = paths.path_lengths(g, paths.by_id(n - 1), with_paths=True).collect()
    assert time.time() - began < 60  # following every layer back to the target takes longer
    assert {r.id: r.paths for r in got} == {i: [list(range(n - 1, i, -1))] for i in range(n)} and len(got) == n
    assert all(r.distance == n - 1 - r.id for r in got)


def test_paths_of_layers_too_large_to_be_kept_are_listed(spark, monkeypatch):
    monkeypatch.setattr(kernels, "BATCH_ROWS", 1)
    # seven squares one after the other, each with two ways through it; then beside them a line, alone in the last layers; 30 is by itself
    e = [x for i in range(0, 21, 3) for x in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3))] + [(i, i + 1) for i in range(40, 59)] + [(59, 21)]
    vertices = [*range(22), 30, *range(40, 60)]
    ways = lambda v, t: [[]] if v == t else [[*p, w] for u, w in e if u == v for p in ways(w, t)]
    g = Graph(spark.createDataFrame([(str(i),) for i in vertices], "id string"), spark.createDataFrame([(str(u), str(w)) for u, w in e], "src string, dst string"))
    got = {(int(r.id), int(r.target)): sorted([*map(int, p)] for p in r.paths) for r in paths.path_lengths(g, with_paths=True).collect()}
    assert got == {(v, t): sorted(p) for v in vertices for t in vertices if (p := ways(v, t))}
    assert len(got[(0, 21)]) == 128


def test_weighted_paths(graphs, spark):
    e = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0), (3, 2, 1.0), (2, 4, 1.0)], "src long, dst long, w double")
    d = paths.path_lengths(Graph(graphs["t2"].vertices, e), paths.by_ids([4]), weight="w")
    assert values(d, "distance") == {1: 3.0, 2: 1.0, 3: 2.0, 4: 0.0}


def test_sinks(graphs, spark, tmp_path):
    paths.write_distances(graphs["t2"], str(tmp_path / "a"))
    lines = {r.value for r in spark.read.text(str(tmp_path / "a/paths")).collect()}
    assert "5;5:0.0;6:1.0" in lines and len(lines) == 6
    paths.write_distances(graphs["t2"], str(tmp_path / "b"), form="parquet")
    assert spark.read.parquet(str(tmp_path / "b/paths")).count() == paths.path_lengths(graphs["t2"]).count()


def test_coarsening_and_approximation(graphs):
    g = graphs["t2"]
    labels = values(coarsening.coarse_labels(g, undirected=True), "label")
    assert all(labels[c] == c for c in labels.values())
    coarse = coarsening.coarsen(g, undirected=True)
    assert sorted(x for r in coarse.vertices.collect() for x in r.component) == T2[0]
    exact = {(r["id"], r["target"]): r["distance"] for r in paths.path_lengths(g, undirected=True).collect()}
    near = {(r["id"], r["target"]): r["distance"] for r in coarsening.approximate_path_lengths(g).collect()}
    assert all(near[k] >= exact[k] for k in near)
    assert all(near[k] == exact[k] for k in near if exact[k] <= 2)


def test_approximate_distances_need_no_exchange_of_pairs(graphs):
    g = graphs["t3"]
    labels = g.vertices.select("id", F.when(F.col("id") <= 3, 1).when(F.col("id") <= 5, 4).otherwise(F.col("id")).cast("long").alias("label"))
    for undirected in (True, False):
        near = coarsening.approximate_path_lengths(g, labels=labels, undirected=undirected)
        assert "Aggregate" not in near._jdf.queryExecution().executedPlan().toString()
        joined = coarsening.approximate_path_lengths(g, labels=labels, undirected=undirected, kernel_edges=0)
        assert sorted(tuple(r) for r in near.collect()) == sorted(tuple(r) for r in joined.collect())


def test_links(graphs):
    assert sorted(tuple(r) for r in links.predict_links(graphs["t2"]).collect()) == [(2, 1), (5, 4)]
    assert sorted(tuple(r) for r in links.predict_links(graphs["t3"]).collect()) == [(4, 1)]
    with pytest.raises(ValueError):
        links.predict_links(graphs["t2"], threshold=-1)


def test_walks(graphs):
    got = values(walks.sample_by_walks(graphs["t3"], 4, seed=3), "samples")
    assert got.keys() == set(T3[0]) and all(len(x) == 4 for x in got.values())
    assert set(got[7]) == {7} and set(got[5]) <= {5, 6} and set(got[1]) <= {1, 2, 3, 4}
    assert got == values(walks.sample_by_walks(graphs["t3"], 4, seed=3), "samples")
