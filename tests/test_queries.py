"""Registered queries do what their operators do by themselves."""

import inspect

import pytest
from pyspark.sql import functions as F

from graphskein.graph import Graph
from graphskein.operators import community, walks
from graphskein.queries import graphs


def test_current_flow_is_registered_with_its_defaults(spark, monkeypatch):
    defaults = inspect.signature(graphs.bt.current_flow_betweenness)
    seen = []
    monkeypatch.setattr(graphs.bt, "current_flow_betweenness", lambda *a, **k: seen.append(defaults.bind(*a, **k).arguments))
    for name in ("current_flow_betweenness_g1", "current_flow_betweenness_g2"):
        graphs.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [{k: v for k, v in s.items() if k != "g" and v != defaults.parameters[k].default} for s in seen] == [{}, {}]


def test_ranks_are_registered_with_their_defaults_too(spark, monkeypatch):
    seen = {}
    for op in ("page_rank", "personalized_page_rank", "hits"):
        given = inspect.signature(getattr(graphs.spectral, op))
        monkeypatch.setattr(graphs.spectral, op, lambda *a, _op=op, _given=given, **k: seen.update({_op: {n for n, v in _given.bind(*a, **k).arguments.items() if v != _given.parameters[n].default}}))
    monkeypatch.setattr(graphs, "_round", lambda df, *names: df)
    for name in ("page_rank_default_g0", "personalized_page_rank_default_g0", "hits_default_g3"):
        graphs.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert {op: len(names) for op, names in seen.items()} == {"page_rank": 1, "personalized_page_rank": 2, "hits": 1}


def test_walks_are_followed_to_their_ends(spark, monkeypatch):
    monkeypatch.setattr(walks, "MERGE", 3)
    g = Graph(spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(1, 2)] * 4, "src long, dst long"))
    got = {r.id: r.samples for r in walks.sample_by_walks(g, 2).collect()}
    assert got.keys() == {1, 2, 3} and all(len(s) == 2 for s in got.values()) and got[3] == [3, 3]
    assert inspect.signature(walks.sample_by_walks).parameters["max_steps"].default is None
    with pytest.raises(RuntimeError, match="1 steps"):
        walks.sample_by_walks(g, 2, max_steps=1)


def test_threshold_search_ends_at_the_closest_cut(spark, monkeypatch):
    # 2^21 values; from 123,457 / 2^21 on there are three components, below one, so that 2 is never met
    n, first = 1 << 21, 123_457
    monkeypatch.setattr(community, "structural_similarity", lambda g: spark.range(n).select((F.col("id") / n).alias("similarity")))
    most = lambda links: links.agg(F.count("*")).first()[0]
    monkeypatch.setattr(community, "component_labels", lambda ids, links: ids.select("id", (F.col("id") if most(links) <= n - 1 - first else F.lit(1)).alias("component")))
    g = Graph(spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert community.pscan_with_components(g, 2)[1] == first / n
