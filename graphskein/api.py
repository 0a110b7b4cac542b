"""The public functions by name, on :class:`~graphskein.graph.Graph`; each also under its camel-case name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from graphskein.graph import Graph
from graphskein.operators import betweenness as _betweenness
from graphskein.operators import community as _community
from graphskein.operators import louvain as _louvain
from graphskein.operators import measures as _measures
from graphskein.operators import paths as _paths
from graphskein.operators import spectral as _spectral


def adamic_adar(g: Graph, undirected: bool = False) -> DataFrame:
    """Edges with ``measure`` (double): sum over common neighbours of 1 / ln(their number of neighbours)."""
    return _measures.adamic_adar(g, undirected)


def betweenness(g: Graph, type: str = "edmonds", batch: int | None = None) -> DataFrame:
    """Vertices with ``measure``: normalised undirected shortest-path betweenness."""
    return _betweenness.betweenness(g, type, batch)


def closeness(g: Graph, undirected: bool = False, batch: int | None = None) -> DataFrame:
    """Vertices with ``measure``: 1 / sum of distances along out-edges."""
    return _paths.closeness(g, undirected=undirected, batch=batch)


def clustering(g: Graph, undirected: bool = False) -> DataFrame:
    """Vertices with ``measure``: the local clustering coefficient."""
    return _measures.clustering(g, undirected)


def common_neighbors(g: Graph, undirected: bool = False) -> DataFrame:
    """Edges with ``measure`` (int): the number of common neighbours."""
    return _measures.common_neighbors(g, undirected)


def connected_components(g: Graph) -> DataFrame:
    """Vertices with ``component``."""
    return _community.connected_components(g)


def degree(g: Graph, keep_all: bool = False) -> DataFrame:
    """``id, inDegree, outDegree`` of vertices that have both."""
    return _measures.degree(g, keep_all)


def detect_communities(g: Graph, iterations: int | None = None, epsilon: float = 0.1) -> DataFrame:
    """Vertices with ``label``: label propagation for a number of ``iterations``, else structural clustering by ``epsilon``."""
    return _community.label_propagation(g, iterations) if iterations is not None else _community.pscan(g, epsilon)


def eigenvector(g: Graph, undirected: bool = False) -> DataFrame:
    """Vertices with ``measure``: eigenvector centrality."""
    return _spectral.eigenvector(g, undirected=undirected)


def embeddedness(g: Graph, undirected: bool = False) -> DataFrame:
    """Vertices with ``measure``: mean Jaccard index with the neighbours."""
    return _measures.embeddedness(g, undirected)


def freeman(g: Graph) -> float:
    """Freeman's degree centralisation."""
    return _measures.freeman(g)


def hits(g: Graph) -> DataFrame:
    """Vertices with ``authority`` and ``hub``."""
    return _spectral.hits(g)


def louvain(g: Graph, min_progress: int = 1, progress_counter: int = 1, reference_compat: bool = False) -> DataFrame:
    """Vertices with ``community``."""
    return _louvain.louvain(g, min_progress, progress_counter, reference_compat=reference_compat)


def modularity(g: Graph, community: str | None = None) -> float:
    """Modularity of the communities in a vertex column; 0.0 without one."""
    return _measures.modularity(g, community)


def neighborhood(g: Graph, undirected: bool = False) -> DataFrame:
    """Vertices with ``measure``: mean out-degree of out-neighbours."""
    return _measures.neighborhood(g, undirected)


def page_rank(g: Graph, max_iter: int = 20, reset_probability: float = 0.15, weight: str | None = None) -> DataFrame:
    """Vertices with ``pagerank``."""
    return _spectral.page_rank(g, max_iter, reset_probability, weight)


def personalized_page_rank(g: Graph, landmarks: Sequence, max_iter: int = 20, reset_probability: float = 0.15) -> DataFrame:
    """Vertices with ``reference`` and ``pagerank``, a row per landmark."""
    return _spectral.personalized_page_rank(g, landmarks, max_iter, reset_probability)


def shortest_paths(g: Graph, landmarks: Sequence) -> DataFrame:
    """Vertices with ``distance`` and ``reference``, a row per landmark reached."""
    return _paths.shortest_paths(g, landmarks)


def strongly_connected_components(g: Graph, max_iter: int = 10) -> DataFrame:
    """Vertices with ``component``."""
    return _community.strongly_connected_components(g, max_iter)


adamicAdar = adamic_adar
commonNeighbors = common_neighbors
connectedComponents = connected_components
detectCommunities = detect_communities
pageRank = page_rank
personalizedPageRank = personalized_page_rank
shortestPaths = shortest_paths
stronglyConnectedComponents = strongly_connected_components
