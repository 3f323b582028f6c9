"""Multilayer fits: detection per layer, ties over linked layers, and communities of communities."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links as L
from ..operators import bootstrap as B
from ..operators import detect as D
from ..operators import graph as G
from ..operators import simulate as S
from ..operators import ties as T
from ..operators import track as K
from ..operators.redraw import redraw_sparse
from ..sources.layers import LayerSet, from_matrices
from ..sources.workspace import Workspace

FITS = ("jaccard", "overlap", "weighted_jaccard", "weighted_overlap", "identity")


@dataclass(frozen=True)
class Fit:
    """Tables of one fit; what a kind of fit does not have is None."""

    kind: str
    algorithm: str
    directed: bool
    layers: LayerSet
    links: DataFrame | None
    membership: DataFrame
    modularity: DataFrame
    ties: DataFrame | None
    meta_ids: DataFrame | None
    meta: DataFrame | None
    settings: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Bootstrap:
    fit: Fit
    n_boot: int
    n_completed: int
    members: DataFrame
    coassign: DataFrame
    stability: DataFrame
    modularity_samples: DataFrame
    reproducibility: DataFrame


def as_layers(spark: SparkSession, layers: LayerSet | list, directed: bool, same_nodes: bool = True) -> LayerSet:
    return layers if isinstance(layers, LayerSet) else from_matrices(spark, layers, directed, same_nodes)


def _base(spark, layers, algorithm, layer_links, resolution, directed, objective, seed, same_nodes=True):
    layers = as_layers(spark, layers, directed, same_nodes)
    directed = layers.directed or directed
    effective = D.objective_for(algorithm, objective, directed)
    links = L.make(spark, layers.n_layers, layer_links)
    membership = D.detect_layers(layers.nodes, layers.edges, algorithm, resolution, directed, objective, seed)
    membership = Workspace(spark, "fit").put("membership", membership)
    q = G.modularity(membership, layers.edges)
    if directed or effective == "cpm":
        q = q.withColumn("modularity", F.lit(None).cast("double"))
    return layers, directed, links, membership, q


def _similarity_fit(kind: str, spark: SparkSession, layers, algorithm, layer_links, min_similarity, resolution, directed, add_self_loops, self_loop_multiplier, objective, seed) -> Fit:
    layers, directed, links, membership, q = _base(spark, layers, algorithm, layer_links, resolution, directed, objective, seed)
    strengths = G.strengths(layers.nodes, layers.edges, directed) if kind.startswith("weighted") else None
    ties = T.community_ties(membership, links, kind, min_similarity, strengths)
    if add_self_loops:
        ties = ties.unionByName(T.self_loops(membership, links, self_loop_multiplier, min_similarity, directed))
    ids, meta = D.detect_meta(membership, ties, algorithm, resolution, seed)
    return Fit(kind, algorithm, directed, layers, links, membership, q, ties, ids, meta, {"min_similarity": min_similarity, "resolution": resolution, "seed": seed})


def fit_multilayer_jaccard(spark, layers, algorithm="leiden", layer_links=None, min_similarity=0.0, resolution_parameter=1.0, directed=False, add_self_loops=True, self_loop_multiplier=1.0, objective=None, seed=123) -> Fit:
    return _similarity_fit("jaccard", spark, layers, algorithm, layer_links, min_similarity, resolution_parameter, directed, add_self_loops, self_loop_multiplier, objective, seed)


def fit_multilayer_overlap(spark, layers, algorithm="leiden", layer_links=None, min_similarity=0.0, resolution_parameter=1.0, directed=False, add_self_loops=True, self_loop_multiplier=1.0, objective=None, seed=123) -> Fit:
    return _similarity_fit("overlap", spark, layers, algorithm, layer_links, min_similarity, resolution_parameter, directed, add_self_loops, self_loop_multiplier, objective, seed)


def fit_multilayer_weighted_jaccard(spark, layers, algorithm="leiden", layer_links=None, min_similarity=0.0, resolution_parameter=1.0, directed=False, add_self_loops=True, self_loop_multiplier=1.0, objective=None, seed=123) -> Fit:
    return _similarity_fit("weighted_jaccard", spark, layers, algorithm, layer_links, min_similarity, resolution_parameter, directed, add_self_loops, self_loop_multiplier, objective, seed)


def fit_multilayer_weighted_overlap(spark, layers, algorithm="leiden", layer_links=None, min_similarity=0.0, resolution_parameter=1.0, directed=False, add_self_loops=True, self_loop_multiplier=1.0, objective=None, seed=123) -> Fit:
    return _similarity_fit("weighted_overlap", spark, layers, algorithm, layer_links, min_similarity, resolution_parameter, directed, add_self_loops, self_loop_multiplier, objective, seed)


def fit_multilayer_identity_ties(spark, layers, algorithm="leiden", layer_links=None, resolution_parameter=1.0, omega=1.0, directed=False, objective=None, seed=123, allow_unequal_nodes=False) -> Fit:
    layers, directed, links, membership, q = _base(spark, layers, algorithm, layer_links, resolution_parameter, directed, objective, seed, not allow_unequal_nodes)
    ties = T.identity_ties(layers.nodes, links)
    meta = D.detect_multislice(layers.nodes, layers.edges, ties, algorithm, omega, resolution_parameter, seed)
    return Fit("identity", algorithm, directed, layers, links, membership, q, ties, None, meta, {"omega": omega, "resolution": resolution_parameter, "seed": seed})


def fit_multilayer_hungarian(spark, layers, algorithm="leiden", resolution_parameter=1.0, directed=False, objective=None, seed=123) -> Fit:
    layers, directed, links, membership, q = _base(spark, layers, algorithm, None, resolution_parameter, directed, objective, seed)
    meta = K.track(membership)
    ids = meta.select("meta_community").distinct()
    return Fit("hungarian", algorithm, directed, layers, None, membership, q, None, ids, meta, {"resolution": resolution_parameter, "seed": seed})


def extract_meta_membership(fit: Fit) -> DataFrame:
    """(layer, node, meta_community) in order of layer and node."""
    if fit.meta is None:
        raise ValueError("the fit has no meta communities")
    return fit.meta.orderBy("layer", "node")


def community_lists(fit: Fit) -> DataFrame:
    """communities(layer, community, nodes array)."""
    return fit.membership.groupBy("layer", "community").agg(F.array_sort(F.collect_list("node")).alias("nodes"))


def _fit_function(kind: str):
    return {
        "jaccard": fit_multilayer_jaccard,
        "overlap": fit_multilayer_overlap,
        "weighted_jaccard": fit_multilayer_weighted_jaccard,
        "weighted_overlap": fit_multilayer_weighted_overlap,
        "identity": fit_multilayer_identity_ties,
    }[kind]


def simulate_and_fit_multilayer(spark, n_nodes=100, n_layers=4, n_communities=4, p_in=0.2, p_out=0.05, fit_type="jaccard", algorithm="leiden", layer_links=None, min_similarity=0.0, seed=None, directed=False) -> tuple[LayerSet, DataFrame, Fit]:
    """(layers, truth, fit) of a planted partition that stays the same in all layers."""
    if fit_type not in FITS:
        raise ValueError(f"fit_type must be one of {FITS}")
    s = 0 if seed is None else seed
    truth = S.evolving_partition(spark, n_nodes, n_layers, n_communities, 0.0, s)
    edges = S.planted_edges(truth, p_in, p_out, s, directed)
    layers = LayerSet(truth.select("layer", "node"), edges, n_layers, directed)
    options = {} if fit_type == "identity" else {"min_similarity": min_similarity}
    fit = _fit_function(fit_type)(spark, layers, algorithm=algorithm, layer_links=layer_links, directed=directed, **({"seed": seed} if seed is not None else {}), **options)
    return layers, truth, fit


def bootstrap_multilayer(spark, layers, fit_type="jaccard", algorithm="leiden", n_boot=100, layer_links=None, min_similarity=0.0, resolution_parameter=1.0, directed=False, seed=None, objective=None, omega=1.0) -> Bootstrap:
    """Refits ``n_boot`` redraws of the fitted block model; the replicate is a column, so all run side by side."""
    if fit_type not in FITS:
        raise ValueError(f"fit_type must be one of {FITS}")
    layers = as_layers(spark, layers, directed)
    options = {"omega": omega} if fit_type == "identity" else {"min_similarity": min_similarity}
    fit = _fit_function(fit_type)(spark, layers, algorithm=algorithm, layer_links=layer_links, resolution_parameter=resolution_parameter, directed=directed, objective=objective, seed=123 if seed is None else seed, **options)
    s = 123 if seed is None else seed
    by = ("rep",)
    work = Workspace(spark, "bootstrap")
    edges = work.put("edges", redraw_sparse(spark, layers.nodes, layers.edges, fit.membership, n_boot, s, fit.directed))
    reps = spark.range(1, n_boot + 1).select(F.col("id").cast("int").alias("rep"))
    nodes = layers.nodes.crossJoin(F.broadcast(reps)).select("rep", "layer", "node")
    member = work.put("member", D.detect_layers(nodes, edges, algorithm, resolution_parameter, fit.directed, objective, s, by, check=False))
    if fit_type == "identity":
        ties = T.identity_ties(nodes, fit.links, by)
        meta = D.detect_multislice(nodes, edges, ties, algorithm, omega, resolution_parameter, s, by)
    else:
        strengths = G.strengths(nodes, edges, fit.directed, by) if fit_type.startswith("weighted") else None
        ties = T.community_ties(member, fit.links, fit_type, min_similarity, strengths, by=by)
        ties = ties.unionByName(T.self_loops(member, fit.links, 1.0, min_similarity, fit.directed, by))
        _, meta = D.detect_meta(member, ties, algorithm, resolution_parameter, s, by)
    meta = work.put("meta", meta)
    q = G.modularity(member, edges, by=by)
    if fit.directed or objective == "cpm":
        q = q.withColumn("modularity", F.lit(None).cast("double"))
    done = meta.select("rep").distinct().count() if n_boot else 0
    return Bootstrap(fit, n_boot, done, meta, B.co_assignment(meta, max(done, 1)), B.node_stability(meta), q.select("layer", "rep", "modularity"), B.count_reproducibility(meta, fit.meta))


def community_est(boot: Bootstrap) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(community_count, mean_node_stability, report) of a bootstrap; the report has a sentence per layer."""
    counts = boot.reproducibility.select("layer", "estimate", "reproducibility")
    text = F.when(
        F.col("reproducibility").isNull(),
        F.format_string("Layer %d: %d communities (no replicates)", "layer", "estimate"),
    ).otherwise(
        # Half rounds to even, as in the sentence's usual source languages.
        F.format_string("Layer %d: %d communities (found in %d%% of replicates)", "layer", "estimate", F.bround(100 * F.col("reproducibility")).cast("int"))
    )
    return counts, B.mean_stability(boot.stability), counts.select("layer", text.alias("report"))


def co_assignment_ci(boot: Bootstrap, alpha: float = 0.05) -> DataFrame:
    """(layer, i, j, estimate, lower, upper) of the pairs that were ever together; see ``never_together`` for the rest."""
    return B.intervals(boot.coassign, boot.n_completed, alpha)


def alluvial_rows(fit: Fit, max_nodes: int | None = None) -> DataFrame:
    """(node, layer, community) for flow diagrams, of the first ``max_nodes`` nodes."""
    rows = fit.membership.select("node", "layer", "community")
    if max_nodes is None:
        return rows
    return rows.join(rows.select("node").distinct().orderBy("node").limit(max_nodes), "node", "left_semi")


def plot_rows(fit: Fit, layer: int) -> tuple[DataFrame, DataFrame]:
    """A layer's nodes with their communities, and its edges, for drawing."""
    return fit.membership.where(F.col("layer") == layer), fit.layers.edges.where(F.col("layer") == layer)
