"""Community detection per layer, over ties and over the multislice graph.

Groups (a layer, a replicate) are spread over the cluster; inside a group the
kernels run in memory, since their moves depend on one another.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import fallback_labels, supra_edges
from .kernels.communities import detect


#: Edges of one group that a task takes; larger layers are for ``detect_large``.
MOST_EDGES = 5_000_000


def _refuse_large(group: pd.DataFrame) -> None:
    if len(group) > MOST_EDGES:
        raise ValueError(f"{len(group)} edges in one group, more than {MOST_EDGES}: use detect_large")


def _fresh(df: DataFrame) -> DataFrame:
    """The same rows under new column identities: both sides of a cogroup may stem from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def objective_for(algorithm: str, objective: str | None, directed: bool) -> str:
    """The quality function in force: given, else Potts for directed layers and modularity otherwise."""
    if algorithm not in ("louvain", "leiden"):
        raise ValueError("algorithm must be louvain or leiden")
    if objective is not None and objective not in ("modularity", "cpm"):
        raise ValueError("objective must be modularity or cpm")
    if algorithm == "louvain" and objective == "cpm":
        raise ValueError("louvain works with modularity only")
    return objective or ("cpm" if directed else "modularity")


def refuse_negative(edges: DataFrame, objective: str) -> None:
    if objective != "modularity":
        return
    bad = edges.where("weight < 0").agg(F.min("layer")).first()[0]
    if bad is not None:
        raise ValueError(f"layer {bad} has negative edge weights; use objective='cpm'")


def detect_layers(
    nodes: DataFrame,
    edges: DataFrame,
    algorithm: str = "leiden",
    resolution: float = 1.0,
    directed: bool = False,
    objective: str | None = None,
    seed: int = 123,
    by: tuple[str, ...] = (),
    check: bool = True,
) -> DataFrame:
    """membership(by..., layer, node, community); isolates are communities of their own.

    Louvain sees a directed layer as undirected, reciprocal weights summed.
    """
    effective = objective_for(algorithm, objective, directed)
    if check:
        refuse_negative(edges, effective)
    key = [*by, "layer"]
    potts = effective == "cpm" and algorithm == "leiden"
    as_directed = directed and algorithm == "leiden"

    def work(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        _refuse_large(e)
        n = n.sort_values("node")
        names = n["node"].tolist()
        rows = sorted(zip(e["src"].tolist(), e["dst"].tolist(), e["weight"].tolist(), strict=True))
        n["community"] = detect(names, rows, algorithm, resolution, potts, as_directed, seed)
        return n[[*key, "node", "community"]]

    kinds = dict(nodes.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*key, "node"]) + ", community int"
    return (
        nodes.select(*key, "node").groupBy(*key)
        .cogroup(_fresh(edges.select(*key, "src", "dst", "weight")).groupBy(*key))
        .applyInPandas(work, schema)
    )


def detect_meta(
    membership: DataFrame,
    ties: DataFrame,
    algorithm: str = "leiden",
    resolution: float = 1.0,
    seed: int = 123,
    by: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Communities of communities: (by..., layer, community, meta_community) and the same per node.

    One group holds the communities of all layers, not their nodes.  Without
    any tie the layers' labels are made distinct instead.
    """
    where = ["layer", "community"]
    vertices = membership.select(*by, *where).distinct()
    lines = ties.select(*by, "from_layer", "from_community", "to_layer", "to_community", "weighted_similarity").where("weighted_similarity <> 0")
    one = list(by) or ["__all"]
    if not by:
        vertices, lines = vertices.withColumn("__all", F.lit(1)), lines.withColumn("__all", F.lit(1))

    def work(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        _refuse_large(e)
        v = v.sort_values(where)
        names = list(zip(v["layer"], v["community"], strict=True))
        rows: dict[tuple, float] = {}
        for a, b, c, d, w in zip(*(e[x] for x in ("from_layer", "from_community", "to_layer", "to_community", "weighted_similarity")), strict=True):
            pair = tuple(sorted(((a, b), (c, d))))
            rows[pair] = rows.get(pair, 0.0) + w
        lines = [(u, x, w) for (u, x), w in sorted(rows.items())]
        if lines:
            v["meta_community"] = detect(names, lines, algorithm, resolution, seed=seed)
        else:
            top = v.groupby("layer")["community"].max().cumsum().shift(fill_value=0)
            v["meta_community"] = (v["community"] + v["layer"].map(top)).astype("int32")
        return v[[*one, *where, "meta_community"]]

    kinds = dict(vertices.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*one, *where]) + ", meta_community int"
    ids = vertices.groupBy(*one).cogroup(_fresh(lines).groupBy(*one)).applyInPandas(work, schema)
    ids = ids if by else ids.drop("__all")
    return ids, membership.join(ids, [*by, *where]).select(*by, "layer", "node", "meta_community")


def detect_multislice(
    nodes: DataFrame,
    edges: DataFrame,
    ties: DataFrame,
    algorithm: str = "leiden",
    omega: float = 1.0,
    resolution: float = 1.0,
    seed: int = 123,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """One detection over all (layer, node) pairs with ordinary modularity on the stacked graph.

    The stacked graph of one replicate is one group: use it where that fits a task.
    """
    lines = supra_edges(edges, ties, omega, by)
    one = list(by) or ["__all"]
    v = nodes.select(*by, "layer", "node")
    if not by:
        v, lines = v.withColumn("__all", F.lit(1)), lines.withColumn("__all", F.lit(1))

    def work(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        _refuse_large(e)
        n = n.sort_values(["layer", "node"])
        names = list(zip(n["layer"], n["node"], strict=True))
        rows = sorted(((a, b), (c, d), w) for a, b, c, d, w in zip(*(e[x] for x in ("layer_a", "node_a", "layer_b", "node_b", "weight")), strict=True))
        n["meta_community"] = detect(names, rows, algorithm, resolution, seed=seed) if rows else range(1, len(names) + 1)
        return n[[*one, "layer", "node", "meta_community"]]

    kinds = dict(v.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*one, "layer", "node"]) + ", meta_community int"
    found = v.groupBy(*one).cogroup(_fresh(lines).groupBy(*one)).applyInPandas(work, schema)
    return found if by else found.drop("__all")


__all__ = ["detect_layers", "detect_meta", "detect_multislice", "fallback_labels", "objective_for", "refuse_negative"]
