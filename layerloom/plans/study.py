"""Study plans: grids, baselines, and what a run of them is judged by."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import ties as T
from ..functions import links as L
from ..sources.layers import LayerSet


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """Every combination of the axes' values, with a task number."""
    names = list(axes)
    frames = [spark.createDataFrame([(v,) for v in axes[n]], [n]) for n in names]
    whole = reduce(lambda a, b: a.crossJoin(b), frames)
    from pyspark.sql.window import Window

    return whole.withColumn("task", F.row_number().over(Window.orderBy(*names)))


def shuffled(tasks: DataFrame, seed: int = 1) -> DataFrame:
    """Tasks in an order that depends on seed and task alone."""
    return tasks.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("task").cast("string"))))


def independent(layers: LayerSet, algorithm: str = "leiden", seed: int = 123) -> DataFrame:
    """Each layer on its own; labels distinct over layers."""
    return G.fallback_labels(D.detect_layers(layers.nodes, layers.edges, algorithm, seed=seed))


def aggregated(layers: LayerSet, algorithm: str = "leiden", seed: int = 123) -> DataFrame:
    """One partition of all layers added up, for every layer."""
    edges = G.pooled(layers.edges).withColumn("layer", F.lit(1))
    nodes = layers.nodes.select("node").distinct().withColumn("layer", F.lit(1))
    one = D.detect_layers(nodes, edges, algorithm, seed=seed).select("node", F.col("community").alias("meta_community"))
    return layers.nodes.join(one, "node").select("layer", "node", "meta_community")


def multislice(spark: SparkSession, layers: LayerSet, all_pairs: bool = False, algorithm: str = "louvain", omega: float = 1.0, seed: int = 123) -> DataFrame:
    links = (L.all_pairs if all_pairs else L.chain)(spark, layers.n_layers)
    return D.detect_multislice(layers.nodes, layers.edges, T.identity_ties(layers.nodes, links), algorithm, omega, seed=seed)


def spectral(layers: LayerSet, k: int) -> DataFrame:
    """Block model baseline with a known number of blocks: leading eigenvectors, then k-means; one layer is one group."""
    import numpy as np
    import pandas as pd

    def work(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("node").reset_index(drop=True)
        at = {v: i for i, v in enumerate(n["node"])}
        a = np.zeros((len(n), len(n)))
        for u, v, w in zip(e["src"], e["dst"], e["weight"], strict=True):
            a[at[u], at[v]] = a[at[v], at[u]] = w
        value, vector = np.linalg.eigh(a)
        x = vector[:, np.argsort(-np.abs(value), kind="stable")[:k]]
        centres = [x[0]]
        while len(centres) < min(k, len(x)):  # the farthest point starts the next block
            centres.append(x[np.argmax(np.min([((x - c) ** 2).sum(1) for c in centres], axis=0))])
        for _ in range(1000):
            label = np.argmin([((x - c) ** 2).sum(1) for c in centres], axis=0)
            new = [x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(len(centres))]
            if np.allclose(new, centres):
                break
            centres = new
        else:
            raise RuntimeError("block centres still move after 1,000 rounds")
        n["meta_community"] = label + 1
        return n[["layer", "node", "meta_community"]]

    kind = dict(layers.nodes.dtypes)["node"]
    return layers.nodes.groupBy("layer").cogroup(layers.edges.groupBy("layer")).applyInPandas(work, f"layer int, node {kind}, meta_community int")


def compare(methods: dict[str, Callable[[], DataFrame]], truth: DataFrame) -> DataFrame:
    """nmi, ari and k_mae of each method's meta labels against the truth, per layer means and joint."""
    rows = []
    for name, run in methods.items():
        both = run().select("layer", "node", F.col("meta_community").alias("a")).join(truth.select("layer", "node", F.col("community").alias("b")), ["layer", "node"])
        per = M.nmi(both, ["layer"], trivial=1.0).join(M.ari(both, ["layer"]), "layer").agg(F.avg("nmi").alias("nmi"), F.avg("ari").alias("ari"))
        joint = M.nmi(both, [], trivial=1.0).select(F.col("nmi").alias("joint_nmi"))
        rows.append(per.crossJoin(joint).crossJoin(M.count_error(both)).select(F.lit(name).alias("method"), "*"))
    return reduce(DataFrame.unionByName, rows)


def ranked(runs: DataFrame, value: str = "nmi") -> DataFrame:
    return runs.orderBy(F.col(value).desc(), "method")


METHODS: dict[str, Callable] = {"independent": independent, "aggregated": aggregated}


def register_method(name: str, run: Callable) -> None:
    """Adds a competitor: a function of a LayerSet giving (layer, node, meta_community)."""
    METHODS[name] = run
