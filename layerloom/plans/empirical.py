"""An empirical study as written stages: partitions, sizes, agreement, persistence.

Every stage is a table under one folder.  A study that was cut off goes on
where it stopped: finished tables are read, not made again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import metrics as M
from ..sources import storage
from ..sources.layers import LayerSet
from . import fits

Method = Callable[[SparkSession, LayerSet], DataFrame]

#: The fits of a study by name, each giving (layer, node, meta_community).
FITS: dict[str, Method] = {
    "jaccard": lambda spark, y: fits.fit_multilayer_jaccard(spark, y).meta,
    "overlap": lambda spark, y: fits.fit_multilayer_overlap(spark, y).meta,
    "weighted_jaccard": lambda spark, y: fits.fit_multilayer_weighted_jaccard(spark, y).meta,
    "weighted_overlap": lambda spark, y: fits.fit_multilayer_weighted_overlap(spark, y).meta,
    "hungarian": lambda spark, y: fits.fit_multilayer_hungarian(spark, y).meta,
}

STAGES = ("partitions", "sizes", "quality", "agreement", "persistence")


def study(spark: SparkSession, networks: dict[str, LayerSet], folder: str, methods: dict[str, Method] | None = None) -> dict[str, DataFrame]:
    """The stages of a study of several networks by several methods; ``folder`` is one that all executors share.

    partitions(network, method, layer, node, community); sizes(..., n_communities,
    largest, smallest, pct_largest); quality(..., modularity); agreement(network, layer, method1,
    method2, nmi) of every pair of methods; persistence(network, method, layer,
    nmi) between a layer and the next.  Each partition is a table of its own, so
    at most one is lost when a study is cut off.
    """
    methods = FITS if methods is None else methods
    runs = []
    for network, layers in networks.items():
        for name, method in methods.items():
            made = storage.cached(spark, f"{folder}/partition/{network}/{name}", lambda m=method, y=layers: m(spark, y).select("layer", "node", F.col("meta_community").alias("community")))
            runs.append(made.select(F.lit(network).alias("network"), F.lit(name).alias("method"), "layer", "node", "community"))
    partitions = storage.cached(spark, f"{folder}/partitions", lambda: reduce(DataFrame.unionByName, runs))
    key = ("network", "method")
    edges = reduce(DataFrame.unionByName, [y.edges.select(F.lit(n).alias("network"), "layer", "src", "dst", "weight") for n, y in networks.items()])
    names = spark.createDataFrame([(n, m) for n in networks for m in methods], "network string, method string")
    stages = {
        "sizes": lambda: G.summary(partitions, key),
        "quality": lambda: G.modularity(partitions, edges.join(names, "network"), by=key),
        "agreement": lambda: M.agreement(partitions, ["network", "layer"]),
        "persistence": lambda: M.nmi(_adjacent(partitions, list(key)), [*key, "layer"], trivial=1.0),
    }
    return {"partitions": partitions} | {name: storage.cached(spark, f"{folder}/{name}", make) for name, make in stages.items()}


def _adjacent(partitions: DataFrame, key: list[str]) -> DataFrame:
    """Nodes with their community in a layer (a) and in the next one (b)."""
    later = partitions.select(*key, (F.col("layer") - 1).alias("layer"), "node", F.col("community").alias("b"))
    return partitions.select(*key, "layer", "node", F.col("community").alias("a")).join(later, [*key, "layer", "node"])
