"""Choice between block models by their integrated complete likelihood, from block counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import best_row


def _plogp(x: Column, n: Column) -> Column:
    """x * ln(x / n), 0 at 0."""
    return F.when(x > 0, x * F.ln(x / n)).otherwise(F.lit(0.0))


def icl(candidates: DataFrame, edges: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """(by..., layer, k, icl) of Bernoulli block models; candidates(by..., layer, node, community), undirected edges without weight.

    The log-likelihood of edges and blocks at the best rates, less half a log
    of the pairs for each of the k * (k + 1) / 2 rates and half a log of the nodes
    for each of the k - 1 shares.  Pairs are counted from block sizes and only
    blocks with edges are met: one without has a rate of 0 and adds nothing.
    Loops, edges without weight and nodes without a block take no part.
    """
    key = [*by, "layer"]
    size = candidates.groupBy(*key, "community").agg(F.count(F.lit(1)).alias("s"))
    n = size.groupBy(*key).agg(F.sum("s").alias("n"), F.count(F.lit(1)).alias("k"))
    shares = size.join(n, key).groupBy(*key).agg(F.sum(_plogp(F.col("s").cast("double"), F.col("n"))).alias("shares"))
    a = candidates.select(*by, "layer", F.col("node").alias("src"), F.col("community").alias("ca"))
    b = candidates.select(*by, "layer", F.col("node").alias("dst"), F.col("community").alias("cb"))
    lines = edges.where("weight > 0 and src <> dst").select("layer", "src", "dst")
    block = (
        lines.join(a, ["layer", "src"]).join(b, [*key, "dst"])
        .groupBy(*key, F.least("ca", "cb").alias("q"), F.greatest("ca", "cb").alias("r")).agg(F.count(F.lit(1)).cast("double").alias("m"))
        .join(size.select(*key, F.col("community").alias("q"), F.col("s").alias("sq")), [*key, "q"])
        .join(size.select(*key, F.col("community").alias("r"), F.col("s").alias("sr")), [*key, "r"])
        .withColumn("pairs", F.when(F.col("q") == F.col("r"), F.col("sq") * (F.col("sq") - 1) / 2).otherwise(F.col("sq") * F.col("sr")).cast("double"))
        .groupBy(*key).agg(F.sum(_plogp(F.col("m"), F.col("pairs")) + _plogp(F.col("pairs") - F.col("m"), F.col("pairs"))).alias("rates"))
    )
    pairs = F.col("n") * (F.col("n") - 1) / 2
    cost = F.col("k") * (F.col("k") + 1) / 4 * F.when(pairs > 0, F.ln(F.greatest(pairs, F.lit(1.0)))).otherwise(0.0) + (F.col("k") - 1) / 2 * F.ln("n")
    return n.join(shares, key).join(block, key, "left").select(*key, "k", (F.coalesce("rates", F.lit(0.0)) + F.col("shares") - cost).alias("icl"))


def best_model(scores: DataFrame, ties: list[str]) -> DataFrame:
    """Per layer the candidate of the largest ``icl``; equal ones go to fewer blocks, then to ``ties`` in order."""
    return best_row(scores, ["layer"], "icl", ["k", *ties])


def chosen_partition(candidates: DataFrame, edges: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """The rows of the candidate that each layer's ``icl`` prefers."""
    best = best_model(icl(candidates, edges, by), list(by)).select(*by, "layer")
    return candidates.join(best, [*by, "layer"], "left_semi")
