"""Following communities through the layers by matching labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels.assignment import best_matching, greedy_matching
from .metrics import adjacent, contingency

METHODS = ("optimal", "greedy", "reuse")


def overlapping_matching(score: list[list[float]]) -> list[tuple[int, int]]:
    """Rows by descending best score, each with its best column among those not taken, at a positive score only."""
    pairs: list[tuple[int, int]] = []
    free = set(range(len(score[0])))
    for i in sorted(range(len(score)), key=lambda i: (-max(score[i]), i)):
        j = min(free, key=lambda j: (-score[i][j], j), default=None)
        if j is not None and score[i][j] > 0:
            pairs.append((i, j))
            free.remove(j)
    return pairs


def relabel_step(now: list[int], before: dict[int, int], overlap: dict[tuple[int, int], int], fresh: int, method: str) -> tuple[dict[int, int], int]:
    """Labels for the communities ``now``, given the labels of those before and the common nodes (before, now).

    ``optimal`` and ``greedy`` never use a label again once its community is
    gone; ``reuse`` goes through the communities by their best overlap, gives each
    the free label it overlaps most, if any, and else the next above those in use.
    """
    old = sorted(before, key=lambda c: before[c])  # equal scores go to the smallest label
    score = [[float(overlap.get((o, c), 0)) for o in old] for c in now]
    named: dict[int, int] = {}
    if old and now:
        pairs = best_matching(score) if method == "optimal" else greedy_matching(score) if method == "greedy" else overlapping_matching(score)
        named = {now[i]: before[old[j]] for i, j in pairs if score[i][j] > 0}
    for c in now:
        if c not in named:
            if method == "reuse":
                fresh = max([0, *before.values(), *named.values()]) + 1
            named[c] = fresh
            fresh += 1
    return named, fresh


def track(membership: DataFrame, method: str = "optimal") -> DataFrame:
    """meta_community per (layer, node): each layer's communities matched with those of the layer before.

    Overlaps come from one aggregate over all pairs of layers; the fold over
    the layers sees these counts only, one small group.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    counts = contingency(adjacent(membership), ["layer"])
    present = membership.select("layer", "community").distinct()
    frame = present.select("layer", "community", F.lit(None).cast("int").alias("b"), F.lit(0).cast("bigint").alias("n")).unionByName(
        counts.select("layer", F.col("a").alias("community"), "b", "n")
    ).withColumn("one", F.lit(1))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        layers: dict[int, list[int]] = {}
        overlap: dict[int, dict[tuple[int, int], int]] = {}
        for layer, a, b, n in zip(rows["layer"], rows["community"], rows["b"], rows["n"], strict=True):
            if n:
                overlap.setdefault(layer + 1, {})[(a, int(b))] = n
            else:
                layers.setdefault(layer, []).append(a)
        out, before, fresh, last = [], {}, 1, None
        for layer in sorted(layers):
            step = overlap.get(layer, {}) if last == layer - 1 else {}
            before, fresh = relabel_step(sorted(layers[layer]), before, step, fresh, method)
            last = layer
            out += [(layer, c, m) for c, m in before.items()]
        return pd.DataFrame(out, columns=["layer", "community", "meta_community"])

    names = frame.groupBy("one").applyInPandas(fold, "layer int, community int, meta_community int")
    return membership.join(names, ["layer", "community"]).select("layer", "node", "meta_community")


def windows(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each layer together with the one before it, as graphs of their own (layer -> window): no later information."""
    both = lambda df: df.unionByName(df.withColumn("layer", F.col("layer") + 1))
    top = nodes.agg(F.max("layer").alias("top"))
    inside = lambda df: df.join(F.broadcast(top), F.col("layer") <= F.col("top")).drop("top")
    e = inside(both(edges)).groupBy("layer", "src", "dst").agg(F.sum("weight").alias("weight"))
    return e, inside(both(nodes)).distinct()
