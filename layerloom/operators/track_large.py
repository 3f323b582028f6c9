"""Optimal matching of communities, layer after layer, where there are too many for one group.

A pair of communities is fixed as soon as no other choice can be better: each is
the other's largest overlap, and that is at least as much as what both could
have elsewhere together.  Fixed pairs leave, which fixes more, all layers side
by side, as maxima and joins.  What is left, if anything, is small and is solved
per pair of layers; a larger rest is refused.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import Workspace
from .kernels.assignment import best_matching
from .metrics import adjacent, contingency
from .ranks import ranked

#: Communities of a layer that a task matches; layers that followed communities may run through, as a power of two.
MOST_LEFT, MOST_DOUBLINGS = 400, 40
PAIRS = "layer {layer}, a {a}, b {b}, n bigint"


def _best(overlaps: DataFrame, side: str, other: str) -> DataFrame:
    """(layer, side, best partner, second largest overlap) of every community of one side; ties go to the smaller partner."""
    top = overlaps.groupBy("layer", side).agg(F.max_by(other, F.struct("n", (-F.col(other)).alias("o"))).alias(f"best_{side}"))
    rest = F.coalesce(F.max(F.when(F.col(other) != F.col(f"best_{side}"), F.col("n"))), F.lit(0))
    return overlaps.join(top, ["layer", side]).groupBy("layer", side).agg(F.first(f"best_{side}").alias(f"best_{side}"), rest.alias(f"rest_{side}"))


def safe_pairs(overlaps: DataFrame) -> DataFrame:
    """The pairs (layer, a, b, n) that some best matching holds, whatever the others do.

    Taking such a pair into a matching costs at most ``rest_a + rest_b``, the
    partners that its two ends give up.
    """
    judged = overlaps.join(_best(overlaps, "a", "b"), ["layer", "a"]).join(_best(overlaps, "b", "a"), ["layer", "b"])
    return judged.where("best_a = b and best_b = a and n >= rest_a + rest_b").select("layer", "a", "b", "n")


def heaviest_matching(overlaps: DataFrame, most_left: int = MOST_LEFT) -> DataFrame:
    """(layer, a, b, n): per layer, pairs of largest total n in which no a and no b comes twice.

    ``overlaps`` has each (layer, a, b) once, a and b being numbers; pairs
    without a positive n are never matched.  Equal totals may be reached by other
    pairs than those given, which are the same in every run.  A layer in which more
    than ``most_left`` communities of either side stay undecided is an error.
    """
    work = Workspace(overlaps.sparkSession, "matching")
    todo = work.put("todo0", overlaps.where("n > 0").select("layer", "a", "b", F.col("n").cast("bigint").alias("n")))
    found, turn = todo.limit(0), 0
    while not todo.isEmpty():
        fixed = work.put(f"fixed{turn}", safe_pairs(todo))
        if fixed.isEmpty():
            break
        found = found.unionByName(fixed)
        rest = todo.join(fixed.select("layer", "a"), ["layer", "a"], "left_anti").join(fixed.select("layer", "b"), ["layer", "b"], "left_anti")
        todo, turn = work.put(f"todo{turn + 1}", rest), turn + 1
        work.drop(f"todo{turn - 1}")
    left = todo.groupBy("layer").agg(F.count_distinct("a").alias("x"), F.count_distinct("b").alias("y"))
    if not left.where(F.greatest("x", "y") > most_left).isEmpty():
        raise ValueError(f"more than {most_left} communities of a layer have no partner that is safe")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        old, new = sorted(rows["a"].unique()), sorted(rows["b"].unique())
        cell = dict(zip(zip(rows["a"], rows["b"], strict=True), rows["n"], strict=True))
        pairs = best_matching([[float(cell.get((a, b), 0)) for b in new] for a in old])
        made = [(rows["layer"].iloc[0], old[i], new[j], cell[old[i], new[j]]) for i, j in pairs if (old[i], new[j]) in cell]
        return pd.DataFrame(made, columns=["layer", "a", "b", "n"])

    solved = todo.groupBy("layer").applyInPandas(solve, PAIRS.format(**dict(overlaps.dtypes)))
    return work.put("matching", found.unionByName(solved))


def track_large(membership: DataFrame, most_left: int = MOST_LEFT) -> DataFrame:
    """meta_community per (layer, node), as ``track`` gives it by optimal matching, without a group of all layers.

    A community takes the label of its partner in the layer before; one without a
    partner starts a label, numbered in order of layer and community.  The way back to
    the start of a label is halved in every turn.  Where several matchings have
    the largest total, ``track`` may take another one.
    """
    work = Workspace(membership.sparkSession, "track")
    pairs = heaviest_matching(contingency(adjacent(membership), ["layer"]), most_left)
    before = pairs.select((F.col("layer") + 1).alias("layer"), F.col("b").alias("community"), F.col("layer").alias("to_layer"), F.col("a").alias("to"))
    own = lambda c, o: F.coalesce(F.col(c), F.col(o)).alias(c)
    present = membership.select("layer", "community").distinct()
    way = work.put("way0", present.join(before, ["layer", "community"], "left").select("layer", "community", own("to_layer", "layer"), own("to", "community")))
    for turn in range(1, MOST_DOUBLINGS):
        on = way.select(F.col("layer").alias("to_layer"), F.col("community").alias("to"), F.col("to_layer").alias("next_layer"), F.col("to").alias("next"))
        further = work.put(f"way{turn}", way.join(on, ["to_layer", "to"]).select("layer", "community", F.col("next_layer").alias("to_layer"), F.col("next").alias("to"), (F.col("next_layer") != F.col("to_layer")).alias("moved")))
        work.drop(f"way{turn - 1}")
        moved = not further.where("moved").isEmpty()
        way = further.drop("moved")
        if not moved:
            break
    else:
        raise RuntimeError("labels did not reach their start")
    starts = way.where("layer = to_layer").select(F.col("layer").alias("to_layer"), F.col("community").alias("to"))
    names = ranked(starts, [], ["to_layer", "to"], work.put, "starts").select("to_layer", "to", (F.col("rank") + 1).cast("int").alias("meta_community"))
    labels = work.put("labels", way.join(names, ["to_layer", "to"]).select("layer", "community", "meta_community"))
    return membership.join(labels, ["layer", "community"]).select("layer", "node", "meta_community")
