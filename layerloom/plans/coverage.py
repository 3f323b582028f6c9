"""How often bootstrap intervals hold the truth, when the model fitted to table layers is the truth.

Draws of the fitted block model are networks whose every probability is known.
Each is fitted and drawn again as if it had been observed, and the intervals that
come out are held against the shares of fresh draws.  Outer and inner draws are
columns of one plan, so all run side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import detect as D
from ..operators.redraw import redraw_sparse
from ..sources.layers import LayerSet
from ..sources.workspace import Workspace

#: Ends of intervals are exact for shares of 0 and 1 up to so much.
NOISE = 1e-9


def _together(membership: DataFrame, n: int) -> DataFrame:
    return B.co_assignment(membership.withColumnRenamed("community", "meta_community"), n)


def fresh_truth(spark: SparkSession, layers: LayerSet, membership: DataFrame, n_fresh: int, algorithm: str = "louvain", resolution: float = 1.0, seed: int = 123) -> DataFrame:
    """(layer, i, j, p): how often a fit of a fresh draw of the model puts two nodes together; pairs at 0 are left out."""
    drawn = redraw_sparse(spark, layers.nodes, layers.edges, membership, n_fresh, seed, layers.directed)
    reps = spark.range(1, n_fresh + 1).select(F.col("id").cast("int").alias("rep"))
    nodes = layers.nodes.crossJoin(F.broadcast(reps)).select("rep", "layer", "node")
    return _together(D.detect_layers(nodes, drawn, algorithm, resolution, layers.directed, None, seed, ("rep",), check=False), n_fresh)


def coverage(estimates: DataFrame, truth: DataFrame, sizes: DataFrame, n_inner: int, alpha: float = 0.05) -> DataFrame:
    """(layer, coverage, se, width, pairs, runs) of intervals for the chance that two nodes are together.

    estimates(run, layer, i, j, p) and truth(layer, i, j, p) leave out pairs at
    0, and sizes(run, layer, n) names every run and its number of nodes.  Pairs left
    out on both sides have the interval of a share of 0, which holds 0; they are
    counted, not listed.  ``se`` is the standard error over the runs, null with
    a single one; layers of fewer than two nodes have no pairs and no coverage.
    """
    spread = sizes.select("run", "layer").join(truth.select("layer", "i", "j", F.col("p").alias("true_p")), "layer")
    at = estimates.withColumnRenamed("p", "own_p").join(spread, ["run", "layer", "i", "j"], "full")
    pair = at.select("run", F.col("layer").alias("of"), "i", "j", F.coalesce("own_p", F.lit(0.0)).alias("p"), F.coalesce("true_p", F.lit(0.0)).alias("true_p"))
    found = B.intervals(pair.select(F.struct("run", "of", "true_p").alias("layer"), "i", "j", "p"), n_inner, alpha)
    missed = (F.col("layer.true_p") < F.col("lower") - NOISE) | (F.col("layer.true_p") > F.col("upper") + NOISE)
    listed = found.groupBy(F.col("layer.run").alias("run"), F.col("layer.of").alias("layer")).agg(
        F.sum(missed.cast("bigint")).alias("missed"), F.sum(F.col("upper") - F.col("lower")).alias("widths"), F.count(F.lit(1)).alias("listed")
    )
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    low, high = B.never_together(n_inner, alpha)
    runs = sizes.withColumn("pairs", pairs).where("pairs > 0").join(listed, ["run", "layer"], "left").select(
        "layer", "pairs", (1 - zero("missed") / F.col("pairs")).alias("share"),
        ((zero("widths") + (F.col("pairs") - zero("listed")) * (high - low)) / F.col("pairs")).alias("width"),
    )
    return runs.groupBy("layer").agg(
        F.avg("share").alias("coverage"), (F.stddev_samp("share") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.avg("width").alias("width"), F.max("pairs").alias("pairs"), F.count(F.lit(1)).alias("runs")
    )


def coverage_study(spark: SparkSession, layers: LayerSet, n_outer: int = 50, n_inner: int = 100, n_fresh: int = 200, algorithm: str = "louvain", resolution: float = 1.0, alpha: float = 0.05, seed: int = 123) -> DataFrame:
    """``coverage`` per layer of the intervals from ``n_inner`` redraws of each of ``n_outer`` draws of the fitted model.

    The truth comes from ``n_fresh`` draws with random numbers of their own.
    Intervals are of single layers; labels are not followed over layers.
    Equal seeds give equal rows.
    """
    if min(n_outer, n_inner, n_fresh) < 1:
        raise ValueError("n_outer, n_inner and n_fresh must be 1 or more")
    work = Workspace(spark, "coverage")
    fitted = work.put("fitted", D.detect_layers(layers.nodes, layers.edges, algorithm, resolution, layers.directed, None, seed))
    truth = work.put("truth", fresh_truth(spark, layers, fitted, n_fresh, algorithm, resolution, seed + 1))
    # A run's layers stand behind those of the run before, so that each is a layer of its own to what follows.
    span = layers.n_layers + 1
    stacked = (F.col("rep") * span + F.col("layer")).cast("int").alias("layer")
    outer = work.put("outer", redraw_sparse(spark, layers.nodes, layers.edges, fitted, n_outer, seed + 2, layers.directed).select(stacked, "src", "dst", "weight"))
    reps = lambda n: F.broadcast(spark.range(1, n + 1).select(F.col("id").cast("int").alias("rep")))
    nodes = work.put("nodes", layers.nodes.crossJoin(reps(n_outer)).select(stacked, "node"))
    seen = work.put("seen", D.detect_layers(nodes, outer, algorithm, resolution, layers.directed, None, seed, check=False))
    inner = work.put("inner", redraw_sparse(spark, nodes, outer, seen, n_inner, seed + 3, layers.directed))
    again = D.detect_layers(nodes.crossJoin(reps(n_inner)).select("rep", "layer", "node"), inner, algorithm, resolution, layers.directed, None, seed, ("rep",), check=False)
    run, layer = F.floor(F.col("layer") / span).cast("int").alias("run"), (F.col("layer") % span).cast("int").alias("layer")
    estimates = work.put("estimates", _together(again, n_inner).select(run, layer, "i", "j", "p"))
    sizes = nodes.groupBy(run, layer).agg(F.count(F.lit(1)).alias("n"))
    return coverage(estimates, truth, sizes, n_inner, alpha)
