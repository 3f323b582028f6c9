"""Planted partitions over layers, from portable random numbers: any engine can draw the same networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.portable import uniform


def _grid(spark: SparkSession, n_nodes: int, n_layers: int) -> DataFrame:
    nodes = spark.range(1, n_nodes + 1).select(F.col("id").cast("int").alias("node"))
    return nodes.withColumn("layer", F.explode(F.sequence(F.lit(1), F.lit(n_layers)))).select("layer", "node")


def skewed_shares(k: int, skew: float) -> list[float]:
    weights = [skew**i for i in range(k)]
    return [w / sum(weights) for w in weights]


def draw_community(u: Column, shares: list[float]) -> Column:
    """The community whose share of [0, 1) holds ``u``."""
    out, top = F.lit(len(shares)), 1.0
    for c in range(len(shares) - 1, 0, -1):
        top -= shares[c]
        out = F.when(u < top, c).otherwise(out)
    return out.cast("int")


def evolving_partition(
    spark: SparkSession,
    n_nodes: int,
    n_layers: int,
    n_communities: int,
    p_switch: float = 0.0,
    seed: int = 1,
    skew: float = 1.0,
) -> DataFrame:
    """truth(layer, node, community): nodes redraw their community with ``p_switch`` at each layer.

    A node's community is the draw of the last layer in which it switched.
    """
    g = _grid(spark, n_nodes, n_layers)
    draw = draw_community(uniform(seed, "c", F.col("layer"), F.col("node")), skewed_shares(n_communities, skew))
    if p_switch == 0:
        draw = draw_community(uniform(seed, "c", F.lit(1), F.col("node")), skewed_shares(n_communities, skew))
        return g.select("layer", "node", draw.alias("community"))
    switches = (F.col("layer") == 1) | (uniform(seed, "s", F.col("layer"), F.col("node")) < p_switch)
    w = Window.partitionBy("node").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("d", F.when(switches, draw)).select("layer", "node", F.last("d", ignorenulls=True).over(w).alias("community"))


def switch_count(truth: DataFrame, at: int, mode: str, seed: int = 1) -> DataFrame:
    """Communities merge (6 to 3: pairs become one) or split (3 to 6: halves by coin) from layer ``at`` on."""
    c = F.col("community")
    new = F.ceil(c / 2) if mode == "merge" else 2 * c - (uniform(seed, "half", F.col("node")) < 0.5).cast("int")
    return truth.withColumn("community", F.when(F.col("layer") >= at, new).otherwise(c).cast("int"))


def seasonal(truth: DataFrame, period: int) -> DataFrame:
    """Layers a period apart share their communities."""
    base = truth.where(F.col("layer") <= period).withColumnRenamed("layer", "phase")
    return truth.select("layer", "node", (F.pmod(F.col("layer") - 1, F.lit(period)) + 1).cast("int").alias("phase")).join(base, ["phase", "node"]).select("layer", "node", "community")


def regime_shift(before: DataFrame, after: DataFrame, at: int) -> DataFrame:
    return before.where(F.col("layer") < at).unionByName(after.where(F.col("layer") >= at))


def turnover(spark: SparkSession, n_nodes: int, n_layers: int, rate: float, seed: int = 1) -> DataFrame:
    """active(layer, node): nodes are born and die with ``rate`` per layer; a state is drawn anew when it changes."""
    g = _grid(spark, n_nodes, n_layers)
    flips = (F.col("layer") == 1) | (uniform(seed, "flip", F.col("layer"), F.col("node")) < rate)
    state = uniform(seed, "state", F.col("layer"), F.col("node")) < 0.8
    w = Window.partitionBy("node").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    on = g.withColumn("d", F.when(flips, state)).withColumn("on", F.last("d", ignorenulls=True).over(w))
    return on.where("on").select("layer", "node")


def densities(density: float, ratio: float, k: int) -> tuple[float, float]:
    """p_in and p_out of a mean density and their ratio."""
    p_in = min(1.0, max(0.0, density * ratio * k / (ratio + k - 1)))
    return p_in, min(1.0, p_in / ratio)


def node_factors(nodes: DataFrame, kind: str, seed: int = 1) -> DataFrame:
    """theta(node): none (1), lognormal (sd 0.6, mean 1) or pareto (alpha 2.5, mean 1)."""
    u = F.greatest(uniform(seed, "theta", F.col("node")), F.lit(1e-12))
    if kind == "lognormal":
        theta = F.exp(0.6 * normal(uniform(seed, "t1", F.col("node")), uniform(seed, "t2", F.col("node"))) - 0.18)
    elif kind == "pareto":
        theta = F.pow(u, F.lit(-1 / 2.5)) * (1.5 / 2.5)
    else:
        theta = F.lit(1.0)
    return nodes.select("node").distinct().withColumn("theta", theta)


def normal(u1: Column, u2: Column) -> Column:
    """A normal number from two uniform ones (Box and Muller)."""
    return F.sqrt(-2 * F.ln(F.greatest(u1, F.lit(1e-15)))) * F.cos(2 * F.pi() * u2)


def planted_edges(
    truth: DataFrame,
    p_in: float,
    p_out: float,
    seed: int = 1,
    directed: bool = False,
    weights: str = "binary",
    factors: DataFrame | None = None,
) -> DataFrame:
    """edges(layer, src, dst, weight) drawn for all pairs of a layer, as the model demands.

    ``aligned`` weights are larger inside communities (lognormal, meanlog 1
    against 0, sd 0.75), ``orthogonal`` ones alike (meanlog 0.5).
    """
    a = truth.select("layer", F.col("node").alias("src"), F.col("community").alias("ca"))
    b = truth.select("layer", F.col("node").alias("dst"), F.col("community").alias("cb"))
    pairs = a.join(b, "layer").where("src <> dst" if directed else "src < dst")
    p = F.when(F.col("ca") == F.col("cb"), p_in).otherwise(p_out)
    if factors is not None:
        pairs = pairs.join(factors.select(F.col("node").alias("src"), F.col("theta").alias("ta")), "src").join(factors.select(F.col("node").alias("dst"), F.col("theta").alias("tb")), "dst")
        p = F.least(F.lit(1.0), p * F.col("ta") * F.col("tb"))
    key = (F.col("layer"), F.col("src"), F.col("dst"))
    if weights == "binary":
        w = F.lit(1.0)
    else:
        mean = F.when(F.col("ca") == F.col("cb"), 1.0).otherwise(0.0) if weights == "aligned" else F.lit(0.5)
        w = F.exp(mean + 0.75 * normal(uniform(seed, "w1", *key), uniform(seed, "w2", *key)))
    return pairs.where(uniform(seed, "e", *key) < p).select("layer", "src", "dst", w.alias("weight"))


def random_design(spark: SparkSession, tasks: int, low: float, high: float, seed: int = 1) -> DataFrame:
    """Task rows with a size drawn evenly on a log scale."""
    u = uniform(seed, "n", F.col("id"))
    return spark.range(1, tasks + 1).select(F.col("id").cast("int").alias("task"), F.round(F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low))))).cast("int").alias("n"))
