"""Measures of layered graphs, by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .incidence import linked_counts


def strengths(nodes: DataFrame, edges: DataFrame, directed: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Summed weights of a node's edges (directed: in and out); isolates have 0, a loop counts twice."""
    key = [*by, "layer"]
    ends = edges.select(*key, F.col("src").alias("node"), "weight").unionByName(edges.select(*key, F.col("dst").alias("node"), "weight"))
    total = ends.groupBy(*key, "node").agg(F.sum("weight").alias("strength"))
    return nodes.join(total, [*key, "node"], "left").select(*key, "node", F.coalesce("strength", F.lit(0.0)).alias("strength"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return strengths(nodes, edges.withColumn("weight", F.lit(1.0))).select("layer", "node", F.col("strength").cast("bigint").alias("degree"))


def pooled(edges: DataFrame) -> DataFrame:
    """All layers as one graph: weights summed."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def density(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    n = nodes.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    m = edges.where("src <> dst and weight > 0").groupBy("layer").agg(F.count(F.lit(1)).alias("m"))
    return _density(n, m, 1 if directed else 2)


def _density(n: DataFrame, m: DataFrame, half: int) -> DataFrame:
    pairs = F.col("n") * (F.col("n") - 1) / half
    return n.join(m, "layer", "left").select(
        "layer", "n", F.coalesce("m", F.lit(0)).alias("m"), F.when(pairs > 0, F.coalesce("m", F.lit(0)) / F.nullif(pairs, F.lit(0.0))).otherwise(0.0).alias("density")
    )


def incidence_density(nodes: DataFrame, incidence: DataFrame, group: list[str]) -> DataFrame:
    """``density`` of the graph that joins all nodes of a group; pairs are counted between classes of nodes, see ``linked_counts``."""
    held = incidence.select("layer", "node").distinct().withColumn("community", F.lit(0))
    n = nodes.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    m = linked_counts(held, incidence, group).select("layer", F.col("e_all").alias("m"))
    return _density(n, m, 2)


def modularity(membership: DataFrame, edges: DataFrame, resolution: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Newman modularity per layer; null where a layer has no weight."""
    key = [*by, "layer"]
    a = membership.select(*key, F.col("node").alias("src"), F.col("community").alias("ca"))
    b = membership.select(*key, F.col("node").alias("dst"), F.col("community").alias("cb"))
    e = edges.join(a, [*key, "src"]).join(b, [*key, "dst"])
    ends = e.select(*key, F.col("ca").alias("community"), "weight", F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0).alias("inside")).unionByName(
        e.select(*key, F.col("cb").alias("community"), "weight", F.lit(0.0).alias("inside"))
    )
    per = ends.groupBy(*key, "community").agg(F.sum("weight").alias("degree"), F.sum("inside").alias("inside"))
    two_m = F.sum("degree").over(Window.partitionBy(*key))
    q = per.withColumn("m2", two_m).groupBy(*key).agg(
        F.sum(2 * F.col("inside") / F.nullif(F.col("m2"), F.lit(0.0)) - resolution * F.pow(F.col("degree") / F.nullif(F.col("m2"), F.lit(0.0)), F.lit(2))).alias("modularity")
    )
    return membership.select(*key).distinct().join(q, key, "left")


def incidence_strengths(nodes: DataFrame, incidence: DataFrame, group: list[str]) -> DataFrame:
    """``strengths`` of the graph that joins all nodes of a group, from incidence(layer, group..., node), rows distinct.

    The weight of a pair is the number of groups it shares, so a node gains a
    group's other members; no pair is listed.
    """
    size = incidence.groupBy("layer", *group).agg((F.count(F.lit(1)) - 1).alias("others"))
    total = incidence.join(size, ["layer", *group]).groupBy("layer", "node").agg(F.sum("others").cast("double").alias("strength"))
    return nodes.join(total, ["layer", "node"], "left").select("layer", "node", F.coalesce("strength", F.lit(0.0)).alias("strength"))


def incidence_modularity(membership: DataFrame, incidence: DataFrame, group: list[str], resolution: float = 1.0) -> DataFrame:
    """``modularity`` of the graph that joins all nodes of a group.

    Of the n members of a group, m of one community share m * (m - 1) / 2
    edges inside it and bring it a degree of m * (n - 1).  Nodes without a
    community take no part.
    """
    held = incidence.join(membership.select("layer", "node", "community"), ["layer", "node"])
    cell = held.groupBy("layer", *group, "community").agg(F.count(F.lit(1)).alias("m"))
    size = cell.groupBy("layer", *group).agg(F.sum("m").alias("n"))
    per = cell.join(size, ["layer", *group]).groupBy("layer", "community").agg(
        F.sum(F.col("m") * (F.col("n") - 1)).cast("double").alias("degree"), F.sum(F.col("m") * (F.col("m") - 1)).cast("double").alias("twice")
    )
    total = per.groupBy("layer").agg(F.nullif(F.sum("degree"), F.lit(0.0)).alias("m2"))
    q = per.join(total, "layer").groupBy("layer").agg(F.sum(F.col("twice") / F.col("m2") - resolution * F.pow(F.col("degree") / F.col("m2"), F.lit(2))).alias("modularity"))
    return membership.select("layer").distinct().join(q, "layer", "left")


def summary(membership: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Communities per layer: how many, the largest, the smallest, the largest's share."""
    per = membership.groupBy(*by, "layer", "community").agg(F.count(F.lit(1)).alias("size"))
    return per.groupBy(*by, "layer").agg(
        F.count(F.lit(1)).alias("n_communities"),
        F.max("size").alias("largest"),
        F.min("size").alias("smallest"),
        (F.max("size") / F.sum("size")).alias("pct_largest"),
    )


def supra_edges(edges: DataFrame, ties: DataFrame, omega: float = 1.0, by: tuple[str, ...] = (), once: bool = False) -> DataFrame:
    """The multislice graph on (layer, node): own edges, and identity ties weighted by link and ``omega``; parallels are summed.

    ``once`` says that ``edges`` has every pair once, as src < dst; then only ties are summed and edges pass as they are.
    """
    inner = edges.select(*by, F.col("layer").alias("layer_a"), F.col("src").alias("node_a"), F.col("layer").alias("layer_b"), F.col("dst").alias("node_b"), "weight")
    outer = ties.select(*by, F.col("from_layer").alias("layer_a"), F.col("node").alias("node_a"), F.col("to_layer").alias("layer_b"), F.col("node").alias("node_b"), (F.col("layer_weight") * omega).alias("weight"))
    u, v = F.struct(F.col("layer_a").alias("l"), F.col("node_a").alias("n")), F.struct(F.col("layer_b").alias("l"), F.col("node_b").alias("n"))
    summed = (
        (outer if once else inner.unionByName(outer))
        .select(*by, F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), "weight")
        .groupBy(*by, "u", "v")
        .agg(F.sum("weight").alias("weight"))
        .select(*by, F.col("u.l").alias("layer_a"), F.col("u.n").alias("node_a"), F.col("v.l").alias("layer_b"), F.col("v.n").alias("node_b"), "weight")
    )
    return inner.unionByName(summed) if once else summed


def fallback_labels(membership: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Labels distinct over all layers when nothing ties them: each layer's are shifted by the maxima before it."""
    top = membership.groupBy(*by, "layer").agg(F.max("community").alias("top"))
    w = Window.partitionBy(*by).orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    shift = top.withColumn("shift", F.coalesce(F.sum("top").over(w), F.lit(0))).drop("top")
    return membership.join(shift, [*by, "layer"]).select(*by, "layer", "node", (F.col("community") + F.col("shift")).cast("int").alias("meta_community"))
