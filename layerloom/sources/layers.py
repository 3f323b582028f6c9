"""Ordered layers of weighted edges over a node universe, as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.incidence import incidence_edges
from ..operators.ranks import dense
from .workspace import Workspace

EDGES = "layer int, src {t}, dst {t}, weight double"


@dataclass(frozen=True)
class LayerSet:
    """nodes(layer, node), with isolates; edges(layer, src, dst, weight); optional labels(node, label)."""

    nodes: DataFrame
    edges: DataFrame
    n_layers: int
    directed: bool = False
    labels: DataFrame | None = None


def undirected(edges: DataFrame, how: str = "max") -> DataFrame:
    """One row per unordered pair: endpoints in order, parallel weights combined by ``how``."""
    agg = {"max": F.max, "sum": F.sum}[how]
    return (
        edges.groupBy("layer", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(agg("weight").alias("weight"))
        .select("layer", "src", "dst", "weight")
    )


def from_edges(
    edges: DataFrame,
    nodes: DataFrame | None = None,
    directed: bool = False,
    same_nodes: bool = True,
    drop_loops: bool = False,
    n_layers: int | None = None,
    how: str = "sum",
) -> LayerSet:
    """Layers from an edge table; zero weights are no edges, a missing weight is 1.

    Parallel edges add up, undirected ones in either direction; ``how="max"``
    is for tables that list both directions of one edge, as a matrix does.
    Without ``nodes`` a layer's nodes are its endpoints.  ``same_nodes`` demands
    equal node sets in all layers.
    """
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    edges = edges.select(F.col("layer").cast("int"), "src", "dst", F.col("weight").cast("double")).where("weight <> 0")
    ends = edges.select("layer", F.col("src").alias("node")).unionByName(edges.select("layer", F.col("dst").alias("node")))
    nodes = (nodes.select(F.col("layer").cast("int"), "node").unionByName(ends) if nodes is not None else ends).distinct()
    if drop_loops:
        edges = edges.where("src <> dst")
    merged = {"max": F.max, "sum": F.sum}[how]("weight").alias("weight")
    edges = edges.groupBy("layer", "src", "dst").agg(merged) if directed else undirected(edges, how)
    n = n_layers or nodes.agg(F.max("layer")).first()[0] or 0
    if n < 2:
        raise ValueError("at least two layers are needed")
    found = LayerSet(nodes, edges, n, directed)
    return canonical(validated(found)) if same_nodes else found


def validated(layers: LayerSet) -> LayerSet:
    """Raises unless every node is in every layer."""
    per = layers.nodes.groupBy("node").agg(F.count_distinct("layer").alias("n"))
    if not per.where(F.col("n") != layers.n_layers).isEmpty():
        raise ValueError("all layers must have the same node set")
    return layers


def canonical(layers: LayerSet) -> LayerSet:
    """Node ids 1..n in the order of the labels; labels are kept where they differ from the ids."""
    universe = layers.nodes.select("node").distinct()
    work = Workspace(universe.sparkSession, "canonical")
    ids = work.put("ids", dense(universe, "node", work.put).select("node", F.col("id").cast("int").alias("id")))
    if not ids.where(F.col("node").cast("string") != F.col("id").cast("string")).isEmpty():
        nodes = layers.nodes.join(ids, "node").select("layer", F.col("id").alias("node"))
        a = ids.select(F.col("node").alias("src"), F.col("id").alias("a"))
        b = ids.select(F.col("node").alias("dst"), F.col("id").alias("b"))
        edges = layers.edges.join(a, "src").join(b, "dst").select("layer", F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
        return LayerSet(nodes, edges, layers.n_layers, layers.directed, ids.select(F.col("id").alias("node"), F.col("node").alias("label")))
    return layers


def from_matrices(spark: SparkSession, layers: list, directed: bool = False, same_nodes: bool = True) -> LayerSet:
    """Layers from square matrices (lists of rows), nodes 1..n."""
    if not isinstance(layers, list):
        raise TypeError("layers must be a list")
    if len(layers) < 2:
        raise ValueError("at least two layers are needed")
    rows, nodes = [], []
    for t, m in enumerate(layers, 1):
        m = [list(r) for r in m]
        if any(len(r) != len(m) for r in m):
            raise ValueError(f"layer {t} is not a square matrix")
        nodes += [(t, i + 1) for i in range(len(m))]
        rows += [(t, i + 1, j + 1, float(w)) for i, r in enumerate(m) for j, w in enumerate(r) if w != 0]
    return from_edges(
        spark.createDataFrame(rows, EDGES.format(t="int")),
        spark.createDataFrame(nodes, "layer int, node int"),
        directed,
        same_nodes,
        n_layers=len(layers),
        how="max",
    )


def from_arrays(matrices: DataFrame) -> DataFrame:
    """Rows (layer, matrix array<array<double>>) as edges."""
    return (
        matrices.select("layer", F.posexplode("matrix").alias("i", "row"))
        .select("layer", "i", F.posexplode("row").alias("j", "weight"))
        .where("weight <> 0")
        .select(F.col("layer").cast("int"), (F.col("i") + 1).alias("src"), (F.col("j") + 1).alias("dst"), "weight")
    )


def panel_layers(panel: DataFrame, value: str, first: int, last: int, a: str = "ccode1", b: str = "ccode2", year: str = "year", order: str | None = None) -> LayerSet:
    """A dyad-year panel as yearly layers over all states of the period; null is 0.

    Of several rows of a pair, in either direction, the last by ``order`` holds,
    even where it is 0, of equally late ones the largest; without an order the larger value does.
    """
    rows = panel.where(F.col(year).between(first, last)).select(
        (F.col(year) - (first - 1)).cast("int").alias("layer"),
        F.col(a).alias("src"),
        F.col(b).alias("dst"),
        F.coalesce(F.col(value), F.lit(0)).cast("double").alias("weight"),
        F.col(order or year).alias("place"),
    )
    states = rows.select(F.col("src").alias("node")).unionByName(rows.select(F.col("dst").alias("node"))).distinct()
    n = last - first + 1
    years = panel.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("layer"))
    nodes = states.withColumn("layer", F.explode(F.sequence(F.lit(1), F.lit(n)))).select("layer", "node") if n else years
    apart = rows.where("src <> dst")
    if order is None:
        return LayerSet(nodes, undirected(apart.where("weight <> 0")), n)
    last = apart.groupBy("layer", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max_by("weight", F.struct("place", "weight")).alias("weight"))
    return LayerSet(nodes, last.where("weight <> 0"), n)


def total_of(*columns: str) -> Column:
    """A measure summed from several columns, nulls as 0."""
    out = F.lit(0.0)
    for c in columns:
        out = out + F.coalesce(F.col(c), F.lit(0))
    return out


def find_column(columns: Sequence[str], patterns: Sequence[str]) -> str:
    """The first column that fits the earliest pattern that any fits."""
    for p in patterns:
        for c in columns:
            if re.search(p, c, re.IGNORECASE):
                return c
    raise ValueError(f"no column fits any of {list(patterns)}")


def drop_isolates(layers: LayerSet) -> LayerSet:
    e = layers.edges.where("src <> dst")
    ends = e.select("layer", F.col("src").alias("node")).unionByName(e.select("layer", F.col("dst").alias("node")))
    return LayerSet(layers.nodes.join(ends.distinct(), ["layer", "node"], "left_semi"), layers.edges, layers.n_layers, layers.directed, layers.labels)


# Layers from the driver's tables.


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly trade between nations: (layer, src, dst, weight), nations apart, weights in whole cents."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    c = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("a"))
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, F.col("o_custkey") == c.c_custkey)
        .join(s, F.col("l_suppkey") == s.s_suppkey)
        .where("a <> b")
        .groupBy((F.col("y") - 1994).cast("int").alias("layer"), F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("weight"))
    )


def trade_layers(spark: SparkSession, sf_dir: str) -> LayerSet:
    edges = trade_edges(spark, sf_dir)
    n = edges.agg(F.max("layer")).first()[0]
    nations = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    nodes = nations.withColumn("layer", F.explode(F.sequence(F.lit(1), F.lit(n)))).select("layer", "node")
    return LayerSet(nodes, edges, n)


def week_of(ts: Column) -> Column:
    return (F.floor((F.dayofmonth(ts) - 1) / 7) + 1).cast("int")


def event_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by week and most frequent event type: (layer, node, community); ties by name."""
    e = _read(spark, sf_dir, "events").select(week_of(F.col("ts")).alias("layer"), F.col("user_id").alias("node"), "event_type")
    counts = e.groupBy("layer", "node", "event_type").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("layer", "node").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("t"))
    kinds = e.select("event_type").distinct().select("event_type", F.dense_rank().over(Window.orderBy("event_type")).cast("int").alias("community"))
    return top.select("layer", "node", F.col("t.event_type").alias("event_type")).join(kinds, "event_type").select("layer", "node", "community")


#: What two users share to be joined by an edge.
EVENT_GROUP = ["d", "event_type"]


def event_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, d, event_type, node): the users of an event type on a day, by week; ``event_edges`` lists their pairs."""
    return _read(spark, sf_dir, "events").select(
        week_of(F.col("ts")).alias("layer"), F.to_date("ts").alias("d"), "event_type", F.col("user_id").alias("node")
    ).distinct()


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the same event type on the same day, by week: weight counts (day, type) pairs."""
    return incidence_edges(event_incidence(spark, sf_dir), EVENT_GROUP)


def copart_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ordered together, by year."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", (F.year("o_orderdate") - 1994).cast("int").alias("layer"))
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src")).distinct()
    other = li.select("l_orderkey", F.col("src").alias("dst"))
    return (
        li.join(other, "l_orderkey").where("src < dst").join(o, F.col("l_orderkey") == o.o_orderkey)
        .groupBy("layer", "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
