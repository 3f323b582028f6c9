"""The parametric network bootstrap: redraw layers from a fitted block model, refit, and count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.portable import uniform, wilson
from ..sources.workspace import Workspace
from .incidence import _largest, _met_in_runs, incidence_edges, linked_counts, linked_weights, summed_weights


def edge_model(nodes: DataFrame, edges: DataFrame, membership: DataFrame, directed: bool = False) -> DataFrame:
    """(layer, p_in, p_out): shares of pairs with a positive edge, inside and between communities.

    Pairs are counted from community sizes, none is listed.  Without pairs of
    one kind the overall share stands in, and 0 without any.
    """
    e = edges.where("weight > 0 and src <> dst")
    a = membership.select("layer", F.col("node").alias("src"), F.col("community").alias("ca"))
    b = membership.select("layer", F.col("node").alias("dst"), F.col("community").alias("cb"))
    n = e.join(a, ["layer", "src"]).join(b, ["layer", "dst"]).groupBy("layer").agg(
        F.sum((F.col("ca") == F.col("cb")).cast("bigint")).alias("e_in"), F.count(F.lit(1)).alias("e_all")
    )
    return _shares(n, membership, 1 if directed else 2)


def incidence_edge_model(membership: DataFrame, incidence: DataFrame, group: list[str]) -> DataFrame:
    """``edge_model`` of the graph that joins all nodes of a group, without listing its edges."""
    return _shares(linked_counts(membership, incidence, group), membership, 2)


def _shares(n: DataFrame, membership: DataFrame, half: int) -> DataFrame:
    """The model from (layer, e_in, e_all) and the sizes of the communities."""
    size = membership.groupBy("layer", "community").agg(F.count(F.lit(1)).alias("s"))
    d = size.groupBy("layer").agg(F.sum(F.col("s") * (F.col("s") - 1) / half).alias("d_in"), F.sum("s").alias("n")).withColumn("d_all", F.col("n") * (F.col("n") - 1) / half)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda x, y: x / F.nullif(y, F.lit(0.0))
    p_all = F.coalesce(share(zero("e_all"), F.col("d_all")), F.lit(0.0))
    return d.join(n, "layer", "left").select(
        "layer",
        F.coalesce(share(zero("e_in"), F.col("d_in")), p_all).alias("p_in"),
        F.coalesce(share(zero("e_all") - zero("e_in"), F.col("d_all") - F.col("d_in")), p_all).alias("p_out"),
    )


#: Different weights of a kind up to which a pool is carried as a list of runs.
MOST_RUNS = 256
#: Nodes in a block at least, and blocks of a layer at most; a pair costs two digests per replicate, so blocks are small.
REDRAW_BLOCK, REDRAW_BLOCKS, REDRAW_WIDE = 128, 88, 8


def _known(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Positive edges between nodes with communities, ``same`` telling those inside one."""
    e = edges.where("weight > 0 and src <> dst")
    a = membership.select("layer", F.col("node").alias("src"), F.col("community").alias("ca"))
    b = membership.select("layer", F.col("node").alias("dst"), F.col("community").alias("cb"))
    return e.join(a, ["layer", "src"]).join(b, ["layer", "dst"]).withColumn("same", F.col("ca") == F.col("cb"))


def weight_pools(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(layer, same, weight, idx, idx_all): places of sorted weights inside and between communities and among all; an empty pool borrows all, then 1."""
    known = _known(edges, membership)
    order = Window.partitionBy("layer", "same").orderBy("weight", "src", "dst")
    both = Window.partitionBy("layer").orderBy("weight", "src", "dst")
    return known.select("layer", "same", "weight", (F.row_number().over(order) - 1).alias("idx"), (F.row_number().over(both) - 1).alias("idx_all"))


def _runs_of(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys..., pool, size): per key the weights in order, each with the number of places up to it."""
    per = runs.groupBy(*keys, "weight").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("weight").rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("upto", upto).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("upto", "weight"))).alias("pool"), F.sum("n").alias("size"))


def _few(runs: DataFrame) -> bool:
    return (runs.groupBy("layer").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0) <= MOST_RUNS


def _drawn(spark: SparkSession, membership: DataFrame, model: DataFrame, n_boot: int, seed: int, directed: bool, work: Workspace) -> DataFrame:
    """(rep, layer, src, dst, same): the pairs that are drawn; every pair is asked where two blocks of nodes meet."""
    reps = spark.range(1, n_boot + 1).select(F.col("id").cast("int").alias("rep"))
    points = membership.select("layer", "node", "community")
    met = _met_in_runs(points, ["community"], work, max(REDRAW_BLOCK, -(-_largest(points)[0] // REDRAW_BLOCKS)), REDRAW_WIDE)
    ends = met.select("layer", F.col("a.node").alias("src"), F.col("b.node").alias("dst"), (F.col("a.community") == F.col("b.community")).alias("same"))
    if directed:
        turned = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        ends = ends.select("layer", turned.alias("e"), "same").select("layer", "e.src", "e.dst", "same")
    drawn = ends.join(model, "layer").crossJoin(F.broadcast(reps))
    p = F.when(F.col("same"), F.col("p_in")).otherwise(F.col("p_out"))
    return drawn.where(uniform(seed, F.col("rep"), F.col("layer"), F.col("src"), F.col("dst")) < p)


def _weighed(drawn: DataFrame, runs: DataFrame, seed: int) -> DataFrame:
    """edges(rep, layer, src, dst, weight): weights looked up in runs(layer, same, weight, n) of equal ones."""
    u = uniform(seed, F.lit("w"), F.col("rep"), F.col("layer"), F.col("src"), F.col("dst"))
    drawn = drawn.join(_runs_of(runs, "layer", "same"), ["layer", "same"], "left").join(_runs_of(runs, "layer").withColumnsRenamed({"pool": "pool_all", "size": "size_all"}), "layer", "left")
    drawn = drawn.withColumn("place", F.floor(u * F.coalesce("size", "size_all")))
    at = lambda pool: F.get(F.filter(pool, lambda r: r["upto"] > F.col("place")), F.lit(0))["weight"]
    weight = F.when(F.col("size").isNotNull(), at("pool")).otherwise(at("pool_all"))
    return drawn.select("rep", "layer", "src", "dst", F.coalesce(weight, F.lit(1.0)).alias("weight"))


def incidence_redraw(spark: SparkSession, membership: DataFrame, incidence: DataFrame, group: list[str], n_boot: int, seed: int = 1) -> DataFrame:
    """``redraw`` of the graph that joins all nodes of a group, of which only the numbers of edges by weight are asked.

    Edges are listed only where they have too many different weights.
    """
    work = Workspace(spark, "incidence-redraw")
    runs = work.put("runs", linked_weights(membership, incidence, group))
    if not _few(runs):
        return redraw(spark, membership, incidence_edges(incidence, group), membership, n_boot, seed)
    model = work.put("model", _shares(summed_weights(runs), membership, 2))
    return _weighed(_drawn(spark, membership, model, n_boot, seed, False, work), runs, seed)


def redraw(spark: SparkSession, nodes: DataFrame, edges: DataFrame, membership: DataFrame, n_boot: int, seed: int = 1, directed: bool = False) -> DataFrame:
    """edges(rep, layer, src, dst, weight) of ``n_boot`` redraws; weights come from the matching pool.

    Every pair of nodes is asked once per replicate where two blocks of nodes
    meet, and is not moved after that while pools have few different weights:
    then a pool is a list of runs of equal weights, and a place in it is looked
    up there.  Pools of many different weights are joined by place.
    """
    work = Workspace(spark, "bootstrap-redraw")
    model = work.put("model", edge_model(nodes, edges, membership, directed))
    runs = work.put("runs", _known(edges, membership).groupBy("layer", "same", "weight").agg(F.count(F.lit(1)).alias("n")))
    drawn = _drawn(spark, membership, model, n_boot, seed, directed, work)
    if _few(runs):
        return _weighed(drawn, runs, seed)
    key = (F.col("rep"), F.col("layer"), F.col("src"), F.col("dst"))
    pools = weight_pools(edges, membership)
    kinds = pools.groupBy("layer", "same").agg(F.count(F.lit(1)).alias("size"))
    every = pools.groupBy("layer").agg(F.count(F.lit(1)).alias("size_all"))
    drawn = drawn.join(kinds, ["layer", "same"], "left").join(every, "layer", "left")
    u = uniform(seed, F.lit("w"), *key)
    drawn = drawn.withColumn("idx", F.floor(u * F.col("size")).cast("int")).withColumn("idx_all", F.when(F.col("size").isNull(), F.floor(u * F.col("size_all")).cast("int")))
    own = pools.select("layer", "same", "idx", F.col("weight").alias("w1"))
    rest = pools.select("layer", "idx_all", F.col("weight").alias("w2"))
    return (
        drawn.join(own, ["layer", "same", "idx"], "left").join(rest, ["layer", "idx_all"], "left")
        .select("rep", "layer", "src", "dst", F.coalesce("w1", "w2", F.lit(1.0)).alias("weight"))
    )


def co_assignment(members: DataFrame, n_completed: int) -> DataFrame:
    """coassign(layer, i, j, p) for i < j: the share of replicates with both in one meta-community.

    Pairs never together are left out; their share is 0.
    """
    a = members.select("rep", "layer", "meta_community", F.col("node").alias("i"))
    b = members.select("rep", "layer", "meta_community", F.col("node").alias("j"))
    both = a.join(b, ["rep", "layer", "meta_community"]).where("i < j")
    return both.groupBy("layer", "i", "j").agg((F.count(F.lit(1)) / n_completed).alias("p"))


def label_classes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that have the same labels in all replicates, as one.

    Returns membership(layer, node, class, size), a class being named by its
    smallest node, and labels(layer, class, size, rep, meta_community).  A node's
    labels are folded into one digest per replicate and these into one list, at
    most one entry per replicate.
    """
    line = F.sort_array(F.collect_list(F.struct("rep", "meta_community")))
    marks = members.groupBy("layer", "node").agg(F.sha2(F.to_json(line), 256).alias("mark"))
    classes = marks.groupBy("layer", "mark").agg(F.min("node").alias("class"), F.count(F.lit(1)).alias("size"))
    membership = marks.join(classes, ["layer", "mark"]).select("layer", "node", "class", "size")
    named = classes.select("layer", F.col("class").alias("node"), F.col("class"), "size")
    return membership, members.join(named, ["layer", "node"]).select("layer", "class", "size", "rep", "meta_community")


def class_co_assignment(members: DataFrame, n_completed: int) -> tuple[DataFrame, DataFrame]:
    """``co_assignment`` between classes of nodes alike in all replicates, and the membership beside it.

    Returns similarity(layer, class_a, class_b, size_a, size_b, pairs, p) for
    class_a <= class_b, where ``pairs`` counts the node pairs of the two classes,
    and membership(layer, node, class, size).  No pair of nodes is listed:
    stable communities give few classes whatever their size.  Classes never together
    are left out, as is a class of one with itself.
    """
    membership, labels = label_classes(members)
    key = ["layer", "rep", "meta_community"]
    a = labels.select(*key, F.col("class").alias("class_a"), F.col("size").alias("size_a"))
    b = labels.select(*key, F.col("class").alias("class_b"), F.col("size").alias("size_b"))
    together = (
        a.join(b, key).where("class_a <= class_b").groupBy("layer", "class_a", "class_b", "size_a", "size_b")
        .agg((F.count(F.lit(1)) / n_completed).alias("p"))
    )
    pairs = F.when(F.col("class_a") == F.col("class_b"), F.expr("size_a * (size_a - 1) div 2")).otherwise(F.col("size_a") * F.col("size_b")).cast("bigint")
    found = together.withColumn("pairs", pairs).where("pairs > 0")
    return found.select("layer", "class_a", "class_b", "size_a", "size_b", "pairs", "p"), membership


def expanded(similarity: DataFrame, membership: DataFrame) -> DataFrame:
    """The rows of ``co_assignment`` (layer, i, j, p) of what ``class_co_assignment`` gives; as many as there are pairs."""
    a = membership.select("layer", F.col("class").alias("class_a"), F.col("node").alias("u"))
    b = membership.select("layer", F.col("class").alias("class_b"), F.col("node").alias("v"))
    both = similarity.select("layer", "class_a", "class_b", "p").join(a, ["layer", "class_a"]).join(b, ["layer", "class_b"])
    return both.where("class_a <> class_b or u < v").select("layer", F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j"), "p")


def intervals(coassign: DataFrame, n_completed: int, alpha: float = 0.05) -> DataFrame:
    if n_completed <= 0:
        raise ValueError("no completed replicates")
    lo, hi = wilson(F.col("p"), F.lit(float(n_completed)), alpha)
    return coassign.select("layer", "i", "j", F.col("p").alias("estimate"), lo.alias("lower"), hi.alias("upper"))


def never_together(n_completed: int, alpha: float = 0.05) -> tuple[float, float]:
    """The interval of every pair that is not listed."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - alpha / 2)
    return 0.0, (z * z / n_completed) / (1 + z * z / n_completed)


def node_stability(members: DataFrame) -> DataFrame:
    """Share of replicates in a node's most frequent meta-community (labels are canonical per replicate)."""
    per = members.groupBy("layer", "node", "meta_community").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("layer", "node").agg((F.max("n") / F.sum("n")).alias("stability"))


def count_reproducibility(members: DataFrame, estimate: DataFrame) -> DataFrame:
    """Share of replicates with as many meta-communities as the point estimate; null without replicates."""
    k = estimate.groupBy("layer").agg(F.count_distinct("meta_community").alias("estimate"))
    reps = members.groupBy("layer", "rep").agg(F.count_distinct("meta_community").alias("k"))
    return k.join(reps, "layer", "left").groupBy("layer", "estimate").agg(F.avg((F.col("k") == F.col("estimate")).cast("double")).alias("reproducibility"))


def mean_stability(stability: DataFrame) -> DataFrame:
    return stability.groupBy("layer").agg(F.avg("stability").alias("mean_stability"))
