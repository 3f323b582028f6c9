"""Ties between communities (or nodes) of linked layers: equi-joins and aggregates only.

Every function takes optional ``by`` columns (say, a bootstrap replicate) that
are carried through all joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.portable import ratio

METRICS = ("jaccard", "overlap", "weighted_jaccard", "weighted_overlap")
TIES = ["from_layer", "to_layer", "from_community", "to_community", "similarity", "layer_weight", "weighted_similarity"]


def sizes(membership: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return membership.groupBy(*by, "layer", "community").agg(F.count(F.lit(1)).alias("size"))


def _sides(df: DataFrame, by: tuple[str, ...], **names: str) -> DataFrame:
    return df.select(*by, *[F.col(old).alias(new) for old, new in names.items()])


def numbered(links: DataFrame) -> DataFrame:
    """Links with their multiplicity: repeated links give repeated ties."""
    return links.groupBy("from_layer", "to_layer", "weight").agg(F.count(F.lit(1)).cast("int").alias("times"))


def shared(membership: DataFrame, links: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes in both communities, per link."""
    f = _sides(membership, by, layer="from_layer", node="node", community="from_community")
    t = _sides(membership, by, layer="to_layer", node="node", community="to_community")
    return (
        f.join(numbered(links), "from_layer")
        .join(t, [*by, "to_layer", "node"])
        .groupBy(*by, "from_layer", "to_layer", "weight", "times", "from_community", "to_community")
        .agg(F.count(F.lit(1)).alias("inter"))
    )


def _weighted(membership: DataFrame, links: DataFrame, strengths: DataFrame, metric: str, by: tuple[str, ...]) -> DataFrame:
    """Ties by node strengths: min over the shared nodes, max over the union.

    The max takes both layers' strengths for every node of either community;
    sums of maxima over the union follow by inclusion and exclusion.
    """
    link = numbered(links)
    key = [*by, "from_layer", "to_layer", "weight", "times"]
    sf = _sides(strengths, by, layer="from_layer", node="node", strength="sf")
    st = _sides(strengths, by, layer="to_layer", node="node", strength="st")
    f = _sides(membership, by, layer="from_layer", node="node", community="from_community").join(link, "from_layer")
    t = _sides(membership, by, layer="to_layer", node="node", community="to_community").join(link, "to_layer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    with_both = lambda d: (
        d.join(sf, [*by, "from_layer", "node"], "left").join(st, [*by, "to_layer", "node"], "left")
        .withColumn("sf", zero("sf")).withColumn("st", zero("st"))
        .withColumn("mx", F.greatest("sf", "st")).withColumn("mn", F.least("sf", "st"))
    )
    f, t = with_both(f), with_both(t)
    fs = f.groupBy(*key, "from_community").agg(F.sum("mx").alias("fmx"), F.sum("sf").alias("fs"))
    ts = t.groupBy(*key, "to_community").agg(F.sum("mx").alias("tmx"), F.sum("st").alias("ts"))
    both = (
        f.select(*key, "node", "from_community", "mx", "mn")
        .join(t.select(*key, "node", "to_community"), [*key, "node"])
        .groupBy(*key, "from_community", "to_community")
        .agg(F.sum("mn").alias("num"), F.sum("mx").alias("bmx"))
        .join(fs, [*key, "from_community"])
        .join(ts, [*key, "to_community"])
    )
    if metric == "weighted_jaccard":
        similarity = ratio(F.col("num"), F.col("fmx") + F.col("tmx") - F.col("bmx"))
    else:
        similarity = ratio(F.col("num"), F.least("fs", "ts"))
    return both.select(*key, "from_community", "to_community", similarity.alias("similarity"))


def community_ties(
    membership: DataFrame,
    links: DataFrame,
    metric: str = "jaccard",
    min_similarity: float = 0.0,
    strengths: DataFrame | None = None,
    include_zero: bool = True,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Similarity of every pair of communities of linked layers.

    Kept where similarity * link weight >= ``min_similarity``.  Pairs without a
    common node have similarity 0; with ``include_zero`` those that pass the
    threshold are listed too, which completes each link's pairs of communities.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    key = [*by, "from_layer", "to_layer", "weight", "times"]
    if metric.startswith("weighted"):
        if strengths is None:
            raise ValueError("weighted metrics need node strengths")
        found = _weighted(membership, links, strengths, metric, by)
    else:
        n = sizes(membership, by)
        a = _sides(n, by, layer="from_layer", community="from_community", size="na")
        b = _sides(n, by, layer="to_layer", community="to_community", size="nb")
        inter = F.col("inter").cast("double")
        under = F.col("na") + F.col("nb") - F.col("inter") if metric == "jaccard" else F.least("na", "nb")
        found = (
            shared(membership, links, by)
            .join(a, [*by, "from_layer", "from_community"])
            .join(b, [*by, "to_layer", "to_community"])
            .select(*key, "from_community", "to_community", ratio(inter, under).alias("similarity"))
        )
    if include_zero and min_similarity <= 0:
        c = membership.select(*by, "layer", "community").distinct()
        a = _sides(c, by, layer="from_layer", community="from_community")
        b = _sides(c, by, layer="to_layer", community="to_community")
        pairs = a.join(numbered(links), "from_layer").join(b, [*by, "to_layer"])
        found = pairs.join(found, [*key, "from_community", "to_community"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return (
        found.withColumn("weighted_similarity", F.col("similarity") * F.col("weight"))
        .where(F.col("weighted_similarity") >= min_similarity)
        .withColumn("one", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .withColumnRenamed("weight", "layer_weight")
        .select(*by, *TIES)
    )


def self_loops(
    membership: DataFrame,
    links: DataFrame,
    multiplier: float = 1.0,
    min_similarity: float = 0.0,
    directed: bool = False,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """One loop per community of a linked layer: similarity 2 (directed: 1), weighted by the layer's largest link."""
    ends = links.select(F.col("from_layer").alias("layer"), "weight").unionByName(links.select(F.col("to_layer").alias("layer"), "weight"))
    per = ends.groupBy("layer").agg(F.greatest(F.max("weight"), F.lit(0.0)).alias("layer_weight"))
    own = membership.select(*by, "layer", "community").distinct().join(per, "layer")
    similarity = F.lit(1.0 if directed else 2.0)
    return (
        own.select(
            *by,
            F.col("layer").alias("from_layer"),
            F.col("layer").alias("to_layer"),
            F.col("community").alias("from_community"),
            F.col("community").alias("to_community"),
            similarity.alias("similarity"),
            "layer_weight",
            (similarity * F.col("layer_weight") * multiplier).alias("weighted_similarity"),
        )
        .where(F.col("weighted_similarity") >= min_similarity)
        .select(*by, *TIES)
    )


def identity_ties(nodes: DataFrame, links: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes that are in both layers of a link: from_layer, to_layer, node, layer_weight."""
    f = _sides(nodes, by, layer="from_layer", node="node")
    t = _sides(nodes, by, layer="to_layer", node="node")
    return (
        f.join(links, "from_layer")
        .join(t, [*by, "to_layer", "node"])
        .select(*by, "from_layer", "to_layer", "node", F.col("weight").alias("layer_weight"))
    )
