"""Agreement of partitions, coverage and roll-ups, from contingency counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.portable import ratio
from ..sources.workspace import Workspace
from .ranks import best_before


def contingency(labels: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    return labels.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))


def adjacent(membership: DataFrame) -> DataFrame:
    """Nodes of a layer with their community there (a) and in the next layer (b)."""
    later = membership.select((F.col("layer") - 1).alias("layer"), "node", F.col("community").alias("b"))
    return membership.select("layer", "node", F.col("community").alias("a")).join(later, ["layer", "node"])


def _margins(table: DataFrame, keys: list[str]) -> DataFrame:
    w = lambda *c: Window.partitionBy(*keys, *c)
    return table.withColumn("na", F.sum("n").over(w("a"))).withColumn("nb", F.sum("n").over(w("b"))).withColumn("total", F.sum("n").over(w()))


def nmi(labels: DataFrame, keys: list[str], trivial: float = 0.0) -> DataFrame:
    """Mutual information over the mean of the entropies; ``trivial`` where both partitions are one block."""
    m = _margins(contingency(labels, keys), keys)
    p = F.col("n") / F.col("total")
    per = m.groupBy(*keys).agg(
        F.sum(p * F.ln(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("i"),
        # Each cell carries its share of its row's and column's entropy.
        F.sum(-p * F.ln(F.col("na") / F.col("total"))).alias("ha"),
        F.sum(-p * F.ln(F.col("nb") / F.col("total"))).alias("hb"),
    )
    h = (F.col("ha") + F.col("hb")) / 2
    return per.select(*keys, F.when(h <= 1e-12, F.lit(trivial)).otherwise(F.col("i") / F.nullif(h, F.lit(0.0))).alias("nmi"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def pair_counts(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs together in both, in a, in b, and all; from counts, no pair is listed."""
    t = contingency(labels, keys)
    both = t.groupBy(*keys).agg(F.sum(_pairs(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    one = lambda c: t.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(_pairs(F.col("n"))).alias(f"in_{c}"))
    if keys:
        joined = both.join(one("a"), keys).join(one("b"), keys)
    else:
        joined = both.crossJoin(one("a")).crossJoin(one("b"))  # one row each
    return joined.withColumn("pairs", _pairs(F.col("total")))


def ari(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Adjusted Rand index; 0 where it is undefined."""
    expected = ratio(F.col("in_a") * F.col("in_b"), F.col("pairs"))
    top = (F.col("in_a") + F.col("in_b")) / 2
    c = pair_counts(labels, keys).withColumn("e", expected).withColumn("top", top)
    return c.select(*keys, F.when(F.col("top") - F.col("e") <= 0, 0.0).otherwise((F.col("both") - F.col("e")) / F.nullif(F.col("top") - F.col("e"), F.lit(0.0))).alias("ari"))


def comembership(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Share of pairs whose being together agrees (the Rand index)."""
    same = F.col("pairs") + 2 * F.col("both") - F.col("in_a") - F.col("in_b")
    return pair_counts(labels, keys).select(*keys, ratio(same, F.col("pairs")).alias("accuracy"))


def count_error(labels: DataFrame, layer: str = "layer", keys: list[str] | None = None) -> DataFrame:
    """Mean absolute difference of the numbers of communities per layer."""
    keys = keys or []
    per = labels.groupBy(*keys, layer).agg(F.abs(F.count_distinct("a") - F.count_distinct("b")).alias("d"))
    return per.groupBy(*keys).agg(F.avg("d").alias("k_mae"))


def community_counts(membership: DataFrame) -> DataFrame:
    per = membership.groupBy("layer").agg(F.count_distinct("community").alias("k"))
    return per.agg(F.avg("k").alias("mean_per_layer")).crossJoin(membership.agg(F.count_distinct("community").alias("total")))


def change_nmi(detected: DataFrame, truth: DataFrame, least: float = 0.05) -> DataFrame:
    """NMI of the layers in which more than ``least`` of the common nodes changed their true community."""
    before = truth.select((F.col("layer") + 1).alias("layer"), "node", F.col("community").alias("old"))
    changed = truth.join(before, ["layer", "node"]).groupBy("layer").agg(F.avg((F.col("community") != F.col("old")).cast("double")).alias("changed")).where(F.col("changed") > least)
    both = detected.select("layer", "node", F.col("community").alias("a")).join(truth.select("layer", "node", F.col("community").alias("b")), ["layer", "node"])
    return nmi(both, ["layer"]).join(changed, "layer")


def active_only(rows: DataFrame, active: DataFrame) -> DataFrame:
    """The rows whose node is active in their layer; active(layer, node)."""
    return rows.join(active.select("layer", "node"), ["layer", "node"], "left_semi")


def transition_nmi(detected: DataFrame, truth: DataFrame, active: DataFrame | None = None, least: float = 0.05) -> DataFrame:
    """One row: the mean of ``change_nmi`` and its number of layers, over active nodes; null where nothing changes."""
    if active is not None:
        detected, truth = active_only(detected, active), active_only(truth, active)
    return change_nmi(detected, truth, least).agg(F.avg("nmi").alias("nmi_change"), F.count(F.lit(1)).alias("layers"))


def valid_runs(runs: DataFrame, values: list[str], status: str = "status", ok: str = "ok") -> DataFrame:
    """Runs that ended well and have all of ``values``."""
    kept = runs.where(F.col(status) == ok)
    return kept.dropna(subset=values) if values else kept


def without_methods(runs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The distinct methods of ``runs`` that ``dropped`` does not list, both by column ``method``."""
    return runs.select("method").subtract(dropped.select("method"))


def agreement(labels: DataFrame, keys: list[str]) -> DataFrame:
    """NMI of every unordered pair of methods; labels(keys..., method, node, community)."""
    a = labels.select(*keys, "node", F.col("method").alias("method1"), F.col("community").alias("a"))
    b = labels.select(*keys, "node", F.col("method").alias("method2"), F.col("community").alias("b"))
    return nmi(a.join(b, [*keys, "node"]).where("method1 < method2"), [*keys, "method1", "method2"])


def count_interval(counts: DataFrame, keys: list[str], truth: str = "k_true", alpha: float = 0.05) -> DataFrame:
    """Percentile interval of replicate counts ``k``, whether it covers the truth, and its width."""
    q = counts.groupBy(*keys, truth).agg(F.percentile("k", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    return q.select(*keys, truth, lo.alias("lower"), hi.alias("upper"), ((lo <= F.col(truth)) & (F.col(truth) <= hi)).alias("covered"), (hi - lo).alias("width"))


def pair_coverage(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs(lower, upper, truth, same): coverage over all, within and between communities, and mean width."""
    hit = ((F.col("lower") <= F.col("truth")) & (F.col("truth") <= F.col("upper"))).cast("double")
    return pairs.groupBy(*keys).agg(
        F.avg(hit).alias("coverage"),
        F.avg(F.when(F.col("same"), hit)).alias("coverage_same"),
        F.avg(F.when(~F.col("same"), hit)).alias("coverage_different"),
        F.avg(F.col("upper") - F.col("lower")).alias("width"),
    )


def calibration(pairs: DataFrame, p: str = "p", truth: str = "same", bins: int = 20) -> DataFrame:
    at = F.least(F.lit(bins), 1 + F.floor(bins * F.col(p))).cast("int")
    return pairs.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col(truth).cast("bigint")).alias("n_true")).select(
        "bin", ((F.col("bin") - 1) / bins).alias("bin_lo"), (F.col("bin") / bins).alias("bin_hi"), "n_pairs", "n_true"
    )


def gate(runs: DataFrame, keys: list[str], count_width: float = 1.0, pair_width: float = 0.05) -> DataFrame:
    """Share of runs narrow enough to be trusted, and the coverage of those."""
    passes = (F.col("width_k") <= count_width) & (F.col("width_p") < pair_width)
    return runs.groupBy(*keys).agg(F.avg(passes.cast("double")).alias("pass_rate"), F.avg(F.when(passes, F.col("coverage"))).alias("coverage_passed"), F.count(F.lit(1)).alias("runs"))


def roll_up(runs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean, deviation, standard error and 95 % bounds of each value."""
    out = []
    for v in values:
        m, s, n = F.avg(v), F.stddev_samp(v), F.count(v)
        e = s / F.sqrt(n)
        out += [m.alias(f"{v}_mean"), s.alias(f"{v}_sd"), e.alias(f"{v}_se"), (m - 1.96 * e).alias(f"{v}_lo"), (m + 1.96 * e).alias(f"{v}_hi")]
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), *out)


def pareto(rows: DataFrame, low: str, high: str) -> DataFrame:
    """Rows that no other beats in both: strictly smaller ``low`` and strictly larger ``high``."""
    best = rows.groupBy(low).agg(F.max(high).alias("top"))
    edge = best_before(best, low, "top", Workspace(rows.sparkSession, "pareto").put)
    return rows.join(edge, low).where(F.col("edge").isNull() | (F.col(high) >= F.col("edge"))).select(*rows.columns)


def best_row(rows: DataFrame, keys: list[str], value: str, ties: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), *ties)
    return rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def histogram(rows: DataFrame, value: str, bins: int = 30, low: float = 0.0, high: float = 1.0) -> DataFrame:
    at = F.least(F.lit(bins), F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins))).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
