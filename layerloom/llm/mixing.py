"""Mixing sources to target weights by entropy balancing, in built-in operations only.

Document rates stay as near to one in relative entropy as the word totals of
the sources and the bound on a rate allow.  The dual of that problem is convex
with one multiplier per source; its optimum gives a document of ``size`` words
the rate exp(tilt * size), cut at the bound.  Newton steps inside a bracket find
the multipliers, each step one aggregate over the (source, size) classes.  Rates
are then rounded into whole copies by systematic rounding along the sizes of a
source, which keeps each total within about one document of its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets that split one (source, size) class while its rows are numbered.
CLASS_BUCKETS = 1024
#: Rates are rounded in whole parts of this unit, so that running totals are exact in any order.
UNIT = 10**9
#: Sums of the dual are taken in decimals for the same reason.
EXACT = "decimal(38,12)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    per_source: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Targets by water filling: min(most * size, level * weight) with a level that uses up the budget.

    ``per_source`` has one row per source (no_source, source, source_size); the
    two windows run over that aggregate alone.  Resharing an excess by weight
    among the sources below their bound ends at this same level.
    """
    order = Window.orderBy("no_source", "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per_source.withColumn(
        "weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("bound", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("bound") / F.col("weight"), "no_source", "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    leveled = (
        ranked.withColumn("budget", F.lit(share) * F.sum("source_size").over(every))
        .withColumn("full", F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.greatest(F.lit(0.0), (F.col("budget") - F.col("full")) / F.col("open_weight")))
        # The level holds from the first source whose bound it does not reach.
        .withColumn("holds", F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.col("level")))
        .withColumn("final", F.first("holds", ignorenulls=True).over(Window.orderBy(F.col("bound") / F.col("weight"), "no_source", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return leveled.select(
        "no_source",
        "source",
        "source_size",
        F.when(F.col("final").isNull(), F.col("bound"))
        .otherwise(F.least(F.col("bound"), F.col("final") * F.col("weight")))
        .alias("target"),
    )


def solve_dual(
    classes: DataFrame, targets: DataFrame, scratch: Scratch, most: float = 2.0, tolerance: float = 1e-9, steps: int = 100
) -> DataFrame:
    """Multipliers (no_source, source, tilt, steps) at which the rates min(most, exp(tilt * size)) meet the targets.

    Minimises sum n*phi(tilt*size) - target*tilt, where phi' is the rate.  With
    S the source's size and s its smallest document, the optimum lies between 0
    and ln(target / S) / s; a Newton step that leaves what is left of this
    bracket is replaced by its middle.  Only the largest relative gradient
    reaches the driver.  Sources without words or target have no row; an
    exhausted ``steps`` is an error.
    """
    keys = ["no_source", "source"]
    size, n = F.col("size").cast("double"), F.col("n").cast("double")
    total = lambda x: F.sum(x.cast(EXACT)).cast("double")
    edge = F.ln(F.col("target") / F.col("source_size")) / F.col("least")
    start = F.ln(F.col("target") / F.col("source_size")) * F.col("source_size") / F.col("square")
    extent = classes.where("size > 0").groupBy(*keys).agg(F.min("size").alias("least"), total(n * size * size).alias("square"))
    state = scratch.put(
        "tilt0",
        targets.where("source_size > 0 and target > 0").join(extent, keys).select(
            *keys,
            "target",
            (F.col("source_size") / F.col("square")).alias("scale"),
            F.least(F.lit(0.0), edge).alias("low"),
            F.greatest(F.lit(0.0), edge).alias("high"),
            start.alias("tilt"),
        ),
    )
    for step in range(steps):
        bent = F.col("tilt") * size
        capped = bent >= math.log(most)
        rate = F.exp(F.least(bent, F.lit(math.log(most))))
        graded = (
            classes.where("size > 0")
            .join(state, keys)
            .groupBy(*keys, "target", "scale", "low", "high", "tilt")
            .agg(
                total(n * size * rate).alias("taken"),
                # In units of the source's typical size, lest squares of long texts pass the decimals.
                total(F.when(capped, 0.0).otherwise(n * size * rate * size * F.col("scale"))).alias("curve"),
            )
            .withColumn("slope", F.col("taken") - F.col("target"))
            .withColumn("low", F.when(F.col("slope") < 0, F.col("tilt")).otherwise(F.col("low")))
            .withColumn("high", F.when(F.col("slope") > 0, F.col("tilt")).otherwise(F.col("high")))
            .withColumn("newton", F.when(F.col("curve") > 0, F.col("tilt") - F.col("slope") * F.col("scale") / F.nullif("curve", F.lit(0.0))))
            .withColumn("off", F.abs(F.col("slope")) / F.col("target"))
            .withColumn("done", F.col("off") <= tolerance)
        )
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        moved = F.when(F.col("done"), F.col("tilt")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        state = scratch.put(f"tilt{step + 1}", graded.select(*keys, "target", "scale", "low", "high", moved.alias("tilt"), "off"))
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            return state.select(*keys, "tilt", F.lit(step).alias("steps"))
        state = state.drop("off")
    raise RuntimeError(f"no convergence in {steps} steps: relative gradient {worst}")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    corrections: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, rate, copies, taken, source.

    Copies follow from hashes of the ids alone, so reruns agree; repeated rows
    are numbered among themselves and together get the copies of their class.
    ``rate`` is exp(tilt * size), at most ``most``; 0 where there are no words or
    no target.  Null text: size 0, taken 0.  Null source: a source of its own, last.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    keys = ["no_source", "source"]
    sized = scratch.put(
        "sized",
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).isNull().alias("no_source"),
            F.coalesce(F.col(source_col), F.lit("")).alias("source"),
            word_count(F.col(text_col)).alias("size"),
        ).withColumn("h", F.xxhash64(F.lit("mix"), F.col("doc_id"))),
    )
    classes = scratch.put("classes", sized.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("n")))
    per_source = classes.groupBy(*keys).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = scratch.put("targets", source_targets(per_source, weights, share, most))
    tilts = solve_dual(classes, targets, scratch, most)
    rate = F.when(F.col("size") > 0, F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(math.log(most)))))
    units = F.round(F.col("rate") * UNIT).cast("bigint")
    rated = scratch.put(
        "rated",
        classes.join(tilts.select(*keys, "tilt"), keys, "left")
        .withColumn("rate", F.coalesce(rate, F.lit(0.0)))
        .withColumn("whole", F.floor(units / UNIT).cast("bigint"))
        .withColumn("part", units % UNIT)
        # Bands of neighbouring sizes; only these are in order per source.
        .withColumn("band", F.floor(F.sqrt("size")).cast("bigint")),
    )

    # Parts add up along (size, bucket, hash): over bands, classes and buckets,
    # then by place inside a bucket; no step orders a whole source.  A row gets
    # a further copy where the sum passes a whole unit, so sums are kept modulo it.
    modulo = lambda x: F.pmod(x, F.lit(UNIT))
    parts = modulo(F.pmod(F.col("n"), F.lit(UNIT)) * F.col("part"))
    before = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
    bands = (
        rated.groupBy(*keys, "band").agg(F.sum(parts).alias("all"))
        .select(*keys, "band", modulo(earlier("all", before("band", *keys))).alias("band_start"))
    )
    class_start = (
        rated.withColumn("class_start", earlier(parts, before("size", *keys, "band")))
        .join(bands, [*keys, "band"])
        .select(*keys, "size", "rate", "whole", "part", modulo(F.col("class_start") + F.col("band_start") + UNIT // 2).alias("class_start"))
    )
    tagged = sized.withColumn("bucket", F.pmod(F.col("h"), F.lit(CLASS_BUCKETS)).cast("int"))
    cells = tagged.groupBy(*keys, "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = cells.withColumn("bucket_start", earlier("n", before("bucket", *keys, "size"))).join(class_start, [*keys, "size"]).drop("n")
    place = Window.partitionBy(*keys, "size", "bucket").orderBy("h", F.col("doc_id"))
    rank = F.pmod(F.col("bucket_start") + F.col("place"), F.lit(UNIT))
    passed = modulo(F.col("class_start") + modulo(rank * F.col("part"))) < F.col("part")
    drawn = scratch.put(
        "drawn",
        tagged.withColumn("place", F.row_number().over(place))
        .join(starts, [*keys, "size", "bucket"])
        .withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + passed.cast("bigint")).otherwise(F.lit(0)).cast("bigint"))
        .drop("class_start", "bucket_start", "h", "whole", "part"),
    )

    # What rounding leaves of a total is met by single documents of about that size.
    unit = [*keys, "size", "bucket", "place"]
    for turn in range(corrections):
        left = scratch.put(
            f"left{turn}",
            drawn.groupBy(*keys).agg(F.sum(F.col("size") * F.col("copies")).alias("got"))
            .join(targets, keys)
            .select(*keys, (F.col("target") - F.col("got")).alias("gap")),
        )
        step = F.signum("gap").cast("bigint")
        near = F.abs(F.abs(F.col("gap")) - F.col("size"))
        able = (F.col("copies") + step >= 0) & (F.col("copies") + step <= F.lit(int(most)))
        pick = (
            drawn.join(left, keys)
            .where((F.col("size") > 0) & able & (near < F.abs(F.col("gap"))))
            .groupBy(*keys)
            .agg(F.min(F.struct(near.alias("near"), F.col("size"), F.col("bucket"), F.col("place"), step.alias("step"))).alias("m"))
            .select(*keys, "m.size", "m.bucket", "m.place", "m.step")
        )
        drawn = scratch.put(
            f"drawn{turn}",
            drawn.join(scratch.put(f"pick{turn}", pick), unit, "left")
            .withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0)))
            .drop("step"),
        )
    scratch.drop("sized", "classes", *["drawn", *[f"drawn{turn}" for turn in range(corrections)]][:-1])
    return drawn.join(targets, keys).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "rate",
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.when(~F.col("no_source"), F.col("source")).alias("source"),
    )
