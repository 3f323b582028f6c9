"""Ranks and running maxima without a task that sees all rows.

Rows are sorted over range partitions and written; what stands before a
partition is then one row per partition, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Put = Callable[[str, DataFrame], DataFrame]
#: ``monotonically_increasing_id`` keeps the partition above this bit and the place within it below.
PARTITION_BIT = 33


def _part() -> Column:
    return F.shiftright("__place", PARTITION_BIT)


def _sorted(rows: DataFrame, columns: list[str], put: Put, name: str) -> DataFrame:
    ranged = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return put(name, ranged.withColumn("__place", F.monotonically_increasing_id()))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"__{k}"])
    return out


def ranked(rows: DataFrame, keys: list[str], order: list[str], put: Put, name: str = "ranked", rank: str = "rank", total: str | None = None) -> DataFrame:
    """``rows`` with their rank from 0 among the rows of equal ``keys`` in ascending ``order``, nulls first.

    Null is a key like any other.  Rows alike in keys and order get different
    ranks in no particular order; the written table fixes which.  A key may hold
    any share of the rows: it is spread over partitions.  Per key and partition
    one row goes into the sums of what stands before.  ``total`` names a column
    for the rows of the key.  An empty table stays empty.
    """
    placed = _sorted(rows, [*keys, *order], put, f"{name}_sorted")
    before = Window.partitionBy(*[f"__{k}" for k in keys], "__one").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*[f"__{k}" for k in keys], "__one")
    runs = (
        placed.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], _part().alias("__part"))
        .agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .withColumn("__one", F.col("__part") * 0)
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .withColumn("__total", F.sum("__n").over(every))
    )
    joined = placed.withColumn("__part_of", _part()).join(runs, _same(placed, runs, keys) & (F.col("__part_of") == F.col("__part")))
    more = [F.col("__total").alias(total)] if total else []
    return joined.select(*[placed[c] for c in rows.columns], (F.col("__before") + F.col("__place") - F.col("__first")).alias(rank), *more)


def dense(values: DataFrame, column: str, put: Put, name: str = "dense", rank: str = "id") -> DataFrame:
    """(column, rank): the distinct values of one column and their places from 1, nulls first."""
    return ranked(values.select(column).distinct(), [], [column], put, name, "__rank").select(column, (F.col("__rank") + 1).alias(rank))


def best_before(best: DataFrame, low: str, high: str, put: Put, name: str = "skyline") -> DataFrame:
    """(low, edge): the largest ``high`` among rows of strictly smaller ``low``; ``best`` has each ``low`` once.

    Inside a range partition a window runs over that partition only; maxima of
    the partitions before it come from one row each.
    """
    placed = _sorted(best.select(low, high), [low], put, f"{name}_sorted").withColumn("__part", _part())
    tops = placed.groupBy("__part").agg(F.max(high).alias("__top")).withColumn("__one", F.col("__part") * 0)
    earlier = Window.partitionBy("__one").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("__earlier", F.max("__top").over(earlier)).select(F.col("__part").alias("__of"), "__earlier")
    inside = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("__inside", F.max(high).over(inside))
        .join(tops, F.col("__part") == F.col("__of"))
        .select(low, F.greatest("__earlier", "__inside").alias("edge"))
    )
