"""Layer links: which layers are compared, and how much each comparison counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "from_layer int, to_layer int, weight double"


def _pairs(spark: SparkSession, n_layers: int, step: int) -> DataFrame:
    ids = spark.range(1, max(1, n_layers - step + 1)).select(F.col("id").cast("int").alias("from_layer"))
    return ids.select("from_layer", (F.col("from_layer") + step).cast("int").alias("to_layer"), F.lit(1.0).alias("weight"))


def chain(spark: SparkSession, n_layers: int) -> DataFrame:
    return _pairs(spark, n_layers, 1)


def lagged(spark: SparkSession, n_layers: int, period: int) -> DataFrame:
    """The chain, and each layer with the one a period later."""
    return chain(spark, n_layers).unionByName(_pairs(spark, n_layers, period)).distinct()


def all_pairs(spark: SparkSession, n_layers: int) -> DataFrame:
    ids = spark.range(1, n_layers).select(F.col("id").cast("int").alias("from_layer"))
    later = F.explode(F.sequence((F.col("from_layer") + 1).cast("int"), F.lit(n_layers)))
    return ids.select("from_layer", later.alias("to_layer"), F.lit(1.0).alias("weight"))


def custom(spark: SparkSession, links: DataFrame | list, n_layers: int) -> DataFrame:
    """Checked links; a missing weight counts as 1, other columns are dropped.

    Duplicates, loops, backward links and negative weights are allowed.
    """
    if not isinstance(links, DataFrame):
        rows = [(int(r[0]), int(r[1]), float(r[2]) if len(r) > 2 else 1.0) for r in links]
        links = spark.createDataFrame(rows, SCHEMA)
    named = {"from": "from_layer", "to": "to_layer"}
    for old, new in named.items():
        if old in links.columns:
            links = links.withColumnRenamed(old, new)
    missing = {"from_layer", "to_layer"} - set(links.columns)
    if missing:
        raise ValueError(f"layer links need from and to; missing: {sorted(missing)}")
    if "weight" not in links.columns:
        links = links.withColumn("weight", F.lit(1.0))
    links = links.select(F.col("from_layer").cast("int"), F.col("to_layer").cast("int"), F.col("weight").cast("double"))
    r = links.agg(F.min(F.least("from_layer", "to_layer")), F.max(F.greatest("from_layer", "to_layer"))).first()
    if r[0] is not None and (r[0] < 1 or r[1] > n_layers):
        raise ValueError(f"layer links must lie in 1..{n_layers}")
    return links


def make(spark: SparkSession, n_layers: int, links: DataFrame | list | None = None) -> DataFrame:
    return chain(spark, n_layers) if links is None else custom(spark, links, n_layers)
