"""Memberships of an event stream, from counts that a state store keeps.

A stream adds events up by day, user and type.  Its state is Spark's own: counts
of days that the watermark has passed are dropped, the others survive restarts
in the checkpoint.  Each batch writes the counts it changed under its number, so
that a batch tried again writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.layers import week_of

SCHEMA = "ts timestamp, user_id bigint, event_type string"


def land(events: DataFrame, landing: str) -> None:
    """Writes events week by week, as files that arrive in order of time."""
    week = F.date_trunc("week", "ts")
    for row in events.select(week.alias("week")).distinct().orderBy("week").toLocalIterator():
        rows = events.where(week.eqNullSafe(F.lit(row["week"]))).select("ts", "user_id", "event_type")
        rows.write.mode("append").parquet(landing)


def follow(spark: SparkSession, landing: str, folder: str, late: str = "8 days", files: int = 4) -> None:
    """Takes what has landed since the last call into the counts under ``folder``; events later than ``late`` are lost."""
    seen = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(landing)
    counts = seen.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={batch_id:08d}")

    stream = (
        counts.select(F.col("w.start").alias("day"), "user_id", "event_type", "n")
        .writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    stream.awaitTermination()


def daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(day, user_id, event_type, n) so far: of the updates of a count the last is the largest."""
    schema = "day timestamp, user_id bigint, event_type string, n bigint"
    return spark.read.schema(schema).parquet(f"{folder}/updates").groupBy("day", "user_id", "event_type").agg(F.max("n").alias("n"))


def weekly_membership(spark: SparkSession, folder: str) -> DataFrame:
    """(layer, node, event_type, n): users by week and most frequent type, ties by name."""
    counts = daily_counts(spark, folder).groupBy(week_of(F.col("day")).alias("layer"), F.col("user_id").alias("node"), "event_type").agg(F.sum("n").alias("n"))
    top = counts.groupBy("layer", "node").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("t"))
    return top.select("layer", "node", F.col("t.event_type").alias("event_type"), (-F.col("t.n")).alias("n"))
