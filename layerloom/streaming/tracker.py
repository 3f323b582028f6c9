"""Following communities over a stream: a tumbling window is a layer.

Every finished window is detected and matched with the labels of the last one,
which is what the batch fold does, since it looks one layer back only.  The
written layers are the state: a restarted stream goes on from the last layer of
earlier batches, and a batch that is tried again writes the same layers again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.detect import detect_layers
from ..operators.track import relabel_step


def windowed_edges(events: DataFrame, ts: str = "ts", width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Stream of (window, src, dst, weight): events of pairs added up per tumbling window; late ones within ``late`` count."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, width).alias("w"), "src", "dst")
        .agg(F.sum("weight").alias("weight"))
        .select(F.col("w.start").alias("start"), "src", "dst", "weight")
    )


class StreamTracker:
    """A ``foreachBatch`` sink; layers must close in order of time.

    It writes batch=B/layer=L below ``path``: start, node, meta_community and
    ``fresh``, the next unused label.  A path belongs to one checkpoint of one
    stream, whose batch numbers it relies on.  Only labels and their counts in
    common reach the driver, never nodes.
    """

    def __init__(self, spark: SparkSession, path: str, algorithm: str = "leiden", seed: int = 123):
        self.spark, self.path, self.algorithm, self.seed = spark, path, algorithm, seed

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        last, layer = self._before(batch_id)
        for row in batch.select("start").distinct().orderBy("start").toLocalIterator():
            layer += 1
            last = self._layer(batch.where(F.col("start") == row["start"]), row["start"], batch_id, layer, last)

    def _place(self, batch_id: int, layer: int) -> str:
        return f"{self.path}/batch={batch_id:08d}/layer={layer:06d}"

    def _before(self, batch_id: int) -> tuple[DataFrame | None, int]:
        """The last layer that batches before this one wrote, and its number."""
        try:
            kept = self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None, 0
            raise
        top = kept.where(F.col("batch") < batch_id).agg(F.max(F.struct("batch", "layer")).alias("top")).first()["top"]
        return (None, 0) if top is None else (self.spark.read.parquet(self._place(top["batch"], top["layer"])), top["layer"])

    def _layer(self, edges: DataFrame, start, batch_id: int, layer: int, last: DataFrame | None) -> DataFrame:
        e = edges.select(F.lit(layer).alias("layer"), "src", "dst", F.col("weight").cast("double").alias("weight"))
        nodes = e.select("layer", F.col("src").alias("node")).unionByName(e.select("layer", F.col("dst").alias("node"))).distinct()
        found = detect_layers(nodes, e, self.algorithm, seed=self.seed).persist()
        try:
            now = sorted(r["community"] for r in found.select("community").distinct().collect())
            before: dict[int, int] = {}
            overlap: dict[tuple[int, int], int] = {}
            fresh = 1
            if last is not None:
                before = {r[0]: r[0] for r in last.select("meta_community").distinct().collect()}
                fresh = last.select("fresh").first()["fresh"]
                common = last.select("node", "meta_community").join(found, "node").groupBy("meta_community", "community").count()
                overlap = {(r["meta_community"], r["community"]): r["count"] for r in common.collect()}
            named, fresh = relabel_step(now, before, overlap, fresh, "optimal")
            labels = self.spark.createDataFrame(sorted(named.items()), "community int, meta_community int")
            found.join(labels, "community").select(
                F.lit(start).alias("start"), "node", "meta_community", F.lit(fresh).alias("fresh")
            ).write.mode("overwrite").parquet(self._place(batch_id, layer))
        finally:
            found.unpersist()
        return self.spark.read.parquet(self._place(batch_id, layer))
