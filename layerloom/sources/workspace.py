"""Written tables in a folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """A family of Parquet tables under one fresh folder of ``spark.checkpoint.dir``.

    Only where that is unset and one machine runs everything, as in tests, a
    temporary folder takes its place.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='layerloom-')}"
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark = spark
        self.root = f"{root.rstrip('/')}/layerloom/{name}-{uuid.uuid4().hex}"

    def put(self, table: str, df: DataFrame) -> DataFrame:
        """Writes ``df`` and reads it back under its own schema."""
        df.write.mode("overwrite").parquet(f"{self.root}/{table}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{table}")

    def drop(self, *tables: str) -> None:
        """Deletes tables that no later step reads."""
        paths = self.spark._jvm.org.apache.hadoop.fs.Path
        for table in tables:
            path = paths(f"{self.root}/{table}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
