"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

New data is reduced to one row per digest, anti-joined with the index by a
sort-merge join, and appended.  The index side needs no shuffle, being bucketed
by the join key; a bucket of several files is sorted again as it is read.  What a
batch adds to texts that the index holds goes to a second table of the same
layout, so counts add up.  A batch is named; one that runs again, after a crash
or by mistake, finds its rows there, adds none and gives the same verdict.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

INDEX_DDL = "digest BINARY, keep_id BIGINT, n BIGINT, batch STRING"


class DigestIndex:
    """A table (digest, keep_id, n, batch) that outlives a session when given a ``path``.

    ``path`` is a folder all executors share; without one the table lives in
    the warehouse.  ``buckets`` is fixed when the index is created.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = 64):
        self.spark, self.name = spark, name
        self.counts = f"{name}_counts"
        for table, suffix in ((name, ""), (self.counts, "_counts")):
            place = f" LOCATION '{path}{suffix}'" if path else ""
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({INDEX_DDL}) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS{place}"
            )
        self.buckets = buckets

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def before(self, batch: str = "") -> DataFrame:
        """The digests that other batches than ``batch`` brought."""
        return self.read().where(F.col("batch") != batch)

    def counted(self, batch: str) -> DataFrame:
        """(digest, held_id, held): the staying ids and the rows of all other batches."""
        more = self.spark.table(self.counts).where(F.col("batch") != batch).withColumn("keep_id", F.lit(None).cast("bigint"))
        return self.before(batch).unionByName(more).groupBy("digest").agg(F.max("keep_id").alias("held_id"), F.sum("n").alias("held"))

    def new_groups(self, groups: DataFrame, batch: str = "") -> DataFrame:
        """Rows of ``groups`` whose digest no other batch holds."""
        return groups.join(self.before(batch).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str, known: bool = False) -> None:
        """Adds a batch's groups, new ones or what it has of known ones, once: Spark commits an append's files together."""
        table = self.counts if known else self.name
        if not self.spark.table(table).where(F.col("batch") == batch).isEmpty():
            return
        (
            groups.select("digest", "keep_id", "n", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(table)
        )
        self.spark.catalog.refreshTable(table)

    def drop(self) -> None:
        for table in (self.name, self.counts):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def digest_of(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes as binary; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def dedup(
    docs: DataFrame,
    index: DigestIndex,
    id_col: str = "doc_id",
    text_col: str = "text",
    scratch: Scratch | None = None,
    batch: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, plus ``row_tag``.

    Of equal texts the row with the largest id stays; a row with a null id
    stays only where every id of its group is null.  Rows that repeat the
    winning id and text count as copies: one of them stays.  A text that the
    index held before keeps the indexed id and drops every new row; group_size
    counts the rows of all batches so far.  ``batch`` names the input: the same
    name again changes nothing and gives the same result.
    An empty input gives an empty result.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact")
    staged = scratch.put(
        "staged",
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col)).alias("digest")
        ).withColumn("row_tag", F.monotonically_increasing_id()),
    )
    groups = scratch.put(
        "groups",
        staged.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row_tag")).alias("top"), F.count(F.lit(1)).alias("n")
        ).select("digest", F.col("top.doc_id").alias("keep_id"), "n", F.col("top.row_tag").alias("keep_tag")),
    )
    batch = batch or uuid.uuid4().hex
    fresh = index.new_groups(groups, batch).select("digest", "keep_id", F.col("n").alias("group_size"), "keep_tag", "n")
    old = (
        groups.join(index.counted(batch).hint("merge"), "digest")
        .select("digest", F.col("held_id").alias("keep_id"), (F.col("held") + F.col("n")).alias("group_size"), F.lit(None).cast("bigint").alias("keep_tag"), "n")
    )
    # Read back from files, so that both sides of the join are exchanged and a
    # hot digest can be split at run time.
    verdict = scratch.put("verdict", fresh.unionByName(old))
    index.append(verdict.where("group_size = n"), batch)
    index.append(verdict.where("group_size > n"), batch, known=True)
    verdict = verdict.drop("n")
    scratch.drop("groups")
    return staged.join(verdict, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row_tag") == F.col("keep_tag"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row_tag",
    )


def dedup_in_two(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``dedup`` for a table that comes in two batches, the larger ids first; group_size counts both.

    The second batch meets what the first one left in the index.  As its ids
    are smaller, the largest id of a text stays all the same; null ids are in
    the second batch, and an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact-two")
    ends = docs.agg(F.min(id_col).cast("decimal(38,0)").alias("a"), F.max(id_col).cast("decimal(38,0)").alias("b")).first()
    upper = F.coalesce(F.col(id_col) > F.lit((ends.a + ends.b) // 2), F.lit(False)) if ends.a is not None else F.lit(False)
    first = dedup(docs.where(upper), index, id_col, text_col, batch="upper")
    both = first.unionByName(dedup(docs.where(~upper), index, id_col, text_col, batch="lower"))
    totals = scratch.put("totals", index.counted("").select(F.lower(F.hex("digest")).alias("sha"), "held"))
    return both.join(totals, F.col("text_sha256") == F.col("sha")).select(
        "doc_id", "keep_id", F.col("held").alias("group_size"), "kept", "text_sha256", "row_tag"
    )


def fresh_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets=min(max(buckets, 1), 4096))


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns unchanged.

    A row is named by its id and digest.  Rows that repeat both are alike;
    they are reduced to one only where some exist, and after partial
    aggregation, so that texts otherwise move once.
    """
    spark = docs.sparkSession
    index, work = fresh_index(spark), Scratch(spark, "exact")
    decided = dedup(docs, index, scratch=work)
    index.drop()
    stay = Scratch(spark, "exact-stay").put(
        "stay",
        decided.groupBy(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest"))
        .agg(F.count(F.lit(1)).alias("__rows"), F.max("kept").alias("__kept"))
        .where("__kept")
        .drop("__kept"),
    )
    work.close()
    tagged = docs.withColumn("__own", digest_of(F.col("text")))
    joined = tagged.join(
        stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest"))
    )
    if not stay.where("__rows > 1").isEmpty():
        joined = joined.dropDuplicates(["doc_id", "__own"])
    return joined.select(*[joined[c] for c in docs.columns])
