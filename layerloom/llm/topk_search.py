"""Exact top-k search by inner product over vectors sorted by length.

Candidates lie in descending order of length, rotated onto the singular
directions of the whole set.  A block is first multiplied on its leading
directions only; by Cauchy-Schwarz the rest can add at most the product of the
residual lengths, and only pairs that may still reach a query's k-th best score
are scored in full, in whole numbers.  A query's bound starts from the longest
vectors and rises as blocks pass; a block too short for every query ends it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

#: Queries sent to the workers at once (one job each), queries and candidates multiplied at once.
PASS, QUERIES, BLOCK = 8192, 1024, 2048
#: Leading directions hold this share of the squared lengths.
LEADING = 0.6
SLACK = 1e-6


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as float64 rows, shorter vectors padded with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Searcher:
    """The queries of one pass with their best k so far."""

    def __init__(self, ids: np.ndarray, tags: np.ndarray, whole: np.ndarray, rotation: np.ndarray, lead: int, k: int):
        self.ids, self.tags, self.whole, self.k, self.lead = ids, tags, whole, k, lead
        self.rotation = rotation
        turned = whole @ rotation
        self.head = turned[:, :lead]
        self.rest = np.sqrt((turned[:, lead:] ** 2).sum(1))
        self.length = np.sqrt((whole**2).sum(1))
        self.floor = np.full(len(ids), -np.inf)
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [
            (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids
        ]

    def offer(self, ids: np.ndarray, tags: np.ndarray, whole: np.ndarray) -> None:
        """One block of candidates in descending order of length."""
        if not len(ids) or not len(self.ids):
            return
        length = np.sqrt((whole**2).sum(1))
        slack = SLACK * (1 + self.length * length.max())
        if (self.length * length.max() + slack < self.floor).all():
            return
        turned = whole @ self.rotation
        head, rest = turned[:, : self.lead], np.sqrt((turned[:, self.lead :] ** 2).sum(1))
        for at in range(0, len(self.ids), QUERIES):
            q = slice(at, at + QUERIES)
            bound = self.head[q] @ head.T + self.rest[q][:, None] * rest[None, :] + slack[q][:, None]
            a, b = np.nonzero(bound >= self.floor[q][:, None])
            mine = self.tags[at + a] != tags[b]
            a, b = a[mine], b[mine]
            if not len(a):
                continue
            if len(a) * 4 > bound.size:
                score = (self.whole[q] @ whole.T)[a, b]
            else:
                score = np.concatenate([np.einsum("ij,ij->i", self.whole[at + a[i : i + 65536]], whole[b[i : i + 65536]]) for i in range(0, len(a), 65536)])
            keep = score >= self.floor[at + a]
            a, b, score = a[keep], b[keep], score[keep]
            starts = np.searchsorted(a, np.arange(min(QUERIES, len(self.ids) - at) + 1))
            for i in np.unique(a):
                part = slice(starts[i], starts[i + 1])
                s, v, t = (np.concatenate(x) for x in zip(self.best[at + i], (score[part], ids[b[part]], tags[b[part]]), strict=True))
                order = np.lexsort((t, v, -s))[: self.k]
                self.best[at + i] = s[order], v[order], t[order]
                if len(order) == self.k:
                    self.floor[at + i] = max(self.floor[at + i], s[order[-1]])

    def rows(self) -> pa.RecordBatch:
        n = [len(s) for s, _, _ in self.best]
        cat = lambda k, kind: np.concatenate([x[k] for x in self.best]).astype(kind) if n else np.zeros(0, kind)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.tags, n)),
                pa.array(np.repeat(self.ids, n)),
                pa.array(cat(1, np.int64)),
                pa.array(cat(0, np.int64)),
            ],
            names=["query_tag", "query_id", "vec_id", "score"],
        )


def search(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every row whose id is divisible by ``every``.

    Components become floor(scale * x).  Rows with a null vector, or with a
    null or non-finite component, take no part, nor do rows with a null id;
    shorter vectors count as padded with zeros.  Equal scores go to the smaller
    id.  A row never answers itself, but a repeated row may.  Queries pass
    through the workers in blocks of fixed size; candidates are never sent.
    Scores are exact while they stay below 2**53.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    v = F.col(vector_col)
    sound = vectors.where(
        F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).withColumn("tag", F.monotonically_increasing_id())

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
            offsets = lists.offsets.to_numpy()
            offsets = offsets - (offsets[0] if len(offsets) else 0)
            sums = np.concatenate([[0.0], np.cumsum(values**2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sums[offsets[1:]] - sums[offsets[:-1]]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))],
                names=["vec_id", "tag", "norm2", "v"],
            )

    rows = scratch.put("scaled", sound.mapInArrow(scaled, "vec_id bigint, tag bigint, norm2 double, v array<double>"))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not dim:
        return empty
    # By length; equal lengths are dealt by id, so a common vector spreads over many partitions.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = scratch.put(
        "ordered",
        rows.repartitionByRange(parts, F.col("norm2").desc(), "vec_id", "tag").sortWithinPartitions(F.col("norm2").desc(), "vec_id", "tag"),
    )

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = matrix(batch.column(0), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["c"])

    gram = np.zeros(dim * dim)
    sums = ordered.select("v").mapInArrow(products, "c array<double>").select(F.posexplode("c").alias("i", "x"))
    for r in sums.groupBy("i").agg(F.sum("x").alias("x")).toLocalIterator():
        gram[r["i"]] = r["x"]
    power, rotation = np.linalg.eigh(gram.reshape(dim, dim))
    power, rotation = np.maximum(power[::-1], 0), rotation[:, ::-1].copy()
    lead = int(np.searchsorted(np.cumsum(power), LEADING * power.sum()) + 1) if power.sum() > 0 else 1

    queries = ordered.where(F.pmod("vec_id", F.lit(every)) == 0)
    passes = max(1, -(-queries.count() // PASS))
    cut = F.pmod(F.xxhash64("tag"), F.lit(passes))
    longest = ordered.orderBy(F.col("norm2").desc(), "vec_id", "tag").limit(BLOCK).toArrow()
    found: list[DataFrame] = []
    for turn in range(passes):
        block = queries.where(cut == turn).select("vec_id", "tag", "v").toArrow().combine_chunks()
        if not block.num_rows:
            continue
        part = block.to_batches()[0]
        args = part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), dim), rotation, lead, k
        seed = Searcher(*args)
        for b in longest.select(["vec_id", "tag", "v"]).combine_chunks().to_batches():
            seed.offer(b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), dim))
        sent = spark.sparkContext.broadcast((args, seed.floor))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, floor = sent.value
            s = Searcher(*own)
            s.floor[:] = floor
            for batch in batches:
                x = matrix(batch.column(2), dim)
                ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for at in range(0, len(ids), BLOCK):
                    s.offer(ids[at : at + BLOCK], tags[at : at + BLOCK], x[at : at + BLOCK])
            yield s.rows()

        hits = ordered.select("vec_id", "tag", "v").mapInArrow(work, "query_tag bigint, query_id bigint, vec_id bigint, score bigint")
        best = Window.partitionBy("query_tag").orderBy(F.col("score").desc(), "vec_id")
        found.append(
            scratch.put(f"found{turn}", hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
            .select("query_id", "rank", "vec_id", "score")
        )
        sent.unpersist()
    out = empty
    for f in found:
        out = f if out is empty else out.unionByName(f)
    return out
