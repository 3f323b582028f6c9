"""Redraws of a block model that cost what they draw, not what could be drawn.

Nodes of a layer are put in order of their communities.  The pairs a node is
asked about are then two runs of places, those inside its community and those
outside, each with one probability: the distance to the next pair that is drawn
is geometric, and the pairs between are never made.  Where most pairs are drawn
the walk goes from one pair that is not drawn to the next, and what lies between
stays a stretch until somebody wants its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import Workspace
from .bootstrap import edge_model
from .ranks import ranked

#: Jumps expected in one stretch of a run, pairs of a stretch at most (of which most, few are drawn), jumps of a task, and tasks at most.
STRETCH, MOST_DENSE, MOST_SPARSE, TASK, MOST_TASKS = 1024, 1 << 16, 1 << 30, 4_000_000, 2000
#: Jumps sent on at once, and made at once (arrays of these stay in a core's cache).
AT_ONCE, IN_CACHE = 1 << 20, 1 << 15


def _chance(*keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def placed_nodes(membership: DataFrame, work: Workspace) -> DataFrame:
    """(layer, node, community, place, first, size, n): places 0..n-1 by community; a community holds first..first+size-1."""
    at = work.put("places", ranked(membership.select("layer", "community", "node"), ["layer"], ["community", "node"], work.put, "order", "place", "n"))
    runs = at.groupBy("layer", "community").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    return work.put("placed", at.join(runs, ["layer", "community"]))


def node_runs(placed: DataFrame, model: DataFrame, directed: bool) -> DataFrame:
    """(layer, place, same, length, p): the runs of partners of every node, undirected ones with later nodes only."""
    end = F.col("first") + F.col("size")
    if directed:
        inside, outside = F.col("size") - 1, F.col("n") - F.col("size")
    else:
        inside, outside = end - 1 - F.col("place"), F.col("n") - end
    both = F.array(
        F.struct(F.lit(True).alias("same"), inside.alias("length"), F.col("p_in").alias("p")),
        F.struct(F.lit(False).alias("same"), outside.alias("length"), F.col("p_out").alias("p")),
    )
    return placed.join(model, "layer").select("layer", "place", F.explode(both).alias("r")).select("layer", "place", "r.*").where("length > 0 and p > 0")


def _partner(directed: bool, k: Column) -> Column:
    """The place of the k-th partner in a run."""
    end = F.col("first") + F.col("size")
    if directed:
        inside = F.col("first") + k + (F.col("first") + k >= F.col("place")).cast("bigint")
        outside = F.when(k < F.col("first"), k).otherwise(k + F.col("size"))
    else:
        inside, outside = F.col("place") + 1 + k, end + k
    return F.when(F.col("same"), inside).otherwise(outside)


def _uniform(keys: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The j-th number in (0, 1) of every key (splitmix64)."""
    x = keys + (j.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(12)).astype(np.float64) * 2.0**-52 + 2.0**-53


def walks(keys: np.ndarray, q: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets below ``length`` that geometric jumps of chance ``q`` land on, walk by walk, and how many each walk has."""
    part = (np.cumsum(length * q + 1) // IN_CACHE).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.zeros(1, np.int64)
    found = [_walks(*(v[i:j] for v in (keys, q, length))) for i, j in zip(cuts, np.append(cuts[1:], len(keys)), strict=True)]
    place, made = zip(*found, strict=True)
    return np.concatenate(place), np.concatenate(made)


def _walks(keys: np.ndarray, q: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = length * q
    made = np.zeros(len(keys), np.int64)
    at = np.full(len(keys), -1, np.int64)
    rows, found = [], []
    todo = np.flatnonzero((q > 0) & (length > 0))
    with np.errstate(divide="ignore"):
        scale = np.log1p(-q)  # -inf: every place
    more = np.where(q >= 1, length, (mean + 4 * np.sqrt(mean) + 4).astype(np.int64))
    while len(todo):
        n = more[todo]
        first = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(todo)), n)
        j = np.arange(len(owner)) - first[owner] + made[todo][owner]
        jump = 1 + np.minimum(np.log(_uniform(keys[todo][owner], j)) / scale[todo][owner], 2.0**31).astype(np.int64)
        upto = np.cumsum(jump)
        place = upto + (at[todo] - np.append(0, upto)[first])[owner]
        keep = place < length[todo][owner]
        rows.append(todo[owner[keep]])
        found.append(place[keep])
        at[todo] = place[first + n - 1]
        made[todo] += n
        more = np.where(q >= 1, length, np.maximum(8, more // 4))
        todo = todo[at[todo] < length[todo]]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(len(keys), np.int64)
    row, place = np.concatenate(rows), np.concatenate(found)
    if len(rows) > 1:
        order = np.argsort(row, kind="stable")  # a later turn goes on where the one before it ended
        row, place = row[order], place[order]
    return place, np.bincount(row, minlength=len(keys))


def drawn_stretches(spark: SparkSession, runs: DataFrame, n_boot: int, seed: int, checked: bool = False) -> DataFrame:
    """(rep, layer, place, same, start, stop, dense, at): what is drawn of the partners start..stop-1 of a node.

    ``at`` are offsets from ``start``, ascending: of the partners drawn, or, where
    ``dense``, of those that are not drawn while all others are.  A run is cut
    into stretches in which about a thousand jumps are expected, each with random
    numbers of its own, so hot nodes and sure pairs spread over the cluster.
    With ``checked`` offsets do not leave the task that draws them: ``size_at``
    and ``sound`` of ``_checked`` come in their place.
    """
    dense = F.col("p") > 0.5
    q = F.when(dense, 1 - F.least(F.col("p"), F.lit(1.0))).otherwise(F.col("p"))
    per = F.least(F.ceil(F.lit(float(STRETCH)) / F.greatest(F.col("q"), F.lit(1e-12))), F.when(F.col("dense"), MOST_DENSE).otherwise(MOST_SPARSE).cast("bigint"))
    cut = runs.select("layer", "place", "same", "length", dense.alias("dense"), q.alias("q")).withColumn("per", per)
    jumps = cut.agg(F.sum(F.col("q") * F.col("length") + F.ceil(F.col("length") / F.col("per")))).first()[0] or 0
    tasks = int(min(MOST_TASKS, max(1, jumps * n_boot // TASK)))
    cut = cut.repartition(tasks, "layer", "place", "same") if tasks > 1 else cut
    cut = cut.withColumn("start", F.explode(F.expr("sequence(0L, length - 1, per)"))).withColumn("stop", F.least(F.col("start") + F.col("per"), F.col("length")))
    todo = cut.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).withColumn(
        "key", F.xxhash64(F.lit(f"{seed}|jumps"), F.col("rep"), F.col("layer"), F.col("place"), F.col("same"), F.col("start"))
    )
    kept = ["rep", "layer", "place", "same", "start", "stop", "dense"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, chance, start, stop = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "q", "start", "stop"))
            length = stop - start
            part = ((np.cumsum(length * chance) + np.arange(len(length))) // AT_ONCE).astype(np.int64)
            for begin, end in zip(*(np.flatnonzero(np.diff(part, **side)) for side in ({"prepend": -1}, {"append": -1})), strict=True):
                here = slice(begin, end + 1)
                place, n = walks(key[here].view(np.uint64), chance[here], length[here])
                some = batch.slice(begin, end + 1 - begin)
                off = np.append(0, np.cumsum(n)).astype(np.int32)
                if checked:
                    made = [pa.array(n.astype(np.int32)), pa.array(_sound(place, off, length[here]))]
                else:
                    made = [pa.ListArray.from_arrays(pa.array(off), pa.array(place.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(c)) for c in kept), *made], names=[*kept, *more])

    kinds, more = dict(todo.dtypes), ["size_at", "sound"] if checked else ["at"]
    return todo.select(*kept, "key", "q").mapInArrow(work, ", ".join(f"{c} {kinds[c]}" for c in kept) + (", size_at int, sound boolean" if checked else ", at array<int>"))


def drawn_pairs(stretches: DataFrame) -> DataFrame:
    """(rep, layer, place, same, k): the k-th partners that are drawn."""
    every = F.sequence(F.lit(0), (F.col("stop") - F.col("start") - 1).cast("int"))
    at = F.when(F.col("dense"), F.array_except(F.when(F.col("dense"), every), F.col("at"))).otherwise(F.col("at"))
    return stretches.select("rep", "layer", "place", "same", "start", F.explode(at).alias("k")).withColumn("k", F.col("start") + F.col("k")).drop("start")


def _sound(at: np.ndarray, off: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the numbers from ``off`` to the next one ascend from 0 or more and stay below ``length``."""
    some = np.diff(off) > 0
    sound = np.ones(len(length), bool)
    sound[some] = (at[off[:-1][some]] >= 0) & (at[off[1:][some] - 1] < length[some])
    falls = np.flatnonzero(at[1:] <= at[:-1]) + 1
    row = np.searchsorted(off, falls, "right") - 1
    sound[row[off[row] < falls]] = False
    return sound


def _checked(stretches: DataFrame) -> DataFrame:
    """``stretches`` with the number of offsets and ``sound``, whether they ascend inside the stretch, in place of ``at``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, start, stop, at = batch.columns
            v, off = at.flatten().to_numpy(), at.offsets.to_numpy() - at.offsets[0].as_py()
            sound = _sound(v, off, stop.to_numpy() - start.to_numpy())
            yield pa.RecordBatch.from_arrays([*rest, start, stop, pa.array(np.diff(off).astype(np.int32)), pa.array(sound)], names=[*batch.schema.names[:-1], "size_at", "sound"])

    kept = ["rep", "layer", "place", "same", "dense", "start", "stop"]
    kinds = dict(stretches.dtypes)
    return stretches.select(*kept, "at").mapInArrow(work, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", size_at int, sound boolean")


def stretch_counts(stretches: DataFrame, placed: DataFrame, directed: bool = False) -> DataFrame:
    """(layer, place, low, high, inside, drawn, sound, rows, r0, r1, ...): what all replicates drew of a stretch, from places low to high.

    ``inside`` tells whether these places belong to the node's community (null: to both), ``sound`` whether the
    offsets of every replicate ascend inside the stretch.  A replicate is a bit of r0, r1, ..., where it drew a pair.
    """
    here = (stretches if "sound" in stretches.columns else _checked(stretches)).join(placed.select("layer", "place", "first", "size"), ["layer", "place"])
    partner = lambda k: _partner(directed, k)
    n, end = F.col("stop") - F.col("start"), F.col("first") + F.col("size")
    low, high = F.col("low"), F.col("high")
    rows = here.select(
        "rep", "layer", "place", partner(F.col("start")).alias("low"), partner(F.col("stop") - 1).alias("high"), "first", "size",
        F.when(F.col("dense"), n - F.col("size_at")).otherwise(F.col("size_at")).alias("n"), "sound",
    ).withColumn("inside", F.when((low >= F.col("first")) & (high < end), True).when((high < F.col("first")) | (low >= end), False))
    return rows.groupBy("layer", "place", "low", "high", "inside").agg(F.sum("n").alias("drawn"), F.every("sound").alias("sound"), F.count(F.lit(1)).alias("rows"), *replicate_bits(F.col("n") > 0))


#: Words of bits for replicates, and replicates in a word.
BIT_WORDS, BIT_WORD = 2, 62


def replicate_bits(where: Column) -> list[Column]:
    """r0, r1, ...: the replicates of a group as bits."""
    bit = lambda w: F.when(where & (F.floor(F.col("rep") / BIT_WORD) == w), F.expr(f"shiftleft(1L, cast(rep % {BIT_WORD} as int))")).otherwise(F.lit(0).cast("bigint"))
    return [F.bit_or(bit(w)).alias(f"r{w}") for w in range(BIT_WORDS)]


def weight_ranks(edges: DataFrame, membership: DataFrame, work: Workspace) -> DataFrame:
    """(layer, same, weight, idx, size, idx_all, size_all): places of a layer's weights among those of its kind and among all."""
    e = edges.where("weight > 0 and src <> dst")
    a = membership.select("layer", F.col("node").alias("src"), F.col("community").alias("ca"))
    b = membership.select("layer", F.col("node").alias("dst"), F.col("community").alias("cb"))
    known = e.join(a, ["layer", "src"]).join(b, ["layer", "dst"]).select("layer", (F.col("ca") == F.col("cb")).alias("same"), "weight", "src", "dst")
    kind = work.put("kind_ranks", ranked(known, ["layer", "same"], ["weight", "src", "dst"], work.put, "by_kind", "idx", "size"))
    return work.put("weight_ranks", ranked(kind, ["layer"], ["weight", "src", "dst"], work.put, "by_layer", "idx_all", "size_all").drop("src", "dst"))


def redraw_sparse(spark: SparkSession, nodes: DataFrame, edges: DataFrame, membership: DataFrame, n_boot: int, seed: int = 1, directed: bool = False) -> DataFrame:
    """edges(rep, layer, src, dst, weight) of ``n_boot`` redraws of the block model of ``edge_model``.

    Work and rows grow with the edges drawn and with nodes x replicates, never
    with pairs.  Weights come from the observed ones of the same kind, of the layer
    if it has none of that kind, else they are 1.  Equal seeds give equal rows.
    Nodes without a community take no part; undirected rows have src < dst.
    """
    work = Workspace(spark, "redraw")
    if n_boot < 1:
        kinds = dict(membership.dtypes)
        return spark.createDataFrame([], f"rep int, layer {kinds['layer']}, src {kinds['node']}, dst {kinds['node']}, weight double")
    placed = placed_nodes(membership, work)
    model = work.put("model", edge_model(nodes, edges, membership, directed))
    runs = node_runs(placed, model, directed)
    drawn = drawn_pairs(drawn_stretches(spark, runs, n_boot, seed))
    here = placed.select("layer", "place", F.col("node").alias("u"), "first", "size")
    there = placed.select("layer", F.col("place").alias("to"), F.col("node").alias("v"))
    ends = drawn.join(here, ["layer", "place"]).withColumn("to", _partner(directed, F.col("k"))).join(there, ["layer", "to"])
    src, dst = (F.col("u"), F.col("v")) if directed else (F.least("u", "v"), F.greatest("u", "v"))
    pairs = work.put("pairs", ends.select("rep", "layer", src.alias("src"), dst.alias("dst"), "same"))
    pools = weight_ranks(edges, membership, work)
    kinds = pools.groupBy("layer", "same").agg(F.first("size").alias("size"))
    layers = pools.groupBy("layer").agg(F.first("size_all").alias("size_all"))
    u = _chance(F.lit(f"{seed}|w"), F.col("rep"), F.col("layer"), F.col("src"), F.col("dst"))
    picked = (
        pairs.join(kinds, ["layer", "same"], "left").join(layers, "layer", "left")
        .withColumn("idx", F.floor(u * F.col("size")).cast("bigint"))
        .withColumn("idx_all", F.when(F.col("size").isNull(), F.floor(u * F.col("size_all")).cast("bigint")))
    )
    own = pools.select("layer", "same", "idx", F.col("weight").alias("w1"))
    rest = pools.select("layer", "idx_all", F.col("weight").alias("w2"))
    return picked.join(own, ["layer", "same", "idx"], "left").join(rest, ["layer", "idx_all"], "left").select("rep", "layer", "src", "dst", F.coalesce("w1", "w2", F.lit(1.0)).alias("weight"))
