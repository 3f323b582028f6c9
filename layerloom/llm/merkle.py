"""A Merkle manifest of a dataset: one tree per source, and one over the sources.

Leaves are numbered within their source without gathering it anywhere, and cut
into aligned blocks of 4,096, three whole levels of sixteen.  Executors run
DuckDB level queries (ordered string_agg, then sha256) over the Arrow batches
that hold these blocks; Spark combines the block roots level by level.  The way
from a block's root to the dataset's root is the same for all its leaves: it is
made once per block, joined back, and the second pass of DuckDB queries completes
and folds every proof.  Proofs themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .scratch import Scratch

FAN = 16
#: Levels of a block; a block has FAN ** BLOCK_LEVELS leaves.
BLOCK_LEVELS = 3
BLOCK = FAN**BLOCK_LEVELS
#: Levels that 64-bit numbers of leaves can need.
MOST_LEVELS = 16

SIDES = "array<struct<l:string,r:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def levels_of(n: Column) -> Column:
    """How often n nodes must be grouped by sixteen until one is left."""
    out = F.lit(0)
    for level in range(MOST_LEVELS):
        out = out + (n > F.lit(FAN**level)).cast("int") if FAN**level < 2**63 else out
    return out


# The block engine: SQL over whole blocks, many at a time.


def _over_blocks(rows: DataFrame, keys: list[str], sort: list[str], run: Callable, schema: str) -> DataFrame:
    """``run(connection, table)`` over Arrow tables that hold whole blocks, one after another.

    Blocks are dealt out by key and follow one another in a task; a task holds
    one Arrow batch and the block it cuts, never more.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            # The last block may go on in the next batch: keep it back.
            tail = reduce(pc.and_, [pc.equal(table.column(k), table.column(k)[-1]) for k in keys])
            cut = table.num_rows - pc.sum(tail).as_py()
            whole, rest = table.slice(0, cut), table.slice(cut).combine_chunks()
            if whole.num_rows:
                yield from run(con, whole).to_batches(max_chunksize=2048)
        if rest is not None and rest.num_rows:
            yield from run(con, rest).to_batches(max_chunksize=2048)
        con.close()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *sort).mapInArrow(work, schema)


def _level(con, k: int) -> None:
    """From the nodes of level k those of level k + 1, and every node's run with its place there; blocks that end at k stay."""
    con.execute(f"""CREATE OR REPLACE TEMP TABLE level{k + 1} AS
        SELECT tree, block, depth, pos // {FAN} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h
        FROM level{k} WHERE depth > {k} GROUP BY tree, block, depth, pos // {FAN}""")


def _start(con, leaves: pa.Table) -> None:
    con.register("given", leaves)
    con.execute("CREATE OR REPLACE TEMP TABLE level0 AS SELECT tree, block, least(depth, ?) AS depth, pos, leaf AS h FROM given WHERE leaf IS NOT NULL", [BLOCK_LEVELS])


def _roots(con, leaves: pa.Table) -> pa.Table:
    """(tree, block, h) of every block."""
    _start(con, leaves)
    for k in range(BLOCK_LEVELS):
        _level(con, k)
    parts = " UNION ALL ".join(f"SELECT tree, block, h FROM level{k} WHERE depth = {k}" for k in range(BLOCK_LEVELS + 1))
    return con.sql(parts).to_arrow_table()


def _sides(con, k: int) -> None:
    """What stands left and right of every node of level k in its run of sixteen."""
    con.execute(f"""CREATE OR REPLACE TEMP TABLE sides{k} AS
        WITH runs AS (SELECT tree, block, pos // {FAN} AS run, list(h ORDER BY pos) AS hs FROM level{k} WHERE depth > {k} GROUP BY ALL)
        SELECT n.tree, n.block, n.pos, array_to_string(hs[1 : n.pos % {FAN}], '') AS l, array_to_string(hs[n.pos % {FAN} + 2 :], '') AS r
        FROM level{k} n JOIN runs USING (tree, block) WHERE n.depth > {k} AND run = n.pos // {FAN}""")


def _proofs(con, rows: pa.Table) -> pa.Table:
    """Per leaf its proof's digest and the root that its (tampered) text folds to; header rows bring the way above the block."""
    _start(con, rows)
    for k in range(BLOCK_LEVELS):
        _sides(con, k)
        _level(con, k)
    con.execute("CREATE OR REPLACE TEMP TABLE above AS SELECT tree, block, way, subroot, root FROM given WHERE leaf IS NULL")
    con.execute("CREATE OR REPLACE TEMP TABLE fold AS SELECT tree, block, pos, doc_id, leaf, '' AS proof, coalesce(tampered, leaf) AS h FROM given WHERE leaf IS NOT NULL")
    for k in range(BLOCK_LEVELS):
        con.execute(f"""CREATE OR REPLACE TEMP TABLE fold AS
            SELECT f.tree, f.block, f.pos, f.doc_id, f.leaf,
              CASE WHEN s.pos IS NULL THEN f.proof ELSE f.proof || s.l || s.r END AS proof,
              CASE WHEN s.pos IS NULL THEN f.h ELSE sha256(s.l || f.h || s.r) END AS h
            FROM fold f LEFT JOIN sides{k} s ON s.tree = f.tree AND s.block = f.block AND s.pos = f.pos // {FAN**k}""")
    con.execute("""CREATE OR REPLACE TEMP TABLE done AS
        SELECT f.doc_id, f.leaf, subroot, root, sha256(proof || array_to_string(list_transform(way, lambda s: s.l || s.r), '')) AS proof_sha256, h, way
        FROM fold f JOIN above a ON a.tree = f.tree AND a.block = f.block""")
    # One hash a level above the block, the same levels for all leaves of a block.
    deepest = con.execute("SELECT coalesce(max(len(way)), 0) FROM above").fetchall()[0][0]
    for k in range(1, deepest + 1):
        con.execute(f"""CREATE OR REPLACE TEMP TABLE done AS
            SELECT doc_id, leaf, subroot, root, proof_sha256, way, CASE WHEN len(way) < {k} THEN h ELSE sha256(way[{k}].l || h || way[{k}].r) END AS h FROM done""")
    return con.sql("SELECT doc_id, leaf, subroot, root, proof_sha256, h AS folded_root FROM done").to_arrow_table()


# The levels above the blocks, and the tree over the sources, by Spark.


def _joined(items: Column) -> Column:
    return F.array_join(items, "")


def climb(nodes: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Trees (tree, pos, n, h), n nodes each, up to their roots.

    Returns roots (tree, h) and, for every node given, its way (tree, pos, way):
    what stands left and right of it, of its parent, and so on.  A level is one
    aggregate of at most sixteen nodes a group, written before the next.
    """
    levels, way = nodes, nodes.select("tree", "pos", F.lit(None).cast(SIDES).alias("way"))
    way = way.withColumn("way", F.coalesce("way", F.array().cast(SIDES)))
    roots = nodes.where("n = 1").select("tree", "h")
    for level in range(MOST_LEVELS):
        levels = levels.where("n > 1")
        if levels.isEmpty():
            break
        run = F.floor(F.col("pos") / FAN).cast("bigint")
        runs = scratch.put(
            f"{name}_runs{level}",
            levels.groupBy("tree", "n", run.alias("run")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]).alias("hs")),
        )
        at = F.floor(F.col("pos") / F.lit(FAN**level)).cast("bigint")
        mine = runs.select(F.col("tree").alias("__tree"), F.col("run").alias("__run"), "hs")
        here = F.pmod(at, F.lit(FAN)).cast("int")
        side = F.struct(
            _joined(F.slice("hs", F.lit(1), here)).alias("l"),
            _joined(F.slice("hs", here + 2, F.lit(FAN))).alias("r"),
        )
        way = way.join(mine, (F.col("tree") == F.col("__tree")) & (F.floor(at / FAN) == F.col("__run")), "left").select(
            "tree", "pos", F.when(F.col("hs").isNull(), F.col("way")).otherwise(F.concat("way", F.array(side))).alias("way")
        )
        way = scratch.put(f"{name}_way{level}", way)
        levels = scratch.put(f"{name}_level{level}", runs.select("tree", F.col("run").alias("pos"), F.floor((F.col("n") + FAN - 1) / FAN).cast("bigint").alias("n"), F.sha2(_joined(F.col("hs")), 256).alias("h")))
        roots = roots.unionByName(levels.where("n = 1").select("tree", "h"))
    else:
        raise RuntimeError("more levels than 64-bit numbers need")
    return roots, way


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of doc_id, source, lang, n_chars and text.  Leaves of a
    source ascend by doc_id, null first, then by digest; rows alike in all that
    are leaves of their own.  A null source is a source, the first one.  ``proof_sha256``
    is the digest of all siblings from the leaf to the root, empty for the only
    leaf of the only source.  ``folded_root`` starts from the leaf of the tampered
    text (lower case) where 5 divides the CRC-32 of doc_id; null ids are not
    tampered with.  Long texts are hashed where they are read; only digests move.
    Other columns are ignored; an empty table has an empty manifest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    lowered = F.translate("text", UPPER, LOWER)
    leaves = docs.select(
        "source",
        "doc_id",
        leaf_of(*[F.col(c) for c in names]).alias("leaf"),
        F.when(chosen, leaf_of(*[F.col(c) for c in names[:-1]], lowered)).alias("tampered"),
    )
    leaves = scratch.put("leaves", leaves)  # ranges are found by a pass of their own: hash texts once only
    placed = ranked(leaves, ["source"], ["doc_id", "leaf"], scratch.put, "by_doc", "pos", "n")
    # Sources by number, null first: the order of the tree over them, and a key without nulls.
    sources = scratch.put("sources", ranked(scratch.put("names", docs.select("source").distinct()), [], ["source"], scratch.put, "by_source", "tree", "trees"))
    numbered = sources.select(F.col("source").alias("__source"), "tree")
    block = F.floor(F.col("pos") / BLOCK).cast("bigint")
    rows = scratch.put(
        "blocks",
        placed.join(numbered, F.col("source").eqNullSafe(F.col("__source"))).select(
            "tree", block.alias("block"), (F.col("pos") - block * BLOCK).cast("int").alias("pos"), "n", levels_of(F.col("n")).alias("depth"), "doc_id", "leaf", "tampered"
        ),
    )
    # Block roots: trees of up to a block are done, the others go on with them as leaves.
    roots = scratch.put("roots", _over_blocks(rows.select("tree", "block", "pos", "depth", "leaf"), ["tree", "block"], ["pos"], _roots, "tree long, block long, h string"))
    sizes = rows.groupBy("tree").agg(F.max("block").alias("last"))
    nodes = scratch.put("nodes", roots.join(sizes, "tree").select("tree", F.col("block").alias("pos"), (F.col("last") + 1).alias("n"), "h"))
    subroots, ways = climb(nodes, scratch, "within")
    subroots = scratch.put("subroots", subroots)
    total = sources.select(F.col("tree").alias("pos"), F.col("trees").alias("n"))
    tops = scratch.put("tops", subroots.withColumnRenamed("tree", "pos").join(total, "pos").select(F.lit(0).cast("bigint").alias("tree"), "pos", "n", "h"))
    root, outer = climb(tops, scratch, "over")
    # What all leaves of a block share: the way above it, and where that ends.
    tree_root = subroots.select(F.col("tree").alias("__of"), F.col("h").alias("subroot"))
    above = outer.join(root.select("tree", F.col("h").alias("root")), "tree").select(F.col("pos").alias("__tree"), F.col("way").alias("__outer"), "root")
    headers = scratch.put(
        "headers",
        ways.join(above, F.col("tree") == F.col("__tree")).join(tree_root, F.col("tree") == F.col("__of")).select("tree", F.col("pos").alias("block"), F.concat("way", "__outer").alias("way"), "subroot", "root"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    header = headers.select("tree", "block", F.lit(-1).alias("pos"), none("int").alias("depth"), none("bigint").alias("doc_id"), none("string").alias("leaf"), none("string").alias("tampered"), "way", "subroot", "root")
    body = rows.select("tree", "block", "pos", "depth", F.col("doc_id").cast("bigint"), "leaf", "tampered", none(SIDES).alias("way"), none("string").alias("subroot"), none("string").alias("root"))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    proofs = _over_blocks(header.unionByName(body), ["tree", "block"], ["pos"], _proofs, schema)
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))
