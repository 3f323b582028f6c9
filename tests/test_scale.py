"""Operators that must not gather a layer, a block or a group of rows: ranks, detection, redraws, classes, incidence."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerloom.operators import bootstrap as B
from layerloom.operators import detect as D
from layerloom.operators import detect_large as DL
from layerloom.operators import graph as G
from layerloom.operators import ranks, redraw
from layerloom.operators.detect_large import detect_large
from layerloom.sources.workspace import Workspace

EDGES = "layer int, src long, dst long, weight double"


def put(spark):
    return Workspace(spark, "test").put


# Ranks.


def test_ranks_equal_a_sorted_list(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), rng.choice([None, *range(40)]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, v long, tag long").repartition(7)
    got = ranks.ranked(df, ["k"], ["v", "tag"], put(spark), total="n").collect()
    groups = defaultdict(list)
    for k, v, tag in rows:
        groups[k].append((v is not None, v or 0, tag))
    want = {tag: (i, len(g)) for g in groups.values() for i, (_, _, tag) in enumerate(sorted(g))}
    assert {r.tag: (r["rank"], r.n) for r in got} == want


def test_ranks_of_ties_and_of_nothing(spark):
    same = spark.range(90).select(F.lit("x").alias("k"), F.lit(1).alias("v"))
    assert sorted(r["rank"] for r in ranks.ranked(same, ["k"], ["v"], put(spark)).collect()) == list(range(90))
    assert ranks.ranked(same.limit(0), [], ["v"], put(spark)).isEmpty()
    got = ranks.dense(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string"), "c", put(spark)).collect()
    assert {r.c: r.id for r in got} == {None: 1, "a": 2, "b": 3}


def test_best_before_is_a_running_maximum(spark):
    rng = random.Random(2)
    best = {x: rng.random() for x in range(300)}
    got = ranks.best_before(spark.createDataFrame(list(best.items()), "low long, high double").repartition(5), "low", "high", put(spark)).collect()
    assert {r.low: r.edge for r in got} == {x: max([best[y] for y in range(x)], default=None) for x in best}


def test_no_window_without_partition(spark):
    df = spark.range(50).withColumnRenamed("id", "v")
    plan = ranks.ranked(df, [], ["v"], put(spark))._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(v" not in plan


# Detection.


def planted(n, blocks, p_in, p_out, seed, layers=2):
    rng = random.Random(seed)
    return [
        (t, a, b, 1.0) for t in range(1, layers + 1) for a in range(n) for b in range(a + 1, n)
        if rng.random() < (p_in if a % blocks == b % blocks else p_out)
    ]


def test_large_detection_is_as_good_as_the_kernel(spark):
    edges = spark.createDataFrame(planted(90, 4, 0.35, 0.06, 3), EDGES)
    nodes = spark.range(92).withColumnRenamed("id", "node").withColumn("layer", F.explode(F.array(F.lit(1), F.lit(2)))).select("layer", "node")
    found = Workspace(spark, "found").put("m", detect_large(nodes, edges, small=0))
    rows = found.collect()
    assert Counter((r.layer, r.node) for r in rows) == Counter((r.layer, r.node) for r in nodes.collect())
    for layer in (1, 2):
        first = {}
        for r in sorted((r for r in rows if r.layer == layer), key=lambda r: r.node):
            first.setdefault(r.community, r.node)
        assert list(first) == list(range(1, len(first) + 1))
        alone = Counter(r.community for r in rows if r.layer == layer)
        assert all(alone[r.community] == 1 for r in rows if r.layer == layer and r.node >= 90)
    score = {r.layer: r.modularity for r in G.modularity(found, edges).collect()}
    kernel = {r.layer: r.modularity for r in G.modularity(D.detect_layers(nodes, edges, "louvain"), edges).collect()}
    assert all(score[t] >= 0.95 * kernel[t] for t in kernel)
    joined = {r.layer: r.modularity for r in G.modularity(detect_large(nodes, edges), edges).collect()}
    assert all(joined[t] >= 0.95 * kernel[t] for t in kernel)


def test_large_detection_sends_labels_between_blocks(spark, monkeypatch):
    """Rounds read blocks, made once, in place of joins over all edges; several blocks, joins for large vertices and text as ids find communities as good."""
    rows = planted(90, 4, 0.35, 0.06, 3)
    edges = spark.createDataFrame(rows, EDGES)
    nodes = edges.select("layer", F.col("src").alias("node")).union(edges.select("layer", F.col("dst").alias("node"))).distinct()
    kernel = {r.layer: r.modularity for r in G.modularity(D.detect_layers(nodes, edges, "louvain"), edges).collect()}

    def good(nodes, edges):
        found = Workspace(spark, "found").put("m", detect_large(nodes, edges, small=0))
        score = {r.layer: r.modularity for r in G.modularity(found, edges).collect()}
        return found.count() == nodes.count() and all(score[t] >= 0.9 * kernel[t] for t in kernel)

    with monkeypatch.context() as m:
        m.setattr(DL, "_survey", None)
        m.setattr(DL.blocks, "BLOCK_EDGES", 700)
        assert good(nodes, edges)
    text = [F.concat(F.lit("n"), F.col(c)).alias(c) for c in ("src", "dst")]
    assert good(nodes.select("layer", F.concat(F.lit("n"), "node").alias("node")), edges.select("layer", *text, "weight"))
    monkeypatch.setattr(DL.blocks, "MOST_AROUND", 10)
    assert good(nodes, edges)


def test_blocks_hold_each_edge_once_and_send_labels_where_they_are_read(spark):
    ends = [(1, 3, 5, 1.0), (1, 5, 3, 1.0), (1, 3, 5, 2.0), (1, 5, 3, 2.0), (1, 5, 8, 1.0), (1, 8, 5, 1.0), (1, 3, 3, 4.0), (1, 8, 99, 1.0), (1, 99, 8, 1.0)]
    vertices = spark.createDataFrame([(1, a, 1.0) for a in (3, 5, 8, 11)], "layer int, a long, x double")
    made = DL.blocks.build(spark.createDataFrame(ends, "layer int, a long, b long, w double"), vertices, {1: 3})
    block, got, sent = {}, {}, {}
    for r in made.collect():
        own, _, halo, start, near, w, to_start, to = [np.frombuffer(r[n], t) for n, t in zip(DL.blocks.ARRAYS, DL.blocks.TYPES, strict=True)]
        for i, a in enumerate(own.tolist()):
            block[a] = r.block
            got |= {(a, halo[near[j]]): w[j] for j in range(start[i], start[i + 1])}
            sent[a] = set(to[to_start[i] : to_start[i + 1]].tolist())
    assert got == {(3, 5): 3.0, (5, 3): 3.0, (5, 8): 1.0, (8, 5): 1.0, (8, 99): 1.0}
    assert sent[3] == {block[3], block[5]} and sent[11] == {block[11]} and sent[5] == {block[3], block[5], block[8]}


def test_joining_counts_communities_that_nothing_leaves(spark):
    """Without the strength of the third, 990 of 1000, joining the other two would cost more than the edge between them gives."""
    apart = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 0, 1.0)], "layer int, a long, b long, w double")
    vertices = spark.createDataFrame([(1, a, k / 1000**0.5) for a, k in ((0, 5.0), (1, 5.0), (9, 990.0))], "layer int, a long, x double")
    total = spark.createDataFrame([(1, 1000.0)], "layer int, m2 double")
    assert {r["at"]: r["to"] for r in DL._joined(apart, vertices, total, 1.0, 1).collect()} == {0: 0, 1: 0, 9: 9}


def test_large_detection_by_potts_keeps_cliques_apart(spark):
    cliques = [(1, 5 * c + i, 5 * c + j, 1.0) for c in range(12) for i in range(5) for j in range(i + 1, 5)]
    ring = [(1, 5 * c, 5 * ((c + 1) % 12) + 2, 1.0) for c in range(12)]
    edges = spark.createDataFrame(cliques + ring, EDGES)
    nodes = spark.range(60).select(F.lit(1).alias("layer"), F.col("id").alias("node"))
    got = {r.node: r.community for r in detect_large(nodes, edges, 0.5, potts=True).collect()}
    assert got == {v: v // 5 + 1 for v in range(60)}


def test_large_detection_of_edge_cases(spark):
    nodes = spark.createDataFrame([(1, 4), (1, 9), (2, 4)], "layer int, node long")
    none = spark.createDataFrame([], EDGES)
    assert {(r.layer, r.node, r.community) for r in detect_large(nodes, none).collect()} == {(1, 4, 1), (1, 9, 2), (2, 4, 1)}
    assert detect_large(nodes.limit(0), none).isEmpty()
    loops = spark.createDataFrame([(1, 4, 4, 3.0), (1, 4, 9, 1.0)], EDGES)
    assert detect_large(nodes, loops).count() == 3
    with pytest.raises(ValueError):
        detect_large(nodes, spark.createDataFrame([(1, 4, 9, -1.0)], EDGES))
    edges = spark.createDataFrame(planted(30, 3, 0.6, 0.1, 1, 1), EDGES)
    points = spark.range(30).select(F.lit(1).alias("layer"), F.col("id").alias("node"))
    with pytest.raises(RuntimeError):
        detect_large(points, edges, most_rounds=1)


def test_a_layer_beyond_a_task_is_refused(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(D, "MOST_EDGES", 3)
    with pytest.raises(ValueError, match="detect_large"):
        D._refuse_large(pd.DataFrame({"a": range(4)}))
    D._refuse_large(pd.DataFrame({"a": range(3)}))
    assert DL.MOST_AT_ONCE < 1


# Redraws.


def model_rows(spark, members, edges):
    m = spark.createDataFrame([(1, v, c) for v, c in members.items()], "layer int, node long, community int")
    return m, spark.createDataFrame([(1, a, b, float(w)) for a, b, w in edges], EDGES)


def test_sure_and_impossible_pairs_are_drawn_exactly(spark):
    members = {v: v % 3 for v in range(31)}
    inside = [(a, b, 1 + (a + b) % 4) for a in range(31) for b in range(a + 1, 31) if members[a] == members[b]]
    m, e = model_rows(spark, members, inside)
    got = redraw.redraw_sparse(spark, m, e, m, 3, 9).collect()
    assert Counter((r.rep, r.src, r.dst) for r in got) == Counter((rep, a, b) for rep in (1, 2, 3) for a, b, _ in inside)
    assert {r.weight for r in got} <= {w for _, _, w in inside}


@pytest.mark.parametrize("directed", [False, True])
def test_redraws_follow_the_model(spark, directed):
    rng = random.Random(8)
    members = {v: 0 if v < 40 else 1 + v % 4 for v in range(80)}
    pairs = [(a, b) for a in range(80) for b in range(80) if (a != b if directed else a < b)]
    chance = lambda a, b: 0.3 if members[a] == members[b] else 0.04
    m, e = model_rows(spark, members, [(a, b, 1 if members[a] == members[b] else 2) for a, b in pairs if rng.random() < chance(a, b)])
    p = B.edge_model(m, e, m, directed).first()
    n = 40
    first = redraw.redraw_sparse(spark, m, e, m, n, 5, directed).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, redraw.redraw_sparse(spark, m, e, m, n, 5, directed).collect()))
    assert max(Counter((r.rep, r.src, r.dst) for r in first).values()) == 1
    assert all(r.src < r.dst for r in first) or directed
    for same, share in ((True, p.p_in), (False, p.p_out)):
        kind = [(a, b) for a, b in pairs if (members[a] == members[b]) == same]
        mean = n * len(kind) * share
        drawn = [r for r in first if (members[r.src] == members[r.dst]) == same]
        assert abs(len(drawn) - mean) <= 4 * (mean * (1 - share)) ** 0.5
        assert {r.weight for r in drawn} == {1.0 if same else 2.0}
        # Every pair has the same chance: none of them stands out.
        seen = Counter((r.src, r.dst) for r in drawn)
        top = n * share + 6 * (n * share * (1 - share)) ** 0.5 + 1
        assert set(seen) <= set(kind) and max(seen.values()) <= top


@pytest.mark.parametrize(("stretch", "dense"), [(3, 5), (1024, 1 << 16)])
def test_almost_sure_pairs_are_drawn_by_what_is_missing(spark, monkeypatch, stretch, dense):
    monkeypatch.setattr(redraw, "STRETCH", stretch)
    monkeypatch.setattr(redraw, "MOST_DENSE", dense)
    n, reps, p = 90, 30, {True: 0.97, False: 0.02}
    m = spark.createDataFrame([(1, v, v % 2) for v in range(n)], "layer int, node long, community int")
    model = spark.createDataFrame([(1, p[True], p[False])], "layer int, p_in double, p_out double")
    work = Workspace(spark, "redraw-test")
    placed = redraw.placed_nodes(m, work)
    stretches = work.put("stretches", redraw.drawn_stretches(spark, redraw.node_runs(placed, model, False), reps, 3))
    drawn = Counter(tuple(r) for r in redraw.drawn_pairs(stretches).collect())
    assert set(drawn.values()) == {1}
    pairs = {True: 2 * 45 * 44 // 2, False: 45 * 45}
    for same in (True, False):
        x = sum(k[3] == same for k in drawn)
        assert abs(x - reps * pairs[same] * p[same]) <= 4 * (reps * pairs[same] * p[same] * (1 - p[same])) ** 0.5
    # What is held are the few exceptions, not the pairs.
    assert sum(len(r.at) for r in stretches.collect()) < len(drawn) / 10
    counts = redraw.stretch_counts(stretches, placed).collect()
    assert sum(r.drawn for r in counts) == len(drawn) and all(r.sound and r.rows == reps and r.low > r.place for r in counts)
    assert {r.inside: sum(q.drawn for q in counts if q.inside == r.inside) for r in counts} == {b: sum(k[3] == b for k in drawn) for b in (True, False)}
    there = redraw.drawn_stretches(spark, redraw.node_runs(placed, model, False), reps, 3, checked=True)
    assert "at" not in there.columns and sorted(map(tuple, redraw.stretch_counts(there, placed).collect()), key=str) == sorted(map(tuple, counts), key=str)
    broken = stretches.withColumn("at", F.when(F.size("at") > 0, F.concat("at", F.slice("at", 1, 1))).otherwise(F.col("at")))
    assert not all(r.sound for r in redraw.stretch_counts(broken, placed).collect())


def test_stretches_are_checked_by_arrays(spark):
    """A lambda for every offset took most of the time; what it found is kept."""
    rows = [(1, 1, 0, True, 0, 9, False, at) for at in ([], [0, 8], [3], [3, 3], [4, 2], [-1, 2], [2, 9], [1, 5, 6])]
    stretches = spark.createDataFrame([(rep, *r[1:]) for rep, r in enumerate(rows)], "rep int, layer int, place long, same boolean, start long, stop long, dense boolean, at array<int>")
    placed = spark.createDataFrame([(1, 0, 0, 20)], "layer int, place long, first long, size long")
    found = {r.rep: (r.size_at, r.sound) for r in redraw._checked(stretches).collect()}
    assert [found[i] for i in range(8)] == [(0, True), (2, True), (1, True), (2, False), (2, False), (2, False), (2, False), (3, True)]
    counts = redraw.stretch_counts(stretches, placed)
    assert "lambda" not in counts._jdf.queryExecution().optimizedPlan().toString() and [r.sound for r in counts.collect()] == [False]


def test_walks_land_on_every_place_alike():
    n, length, q = 4000, 50, 0.3
    keys = np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)
    at, size = redraw.walks(keys, np.full(n, q), np.full(n, length))
    assert size.sum() == len(at) and at.min() >= 0 and at.max() < length
    row = np.repeat(np.arange(n), size)
    assert (np.diff(at)[np.diff(row) == 0] > 0).all()
    seen = np.bincount(at, minlength=length)
    assert np.abs(seen - n * q).max() <= 5 * (n * q * (1 - q)) ** 0.5
    sure, size = redraw.walks(keys[:3], np.array([1.0, 0.0, 1.0]), np.array([4, 4, 2]))
    assert sure.tolist() == [0, 1, 2, 3, 0, 1] and size.tolist() == [4, 0, 2]


def test_redraws_of_empty_layers(spark):
    m, e = model_rows(spark, {1: 1, 2: 1, 3: 2}, [])
    assert redraw.redraw_sparse(spark, m, e, m, 5).isEmpty()
    assert redraw.redraw_sparse(spark, m, e, m, 0).isEmpty()


# Classes of nodes alike in all replicates.


def test_classes_expand_to_all_pairs(spark):
    rng = random.Random(4)
    kinds = [[rng.randrange(3) for _ in range(6)] for _ in range(5)]
    rows = [(rep + 1, layer, v, kinds[(v + layer) % 5][rep]) for rep in range(6) for layer in (1, 2) for v in range(20)]
    members = spark.createDataFrame(rows, "rep int, layer int, node int, meta_community int")
    similarity, membership = B.class_co_assignment(members, 6)
    assert membership.select("layer", "class").distinct().count() <= 10
    got = B.expanded(similarity, membership).collect()
    assert Counter((r.layer, r.i, r.j, round(r.p, 9)) for r in got) == Counter((r.layer, r.i, r.j, round(r.p, 9)) for r in B.co_assignment(members, 6).collect())
    assert similarity.agg(F.sum("pairs")).first()[0] == len(got)


# Incidence.


def test_incidence_measures_equal_those_of_listed_pairs(spark):
    rng = random.Random(6)
    rows = sorted({(layer, rng.randrange(8), rng.randrange(25)) for layer in (1, 2) for _ in range(120)})
    inc = spark.createDataFrame(rows, "layer int, g int, node int")
    other = inc.withColumnRenamed("node", "dst")
    edges = inc.withColumnRenamed("node", "src").join(other, ["layer", "g"]).where("src < dst").groupBy("layer", "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    nodes = spark.range(27).select(F.col("id").cast("int").alias("node")).withColumn("layer", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("layer", "node")
    m = nodes.withColumn("community", F.col("node") % 4)
    key = lambda df, c: {tuple(r[:-1]): None if r[-1] is None else round(r[-1], 9) for r in df.collect()}
    assert key(G.incidence_strengths(nodes, inc, ["g"]), "strength") == key(G.strengths(nodes, edges), "strength")
    assert key(G.incidence_modularity(m, inc, ["g"]), "q") == key(G.modularity(m, edges), "q")
