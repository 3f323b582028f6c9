"""Hand-made cases with known results."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from layerloom.functions import links as L
from layerloom.functions.portable import wilson
from layerloom.operators import bootstrap as B
from layerloom.operators import detect as D
from layerloom.operators import graph as G
from layerloom.operators import metrics as M
from layerloom.operators import simulate as S
from layerloom.operators import ties as T
from layerloom.operators import track as K
from layerloom.operators.kernels.assignment import best_matching, greedy_matching
from layerloom.operators.kernels.communities import detect
from layerloom.plans import fits, study
from layerloom.sources import layers as Y
from layerloom.sources import storage


def eye(n, t):
    return [[[float(i == j) for j in range(n)] for i in range(n)] for _ in range(t)]


def cliques(*sizes):
    n, at, m = sum(sizes), 0, None
    m = [[0.0] * n for _ in range(n)]
    for s in sizes:
        for i, j in itertools.permutations(range(at, at + s), 2):
            m[i][j] = 1.0
        at += s
    return m


def members(spark, rows):
    return spark.createDataFrame(rows, "layer int, node int, community int")


def test_identity_ties_of_identity_matrices(spark):
    fit = fits.fit_multilayer_identity_ties(spark, eye(6, 3), layer_links=[(1, 2, 1.0), (2, 3, 0.7)])
    assert fit.ties.count() == 12
    assert fits.fit_multilayer_identity_ties(spark, eye(8, 5)).ties.count() == 32


def test_named_unequal_layers(spark):
    rows = [(1, "A", "B"), (1, "A", "C"), (1, "B", "C"), (2, "B", "C"), (2, "B", "D"), (2, "C", "D"), (3, "A", "C"), (3, "A", "D"), (3, "C", "D")]
    edges = spark.createDataFrame(rows, "layer int, src string, dst string")
    layers = Y.from_edges(edges, same_nodes=False)
    fit = fits.fit_multilayer_identity_ties(spark, layers, allow_unequal_nodes=True)
    assert sorted((r.from_layer, r.node) for r in fit.ties.collect()) == [(1, "B"), (1, "C"), (2, "C"), (2, "D")]
    with pytest.raises(ValueError, match="same node"):
        Y.from_edges(edges)


def test_weighted_similarities(spark):
    one = [[0, 10, 1], [10, 0, 0], [1, 0, 0]]
    two = [[0, 1, 10], [1, 0, 0], [10, 0, 0]]
    layers = Y.from_matrices(spark, [one, two])
    m = members(spark, [(t, i, 1) for t in (1, 2) for i in (1, 2, 3)])
    s = G.strengths(layers.nodes, layers.edges)
    for metric, value in (("weighted_jaccard", 13 / 31), ("weighted_overlap", 13 / 22)):
        row = T.community_ties(m, L.chain(spark, 2), metric, strengths=s).first()
        assert row.similarity == pytest.approx(value)


def test_set_similarities(spark):
    m = members(spark, [(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 2, 1), (2, 3, 1), (2, 4, 1)])
    assert T.community_ties(m, L.chain(spark, 2)).first().similarity == pytest.approx(2 / 4)
    assert T.community_ties(m, L.chain(spark, 2), "overlap").first().similarity == pytest.approx(2 / 3)


def test_strength_maps(spark):
    m = members(spark, [(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 2, 1), (2, 3, 1), (2, 4, 1)])
    s = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (1, 3, 1.0), (2, 2, 2.0), (2, 3, 4.0), (2, 4, 6.0)], "layer int, node int, strength double")
    get = lambda metric: T.community_ties(m, L.chain(spark, 2), metric, strengths=s).first().similarity
    assert get("weighted_jaccard") == pytest.approx(3 / 18)
    assert get("weighted_overlap") == pytest.approx(3 / 9)


def test_zero_pairs_are_kept_only_without_threshold(spark):
    m = members(spark, [(t, i, c) for t in (1, 2) for i, c in ((1, 1), (2, 1), (3, 2), (4, 2))])
    assert T.community_ties(m, L.chain(spark, 2)).count() == 4
    assert T.community_ties(m, L.chain(spark, 2), include_zero=False).count() == 2
    assert T.community_ties(m, L.chain(spark, 2), min_similarity=0.5).count() == 2
    assert T.community_ties(m, L.custom(spark, [(1, 2), (1, 2)], 2)).count() == 8


def test_self_loops(spark):
    m = members(spark, [(1, 1, 1), (1, 2, 2), (2, 1, 1)])
    links = L.custom(spark, [(1, 2, 0.5)], 2)
    assert {r.similarity for r in T.self_loops(m, links).collect()} == {2.0}
    assert {r.similarity for r in T.self_loops(m, links, directed=True).collect()} == {1.0}
    assert {r.weighted_similarity for r in T.self_loops(m, links, 2.0).collect()} == {2.0}


def test_negative_weights(spark):
    layer = [[0, 1, -1], [1, 0, 1], [-1, 1, 0]]
    with pytest.raises(ValueError, match="negative edge weights"):
        fits.fit_multilayer_jaccard(spark, [layer, layer])
    fit = fits.fit_multilayer_jaccard(spark, [layer, layer], objective="cpm")
    assert fit.membership.count() == 6
    assert {r.modularity for r in fit.modularity.collect()} == {None}


def test_hungarian_is_stable(spark):
    fit = fits.fit_multilayer_hungarian(spark, [cliques(3, 3)] * 3, algorithm="louvain")
    by = {}
    for r in fits.extract_meta_membership(fit).collect():
        by.setdefault(r.layer, []).append(r.meta_community)
    assert by[1] == by[2] == by[3] and len(set(by[1])) == 2


def test_tracking_never_reuses_a_label_unless_asked(spark):
    m = members(spark, [(1, 1, 1), (1, 2, 2), (2, 1, 1), (3, 1, 1), (3, 3, 2)])
    new = lambda method: {r.node: r.meta_community for r in K.track(m, method).where("layer = 3").collect()}
    assert new("optimal")[3] == 3
    assert new("reuse")[3] == 2


def test_links(spark):
    assert [(r.from_layer, r.to_layer, r.weight) for r in L.chain(spark, 5).orderBy("from_layer").collect()] == [(i, i + 1, 1.0) for i in range(1, 5)]
    with pytest.raises(ValueError):
        L.custom(spark, [(1, 9)], 3)
    with pytest.raises(ValueError):
        L.custom(spark, spark.createDataFrame([(1,)], "a int"), 3)


def test_edge_cases(spark):
    zero = [[0.0] * 5 for _ in range(5)]
    assert fits.fit_multilayer_jaccard(spark, [zero, zero], algorithm="louvain").meta.count() == 10
    assert fits.fit_multilayer_jaccard(spark, [[[0.0]], [[0.0]]], algorithm="louvain").meta.count() == 2
    with pytest.raises(ValueError, match="same node"):
        fits.fit_multilayer_overlap(spark, [eye(4, 1)[0], eye(6, 1)[0]])
    with pytest.raises(TypeError):
        Y.from_matrices(spark, (1, 2))
    with pytest.raises(ValueError):
        Y.from_matrices(spark, [[[0.0]]])
    for bad in ({"algorithm": "x"}, {"objective": "x"}, {"algorithm": "louvain", "objective": "cpm"}):
        with pytest.raises(ValueError):
            fits.fit_multilayer_jaccard(spark, [cliques(3), cliques(3)], **bad)


def test_directed_layers(spark):
    ring = [[0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [1, 0, 0, 0]]
    fit = fits.fit_multilayer_jaccard(spark, [ring, ring], algorithm="louvain", directed=True)
    assert {r.modularity for r in fit.modularity.collect()} == {None}
    loops = fit.ties.where("from_layer = to_layer").collect()
    assert {r.similarity for r in loops} == {1.0}


def test_labels_are_kept(spark):
    edges = spark.createDataFrame([(t, a, b, 1.0) for t in (1, 2) for a, b in (("bob", "alice"), ("carol", "dave"))], "layer int, src string, dst string, weight double")
    layers = Y.from_edges(edges)
    assert [(r.node, r.label) for r in layers.labels.orderBy("node").collect()] == [(1, "alice"), (2, "bob"), (3, "carol"), (4, "dave")]


def test_kernels_reach_best_or_nearly_best_partitions():
    def quality(label, edges, n):
        m = sum(w for *_, w in edges)
        k, inside, total = [0.0] * n, 0.0, {}
        for a, b, w in edges:
            k[a] += w
            k[b] += w
            inside += w * (label[a] == label[b])
        for v in range(n):
            total[label[v]] = total.get(label[v], 0) + k[v]
        return inside / m - sum(x * x for x in total.values()) / (4 * m * m)

    def partitions(n, label=(), top=0):
        if len(label) == n:
            yield label
            return
        for c in range(top + 1):
            yield from partitions(n, (*label, c), max(top, c + 1))

    rng, n, missed = random.Random(3), 6, 0
    for _ in range(30):
        edges = [(a, b, float(rng.randint(1, 3))) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5] or [(0, 1, 1.0)]
        best = max(quality(p, edges, n) for p in partitions(n))
        for algorithm in ("louvain", "leiden"):
            got = quality(detect(list(range(n)), edges, algorithm), edges, n)
            missed += got < best - 1e-9
            assert got > best - 0.08
    assert missed < 12


def test_assignment_is_optimal():
    rng = random.Random(4)
    for _ in range(100):
        r, c = rng.randint(1, 5), rng.randint(1, 5)
        score = [[rng.randint(0, 6) for _ in range(c)] for _ in range(r)]
        n = max(r, c)
        best = max(sum(score[i][p[i]] for i in range(r) if p[i] < c) for p in itertools.permutations(range(n)))
        assert sum(score[i][j] for i, j in best_matching(score)) == best
    assert greedy_matching([[1, 5], [6, 5]]) == [(0, 1), (1, 0)]


def test_metrics_of_equal_and_trivial_partitions(spark):
    same = spark.createDataFrame([(i, i % 3, (i % 3) + 5) for i in range(9)], "node int, a int, b int")
    assert M.nmi(same, []).first().nmi == pytest.approx(1)
    assert M.ari(same, []).first().ari == pytest.approx(1)
    assert M.comembership(same, []).first().accuracy == 1
    one = same.withColumn("a", F.lit(1)).withColumn("b", F.lit(1))
    assert M.nmi(one, []).first().nmi == 0 and M.nmi(one, [], 1.0).first().nmi == 1


def test_edge_model_against_all_pairs(spark):
    layers = Y.from_matrices(spark, [cliques(3, 2), cliques(5)])
    m = members(spark, [(t, i, 1 if i <= 3 else 2) for t in (1, 2) for i in range(1, 6)])
    got = {r.layer: (r.p_in, r.p_out) for r in B.edge_model(layers.nodes, layers.edges, m).collect()}
    assert got == {1: (1.0, 0.0), 2: (1.0, 1.0)}


def test_bootstrap(spark):
    boot = fits.bootstrap_multilayer(spark, [cliques(4, 4)] * 2, n_boot=4, seed=5)
    assert boot.n_completed == 4
    ci = fits.co_assignment_ci(boot).collect()
    assert ci and all(0 <= r.lower <= r.estimate <= r.upper <= 1 for r in ci)
    wide = {(r.layer, r.i, r.j): r.upper - r.lower for r in ci}
    for r in fits.co_assignment_ci(boot, 0.5).collect():
        assert r.upper - r.lower < wide[r.layer, r.i, r.j]
    assert all(0 <= r.stability <= 1 for r in boot.stability.collect())
    count, mean, report = fits.community_est(boot)
    assert report.first().report.startswith("Layer")
    with pytest.raises(ValueError):
        B.intervals(boot.coassign, 0)
    for kind in ("identity", "weighted_overlap"):
        assert fits.bootstrap_multilayer(spark, [cliques(3, 3)] * 2, kind, n_boot=2).n_completed == 2


def test_wilson_of_zero(spark):
    lo, hi = wilson(F.lit(0.0), F.lit(100.0))
    r = spark.range(1).select(lo.alias("a"), hi.alias("b")).first()
    assert r.a == 0 and r.b == pytest.approx(0.036993, abs=1e-6)
    assert B.never_together(100)[1] == pytest.approx(r.b)


def test_simulation(spark):
    truth = S.evolving_partition(spark, 30, 6, 6, 0.3, 2, skew=0.6)
    assert truth.count() == 180
    merged = S.switch_count(truth, 4, "merge").where("layer >= 4").agg(F.max("community")).first()[0]
    assert merged <= 3
    assert S.switch_count(truth.withColumn("community", F.least("community", F.lit(3))), 4, "split", 2).agg(F.max("community")).first()[0] <= 6
    s = S.seasonal(truth, 3)
    same = s.where("layer = 1").select("node", "community").exceptAll(s.where("layer = 4").select("node", "community"))
    assert s.count() == 180 and same.count() == 0
    assert S.regime_shift(truth, truth, 3).count() == 180
    assert 0 < S.turnover(spark, 30, 5, 0.3).count() <= 150
    p_in, p_out = S.densities(0.1, 5, 4)
    assert p_in / p_out == pytest.approx(5)
    for kind in ("none", "lognormal", "pareto"):
        f = S.node_factors(truth, kind)
        assert S.planted_edges(truth, 0.4, 0.1, 3, weights="aligned", factors=f).count() > 0
    assert S.random_design(spark, 5, 50, 400).where("n between 50 and 400").count() == 5


def test_study(spark):
    tasks = study.grid(spark, n=[1, 2], r=[0.5])
    assert tasks.count() == 2 and study.shuffled(tasks).count() == 2
    layers = Y.from_matrices(spark, [cliques(3, 3)] * 2)
    truth = members(spark, [(t, i, 1 if i <= 3 else 2) for t in (1, 2) for i in range(1, 7)])
    study.register_method("multislice", lambda y: study.multislice(spark, y, True))
    table = study.compare({k: (lambda f=f: f(layers)) for k, f in study.METHODS.items()}, truth)
    assert {r.method: round(r.nmi, 6) for r in study.ranked(table).collect()} == {"independent": 1, "aggregated": 1, "multislice": 1}
    del study.METHODS["multislice"]


def test_storage(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert storage.cached(spark, f"{tmp_path}/a", make).count() == storage.cached(spark, f"{tmp_path}/a", make).count() == 3
    assert len(calls) == 1
    storage.write_results(spark.range(2), f"{tmp_path}/b", "csv")
    assert storage.read_results(spark, f"{tmp_path}/b", "id bigint", "csv").count() == 2
    with pytest.raises(ValueError):
        Y.find_column(["a"], ["b"])


def test_plot_rows(spark):
    fit = fits.fit_multilayer_jaccard(spark, [cliques(3, 3)] * 2)
    assert fits.alluvial_rows(fit, 2).count() == 4 and fits.alluvial_rows(fit).count() == 12
    nodes, edges = fits.plot_rows(fit, 1)
    assert nodes.count() == 6 and edges.count() == 6
    assert fits.community_lists(fit).count() == 4


def test_stream_follows_communities(spark, tmp_path):
    from layerloom.streaming.tracker import StreamTracker, windowed_edges

    rows = [(f"2024-01-{1 + 7 * t:02d} 10:00:00", a, b, 1.0) for t in range(3) for block in ((1, 2, 3), (4, 5, 6)) for a, b in itertools.combinations(block, 2)]
    rows.append(("2024-02-20 00:00:00", 1, 2, 1.0))  # closes the windows before
    source = f"{tmp_path}/in"
    df = spark.createDataFrame(rows, "ts string, src int, dst int, weight double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    sink = StreamTracker(spark, f"{tmp_path}/out")
    q = windowed_edges(stream).writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 18
    assert got.groupBy("node").agg(F.count_distinct("meta_community").alias("k")).agg(F.max("k")).first()[0] == 1


def test_stream_survives_restarts_and_retries(spark, tmp_path):
    from datetime import datetime

    from layerloom.streaming.tracker import StreamTracker

    blocks = [[(1, 2, 3), (4, 5, 6)], [(1, 2, 3), (7, 8, 9)], [(4, 5, 6), (7, 8, 9)]]
    batch = lambda t: spark.createDataFrame(
        [(datetime(2024, 1, 1 + 7 * t), a, b, 1.0) for block in blocks[t] for a, b in itertools.combinations(block, 2)],
        "start timestamp, src int, dst int, weight double",
    )
    out = lambda: sorted((r.layer, r.node, r.meta_community) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    for t in (0, 1, 1, 2, 2):  # a new tracker each time, and two batches tried again
        StreamTracker(spark, f"{tmp_path}/out")(batch(t), t)
    labels = [(1, 1, 2), (2, 1, 3), (3, 4, 3)]  # layer, label of its first block, of its second
    assert out() == sorted((layer, n, m) for layer, *names in labels for m, block in zip(names, blocks[layer - 1], strict=True) for n in block)
    spark.createDataFrame([], "start timestamp, src int, dst int, weight double").transform(lambda df: StreamTracker(spark, f"{tmp_path}/out")(df, 3) or df)
    assert len(out()) == 18


def test_null_flows_are_no_edges(spark):
    rows = [(2000, 1, 2, None), (2000, 2, 3, 4.0), (2001, 1, 2, 0.0)]
    y = Y.panel_layers(spark.createDataFrame(rows, "year int, ccode1 int, ccode2 int, flow double"), "flow", 2000, 2001)
    assert [tuple(r) for r in y.edges.select("layer", "src", "dst", "weight").collect()] == [(1, 2, 3, 4.0)]
    assert y.nodes.count() == 6


def test_reuse_takes_labels_at_positive_overlap_only():
    from layerloom.operators.track import relabel_step

    overlap = {(0, 0): 5, (0, 1): 4, (1, 2): 3}
    assert relabel_step([0, 1, 2], {0: 1, 1: 2}, overlap, 3, "reuse")[0] == {0: 1, 2: 2, 1: 3}


def test_parallel_edges_add_up_and_the_last_panel_row_holds(spark):
    rows = [(1, "a", "b", 2.0), (1, "b", "a", 3.0), (2, "a", "b", 1.0)]
    edges = spark.createDataFrame(rows, "layer int, src string, dst string, weight double")
    found = lambda y: sorted((r.layer, r.src, r.dst, r.weight) for r in y.edges.collect())
    assert found(Y.from_edges(edges, same_nodes=False)) == [(1, "a", "b", 5.0), (2, "a", "b", 1.0)]
    assert found(Y.from_edges(edges, same_nodes=False, how="max")) == [(1, "a", "b", 3.0), (2, "a", "b", 1.0)]
    assert found(Y.from_edges(edges, same_nodes=False, directed=True))[:2] == [(1, "a", "b", 2.0), (1, "b", "a", 3.0)]
    panel = spark.createDataFrame([(1, 1, 2, 2000, 9.0), (2, 2, 1, 2000, 4.0), (3, 1, 3, 2001, 7.0), (4, 1, 3, 2001, None)], "k int, ccode1 int, ccode2 int, year int, flow double")
    assert found(Y.panel_layers(panel, "flow", 2000, 2001, order="k")) == [(1, 1, 2, 4.0)]
    assert found(Y.panel_layers(panel, "flow", 2000, 2001)) == [(1, 1, 2, 9.0), (2, 1, 3, 7.0)]
