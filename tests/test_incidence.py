"""Graphs that join all nodes of a group: edges by blocks and counts by classes against all pairs."""

import random
from itertools import combinations

import pytest

from layerloom.operators import bootstrap as B
from layerloom.operators import graph as G
from layerloom.operators import incidence as I


def table(spark, groups, chance):
    rng = random.Random(groups)
    rows = [(layer, f"g{g}", node) for layer in (1, 2) for node in range(30) for g in range(groups) if rng.random() < chance]
    rows += [rows[0], rows[1], (1, None, 3), (1, "g0", None), (3, "alone", 5)]
    members = [(layer, node, node % 3) for layer in (1, 2) for node in range(28)]
    sets = {}
    for layer, g, node in rows:
        if g is not None and node is not None:
            sets.setdefault((layer, node), set()).add(g)
    want = {(la, u, v): float(len(x & y)) for ((la, u), x), ((lb, v), y) in combinations(sorted(sets.items()), 2) if la == lb and x & y}
    return spark.createDataFrame(rows, "layer int, g string, node long"), spark.createDataFrame(members, "layer int, node long, community int"), want


#: Many groups to a node, two words; few groups to a node; blocks of a few rows; no words at all.
CASES = [(70, 0.4, 4096, 32), (40, 0.03, 4096, 32), (70, 0.4, 7, 32), (70, 0.4, 4096, 0)]


@pytest.mark.parametrize("groups, chance, block, words", CASES)
def test_edges_equal_all_pairs(spark, monkeypatch, groups, chance, block, words):
    monkeypatch.setattr(I, "BLOCK", block)
    monkeypatch.setattr(I, "MOST_WORDS", words)
    incidence, _, want = table(spark, groups, chance)
    got = I.incidence_edges(incidence, ["g"]).collect()
    assert {(r.layer, r.src, r.dst): r.weight for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("groups, chance, block, words", CASES)
def test_counts_equal_listed_edges(spark, monkeypatch, groups, chance, block, words):
    monkeypatch.setattr(I, "BLOCK", block)
    monkeypatch.setattr(I, "MOST_WORDS", words)
    incidence, members, want = table(spark, groups, chance)
    edges = spark.createDataFrame([(*k, w) for k, w in want.items()], "layer int, src long, dst long, weight double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(B.incidence_edge_model(members, incidence, ["g"])) == rows(B.edge_model(members, edges, members))
    assert rows(G.incidence_density(members, incidence, ["g"])) == rows(G.density(members, edges))


def test_no_pair_is_shuffled(spark):
    """120 nodes that share 40 groups: what the exchanges carry stays far below the 7,140 pairs."""
    incidence = spark.sql("select 1 as layer, g.id as g, n.id as node from range(40) g, range(120) n")
    edges = I.incidence_edges(incidence, ["g"])
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert edges.count() == 7140 and "Aggregate" not in plan
    counts = I.linked_counts(spark.sql("select 1 as layer, id as node, 0 as community from range(120)"), incidence, ["g"])
    assert [tuple(r) for r in counts.collect()] == [(1, 7140, 7140)]


@pytest.mark.parametrize("run, wide, batch", [(1024, 32, 64), (16, 3, 5)])
def test_edges_come_in_runs(spark, monkeypatch, run, wide, batch):
    """Rows of one src stand together, and those of users with the same groups beside one another, so that written columns pack."""
    for name, value in (("RUN", run), ("WIDE", wide), ("BATCH", batch)):
        monkeypatch.setattr(I, name, value)
    incidence = spark.sql("select 1 as layer, g.id as g, n.id as node from range(40) g, range(120) n where g.id < 20 or n.id % 2 = 0")
    rows = [(r.src, r.dst, r.weight) for r in I.incidence_edges(incidence, ["g"]).collect()]
    assert sorted(rows) == [(a, b, 20.0 if (a | b) % 2 else 40.0) for a in range(120) for b in range(a + 1, 120)]
    blocks = -(-120 // run)
    changes = lambda i: sum(x[i] != y[i] for x, y in zip(rows, rows[1:], strict=False))
    assert changes(0) < 120 * blocks and changes(2) < 2 * 120 * blocks


def test_supra_edges_sum_ties_only(spark):
    edges = spark.createDataFrame([(1, 1, 2, 3.0), (2, 1, 2, 4.0)], "layer int, src long, dst long, weight double")
    ties = spark.createDataFrame([(1, 2, 1, 1.0), (2, 1, 1, 0.5)], "from_layer int, to_layer int, node long, layer_weight double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    once = G.supra_edges(edges, ties, 0.5, once=True)
    assert rows(once) == rows(G.supra_edges(edges, ties, 0.5)) == [(1, 1, 1, 2, 3.0), (1, 1, 2, 1, 0.75), (2, 1, 2, 2, 4.0)]
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_supra_edges_keep_the_runs(spark):
    incidence = spark.sql("select 1 as layer, g.id as g, n.id as node from range(40) g, range(120) n where g.id < 20 or n.id % 2 = 0")
    ties = spark.createDataFrame([(1, 2, 1, 1.0)], "from_layer int, to_layer int, node long, layer_weight double")
    rows = G.supra_edges(I.incidence_edges(incidence, ["g"]), ties, 0.5, once=True).collect()
    assert len(rows) == 7141 and sum((x.node_a, x.weight) != (y.node_a, y.weight) for x, y in zip(rows, rows[1:], strict=False)) < 3 * 120


@pytest.mark.parametrize("directed", [False, True])
def test_redraw_of_runs_equals_pools_and_sorts_no_pool(spark, monkeypatch, directed):
    rng = random.Random(3)
    pairs = [(layer, a, b) for layer in (1, 2) for a in range(14) for b in range(14) if (a != b if directed else a < b)]
    rows = [(layer, a, b, float(rng.choice([1, 1, 2, 5]))) for layer, a, b in pairs if rng.random() < 0.5 and not (layer == 2 and a % 3 == b % 3)]
    edges = spark.createDataFrame(rows, "layer int, src long, dst long, weight double")
    members = spark.createDataFrame([(layer, n, n % 3) for layer in (1, 2) for n in range(14)], "layer int, node long, community int")
    draw = lambda: B.redraw(spark, members, edges, members, 3, 7, directed)
    got = draw()
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    by_runs = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(B, "MOST_RUNS", 0)
    assert by_runs == sorted(map(tuple, draw().collect())) and by_runs


@pytest.mark.parametrize("groups, chance, block, words", CASES)
def test_redraw_of_groups_lists_no_edge(spark, monkeypatch, groups, chance, block, words):
    monkeypatch.setattr(I, "BLOCK", block)
    monkeypatch.setattr(I, "MOST_WORDS", words)
    monkeypatch.setattr(B, "REDRAW_BLOCK", block)
    incidence, members, want = table(spark, groups, chance)
    edges = spark.createDataFrame([(*k, w) for k, w in want.items()], "layer int, src long, dst long, weight double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    with monkeypatch.context() as m:
        m.setattr(B, "incidence_edges", None)
        got = rows(B.incidence_redraw(spark, members, incidence, ["g"], 3, 7))
    assert got == rows(B.redraw(spark, members, edges, members, 3, 7)) and got
    monkeypatch.setattr(B, "MOST_RUNS", 0)
    assert got == rows(B.incidence_redraw(spark, members, incidence, ["g"], 3, 7))
