"""Model choice, studies in stages and streams with state."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from layerloom.operators import model_choice
from layerloom.plans import empirical
from layerloom.sources.layers import LayerSet
from layerloom.streaming import counts

EDGES = "layer int, src int, dst int, weight double"


def plain_icl(blocks, edges):
    n, names = len(blocks), sorted(set(blocks.values()))
    size = Counter(blocks.values())
    met = Counter(tuple(sorted((blocks[a], blocks[b]))) for a, b in edges)
    total = sum(s * math.log(s / n) for s in size.values())
    for i, q in enumerate(names):
        for r in names[i:]:
            pairs = size[q] * (size[q] - 1) / 2 if q == r else size[q] * size[r]
            m = met[q, r]
            total += (m * math.log(m / pairs) if m else 0) + ((pairs - m) * math.log((pairs - m) / pairs) if pairs > m else 0)
    k = len(names)
    return total - k * (k + 1) / 4 * math.log(n * (n - 1) / 2) - (k - 1) / 2 * math.log(n)


def test_icl_equals_its_definition_and_finds_the_blocks(spark):
    rng = random.Random(3)
    truth = {v: v % 3 for v in range(45)}
    edges = [(a, b) for a in range(45) for b in range(a + 1, 45) if rng.random() < (0.6 if truth[a] == truth[b] else 0.03)]
    models = {"one": {v: 0 for v in truth}, "two": {v: v % 2 for v in truth}, "three": truth, "each": {v: v for v in truth}}
    rows = [(name, 1, v, c) for name, m in models.items() for v, c in m.items()]
    candidates = spark.createDataFrame(rows, "model string, layer int, node int, community int")
    e = spark.createDataFrame([(1, a, b, 2.0) for a, b in edges] + [(1, 5, 5, 1.0), (1, 0, 3, 0.0)], EDGES)
    got = {r.model: (r.k, r.icl) for r in model_choice.icl(candidates, e).collect()}
    assert set(got) == set(models)
    for name, m in models.items():
        assert got[name][0] == len(set(m.values()))
        assert got[name][1] == pytest.approx(plain_icl(m, edges), abs=1e-6)
    assert {(r.node, r.community) for r in model_choice.chosen_partition(candidates, e).collect()} == set(truth.items())


def test_icl_without_edges(spark):
    candidates = spark.createDataFrame([("a", 1, 1, 1), ("a", 1, 2, 1), ("a", 2, 1, 1)], "model string, layer int, node int, community int")
    got = {r.layer: r.icl for r in model_choice.icl(candidates, spark.createDataFrame([], EDGES)).collect()}
    assert got == {1: pytest.approx(0.0), 2: pytest.approx(0.0)}


def test_a_study_that_was_cut_off_goes_on(spark, tmp_path):
    nodes = spark.createDataFrame([(t, v) for t in (1, 2) for v in range(6)], "layer int, node int")
    edges = spark.createDataFrame([(t, a, b, 1.0) for t in (1, 2) for a, b in ((0, 1), (1, 2), (3, 4), (4, 5))], EDGES)
    calls, broken = Counter(), {"late": True}

    def method(name, rule):
        def run(spark, layers):
            calls[name] += 1
            if broken.get(name):
                raise RuntimeError("cut off")
            return layers.nodes.selectExpr("layer", "node", f"cast({rule} AS int) AS meta_community")

        return run

    methods = {"early": method("early", "node div 3"), "late": method("late", "node % 2")}
    folder = f"file://{tmp_path}/study"
    with pytest.raises(RuntimeError):
        empirical.study(spark, {"net": LayerSet(nodes, edges, 2)}, folder, methods)
    broken.clear()
    for _ in range(2):
        out = empirical.study(spark, {"net": LayerSet(nodes, edges, 2)}, folder, methods)
    assert calls == {"early": 1, "late": 2}
    assert set(out) == set(empirical.STAGES)
    assert {(r.method, r.layer): round(r.modularity, 9) for r in out["quality"].collect()} == {("early", t): 0.5 for t in (1, 2)} | {("late", t): -0.5 for t in (1, 2)}
    assert [round(r.nmi, 9) for r in out["persistence"].collect()] == [1.0, 1.0]
    assert out["agreement"].count() == 2 and out["sizes"].count() == 4


def events(spark, days, seed):
    rng = random.Random(seed)
    rows = [(datetime(2024, 1, d, rng.randrange(24), rng.randrange(60)) + timedelta(0), rng.randrange(6), rng.choice("abc")) for d in days for _ in range(25)]
    return rows, spark.createDataFrame(rows, "ts timestamp, user_id bigint, event_type string")


def weekly(rows):
    seen = defaultdict(Counter)
    for ts, user, kind in rows:
        seen[(ts.day - 1) // 7 + 1, user][kind] += 1
    return {(*k, min(c, key=lambda x: (-c[x], x)), max(c.values())) for k, c in seen.items()}


def test_a_stream_gives_what_a_batch_gives_and_goes_on_after_a_stop(spark, tmp_path):
    landing, folder = f"file://{tmp_path}/landing", f"file://{tmp_path}/counts"
    first, df = events(spark, range(1, 16), 1)
    counts.land(df, landing)
    counts.follow(spark, landing, folder, files=2)
    assert {tuple(r) for r in counts.weekly_membership(spark, folder).collect()} == weekly(first)
    second, df = events(spark, range(13, 29), 2)  # some days come in two parts
    counts.land(df, landing)
    counts.follow(spark, landing, folder, files=2)
    both = weekly(first + second)
    assert {tuple(r) for r in counts.weekly_membership(spark, folder).collect()} == both
    counts.follow(spark, landing, folder)  # nothing new
    last = max(p.name for p in (tmp_path / "counts" / "updates").iterdir())
    again = spark.read.parquet(f"{folder}/updates/{last}").collect()
    spark.createDataFrame(again, "day timestamp, user_id bigint, event_type string, n bigint").write.mode("overwrite").parquet(f"{folder}/updates/{last}")
    assert {tuple(r) for r in counts.weekly_membership(spark, folder).collect()} == both
