"""Coverage of bootstrap intervals, against a plain count over all pairs."""

import random
from itertools import combinations
from statistics import NormalDist, mean, stdev

import pytest

from layerloom.plans import coverage
from layerloom.sources.layers import from_edges

PAIRS = "layer int, i int, j int, p double"


def interval(p, n):
    z = NormalDist().inv_cdf(0.975)
    mid, half = p + z * z / (2 * n), z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5
    return max(0.0, (mid - half) / (1 + z * z / n)), min(1.0, (mid + half) / (1 + z * z / n))


def test_coverage_equals_a_count_over_all_pairs(spark):
    rng = random.Random(2)
    draw = lambda: {(1, i, j): rng.randrange(1, 21) / 20 for i, j in combinations(range(9), 2) if rng.random() < 0.5}
    truth, runs = draw(), [draw() for _ in range(4)]
    shares, widths = [], []
    for run in runs:
        hits, width = [], []
        for i, j in combinations(range(9), 2):
            lo, hi = interval(run.get((1, i, j), 0.0), 20)
            hits.append(lo - 1e-9 <= truth.get((1, i, j), 0.0) <= hi + 1e-9)
            width.append(hi - lo)
        shares.append(mean(hits))
        widths.append(mean(width))
    estimates = spark.createDataFrame([(r, *k, p) for r, run in enumerate(runs) for k, p in run.items()], f"run int, {PAIRS}")
    known = spark.createDataFrame([(*k, p) for k, p in truth.items()], PAIRS)
    sizes = spark.createDataFrame([(r, layer, 9 if layer == 1 else n) for r in range(4) for layer, n in [(1, 9), (2, 5), (3, 1)]], "run int, layer int, n long")
    got = {r.layer: r for r in coverage.coverage(estimates, known, sizes, 20).collect()}
    assert set(got) == {1, 2}
    assert got[1].coverage == pytest.approx(mean(shares))
    assert got[1].se == pytest.approx(stdev(shares) / 2)
    assert got[1].width == pytest.approx(mean(widths))
    assert (got[1].pairs, got[1].runs) == (36, 4)
    # Nobody was ever together in layer 2, neither in truth nor in a replicate.
    assert (got[2].coverage, got[2].se, got[2].pairs) == (1.0, 0.0, 10)


def test_plain_blocks_are_covered_and_reruns_agree(spark):
    edges = [(layer, a, b, 1.0) for layer in (1, 2) for a, b in combinations(range(16), 2) if a // 8 == b // 8 or (a + b) % 23 == layer]
    layers = from_edges(spark.createDataFrame(edges, "layer int, src int, dst int, weight double"))
    run = lambda: sorted(tuple(r) for r in coverage.coverage_study(spark, layers, n_outer=2, n_inner=10, n_fresh=10).collect())
    first = run()
    assert [(r[0], r[4], r[5]) for r in first] == [(1, 120, 2), (2, 120, 2)]
    assert all(r[1] > 0.9 for r in first)
    assert run() == first
    with pytest.raises(ValueError):
        coverage.coverage_study(spark, layers, n_outer=0)
