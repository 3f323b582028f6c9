"""Matching of many communities, against the kernel and the fold over all layers."""

import random
from collections import defaultdict

import pytest

from layerloom.operators import track, track_large
from layerloom.operators.kernels.assignment import best_matching

OVERLAPS = "layer int, a int, b int, n long"


def totals(rows):
    out = defaultdict(int)
    for layer, _, _, n in rows:
        out[layer] += n
    return dict(out)


def test_matching_has_the_total_of_the_kernel(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for layer in range(1, 25):
        x, y = rng.randrange(1, 9), rng.randrange(1, 9)
        cells = {(a, b): rng.choice([0, 1, 1, 2, 3, 30]) for a in range(x) for b in range(y) if rng.random() < 0.7}
        rows += [(layer, a, b, n) for (a, b), n in cells.items()]
        score = [[float(cells.get((a, b), 0)) for b in range(y)] for a in range(x)]
        if total := sum(score[i][j] for i, j in best_matching(score)):
            want[layer] = total
    got = [tuple(r) for r in track_large.heaviest_matching(spark.createDataFrame(rows, OVERLAPS).repartition(5)).collect()]
    assert totals(got) == want
    assert len({r[:2] for r in got}) == len({(r[0], r[2]) for r in got}) == len(got)
    assert set(got) <= set(rows)


def test_safe_pairs_leave_nothing_to_a_task(spark):
    # Each community keeps most of its members, a few go next door.
    rows = [(1, c, c, 10) for c in range(300)] + [(1, c, c + 1, 4) for c in range(299)]
    got = track_large.heaviest_matching(spark.createDataFrame(rows, OVERLAPS), most_left=0).collect()
    assert sorted((r.a, r.b) for r in got) == [(c, c) for c in range(300)]


def test_undecided_rest_beyond_a_task_and_no_rows(spark):
    even = spark.createDataFrame([(1, a, b, 5) for a in range(4) for b in range(4)], OVERLAPS)
    with pytest.raises(ValueError, match="safe"):
        track_large.heaviest_matching(even, most_left=3)
    assert totals(map(tuple, track_large.heaviest_matching(even).collect())) == {1: 20}
    assert track_large.heaviest_matching(even.where("false")).isEmpty()


def test_labels_equal_the_fold_over_all_layers(spark):
    rng = random.Random(9)
    home = {v: v % 40 for v in range(2000)}
    rows = []
    for layer in [1, 2, 3, 4, 6, 7]:  # a layer is missing: labels end there
        for v in home:
            if rng.random() < 0.1:
                home[v] = rng.randrange(45 + layer)
        # Numbers of a layer say nothing about the one before; sizes differ, so no two matchings are equally good.
        shift = rng.randrange(50)
        rows += [(layer, v, (c * 7 + shift) % 61) for v, c in home.items() if rng.random() < 0.95]
    m = spark.createDataFrame(rows, "layer int, node int, community int").repartition(6)
    want = sorted(tuple(r) for r in track.track(m).collect())
    assert sorted(tuple(r) for r in track_large.track_large(m).collect()) == want
    assert track_large.track_large(m.where("false")).isEmpty()
