import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from layerloom.llm import components, deep_shallow, ngram_join, substring_dedup, topk_search
from layerloom.llm.scratch import Scratch


def gram_sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_components(rows, width, percent):
    sets = [gram_sets(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index = {}
    for a, s in enumerate(sets):
        seen = Counter(b for g in s for b in index.get(g, ()))
        for g in s:
            index.setdefault(g, []).append(a)
        for b, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[b]) - n):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return {i: (len(sets[a]), least[find(a)]) for a, (i, _) in enumerate(rows) if i is not None}


def families(seed, words=300):
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(words)] + ["Ünder", "ABC"]
    rows, k = [], 0
    for _ in range(22):
        base = [rng.choice(v) for _ in range(rng.choice([2, 3, 5, 12, 40, 100, 250]))]
        for _ in range(rng.choice([2, 5, 50])):
            x = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                j, r = rng.randrange(len(x)), rng.random()
                if r < 0.4:
                    x[j] = rng.choice(v)
                elif r < 0.7:
                    x.insert(j, rng.choice(v))
                elif len(x) > 1:
                    del x[j]
            rows.append((k, " ".join(x)))
            k += 1
    return rows + [(k, None), (k + 1, ""), (k + 2, "a"), (k + 3, "A"), (k + 4, "a b"), (k + 5, "A\tb"), (k + 6, " \n"), (None, "a b"), (0, rows[0][1])]


@pytest.mark.parametrize(("width", "percent", "group"), [(3, 90, 256), (3, 90, 8), (5, 80, 12)])
def test_components_equal_brute_force(spark, width, percent, group):
    rows = families(width * percent + group)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, digest string").repartition(4)
    got = ngram_join.join_components(df, width, percent, group=group).collect()
    assert len(got) == len(rows)
    want = brute_components(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want


def test_components_of_nothing(spark):
    assert ngram_join.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = ngram_join.join_components(spark.createDataFrame([(7, "only one")], "doc_id long, text string"), 3, 90).collect()
    assert [tuple(r) for r in one] == [(7, 1, 7)]


def test_partners_lie_in_a_common_range():
    for percent in (80, 85, 90, 95):
        for n in range(1, 3000):
            for m in {n, n * 100 // percent, (n + n * 100 // percent) // 2}:
                assert ngram_join.levels(m, percent)[0] in ngram_join.levels(n, percent)


def test_linked_sets_share_a_signature():
    rng = random.Random(9)
    import numpy as np

    for percent in (80, 90):
        for _ in range(400):
            n = rng.choice([1, 5, 12, 30, 80, 300, 1000])
            x = {rng.getrandbits(64) for _ in range(n)}
            cut = rng.randint(0, n * (100 - percent) // 100)
            y = set(list(x)[cut:]) | {rng.getrandbits(64) for _ in range(rng.randint(0, n * (100 - percent) // 100 - cut) if cut < n * (100 - percent) // 100 else 0)}
            if y and 100 * len(x & y) >= percent * len(x | y):
                a, b = (set(ngram_join.signatures(np.unique(np.array(list(s), np.uint64)), percent).tolist()) for s in (x, y))
                assert a & b
                a, b = (set(ngram_join.signatures(np.unique(np.array(list(s), np.uint64)), percent, 1e-12).tolist()) for s in (x, y))
                assert a & b


def test_divide_skip_finds_all_that_reach_the_overlap():
    rng = random.Random(10)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randint(1, 30))) for _ in range(rng.randint(1, 12))]
        need = rng.randint(1, len(lists))
        counts = Counter(x for items in lists for x in items)
        assert dict(ngram_join.divide_skip(lists, need)) == {x: n for x, n in counts.items() if n >= need}


def test_stars_reach_the_smallest(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 201), (201, 200)]
    got = components.smallest_in_component(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"))
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert {r.vertex: r.root for r in got.collect()} == want


def test_deep_shallow_sorts(monkeypatch):
    rng = random.Random(2)
    for shallow in (8, 64):
        monkeypatch.setattr(deep_shallow, "SHALLOW", shallow)
        for _ in range(400):
            base = [bytes(rng.choice(b"ab") for _ in range(rng.choice([3, 20, 150]))) for _ in range(2)]
            strings = []
            for _ in range(rng.randint(1, 14)):
                s = bytearray(rng.choice(base))
                s[rng.randrange(len(s))] = rng.choice(b"abc\0")
                strings.append(bytes(s[: rng.choice([len(s), rng.randint(0, len(s))])]))
            order, shared = deep_shallow.deep_shallow(strings)
            assert [strings[i] for i in order] == sorted(strings)
            assert shared[1:] == [deep_shallow.common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]


def brute_repeats(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cover[p : p + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if cover[j] and (j == 0 or not cover[j - 1]))
        out[i] = (len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    v = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    many = lambda n: " ".join(rng.choice(v) for _ in range(n))
    parts = [many(n) for n in (30, 80, 200, 120)]
    rows = []
    for k in range(160):
        t = many(rng.randint(0, 120))
        for _ in range(rng.choice([0, 1, 2])):
            p = rng.choice(parts)
            t += rng.choice(["", "x "]) + p[rng.randint(0, len(p) // 2) :] + " " + many(rng.randint(0, 50))
        rows.append((k, t))
    return rows + [(500, None), (501, ""), (502, "a" * 3000), (503, "ab" * 900), (504, "a" * 401), (505, "xyz" * 200 + "q" + "xyz" * 200), (506, "é" * 500), (507, parts[0] * 4), (None, "alone " + parts[2])]


@pytest.mark.parametrize(("length", "crowd", "chunk"), [(400, 256, 1 << 20), (400, 8, 3000), (100, 4, 1 << 20), (64, 1, 1000)])
def test_repeats_equal_brute_force(spark, monkeypatch, length, crowd, chunk):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    rows = passages(length + crowd)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, th string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.remove_repeats(df, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == brute_repeats(rows, length)


def test_tasks_that_send_one_class_do_not_part_its_group(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWD", 8)
    monkeypatch.setattr(substring_dedup, "_parted_groups", lambda *_: pytest.fail("one class is not a large group"))
    line = " ".join(f"licence{i}" for i in range(60))
    rows = [(i, line) for i in range(40)] + [(99, line + " and more"), (100, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24, "doc_id")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {**{i: (len(line), 1) for i in range(40)}, 99: (len(line), 1), 100: (0, 0)}


@pytest.mark.parametrize("crowd", [3, 40])
def test_large_groups_are_parted_and_sorted(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot, tails, heads = word(380), [word(260) for _ in range(9)], [word(260) for _ in range(9)]
    rows = [(i, word(rng.randrange(90)) + rng.choice(heads)[rng.randrange(200) :] + hot + rng.choice(tails)[: rng.randrange(260)] + word(60)) for i in range(160)]
    made = []
    whole = substring_dedup._sorted_groups
    monkeypatch.setattr(substring_dedup, "_sorted_groups", lambda *args: made.append(1) or whole(*args))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.remove_repeats(df, 400).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == brute_repeats(rows, 400)
    assert len(made) > 2  # parts of the large group were sorted


def test_repeated_rows_and_no_rows(spark):
    text = " ".join(f"n{i}" for i in range(200))
    df = spark.createDataFrame([(1, text), (1, text), (2, "short")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in substring_dedup.remove_repeats(df).collect()) == [(1, len(text), 1), (1, len(text), 1), (2, 0, 0)]
    assert substring_dedup.remove_repeats(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(df, 10)


def test_search_equals_brute_force(spark, monkeypatch):
    import math

    import numpy as np

    monkeypatch.setattr(topk_search, "BLOCK", 64)
    monkeypatch.setattr(topk_search, "PASS", 8)
    rng = random.Random(11)
    hot = [rng.gauss(0, 0.2) for _ in range(6)]
    rows = [(i, [rng.gauss(0, 0.2) * (1 + i % 3) for _ in range(6)] if rng.random() < 0.7 else hot) for i in range(600)]
    rows += [(600, None), (650, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] * 6), (750, [float("inf")] + [0.0] * 5), (800, [0.5, 0.5]), (850, []), (0, rows[0][1]), (None, hot)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, norm2 string").repartition(5)
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for a, (i, x) in enumerate(sound):
        if i % 50 == 0:
            scored = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), j) for b, (j, y) in enumerate(sound) if b != a)
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(scored[:5]))
    assert Counter(tuple(r) for r in topk_search.search(df).collect()) == want
    assert topk_search.search(df.where("false")).count() == 0
    assert topk_search.search(df.where("vec_id = 50")).count() == 0


def test_echoes_are_passages_of_words_in_other_documents(spark):
    rng = random.Random(12)
    word = lambda n=4: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    words = lambda n: [word() for _ in range(n)]
    passage, short, line = words(51), words(31), words(60)
    rows, wanted = [], {}
    for i in range(40):  # 51 words of 254 bytes, at any place, with other spaces between
        rows.append((i, " ".join(words(i)) + "\n" + rng.choice([" ", "  ", "\n"]).join(passage) + " " + " ".join(words(40 - i))))
        wanted[i] = True
    rows += [(100 + i, " ".join(words(30) + short + words(30))) for i in range(5)]
    rows += [(200, " ".join(line + words(5) + line)), (201, " ".join(words(300))), (202, None), (203, ""), (204, " ".join(line[:50]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_echoes, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()}
    assert {d for d, (n, _) in got.items() if n} == set(wanted) and len(got) == len(rows)


def test_long_texts_have_the_echoes_of_their_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    text = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for n in (700, 30, 51, 2000, 52)])
    data, starts = substring_dedup.utf8(text)
    whole = {d: set(h.tolist()) for d, h in substring_dedup.echo_anchors(data, starts)}
    assert set(whole) == {0, 2, 3, 4}
    monkeypatch.setattr(substring_dedup, "ECHO_CHUNK", 60)
    monkeypatch.setattr(substring_dedup, "CHUNK", 1000)
    assert {d: set(h.tolist()) for d, h in substring_dedup.echo_anchors(data, starts)} == whole
