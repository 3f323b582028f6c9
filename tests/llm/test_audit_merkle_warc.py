"""The filter audit, the Merkle manifest and the archives against plain Python versions."""

import gzip
import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from layerloom.llm import filter_audit, merkle, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, block int"
LONG = "Word " * 40_000
WORDS = " ".join(f"w{i}" for i in range(60))


def docs(spark, rows):
    """Rows (doc_id, text, lang, source, n_chars), with columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(*r, "x", 3) for r in rows], DOCS)


# Filter audit.


def failures(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, _, source, _ in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        out.append((source or "", i, {f for f, x in fails.items() if x}))
    return out


def audited(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = failures(rows)
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(f in r[2] for r in mine) - len(gone), sum(r[2] == {f} for r in mine),
                    sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone),
                )
        for (p, order, step), row in list(out.items()):
            if p == part:
                out[p, order, step] = (*row, shapley[order[step - 1]])
    return out


ROWS = [
    (1, WORDS, "en", "a", 10), (2, WORDS, "en", "a", 10), (2, WORDS, "en", "a", 10), (3, None, None, None, None), (4, "", "en", "", 0),
    (5, LONG, "en", "a", 7), (6, WORDS + " #", "de", "b", 1), (None, WORDS, "en", "b", 1), (None, None, None, None, None),
    (7, WORDS.upper(), "fr", "b", 3), (8, "one two\x0bthree four $", "fr", "ü", 3), (9, LONG, "en", "a", 7), (-3, "w", "en", "ü", 1), (12, "w", "en", "ü", 1),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, 0, 1), (6, 1, 1), (8, None, 1), (None, 1, 1)]


def test_audit_equals_a_plain_replay(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_documents(docs(spark, ROWS), labels).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got}
    assert len(found) == len(got)
    assert found == audited(ROWS, LABELS)
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in got)


def test_audit_of_nothing_and_of_other_filters(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(docs(spark, []), labels).isEmpty()
    rows = spark.range(30).select(F.lit(None).cast("string").alias("kind"), "id")
    got = filter_audit.audit(rows, {"x": F.col("id") % 2 == 0, "y": F.col("id") % 3 == 0}, "kind", {}).collect()
    assert {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in got} == {
        ("xy", 1): (15, 15, 0, 25), ("xy", 2): (10, 5, 5, 15), ("yx", 1): (20, 10, 0, 15), ("yx", 2): (10, 10, 5, 25)
    }
    with pytest.raises(ValueError):
        filter_audit.audit(rows, {}, "kind", {})


# Merkle manifest.


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for every node its siblings as (left, right) level by level."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for w, k in zip(ways, at, strict=True):
            run = runs[k // 16]
            w.append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        at = [k // 16 for k in at]
        nodes = [H("".join(r)) for r in runs]
    return nodes[0], ways


def manifest(rows):
    if not rows:
        return Counter()
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in sources:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1]), r) for r in rows if r[3] == s), key=lambda x: x[:3])
        subs[s] = (*tree([x[2] for x in mine]), mine)
    root, outer = tree([subs[s][0] for s in sources])
    out = []
    for s, above in zip(sources, outer, strict=True):
        sub, ways, mine = subs[s]
        for (_, _, own, r), way in zip(mine, ways, strict=True):
            h = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                h = leaf(r[0], r[3], r[2], r[4], re.sub("[A-Z]", lambda m: m.group().lower(), r[1]))
            for left, right in way + above:
                h = H(left + h + right)
            out.append((r[0], own, sub, root, H("".join(a + b for a, b in way + above)), h, h == root))
    return Counter(out)


def check_manifest(spark, rows):
    got = merkle.manifest(docs(spark, rows)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(map(tuple, got)) == manifest(rows)


def test_manifest_equals_plain_trees(spark):
    many = [(i * 7919 % 10007 - 50, f"Text {i}", "en", "hot", i) for i in range(4500)]
    small = [(i, f"T{i}", None, f"s{i % 37}", None) for i in range(300)]
    check_manifest(spark, ROWS + many + small)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_manifest_at_the_edges_of_runs(spark, n):
    check_manifest(spark, [(i, "Abc", "en", None, 3) for i in range(n)])


def test_manifest_with_a_block_and_one_leaf(spark):
    check_manifest(spark, [(i, "A", "en", "s", 1) for i in range(4097)])


# Archives.

PAGES = "page_id long, url string, html string, payload string, key int"
PAGE = "é<p>" * 400
PAGE_ROWS = [
    (1, "http://a/", PAGE), (5, "http://b/", PAGE), (3, None, PAGE), (None, "http://c/", PAGE), (7, "http://d/\r\nX: y", "x" * 999),
    (8, "http://d/", "x" * 999), (9, "http://e/", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "y\n" * 600), (10, "u", ""), (11, "u", None),
    (12, "http://f/", "z" * 1000), (12, "http://f/", "z" * 1000), (13, "http://g/", "ß" * 500_000), (14, "h", "\r\n\r\n" * 300), (2, "http://h/", "\x00 " * 400),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


def resolved(rows):
    payload = lambda r: (r[2] or "").encode()
    out = Counter()
    for p in {payload(r) for r in rows}:
        mine = sorted((r for r in rows if payload(r) == p), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
        for k, r in enumerate(mine):
            revisit = len(p) >= 1000 and k > 0
            out[r[0], len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", mine[0][0] if revisit else None] += 1
    return out


def records(folder):
    """A plain reader that trusts declared lengths only."""
    out = []
    for name in Path(folder).glob("*.gz"):
        data, at = gzip.decompress(name.read_bytes()), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            version, *lines = data[at:end].decode().split("\r\n")
            assert version == "WARC/1.1"
            head = dict(x.split(": ", 1) for x in lines)
            n = int(head["Content-Length"])
            block = data[end + 4 : end + 4 + n]
            assert data[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
            at = end + 8 + n
            out.append((head, block))
    return out


def test_archives_read_back_with_revisits_resolved(spark, tmp_path):
    path = f"{tmp_path}/warc"
    archives = warc.write_archives(pages(spark, PAGE_ROWS), f"file://{path}")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, warc.read_pages(spark, archives).select(names).collect())) == resolved(PAGE_ROWS)
    assert warc.open_archives(spark, f"file://{path}") == archives


def test_archives_are_plain_warc(spark, tmp_path):
    path = f"{tmp_path}/warc"
    warc.write_archives(pages(spark, PAGE_ROWS), f"file://{path}")
    found = records(path)
    kinds = Counter(h["WARC-Type"] for h, _ in found)
    want = Counter(r[3] for r in resolved(PAGE_ROWS).elements())
    assert kinds == want + Counter(warcinfo=1)
    assert len({h["WARC-Record-ID"] for h, _ in found}) == len(found)
    responses = {h["WARC-Record-ID"]: h for h, _ in found if h["WARC-Type"] == "response"}
    for head, block in found:
        if head["WARC-Type"] == "response":
            assert head["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(block.split(b"\r\n\r\n", 1)[1]).hexdigest()
        if head["WARC-Type"] == "revisit":
            assert responses[head["WARC-Refers-To"]]["WARC-Payload-Digest"] == head["WARC-Payload-Digest"]
            assert head["WARC-Profile"] == warc.PROFILE


def test_archives_of_no_pages_and_broken_references(spark, tmp_path):
    none = warc.write_archives(pages(spark, []), f"file://{tmp_path}/none")
    assert warc.read_pages(spark, none).isEmpty()
    with pytest.raises(ValueError):
        warc.open_archives(spark, str(Path("/root/testdata/sf0.001/nation.parquet")))
