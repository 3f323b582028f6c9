import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from layerloom.llm import chat_format, language_id, pii, sentencepiece_bpe, url_filter
from layerloom.llm.queries import TOKENIZERS, URL_RULES

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
SYLLABLES = {"en": "the and of ing th er", "de": "der und sch ein ung tz", "fr": "que eau les oi è ai"}


def text_in(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, text_in(rng, lang, rng.randint(5, 60)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=400))]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 !? 3", "de"), (1003, "É", None), (None, text_in(rng, "de", 40), "de"), (1004, text_in(rng, "fr", 60000), "fr")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in language_id.identify(df.repartition(3)).collect()}
    assert len(got) == len(rows)
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    held = [r for r in got.values() if r.held_out]
    assert held and all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.lang_pred == r.lang for r in held if r.lang_pred != "und") >= 0.95 * len([r for r in held if r.lang_pred != "und"])
    assert got[1004].lang_pred == "fr" and got[None].held_out is False
    flipped = df.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert {r.doc_id: r.lang_pred for r in language_id.identify(flipped).collect()} == {i: r.lang_pred for i, r in got.items()}
    assert language_id.identify(df.where("false")).count() == 0


def test_language_codes_do_not_depend_on_chunks(monkeypatch):
    p = language_id.Profiler()
    text = "Abc dé 12  ñandú. " * 50
    whole = p.codes(text).tolist()
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert p.codes(text).tolist() == whole


def test_encoding_is_the_library_s():
    table = sentencepiece_bpe.PrefixTable(MODEL)
    rng = random.Random(2)
    bits = ["a", "b", " ", "  ", "\n", "th", "é", "ñ", "▁", "😀", "\0", "\t", "the", "中", "1", "  \n ", "<s>", "</s>", "<0x0A>", "==", "--", "...", ", ", "and", "ing"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["", " ", " " * 300, "x" * 3000, "▁" * 17, "\n", "a\n\nb", " lead", "trail ", "word. " * 2000]
    for t in texts:
        assert table.encode(t) == table.library.encode(t), repr(t)
        assert ",".join(p[1] for p in table.parts(t)) == ",".join(map(str, table.encode(t)))


def test_stores_may_run_over(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "WORDS", 3)
    monkeypatch.setattr(sentencepiece_bpe, "PAIRS", 5)
    table = sentencepiece_bpe.PrefixTable(MODEL)
    for t in ("one two three four five six seven", "another, completely different line\nof words", "one two three"):
        assert table.encode(t) == table.library.encode(t)


def test_new_words_take_known_steps(monkeypatch):
    table = sentencepiece_bpe.PrefixTable(MODEL)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "ing", "er", "ent", "sch", "ción", "eau", "st"]) for _ in range(rng.randint(2, 5)))
    seen = {word() for _ in range(6000)}
    table.encode(" ".join(sorted(seen)))
    made, step = [], table.step
    monkeypatch.setattr(table, "step", lambda *row: made.append(row) or step(*row))
    fresh = sorted({word() for _ in range(3000)} - seen)
    text = " ".join(fresh)
    assert table.encode(text) == table.library.encode(text)
    assert len(fresh) > 1000 and len(made) < len(fresh) / 2


def test_states_may_run_over(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "STATES", 7)
    table = sentencepiece_bpe.PrefixTable(MODEL)
    for t in ("one two three four", "an-other, völlig anderes wort ççççç" * 5, "one two three", "y" * 500):
        assert table.encode(t) == table.library.encode(t)
        assert len(table.states) <= 8


def test_encoded_documents(spark):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (3, ""), (4, "é" * 5000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    lib = sentencepiece_bpe.prefix_table(MODEL).library
    for r in sentencepiece_bpe.encode_documents(df, MODEL).collect():
        assert r.ids == lib.encode(r.text or "") and r.decoded == lib.decode(r.ids)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in sentencepiece_bpe.encoded_digests(df, MODEL).collect():
        ids = lib.encode(dict(rows)[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    assert sentencepiece_bpe.encode_documents(df.where("false"), MODEL).count() == 0


def base_spans(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]

    def luhn(d):
        return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0

    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_base_spans_are_exact(spark):
    rng = random.Random(5)
    bits = ["a", "b@", "@", "c.d", "1", "22", "255", "256", ".", "-", " ", "+", "(", "4111111111111111", "ñ😀", "_", "x@y.z", "%", "\n", "0000", "é"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "1 " * 30000), (5003, "a." * 30000), (5004, "a@" + "b." * 30000 + "c"), (5005, "9" * 60000), (5006, "+" + "1" * 9)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, base string").repartition(4)
    got = {r.doc_id: (r.b, r.s) for r in pii.find(df).select("doc_id", pii.listed(F.col("base")).alias("b"), pii.listed(F.col("spans")).alias("s")).collect()}
    for i, t in rows:
        assert got[i][0] == base_spans(t or ""), repr((t or "")[:80])
        assert set(got[i][0].split(",")) <= set(got[i][1].split(","))
    assert pii.find(df.where("false")).count() == 0


def test_many_matches_of_one_text_take_their_logarithm_times_as_long(spark):
    numbers, prices = "12, " * 200_000, "a@b.de " * 20_000 + "token = 'abcdef123456' " * 5_000
    rows = [(1, numbers + "+49 30 1234567"), (2, prices), (3, "12, +49 30 1234567 7")]
    began = time.time()
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 120
    assert [(s.kind, s.start, s.end) for s in got[1].base if s.kind == "phone"] == [("phone", 800_000, 800_014)]
    assert [(s.kind, s.start, s.end) for s in got[3].base if s.kind == "phone"] == [("phone", 4, 20)]
    assert [(s.start, s.end) for s in got[2].base] == [(7 * i, 7 * i + 6) for i in range(20_000)]
    assert [(s.start, s.end) for s in got[2].spans if s.kind == "secret"] in ([], [(140_000 + 23 * i + 9, 140_000 + 23 * i + 21) for i in range(5_000)])


def test_running_values(spark):
    rows = spark.createDataFrame([([3, 1, 4, 1, 5, 9, 2, 6],), ([],), ([7],)], "v array<int>")
    got = rows.select(pii.running(F.col("v"), lambda a, b: a + b).alias("s"), pii.running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m")).collect()
    assert [r.s for r in got] == [[3, 4, 8, 9, 14, 23, 25, 31], [], [7]]
    assert [r.m for r in got] == [[3, 3, 4, 4, 5, 9, 9, 9], [], [7]]


def test_labelers_that_agree_are_believed():
    good, bad = (1, 1, 1, 1, 0), (-1, -1, -1, -1, -1)
    belief = pii.estimate([(good, 80), (bad, 60), ((1, 1, 0, 1, 0), 20), ((-1, 0, -1, 1, 0), 20)])
    assert belief[good] > 0.95 and belief[bad] < 0.05
    w = pii.fit([(pii.features(v), p, 50.0) for v, p in belief.items()])
    score = lambda v: sum(a * b for a, b in zip(w, pii.features(v), strict=True))
    assert score(good) > 0 > score(bad)
    assert pii.estimate([]) == {} and pii.fit([]) == []


def test_added_spans_of_labelled_sentences(spark):
    """Sentences with the spans that are to be added; n varies the values."""
    good = [
        ("please call me at {}", lambda n: f"555-{200 + n}-{4000 + 7 * n}"),
        ("fax: {} or later", lambda n: f"({310 + n}) 555-{2000 + 13 * n}"),
        ("write to {} soon", lambda n: f"user.{n} (at) host{n} (dot) com"),
        ("we met {} there", lambda n: ("Dr. John Smith", "Mrs. Mary Brown", "Mr. Peter Jones", "Ms. Anna Weber")[n % 4]),
        ('so token = "{}" it is', lambda n: f"{n:02d}f3ab77c0de{n * 7919:08x}"),
        ("API_KEY={}", lambda n: f"sk_live{n:03d}Zx81{n * 104729:08x}"),
    ]
    bad = [
        "order 555-{0}-4567 page", "invoice no. 312-555-{0}1 paid", "token = {0}", "the secret: understanding people {0}",
        "thanks, Mr. President of {0}", "card 1234 {0} 99 out", "password: changeme{0}", "+12 {0}", "version 300.{0}.1.1", "mail@{0}",
    ]
    rows, want = [], {}
    for n in range(40):
        for text, value in good:
            v = value(n)
            want[len(rows)] = {(text.index("{"), text.index("{") + len(v))}
            rows.append((len(rows), text.format(v)))
        for text in bad:
            want[len(rows)] = set()
            rows.append((len(rows), text.format(200 + n)))
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {r.doc_id: {(s.start, s.end) for s in r.spans} - {(s.start, s.end) for s in r.base} for r in found}
    hits = sum(len(added[i] & want[i]) for i in want)
    assert hits >= 0.9 * sum(map(len, added.values())) and hits >= 0.9 * sum(map(len, want.values()))
    assert not any(s.kind == "card" for r in found for s in r.spans)


def test_anchors_teach_but_stay_apart():
    unknown = [((1, 0, 1, 0, 0), 5), ((1, 0, -1, 0, 0), 5), ((0, 0, 0, 0, 0), 5)]
    alone = pii.estimate(unknown)
    assert alone[unknown[0][0]] > 0.95 > alone[unknown[1][0]] and alone[unknown[2][0]] < 0.95
    doubtful = pii.estimate(unknown, anchors=[((0, 0, 1, 0, 0), 5000, False), ((0, 0, 1, 0, 0), 5000, True)])
    assert doubtful[unknown[0][0]] < alone[unknown[0][0]]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat_format.text_parts(F.col("text")))


def test_chats_read_back(spark):
    rng = random.Random(6)
    bits = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "\\", "<", "|", "<|nl|>", "<\\|", "ü", "😀", " ", "<|image:1|>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "ro\nle<|", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) if rng.random() > 0.1 else None) for c in range(60) for t in rng.sample(range(9), rng.randint(1, 6))]
    rows += [(None, 1, "user", "x"), (99, None, "user", "first"), (99, 1, "assistant", "y" * 200000), (99, 1, "assistant", "y" * 200000)]
    chats = chat_format.format_chats(turns(spark, rows))
    got = {
        r.conv_id: r
        for r in chats.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("m")).collect()
    }
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(want)
    for c, w in want.items():
        w = [(role, text) for _, _, role, text in sorted(w, key=lambda x: x[:3])]
        assert [(t.role, t.text) for t in got[c].t] == w
        assert got[c].m == [text for role, text in w if role == "assistant"]
        assert got[c].formatted.count("<|im_start|>") == len(w)
    assert chat_format.format_chats(turns(spark, [])).count() == 0


def test_typed_parts(spark):
    part = "struct<type:string,text:string,ref:string,tokens:bigint>"
    rows = [(1, 0, "user", [("text", "see <|image:1|>", None, None), ("image", None, "a.png", 10), ("audio", None, "b.wav", None), ("text", None, None, None), ("document", None, None, 5)]), (1, 1, "assistant", None), (1, 2, "assistant", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    r = chat_format.format_chats(df).first()
    assert "see <\\|image:1|><|image:1|><|audio:2|><|document:3|>" in r.formatted
    assert [(a.position, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 10), (2, "audio", "b.wav", 250), (3, "document", None, 5)]
    assert r.media_tokens == 265 and len(r.loss_spans) == 2


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    urls = [None, "", "no scheme/en/1", "http://", "http://A.EXAMPLE.com", "http://example.com/en/1?q=/fr/", "http://www.example.com/en/2#x", "http://x.www.example.com/en/", "http://notexample.com/en/", "ftp://b.net/es/3", "x://b.net/esx", "http://com/", "http://b.org?u=http://c.net/fr/1", "http://Ü.net/fr/", "http://b.net/fr/" + "a/" * 3000, "http://net/fr/9"]
    urls += [f"http://h.net/{lang}/{i}" for lang in ("en", "fr") for i in range(40)] + ["http://h.net/fr/1"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = url_filter.filter_urls(df, URL_RULES).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = "", ""
        if urls[r.page_id] and "://" in urls[r.page_id]:
            rest = urls[r.page_id].split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest).group()
            path = re.match(r"[^?#]*", rest[len(host) :]).group()
            host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        assert (r.host, r.path) == (host, path)
        rule, verdict = rule_of(host, path)
        assert r.rule == rule and (verdict is None or r.verdict == verdict)
        assert r.verdict in ("allow", "block")
    assert url_filter.filter_urls(df.where("false"), URL_RULES).count() == 0


def test_templates_learn_from_rules(spark):
    urls = [f"http://h.net/{lang}/a{i}" for lang in ("fr", "es") for i in range(30)] + [f"http://h.com/ok/a{i}" for i in range(300)] + [f"http://h.net/plain/a{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, URL_RULES).collect()}
    assert {got[i].verdict for i in range(60, 390)} == {"allow"}
    assert got[0].template == "/fr/a{n}" and got[0].purity > 0.8


@pytest.mark.parametrize("sections, pages", [(60, 20), (40, 30)])
def test_small_sections_do_not_share_a_verdict(spark, sections, pages):
    names = [f"{a}{b}" for a in "abcdefgh" for b in "tuvwxyzo"][:sections]
    urls = [f"http://h.net/{s}/p{i}" for s in names for i in range(pages)] + [f"http://h.net/fr/p{i}" for i in range(23)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.filter_urls(df, URL_RULES).collect()
    assert {r.verdict for r in got if r.page_id < sections * pages} == {"allow"}
    assert {r.verdict for r in got if r.page_id >= sections * pages} == {"block"}
    assert not {r.template for r in got if r.path.startswith("/fr/")} & {r.template for r in got if not r.path.startswith("/fr/")}


def test_rules_below_the_fourth_segment_label_their_own_template(spark):
    urls = [f"http://x.net/a/b/c/d/bad/p{i}" for i in range(40)] + ["http://x.net/a/b/c/d/good/p1", "http://x.net/a/b/c/d/good/p2", "http://x.net/a/b/c/d/bad"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.filter_urls(df, [("x.net", "/a/b/c/d/bad/", "block")]).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(40))


def plain_templates(urls, rules, min_share=0.02, min_count=3, z=2.576):
    """Templates by a plain tree over single pages."""
    pages = []
    for u in urls:
        host, path = re.match(r"[^:]*://([^/]*)(.*)", u).groups()
        rule = max(((h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda r: len(r[0] + r[1]), default=None)
        pages.append([host, re.sub("[0-9]+", "{n}", path.removeprefix("/")).split("/"), "", bool(rule and rule[2] == "block")])

    def apart(x, n, y, m):
        p, q = (x + 1) / (n + 2), (y + 1) / (m + 2)
        return abs(p - q) > z * (p * (1 - p) / (n + 2) + q * (1 - q) / (m + 2)) ** 0.5

    for level in range(5):
        groups = {}
        for page in pages:
            if len(page[1]) > level:
                groups.setdefault((page[0], page[2]), {}).setdefault(page[1][level], []).append(page)
        for children in groups.values():
            total = sum(map(len, children.values()))
            small = {s for s, of in children.items() if len(of) < min_count or len(of) < min_share * total}
            traits = lambda of: [sum(p[3] for p in of), sum(len(p[1]) == level + 1 for p in of), sum(len(p[1]) > level + 1 and "{n}" in p[1][level + 1] for p in of)]
            pool = [p for s in small for p in children[s]]
            for s, of in list(children.items()):
                rest = len(pool) - len(of)
                alike = s in small and rest and not any(apart(x, len(of), y - x, rest) for x, y in zip(traits(of), traits(pool), strict=True))
                for p in of:
                    p.append("*" if alike else s)
            for of in children.values():
                for p in of:
                    p[2] += "/" + p.pop()
    return [p[2] for p in pages]


def test_the_tree_equals_a_plain_one(spark):
    rng = random.Random(12)
    urls = []
    for _ in range(1500):
        host = rng.choice(["a.net", "b.net", "c.org"])
        section = rng.choice(["user", "shop", "x", f"s{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}"])
        slug = "".join(rng.choice("abcd") for _ in range(rng.choice([1, 4])))
        urls.append(f"http://{host}/{section}/{slug}" + rng.choice(["", "/12", "/post", "/post/7"]))
    rules = [("a.net", "/user/", "block"), ("b.net", "/sa", "block"), ("b.net", "/user/a", "block"), ("net", "/x/b", "allow")]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert {r.page_id: r.template for r in got} == dict(enumerate(plain_templates(urls, rules)))


def test_a_wildcard_blocks_pages_that_no_rule_names(spark):
    names = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmn"]
    rules = [("h.net", f"/u/{name}/", "block") for name in names[:70]]
    urls = [f"http://h.net/u/{name}/post" for name in names] + [f"http://h.net/help/{name}" for name in names]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert {got[i].template for i in range(75)} == {"/u/*/post"}
    assert all(got[i].verdict == "block" for i in range(75)) and all(got[i].rule is None for i in range(70, 75))
    assert {got[i].verdict for i in range(75, 150)} == {"allow"}


def test_many_clean_pages_beside_a_blocked_section_are_allowed(spark):
    urls = [f"http://h.net/s{chr(97 + s // 8)}{chr(97 + s % 8)}/p{i}" for s in range(60) for i in range(160)] + [f"http://h.net/fr/p{i}" for i in range(180)]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES)
    assert {r.page_id for r in got.where("verdict = 'block'").collect()} == set(range(9600, 9780))


def test_few_labels_do_not_block_a_template(spark):
    rules = [("h.net", "/x/p1", "block"), ("h.net", "/y/*", "block")]
    urls = ["http://h.net/x/p1"] + [f"http://h.net/x/p{i}" for i in range(20, 60)] + ["http://h.net/y/*", "http://h.net/y/a", "http://h.net/z/q"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.path: r.verdict for r in url_filter.filter_urls(df, rules).collect()}
    assert {p for p, v in got.items() if v == "block"} == {"/x/p1", "/y/*"}


@pytest.mark.parametrize("name", ["op7_chat_format", "op10_exact_dedup", "op8_topk_search"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from layerloom.llm import queries

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))
