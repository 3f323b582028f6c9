"""Personal data by weak supervision, in built-in expressions only.

Patterns propose candidate spans; labelers looking at format, gazetteers,
context, borders and shape vote on each (1 for, -1 against, 0 no opinion).
Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is and how likely each pattern means personal data.  Base
matches are anchors there: accepted ones count as personal data, rejected ones
as none.  A logistic span classifier is fitted to those soft labels, with the
length of a span and the characters beside it as further features.  Spans that
the base patterns accept always stay and rejected ones never come back;
proposals are added where the classifier is sure.  Only counts of patterns
reach the driver: 3^5 votes by 3^3 neighbourhoods per kind at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

KINDS = ("email", "ip", "card", "phone", "name", "secret")
LABELERS = ("format", "gazetteer", "context", "border", "shape")
#: What the classifier sees besides the votes, each with three levels.
NEIGHBOURS = ("long", "left", "right")
#: Labelers are taken to be right this often where the data say nothing else.
TRUST = 0.85

# The base patterns.  Runs are possessive and start at a run's first character
# (or where the last match ended), which finds the same matches without
# trying every start of a long run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Proposals beyond the base: spelled-out addresses, numbers without a plus, titled names, assigned secrets.
PROPOSALS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]{1,63}(?: ?[(\[] ?dot ?[)\]] ?[A-Za-z0-9-]{1,63}){1,5}",
    "phone": r"(?<![0-9A-Za-z+./=-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ -])[0-9]{3,4}[ -][0-9]{3,4}(?![0-9A-Za-z/=-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?",
    "secret": r"(?<=[\"'=:]|[=:] )(?<=(?i:key|secret|token|password|passwd|pwd)[\"']{0,1} {0,1}[:=] {0,1}[\"']{0,1})[A-Za-z0-9_+/.-]{8,512}+",
}
#: What makes a pattern worth trying at all.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
# What speaks for a well-formed proposal, and what against it.
FORMED = {
    "email": (r"[A-Za-z]{2,}$", r"^[^A-Za-z]*$"),
    "phone": (r"^(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ -])[2-9][0-9]{2}[ -][0-9]{4}$", r"^\(?(?:19|20)[0-9]{2}\b"),
    "name": (r"^\w+\.? [A-Z][a-z]+", r"^\b$"),
    "secret": (r"^(?=.*[0-9])(?=.*[A-Za-z]).{8,}$", r"^(?:[A-Za-z]+|[0-9]{1,8}|[0-9.]+)$"),
}
# Listed beginnings, endings and words for a kind, and those against it.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot ?[)\]] ?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|ca|au|jp|br|in)$",
    "ip": r"^(?:[1-9]|1[1-9]|[2-9][0-9]|1[013-9][0-9]|12[0-689]|2[01][0-9]|22[0-3])\.",
    "card": r"^[3-6]",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "name": r"(?i) (?:james|mary|john|anna|robert|peter|michael|maria|david|jane|william|linda|richard|susan|thomas|sarah|charles|karen|daniel|laura|paul|emma|mark|julia|george|alice|hans|jean|marie|jose|carlos|carmen|juan|lucia|pierre|claire|klaus|ursula|giovanni|elena|ivan|olga|ali|fatima|wei|yuki)\b",
    "secret": r"^(?:sk_|pk_|gh[pousr]_|xox[abp]-|AKIA|AIza|eyJ)",
}
UNLISTED = {
    "name": r" (?:President|Speaker|Minister|Chancellor|Chairman|Secretary|Justice|Ambassador|Director|Right|Universe)\b",
    "secret": r"(?i)example|changeme|placeholder|your|dummy|sample|^(?:none|null|true|false|undefined|password)$",
}
CONTEXT_FOR = r"(?i)(?:e-?mail|mail|write to|contact|call|tel|phone|fax|mobile|cell|card|visa|account|paid|address|host|login|from|name|by)\W{0,3}(?:\w+\W+){0,2}$"
CONTEXT_AGAINST = r"(?i)(?:version|isbn|order|invoice|page|figure|chapter|section|part|model|token|key|hash|serial|build|release|id)\W{0,4}(?:(?:no|nr|num|number|code)\W{0,3})?$"
SECRET_FOR = r"(?i)(?:api|access|auth|private|secret|token|password|passwd|pwd)[A-Za-z_ -]{0,12}[\"']?\s?[:=]\s?[\"']?$"
SECRET_AGAINST = r"(?i)(?:primary|foreign|public|sort|cache|partition|map)[ _-]?key[\"']?\s?[:=]\s?[\"']?$"


#: Code points before a match that a labeler sees.
SEEN_BEFORE = 40


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running sums, maxima, ... of an array: each turn merges what stands twice as far back as in the turn before."""
    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"))
    return F.aggregate(turns, values, lambda done, k: F.transform(done, lambda x, i: F.coalesce(merge(x, F.get(done, i - F.call_function("shiftleft", F.lit(1), k))), x)))


def located(found: Column, gaps: Column) -> Column:
    """The matches with their places and surroundings: array<struct<start, end, m, before, after>>.

    ``gaps`` is the text around the matches, one more than these.  Places are
    running sums and surroundings come from the nearest pieces, so that the
    work grows with the matches times their logarithm; both columns must be
    attributes, since a lambda evaluates what it mentions at every element.
    """
    lengths = F.zip_with(found, gaps, lambda m, g: F.coalesce(F.length(m), F.lit(0)) + F.length(g))
    ends = running(lengths, lambda x, y: x + y)

    def surrounded(m: Column, i: Column) -> Column:
        # A match has at least two characters: twenty of them and the gaps between fill the view.
        first = F.greatest(i - SEEN_BEFORE // 2, F.lit(0))
        pieces = F.zip_with(F.slice(found, first + 1, i - first), F.slice(gaps, first + 1, i - first), lambda x, g: F.concat(F.right(g, F.lit(SEEN_BEFORE)), x))
        before = F.concat(F.array_join(pieces, ""), F.right(F.get(gaps, i), F.lit(SEEN_BEFORE)))
        after = F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), F.lit("")))
        return F.struct(m.alias("m"), F.right(before, F.lit(SEEN_BEFORE)).alias("before"), F.left(after, F.lit(1)).alias("after"))

    near = F.transform(found, surrounded)
    placed = F.zip_with(near, ends, lambda x, e: F.struct((e - F.length(x["m"])).alias("start"), e.alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))
    return F.slice(placed, F.lit(1), F.size(found))


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct(i.alias("i"), F.substr(turned, i, F.lit(1)).cast("int").alias("v")))
    total = F.aggregate(
        values,
        F.lit(0),
        lambda a, x: a + F.when(x["i"] % 2 == 1, x["v"]).when(x["v"] > 4, 2 * x["v"] - 9).otherwise(2 * x["v"]),
    )
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(
            F.split(m, r"\.", -1),
            lambda p: (F.length(part(p)) < 3)
            | ((F.length(part(p)) == 3) & (F.substr(F.concat(F.lit("0"), part(p)), F.lit(1), F.lit(4)).cast("int") <= 255)),
        )
    if kind == "card":
        digits = F.regexp_replace(m, "[ -]", "")
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def judged(spans: Column, kind: str, base: bool) -> Column:
    """Spans with their base flag and votes."""
    accepted = (lambda m: valid(kind, m)) if base else (lambda m: F.lit(False))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), s["before"].alias("before"), s["after"].alias("after"), accepted(s["m"]).alias("base")))
    speaks_for, against = (SECRET_FOR, SECRET_AGAINST) if kind == "secret" else (CONTEXT_FOR, CONTEXT_AGAINST)

    def vote(s: Column) -> Column:
        before, right = s["before"], s["after"]
        left = F.when(s["start"] > 0, F.right(before, F.lit(1))).otherwise(" ")
        size = s["end"] - s["start"]
        one = F.lit(1).cast("tinyint")
        mark = lambda yes, no: F.when(yes, one).when(no, -one).otherwise(F.lit(0).cast("tinyint"))
        level = lambda low, mid: F.when(low, F.lit(0)).when(mid, 1).otherwise(2).cast("tinyint")
        digits = F.regexp_replace(s["m"], "[^0-9]", "")
        listed = s["m"].rlike(GAZETTEER[kind])
        unlisted = s["m"].rlike(UNLISTED[kind]) if kind in UNLISTED else F.lit(kind in ("ip", "card")) & ~listed
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["base"].alias("base"),
            F.lit(base).alias("tried"),
            (mark(s["base"], F.lit(True)) if base else mark(s["m"].rlike(FORMED[kind][0]) & ~s["m"].rlike(FORMED[kind][1]), s["m"].rlike(FORMED[kind][1]))).alias("format"),
            mark(listed & ~unlisted, unlisted).alias("gazetteer"),
            mark(before.rlike(speaks_for) & ~before.rlike(against), before.rlike(against)).alias("context"),
            mark(F.lit(False), F.concat(left, right).rlike("[0-9A-Za-z/_]" if kind == "secret" else "[0-9A-Za-z=/_]")).alias("border"),
            mark(
                F.lit(kind == "name") & s["m"].rlike(" [A-Z][a-z]+ [A-Z][a-z]+$"),
                digits.rlike(r"([0-9])\1{5,}") | s["m"].rlike(r"([A-Za-z])\1{5,}"),
            ).alias("shape"),
            level(size <= 12, size <= 24).alias("long"),
            level(left.rlike(r"\s"), left.rlike("[\"'(\\[<:]")).alias("left"),
            level((right == "") | right.rlike(r"\s"), right.rlike("[\"')\\]>.,;:!?]")).alias("right"),
        )

    return F.transform(spans, vote)


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and for each kind the voted spans, base and proposed, without the text."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    nothing = F.array().cast("array<string>")
    all_of = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    found = docs.select(
        "*",
        *[F.when(F.contains("text", F.lit(HINTS[k])), all_of(p)).otherwise(nothing).alias(f"b_{k}") for k, p in PATTERNS.items()],
        *[all_of(p).alias(f"p_{k}") for k, p in PROPOSALS.items()],
    )
    names = [*[f"b_{k}" for k in PATTERNS], *[f"p_{k}" for k in PROPOSALS]]
    pattern = {**{f"b_{k}": p for k, p in PATTERNS.items()}, **{f"p_{k}": p for k, p in PROPOSALS.items()}}
    cut = found.select("doc_id", *names, *[F.when(F.size(c) > 0, F.split("text", pattern[c], -1)).otherwise(nothing).alias(f"g_{c}") for c in names])
    placed = cut.select("doc_id", *[located(F.col(c), F.col(f"g_{c}")).alias(c) for c in names])
    return placed.select("doc_id", *[judged(F.col(c), c[2:], c.startswith("b_")).alias(c) for c in names])


def estimate(
    patterns: list[tuple[tuple[int, ...], int]],
    rounds: int = 10_000,
    anchors: list[tuple[tuple[int, ...], int, bool]] | None = None,
) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation: the chance of personal data for every vote pattern.

    Two classes; a labeler's votes are independent given the class, and no
    opinion says nothing.  ``anchors`` are vote patterns of known class; they
    teach reliabilities, but not how common the class is among the others.
    Every labeler starts as right TRUST of the time for either class, and that
    start weighs as much as all votes that it cast on patterns of unknown class
    (ten at least), so that unanchored data cannot turn a labeler around.
    The rounds end where beliefs move by less than 1e-9, or raise.
    """
    if not patterns:
        return {}
    total = sum(n for _, n in patterns)
    known = [(v, n, float(yes)) for v, n, yes in anchors or []]
    cast = [max(10.0, float(sum(n for v, n in patterns if v[j]))) for j in range(len(LABELERS))]
    right = [[TRUST, TRUST] for _ in LABELERS]
    prior = 0.5
    belief: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        new = {}
        for v, _n in patterns:
            odds = math.log(prior / (1 - prior))
            for x, (for_yes, for_no) in zip(v, right, strict=True):
                if x > 0:
                    odds += math.log(for_yes / (1 - for_no))
                elif x < 0:
                    odds += math.log((1 - for_yes) / for_no)
            new[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        moved = max(abs(new[v] - belief.get(v, -1.0)) for v in new)
        belief = new
        if moved < 1e-9:
            return belief
        every = known + [(v, n, belief[v]) for v, n in patterns]
        prior = (sum(n * belief[v] for v, n in patterns) + 0.5 * max(10, total)) / (total + max(10, total))
        for j, weight in enumerate(cast):
            yes = sum(n * p for v, n, p in every if v[j])
            no = sum(n * (1 - p) for v, n, p in every if v[j])
            hit = sum(n * p for v, n, p in every if v[j] > 0)
            miss = sum(n * (1 - p) for v, n, p in every if v[j] < 0)
            right[j] = [(hit + TRUST * weight) / (yes + weight), (miss + TRUST * weight) / (no + weight)]
    raise RuntimeError(f"beliefs still move by {moved} after {rounds} rounds")


def fit(rows: list[tuple[tuple[float, ...], float, float]], ridge: float = 1.0, rounds: int = 1000) -> list[float]:
    """Logistic weights for (features, soft label, count) by Newton steps with a ridge.

    The ridge pulls to what a labeler of reliability TRUST would weigh, so that
    few spans already give sensible scores.
    """
    if not rows:
        return []
    d = len(rows[0][0])
    centre = trusting(d)
    w = list(centre)
    for _ in range(rounds):
        grad = [-ridge * (x - c) for x, c in zip(w, centre, strict=True)]
        hess = [[ridge * (i == j) for j in range(d)] for i in range(d)]
        for f, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f, strict=True))))))
            for i in range(d):
                if f[i]:
                    grad[i] += n * (y - p) * f[i]
                    for j in range(d):
                        hess[i][j] += n * p * (1 - p) * f[i] * f[j]
        for i in range(d):  # solve in place; the ridge keeps the matrix definite
            for k in range(i + 1, d):
                r = hess[k][i] / hess[i][i]
                hess[k] = [a - r * b for a, b in zip(hess[k], hess[i], strict=True)]
                grad[k] -= r * grad[i]
        step = [0.0] * d
        for i in reversed(range(d)):
            step[i] = (grad[i] - sum(hess[i][j] * step[j] for j in range(i + 1, d))) / hess[i][i]
        far = max(1.0, max(map(abs, step)) / 2)  # no weight moves by more than 2 at once
        w = [a + b / far for a, b in zip(w, step, strict=True)]
        if max(map(abs, step)) < 1e-8:
            return w
    raise RuntimeError(f"weights still move after {rounds} rounds")


def trusting(d: int) -> list[float]:
    """Weights for d features that follow from TRUST alone."""
    gain, k = math.log(TRUST / (1 - TRUST)), len(LABELERS)
    return [0.0, *[gain] * k, *[-gain] * k, *[0.0] * (d - 1 - 2 * k)]


def features(votes: tuple[int, ...], levels: tuple[int, ...] = (), *more: float) -> tuple[float, ...]:
    return (
        1.0,
        *[float(x > 0) for x in votes],
        *[float(x < 0) for x in votes],
        *[float(x == y) for x in levels for y in (1, 2)],
        *more,
    )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.95) -> DataFrame:
    """One row per document: doc_id, ``base`` and ``spans``, arrays of (kind, start, end, score).

    Places are code points, ends exclusive; order: kind as in KINDS, then
    start.  ``base`` has the accepted base matches (score 1), ``spans`` these and what
    the classifier adds, which overlaps no base span and is no match that the
    base rejected.  Added spans of two kinds may overlap.  Null text counts as
    empty; repeated rows are treated each; very long texts are read whole.
    """
    spark = docs.sparkSession
    voted = Scratch(spark, "pii").put("voted", candidates(docs, id_col, text_col))
    names = [c for c in voted.columns if c != "doc_id"]
    kinds = {c: c[2:] for c in names}

    seen_by = ("base", "tried", *LABELERS, *NEIGHBOURS)

    def pattern(c: str) -> Column:
        return F.transform(c, lambda s: F.struct(F.lit(kinds[c]).alias("kind"), *[s[x].alias(x) for x in seen_by]))

    counts = (
        voted.select(F.explode(F.concat(*map(pattern, names))).alias("s"))
        .groupBy("s.kind", *[f"s.{x}" for x in seen_by])
        .count()
        .collect()
    )
    weights: dict[str, list[float]] = {}
    for kind in KINDS:
        seen = [
            (tuple(int(r[x]) for x in LABELERS), tuple(int(r[x]) for x in NEIGHBOURS), r["count"], r["base"], r["tried"])
            for r in sorted(counts, key=str)
            if r["kind"] == kind
        ]
        unknown: dict[tuple[int, ...], int] = {}
        for v, _, n, _, tried in seen:
            if not tried:
                unknown[v] = unknown.get(v, 0) + n
        # The format labeler made the anchors, so it has no say on them; anchors have an offset of their own.
        blind = lambda v: (0, *v[1:])
        belief = estimate(list(unknown.items()), anchors=[(blind(v), n, base) for v, _, n, base, tried in seen if tried])
        weights[kind] = fit(
            [
                (features(blind(v), near, 1.0), float(base), float(n)) if tried else (features(v, near, 0.0), belief[v], float(n))
                for v, near, n, base, tried in seen
            ]
        )

    def scored(c: str) -> Column:
        k, m = len(LABELERS), len(NEIGHBOURS)
        w = weights[kinds[c]] or trusting(1 + 2 * k + 2 * m)

        def one(s: Column) -> Column:
            total = F.lit(w[0])
            for j, x in enumerate(LABELERS):
                total = total + F.when(s[x] > 0, F.lit(w[1 + j])).when(s[x] < 0, F.lit(w[1 + k + j])).otherwise(F.lit(0.0))
            for j, x in enumerate(NEIGHBOURS):
                total = total + F.when(s[x] == 1, F.lit(w[1 + 2 * k + 2 * j])).when(s[x] == 2, F.lit(w[2 + 2 * k + 2 * j])).otherwise(F.lit(0.0))
            return F.struct(
                F.lit(KINDS.index(kinds[c])).alias("order"),
                s["start"].cast("bigint").alias("start"),
                s["end"].cast("bigint").alias("end"),
                F.lit(kinds[c]).alias("kind"),
                s["base"].alias("base"),
                s["tried"].alias("tried"),
                F.when(s["base"], F.lit(1.0)).otherwise(1 / (1 + F.exp(-total))).alias("score"),
            )

        return F.transform(c, one)

    every = voted.select("doc_id", F.concat(*[scored(c) for c in names]).alias("every")).select(
        "doc_id",
        F.filter("every", lambda s: s["base"]).alias("base"),
        F.filter("every", lambda s: ~s["tried"] & (s["score"] >= sure)).alias("more"),
    )
    # A proposal overlaps a base span if of those that begin before its end one ends behind its start.
    marks = F.array_sort(F.concat(
        F.transform("base", lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("turn"), b["end"].alias("reach"), b.alias("s"))),
        F.transform("more", lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("turn"), F.lit(-1).cast("bigint").alias("reach"), s.alias("s"))),
    ))
    merged = every.withColumn("marks", F.when(F.size("more") > 0, marks).otherwise(F.slice(marks, 1, 0))).withColumn("reached", running(F.transform("marks", lambda e: e["reach"]), lambda x, y: F.greatest(x, y)))
    free = F.filter(F.arrays_zip("marks", "reached"), lambda z: (z["marks"]["turn"] == 0) & (z["reached"] <= z["marks"]["s"]["start"]))
    added = F.transform(free, lambda z: z["marks"]["s"])
    show = lambda c: F.transform(F.array_sort(c), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return merged.select("doc_id", show(F.col("base")).alias("base"), show(F.concat("base", added)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
