"""URL filters by rules and, where no rule fits, by a tree of path templates per host.

Templates generalise the variable segments of a path: digits become ``{n}``,
and segments that each carry few of their parent's pages become one wildcard,
with or without blocked pages, as long as they are alike: a segment whose
blocked share, or whose paths below, differ significantly from those of the other
small ones stays literal.  Sibling branches whose blocked shares do not differ
significantly are merged.  A template is rejected where the share of pages that
rules block among all its pages, smoothed towards its branch and that towards
all pages, is high: then pages that no rule names are blocked with the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least levels of the tree, which goes on to the deepest rule; what lies deeper shares the last level's node.
DEPTH = 4
#: The pool of a node's variable segments.
WILDCARD = "*"
#: Shares in which small segments must agree to be one wildcard: blocked pages, pages that end here, numbers that follow.
AGREEING = ("blocked", "ends", "numbers")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where ``://`` is missing."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, else null.  ``rules`` is a short list given by the caller."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def depth_for(rules: list[Rule]) -> int:
    """Levels that tell apart whatever a rule does: none looks further than its own last segment."""
    return max([DEPTH, *[len(p.removeprefix("/").split("/")) for _, p, _ in rules]])


def segments(path: Column, depth: int) -> Column:
    """Shapes of the first ``depth`` segments; deeper ones are folded into ``**``.

    Asterisks of the path itself are coded, so that no segment looks like a pool.
    """
    shape = F.replace(F.regexp_replace(path, r"^/", ""), F.lit("*"), F.lit("%2A"))
    shape = F.regexp_replace(shape, "[0-9]+", "{n}")
    parts = F.split(shape, "/", -1)
    return F.concat(F.slice(parts, 1, depth), F.when(F.size(parts) > depth, F.array(F.lit("**"))).otherwise(F.array()))


def differs(x: Column, n: Column, y: Column, m: Column, z: float) -> Column:
    """Whether x of n and y of m are shares of two kinds: two proportions, a success and a failure added to each, which keeps single pages from telling."""
    p, q = (x + 1) / (n + 2), (y + 1) / (m + 2)
    return F.abs(p - q) > z * F.sqrt(p * (1 - p) / (n + 2) + q * (1 - q) / (m + 2))


def template_tree(shapes: DataFrame, depth: int, min_share: float, min_count: int, scratch: Scratch, z: float = 2.576) -> DataFrame:
    """shapes (host, shape, segs, n, labelled, blocked) with a template for each row.

    Works on the aggregate over (host, shape).  At each level the children of a
    node (host, prefix so far) are counted.  Literal stay those with
    ``min_share`` of its pages and at least ``min_count``.  Of the others, which
    may be any number, each is compared with all the rest; those that differ in
    one of AGREEING stay literal too, as does an only one, and the rest become ``*``.
    """
    grown = shapes.withColumn("prefix", F.lit(""))
    node = ["host", "prefix"]
    for level in range(depth + 1):
        here = grown.withColumn("seg", F.get("segs", F.lit(level)))
        ends = F.when(F.size("segs") == level + 1, F.col("n")).otherwise(0)
        numbers = F.when(F.coalesce(F.contains(F.get("segs", F.lit(level + 1)), F.lit("{n}")), F.lit(False)), F.col("n")).otherwise(0)
        children = here.where("seg is not null").groupBy(*node, "seg").agg(
            F.sum("n").alias("c"), F.sum("blocked").alias("blocked"), F.sum(ends).alias("ends"), F.sum(numbers).alias("numbers")
        )
        every = here.where("seg is not null").groupBy(*node).agg(F.sum("n").alias("all"))
        sized = scratch.put(
            f"children{level}",
            children.join(every, node).withColumn("large", (F.col("c") >= min_count) & (F.col("c") >= F.lit(min_share) * F.col("all"))),
        )
        small = sized.where(~F.col("large")).groupBy(*node).agg(F.sum("c").alias("pool"), *[F.sum(x).alias(f"pool_{x}") for x in AGREEING])
        rest = F.col("pool") - F.col("c")
        apart = rest == 0
        for x in AGREEING:
            apart = apart | differs(F.col(x), F.col("c"), F.col(f"pool_{x}") - F.col(x), rest, z)
        named = scratch.put(f"named{level}", sized.join(small, node, "left").where(F.col("large") | apart).select(*node, "seg", F.col("seg").alias("name")))
        grown = scratch.put(
            f"grown{level}",
            here.join(named, [*node, "seg"], "left")
            .withColumn(
                "prefix",
                F.when(F.col("seg").isNull(), F.col("prefix")).otherwise(
                    F.concat("prefix", F.lit("/"), F.coalesce("name", F.lit(WILDCARD)))
                ),
            )
            .drop("seg", "name"),
        )
    return grown.withColumnRenamed("prefix", "template")


def judge_templates(templates: DataFrame, prior: float, strength: float, z: float) -> DataFrame:
    """Templates (host, template, n, labelled, blocked) with their branch and purity.

    Siblings share a host and all but the last segment.  Sorted by the blocked
    share of their pages, a sibling joins the branch of the one before it unless
    a test of two proportions tells them apart; siblings without labels form
    their own branch.  Pages without a label count as not blocked, and each
    template's own pages outweigh its branch, so labels on a minority of a
    template's pages never block it.
    """
    parent = F.regexp_replace("template", r"/[^/]*$", "")
    t = templates.withColumn("parent", parent).withColumn("known", F.col("labelled") > 0)
    t = t.withColumn("share", F.col("blocked") / F.col("n"))
    w = Window.partitionBy("host", "parent", "known").orderBy("share", "template")
    n0, b0 = F.lag("n").over(w), F.lag("blocked").over(w)
    pooled = (F.col("blocked") + b0 + 1) / (F.col("n") + n0 + 2)
    gap = F.abs(F.col("share") - b0 / n0) / F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / n0))
    cut = F.when(F.col("known") & n0.isNotNull() & (gap > z), 1).otherwise(0)
    branch = Window.partitionBy("host", "parent", "known", "branch")
    smoothed = lambda blocked, n, towards: (blocked + F.lit(strength) * towards) / (n + F.lit(strength))
    return (
        t.withColumn("cut", cut)
        .withColumn("branch", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("of_branch", smoothed(F.sum("blocked").over(branch), F.sum("n").over(branch), F.lit(prior)))
        .withColumn("purity", smoothed(F.col("blocked"), F.col("n"), F.col("of_branch")))
        .select("host", "template", "branch", "purity")
    )


def filter_urls(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    min_share: float = 0.02,
    min_count: int = 3,
    strength: float = 2.0,
    z: float = 1.96,
    z_alike: float = 2.576,
    reject_at: float = 0.8,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    The prior is the share of all pages that rules block; a page without a rule
    is blocked where its template's purity reaches ``reject_at``.  Segments are
    alike unless a test at ``z_alike`` (one error in a hundred) tells them apart,
    so that a single page joins a wildcard and two unlike it do not.
    Null and malformed urls have an empty host and path and are judged like
    any other.  Repeated rows are judged each and count each; segments of equal
    counts are told apart by name only.  Very long urls are read whole; an empty
    table gives an empty result, and columns beside id and url are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    depth = depth_for(rules)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    base = scratch.put(
        "base",
        base.withColumn("rule", rule)
        .withColumn("ruled", verdict)
        .withColumn("segs", segments(F.col("path"), depth))
        .withColumn("shape", F.array_join("segs", "/")),
    )
    shapes = scratch.put(
        "shapes",
        base.groupBy("host", "shape", "segs").agg(
            F.count(F.lit(1)).alias("n"),
            F.count("ruled").alias("labelled"),
            F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"),
        ),
    )
    tree = scratch.put("tree", template_tree(shapes, depth, min_share, min_count, scratch, z_alike).drop("segs"))
    totals = tree.agg(F.sum("n"), F.sum("blocked")).first()
    prior = totals[1] / totals[0] if totals[0] else 0.0
    templates = tree.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    judged = scratch.put(
        "judged",
        tree.select("host", "shape", "template").join(
            judge_templates(templates, prior, strength, z), ["host", "template"]
        ),
    )
    return base.join(judged, ["host", "shape"], "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("purity") >= reject_at, "block").otherwise("allow")).alias("verdict"),
        "template",
        "purity",
    )
