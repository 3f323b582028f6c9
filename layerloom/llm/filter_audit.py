"""Interaction audit of filters: what each removes at every place of every order.

The orders of k filters form a trie of k! paths, but what survives a prefix
depends on its set only.  A depth-first walk applies one filter at a time to the
written survivors of the state above, keeps each of the 2^k states once
(memoised by its set), and counts the actual removals at every edge out of it,
per part of the data.  Orders are put together from these edges at the end.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: More filters mean more states (2^k) and orders (k!) than anybody reads.
MOST_FILTERS = 8


def words_of(text: Column) -> Column:
    """Maximal runs without space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _count(condition: Column) -> Column:
    return F.sum(F.coalesce(condition.cast("bigint"), F.lit(0).cast("bigint")))


def edge_counts(rows: DataFrame, filters: dict[str, Column], part: str, marks: dict[str, Column], scratch: Scratch) -> DataFrame:
    """One row per part, state and next filter: (part, filter, removed, <mark>..., kept, unique_fails, state).

    ``filters`` maps a letter to the condition under which a row fails; null is
    no failure.  ``state`` is the bit set of the filters applied before.  Parts
    without survivors in a state have no row there.  ``unique_fails`` holds in
    the empty state; in others it counts survivors.
    """
    letters = list(filters)
    bit = {f: 1 << i for i, f in enumerate(letters)}
    fails = {f: F.coalesce(c, F.lit(False)) for f, c in filters.items()}
    alone = {f: reduce(lambda c, g: c & ~fails[g], [g for g in letters if g != f], fails[f]) for f in letters}
    sums = [F.count(F.lit(1)).alias("__rows")]
    for f in letters:
        sums += [_count(fails[f]).alias(f"__r_{f}"), _count(alone[f]).alias(f"__u_{f}")]
        sums += [_count(fails[f] & c).alias(f"__{m}_{f}") for m, c in marks.items()]
    lines = F.array(*[
        F.struct(
            F.lit(f).alias("filter"),
            F.col(f"__r_{f}").alias("removed"),
            *[F.col(f"__{m}_{f}").alias(m) for m in marks],
            (F.col("__rows") - F.col(f"__r_{f}")).alias("kept"),
            F.col(f"__u_{f}").alias("unique_fails"),
        )
        for f in letters
    ])
    everything = (1 << len(letters)) - 1
    counted: set[int] = set()
    done: list[str] = []

    def count(state: int, survivors: DataFrame) -> None:
        # The same plan in every state: generated code is compiled once.
        edges = survivors.groupBy(part).agg(*sums).select(part, F.explode(lines).alias("e")).select(part, "e.*")
        scratch.put(f"edges/state={state}", edges)

    def visit(state: int, survivors: DataFrame, counts: ThreadPoolExecutor) -> None:
        own = counts.submit(count, state, survivors)
        counted.add(state)
        for f in letters:
            below = state | bit[f]
            if below in counted or below == everything:
                continue
            rest = survivors.where(~fails[f])
            if any(below | b not in counted and below | b != everything for b in bit.values()):
                rest = scratch.put(f"state{below}", rest)  # states below are made from it
                done.append(f"state{below}")
            visit(below, rest, counts)
            if not state:
                scratch.drop(*done)
                done.clear()
        own.result()

    with ThreadPoolExecutor(4) as counts:  # counts of a state run beside the walk below it
        visit(0, rows, counts)
    applied = F.element_at(F.create_map(*[x for f in letters for x in (F.lit(f), F.lit(bit[f]))]), F.col("filter"))
    found = rows.sparkSession.read.parquet(scratch.path("edges")).withColumn("state", F.col("state").cast("int"))
    return found.where(F.col("state").bitwiseAND(applied) == 0)


def _steps(letters: Iterable[str]) -> list[tuple[str, str, int]]:
    """(order, filter, state before it) of every step of every order."""
    letters = list(letters)
    bit = {f: 1 << i for i, f in enumerate(letters)}
    return [("".join(p), f, sum(bit[g] for g in p[:k])) for p in permutations(letters) for k, f in enumerate(p)]


def audit(rows: DataFrame, filters: dict[str, Column], part: str, marks: dict[str, Column]) -> DataFrame:
    """One row per part, order and step of all orders of ``filters`` over ``rows``.

    Columns: part, filter_order, step, filter, kept (after the step), removed,
    redundant (failing, but removed earlier), unique_fails (failing this filter
    only), a count of removed rows per mark, and shapley (removed by the filter,
    summed over all orders).  Conditions should read few and narrow columns:
    survivors are written once per state.  Null parts form a part of their own;
    an empty table has no parts and gives no rows.  Repeated rows all count.
    """
    letters = list(filters)
    if not 1 <= len(letters) <= MOST_FILTERS or len(set("".join(letters))) != len("".join(letters)):
        raise ValueError(f"between 1 and {MOST_FILTERS} filters, named by letters of their own")
    spark = rows.sparkSession
    scratch = Scratch(spark, "filter-audit")
    edges = edge_counts(rows, filters, part, marks, scratch)
    bit = {f: 1 << i for i, f in enumerate(letters)}
    k = len(letters)
    # Every part with every edge of the trie; at most k * 2^(k-1) rows a part, not one per order.
    every = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter")) for s in range(1 << k) for f in letters if not s & bit[f]])
    first = edges.where("state = 0").select(F.col(part).alias("__p"), F.col("filter").alias("__f"), F.col("removed").alias("failing"), F.col("unique_fails").alias("alone"))
    parts = edges.where("state = 0").select(part).distinct().withColumn("e", F.explode(every)).select(part, "e.*")
    counted = edges.drop("unique_fails").select(F.col(part).alias("__cp"), F.col("state").alias("__cs"), F.col("filter").alias("__cf"), "removed", *marks, "kept")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    full = (
        parts.join(counted, F.col(part).eqNullSafe(F.col("__cp")) & (F.col("state") == F.col("__cs")) & (F.col("filter") == F.col("__cf")), "left")
        .select(part, "state", "filter", zero("removed"), *[zero(m) for m in marks], zero("kept"))
    )
    size = F.bit_count("state")
    ways = F.element_at(F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k)]), (size + 1).cast("int"))
    values = full.groupBy(F.col(part).alias("__sp"), F.col("filter").alias("__sf")).agg(F.sum(F.col("removed") * ways).cast("bigint").alias("shapley"))
    known = first.join(values, F.col("__p").eqNullSafe(F.col("__sp")) & (F.col("__f") == F.col("__sf"))).drop("__sp", "__sf")
    table = full.join(known, F.col(part).eqNullSafe(F.col("__p")) & (F.col("filter") == F.col("__f")))
    # An edge stands in a fixed number of orders, whatever the data.
    at: dict[tuple[int, str], list[str]] = {}
    for order, f, state in _steps(letters):
        at.setdefault((state, f), []).append(order)
    listing = spark.createDataFrame([(s, f, names) for (s, f), names in at.items()], "state int, filter string, orders array<string>")
    out = table.join(F.broadcast(listing), ["state", "filter"])  # k * 2^(k-1) rows
    return out.select(
        F.col(part).alias("part"),
        F.explode("orders").alias("filter_order"),
        (F.bit_count("state") + 1).cast("int").alias("step"),
        "filter",
        "kept",
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        F.col("alone").alias("unique_fails"),
        *marks,
        "shapley",
    )


def document_measures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The narrow rows that the registered filters read, one per document.

    (part, n_words, n_distinct, n_upper, n_points, has_symbol, copies, good,
    toxic).  Texts are read once, whole, and not moved; null counts as empty.
    A text is a copy if a row of a smaller doc_id has the same text (SHA-256);
    null ids are smaller than none and copies of none.  Rows of ``labels`` that
    repeat an id count as one, with 1 winning.
    """
    scratch = Scratch(docs.sparkSession, "filter-measures")
    text = F.coalesce(F.col("text"), F.lit(""))
    words = words_of(F.col("__text"))
    staged = scratch.put(
        "staged",
        docs.select(F.col("doc_id").alias("__id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("__text"))
        .withColumn("__words", words)
        .select(
            "__id",
            "part",
            F.size("__words").alias("n_words"),
            F.size(F.array_distinct("__words")).alias("n_distinct"),
            F.length(F.regexp_replace("__text", "[^A-Z]+", "")).alias("n_upper"),
            F.length("__text").alias("n_points"),
            F.col("__text").rlike(r"[#$%&*|]").alias("has_symbol"),
            F.unhex(F.sha2("__text", 256)).alias("__digest"),
        ),
    )
    firsts = scratch.put(
        "firsts",
        staged.groupBy(F.col("__digest").alias("__of")).agg(F.min("__id").alias("__least"), F.max("__id").alias("__most")).where("__least < __most").drop("__most"),
    )
    marked = scratch.put(
        "marks",
        labels.groupBy(F.col("doc_id").alias("__doc")).agg(F.max((F.col("quality") == 1).cast("int")).alias("__q"), F.max((F.col("toxic") == 1).cast("int")).alias("__t")),
    )
    rows = (
        staged.join(firsts, F.col("__digest") == F.col("__of"), "left")
        .join(marked, F.col("__id") == F.col("__doc"), "left")
        .select(
            "part", "n_words", "n_distinct", "n_upper", "n_points", "has_symbol",
            F.coalesce(F.col("__least") < F.col("__id"), F.lit(False)).alias("copies"),
            F.coalesce(F.col("__q") == 1, F.lit(False)).alias("good"),
            F.coalesce(F.col("__t") == 1, F.lit(False)).alias("toxic"),
        )
    )
    return scratch.put("rows", rows)


def document_filters() -> dict[str, Column]:
    """Failure conditions over ``document_measures``."""
    return {
        "A": F.col("n_words") < 50,
        "B": 100 * F.col("n_distinct").cast("bigint") < 65 * F.col("n_words").cast("bigint"),
        "C": 100 * F.col("n_upper").cast("bigint") > 5 * F.col("n_points").cast("bigint"),
        "D": F.col("has_symbol"),
        "E": F.col("copies"),
    }


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the registered filters by source; columns beside doc_id, text and source are ignored."""
    marks = {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")}
    return audit(document_measures(docs, labels), document_filters(), "part", marks)
