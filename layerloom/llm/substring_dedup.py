"""Exact removal of repeated substrings: every byte of a string of ``length`` bytes that starts elsewhere too.

1.  Places: in every window of ``length`` bytes the k-grams with the smallest
    hash are its anchors, so two equal windows have equal anchors at equal
    offsets.  Only anchors whose hash occurs twice or more go on.
2.  Classes: an anchor's context is what a window around it can hold.  Equal
    contexts are one class; a task sends each class once.
3.  Every group of classes with one hash is sorted deep-shallow, by what
    follows the anchor and by what stands before it, reversed; from the two
    orders follows how far each class repeats (``deep_shallow.repeated_spans``).
4.  A group with too many classes for a task is first parted like the strings of
    a multikey quicksort, only by Spark: its windows are cut into ranges of
    offsets, and the key of a part is what all windows of a range share, on both
    sides of the anchor.  Parts that fit a task are sorted as above, larger ones
    are parted again by longer keys; at single windows a part holds equal
    strings only.  Parts are counted by pre-aggregated digests of their keys, so
    no large group has to meet in a task, and how many tasks saw a class does
    not matter.
5.  Spans go back to their documents, and what they cover is cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deep_shallow import repeated_spans
from .scratch import Scratch

#: Anchors are multiples of so many bytes; bytes hashed at once; classes that one task sorts together; ranges that a range is cut into.
WORD, CHUNK, CROWD, SPLIT = 32, 1 << 20, 256, 8
#: Words of a passage that counts as an echo, words of its anchor, and words hashed at once.
ECHO, ECHO_GRAM, ECHO_CHUNK = 51, 32, 1 << 17
#: Turns of cutting ranges by SPLIT; enough for windows of 8**16 offsets.
MOST_TURNS = 16
M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def gram_size(length: int) -> int:
    """Bytes of an anchor: nearly half a window, so that a short common line anchors nothing."""
    return max(WORD, length * 48 // 100 // WORD * WORD)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash, above 0, of the ``gram`` bytes from every place on."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    word = np.zeros(len(data) - 7, np.uint64)
    for j in range(8):
        word |= data[j : len(data) - 7 + j].astype(np.uint64) << np.uint64(8 * j)
    line = np.zeros(len(data) - WORD + 1, np.uint64)
    for j in range(WORD // 8):
        line ^= word[8 * j : 8 * j + len(line)] * M[j]
        line = (line << np.uint64(23)) | (line >> np.uint64(41))
    h = np.zeros(n, np.uint64)
    for j in range(0, gram, WORD):
        h = ((h << np.uint64(29)) | (h >> np.uint64(35))) * M[3]
        h ^= line[j : j + n]
    h ^= h >> np.uint64(31)
    h *= M[1]
    h ^= h >> np.uint64(29)
    return h | np.uint64(1)


def sliding(values: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """``best`` over values[i : i + width] for every i, in two passes over blocks of that width."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, fill, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of anchors in documents data[starts[i] : starts[i + 1]]; windows stay inside documents."""
    gram = gram_size(length)
    return chosen(gram_hashes(data, gram), starts, length, gram)


def chosen(h: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams (hashes ``h``) that are the least of a window of ``length``; windows stay inside documents."""
    width = length - gram + 1
    least = sliding(h, width, np.minimum, 2**64 - 1)
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # A window counts where it ends in the document that it starts in.
    ends = np.repeat(starts[1:], np.diff(starts))[: len(least)]
    least[np.arange(len(least)) + length > ends] = 0
    around = np.zeros(len(h) + width - 1, np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(sliding(around, width, np.maximum, 0)[: len(h)] == h)
    return at, h[at]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M[1]
    x = (x ^ (x >> np.uint64(27))) * M[2]
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of values[low : high] for every pair of places."""
    base = int(M[0])
    upto = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=upto[1:])
    back = powers(pow(base, -1, 2**64), len(values) + 1)
    return mixed((upto[high] - upto[low]) * back[low])


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (what stands between spaces, tabs and line ends), and the first word of every document."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    before = inside[:-1].copy()
    before[starts] = 0  # a word ends where its document does
    after = inside[1:].copy()
    after[starts] = inside[starts + 1]
    low = np.flatnonzero(after[:-1] & ~before[:-1] & 1)
    stop = inside[1:].copy()
    stop[starts] = 0
    high = np.flatnonzero(inside[1:-1] & (1 - stop[1:])) + 1
    return sums(data.astype(np.uint64) + np.uint64(1), low, high), np.searchsorted(low, starts)


def echo_anchors(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(document, different hashes) of anchors of ECHO words in a row, whatever stands between words."""
    first, step = 0, CHUNK
    while first < len(starts) - 1:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + step, "right")) - 1)
        words, at = word_hashes(data[starts[first] : starts[last]], starts[first : last + 1] - starts[first])
        docs, hashes = [], []
        for begin in range(0, max(1, len(words) - ECHO + 1), ECHO_CHUNK):
            some = words[begin : begin + ECHO_CHUNK + ECHO - 1]
            if len(some) < ECHO:
                break
            low = np.arange(len(some) - ECHO_GRAM + 1)
            bounds = np.clip(at - begin, 0, len(some))
            places, found = chosen(sums(some, low, low + ECHO_GRAM) | np.uint64(1), bounds, ECHO, ECHO_GRAM)
            docs.append(np.searchsorted(at, places + begin, "right") - 1)
            hashes.append(found)
        if docs:
            doc, h = np.concatenate(docs), np.concatenate(hashes)
            for d in np.unique(doc):
                yield first + int(d), np.unique(h[doc == d])
        first = last


def document_anchors(data: np.ndarray, starts: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(document, places in it, hashes), chunk by chunk; long documents are taken in overlapping pieces."""
    margin = 2 * length
    first = 0
    while first < len(starts) - 1:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK, "right")) - 1)
        begin, end = int(starts[first]), int(starts[last])
        if last == first + 1 and end - begin > CHUNK:
            for at in range(begin, end, CHUNK):
                low, high = max(begin, at - margin), min(end, at + CHUNK + margin)
                places, hashes = anchors(data[low:high], np.array([0, high - low]), length)
                own = (places + low >= at) & (places + low < at + CHUNK)
                if own.any():
                    yield first, places[own] + low - begin, hashes[own]
        elif end - begin >= length:
            places, hashes = anchors(data[begin:end], starts[first : last + 1] - begin, length)
            doc = np.searchsorted(starts[first : last + 1] - begin, places, "right") - 1
            cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
            for a, b in zip(cut, np.append(cut[1:], len(doc)), strict=True):
                d = int(doc[a])
                yield first + d, places[a:b] - int(starts[first + d] - begin), hashes[a:b]
        first = last


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the starts of its texts (null: empty)."""
    texts = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), starts - starts[0]
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, hash, c): how often an anchor hash occurs in a document; c is 0 for the anchors of echoes."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, starts = utf8(batch.column(2))
        rows, hashes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for d, _, h in document_anchors(data, starts, length):
            u, c = np.unique(h, return_counts=True)
            rows.append(np.full(len(u), d))
            hashes.append(u)
            counts.append(c)
        for d, u in echo_anchors(data, starts):
            rows.append(np.full(len(u), d))
            hashes.append(u)
            counts.append(np.zeros(len(u), np.int64))
        take = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int64))],
            names=["doc_id", "th", "hash", "c"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                yield found(batch.slice(begin, 1000))

    return docs.select("doc_id", "th", "text").mapInArrow(work, "doc_id bigint, th bigint, hash bigint, c bigint")


CONTEXT = "kind int, doc_id bigint, th bigint, hash bigint, c1 bigint, at array<int>, n bigint, l int, ctx binary"


def _contexts(docs: DataFrame, length: int) -> DataFrame:
    """Rows (doc_id, th, hashes, text): members (kind 0), classes (1), and what a task saw of a class after the first time (2)."""
    before = length - gram_size(length)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        counts: dict[tuple[int, int], int] = {}
        out: list[list] = [[] for _ in range(9)]

        def put(*row) -> None:
            for column, value in zip(out, row, strict=True):
                column.append(value)

        def flush() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.binary())
            names = ["kind", "doc_id", "th", "hash", "c1", "at", "n", "l", "ctx"]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
            for column in out:
                column.clear()
            return made

        for batch in batches:
            data, starts = utf8(batch.column(3))
            for d, places, hashes in document_anchors(data, starts, length):
                wanted = batch.column(2)[d].values.to_numpy()
                keep = np.isin(hashes.view(np.int64), wanted)
                if not keep.any():
                    continue
                text = data[starts[d] : starts[d + 1]].tobytes()
                doc_id, th = batch.column(0)[d].as_py(), batch.column(1)[d].as_py()
                mine: dict[tuple[int, int], list[int]] = {}
                for p, h in zip(places[keep].tolist(), hashes[keep].view(np.int64).tolist(), strict=True):
                    low = max(0, p - before)
                    ctx = text[low : p + length]
                    dig = xxh3_64_intdigest(ctx, p - low)
                    key = (h, dig - 2**64 if dig >= 2**63 else dig)
                    mine.setdefault(key, []).append(p)
                    if key not in counts:
                        counts[key] = -1  # the row of the class stands for one place
                        put(1, None, None, *key, None, 1, p - low, ctx)
                for key, at in mine.items():
                    counts[key] += len(at)
                    put(0, doc_id, th, *key, at, len(at), None, None)
                if len(out[0]) >= 4096:
                    yield flush()
        for key, n in counts.items():
            if n:
                put(2, None, None, *key, None, n, None, None)
            if len(out[0]) >= 4096:
                yield flush()
        yield flush()

    return docs.select("doc_id", "th", "hashes", "text").mapInArrow(work, CONTEXT)


SPANS = "hash bigint, c1 bigint, spans array<struct<l:int,r:int>>"


def _sorted_groups(classes: DataFrame, length: int) -> DataFrame:
    """Spans of the classes (part, hash, c1, n, l, ctx, low, high): of windows that start low to high bytes before the anchor.

    The rows of a part lie together in one partition, in order of the part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple[int, int], list] = {}
        current = None
        out: list[list] = [[], [], []]

        def close() -> None:
            if not group or sum(g[0] for g in group.values()) < 2:
                return
            keys = list(group)
            lefts = [ctx[max(0, l - high) : l][::-1] for _, l, ctx, _, high in group.values()]
            rights = [ctx[l : l + length - low] for _, l, ctx, low, _ in group.values()]
            for k, spans in zip(keys, repeated_spans(lefts, rights, [g[0] for g in group.values()], length), strict=True):
                if spans:
                    for column, value in zip(out, (*k, [{"l": a, "r": b} for a, b in spans]), strict=True):
                        column.append(value)

        def flush() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("l", pa.int32()), ("r", pa.int32())]))
            made = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:2]), pa.array(out[2], kind)], names=["hash", "c1", "spans"])
            for column in out:
                column.clear()
            return made

        for batch in batches:
            for part, h, c1, n, l, ctx, low, high in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if part != current:
                    close()
                    group.clear()
                    current = part
                g = group.setdefault((h, c1), [0, 0, b"", low, high])
                g[0] += n
                if ctx is not None:
                    g[1], g[2] = l, ctx
            if len(out[0]) >= 4096:
                yield flush()
        close()
        yield flush()

    rows = classes.select("part", "hash", "c1", "n", "l", "ctx", "low", "high").repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(work, SPANS)


def _whole_groups(classes: DataFrame, length: int) -> DataFrame:
    """Spans of classes (hash, c1, n, l, ctx) with few others of their hash."""
    return _sorted_groups(classes.select(F.col("hash").alias("part"), "*", F.lit(0).alias("low"), F.lit(length - gram_size(length)).alias("high")), length)


def _parted_groups(classes: DataFrame, length: int, scratch: Scratch) -> list[DataFrame]:
    """Spans of classes (hash, c1, n, l, ctx), each there once, of hashes with more classes than a task sorts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        signed = lambda x: x - 2**64 if x >= 2**63 else x
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for h, c1, n, l, ctx, low, high in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                # Offsets are cut at the same places in all classes, so that equal windows fall into equal ranges.
                step = max(1, -(-(high - low + 1) // SPLIT))
                for a in range(low, high + 1, step):
                    b = min(a + step - 1, high)
                    # Windows start o bytes before the anchor; those this context can hold:
                    first, last = max(a, length - (len(ctx) - l)), min(b, l)
                    if first > last:
                        continue
                    core = xxh3_64_intdigest(ctx[l - a : l + length - b], h % 2**64 ^ a * 65536 ^ b)
                    span = xxh3_64_intdigest(ctx[l - last : l + length - first], first * 65536 + last)
                    for column, value in zip(out, (h, c1, a, b, first, last, n, signed(core), signed(span)), strict=True):
                        column.append(value)
            kinds = (*[pa.int64()] * 2, *[pa.int32()] * 4, *[pa.int64()] * 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                names=["hash", "c1", "low", "high", "first", "last", "n", "core", "span"],
            )

    found: list[DataFrame] = []
    key = ["hash", "c1"]
    todo = classes.select(*key, "n", "l", "ctx", F.lit(0).alias("low"), F.lit(length - gram_size(length)).alias("high"))
    for turn in range(MOST_TURNS):
        ranges = scratch.put(f"ranges{turn}", todo.mapInArrow(work, "hash bigint, c1 bigint, low int, high int, first int, last int, n bigint, core bigint, span bigint"))
        if turn:
            scratch.drop(f"mixed{turn - 1}")
        # A range whose very bytes come twice is done; one that only shares the
        # key of its part goes on, together with one of each that is done.
        rid = F.xxhash64(*key)
        spans = scratch.put(f"spans{turn}", ranges.groupBy("core", "span").agg(F.sum("n").alias("own"), F.min(rid).alias("rid")))
        cores = spans.groupBy("core").agg(F.sum("own").alias("total"), F.min("own").alias("least"), F.count(F.lit(1)).alias("strings")).where("total > 1").select("core", (F.col("least") == 1).alias("open"), "strings")
        judged = scratch.put(f"cores{turn}", spans.join(cores, "core"))
        known = ranges.join(judged, ["core", "span"])
        whole = known.where("own > 1").select(*key, F.array(F.struct(F.col("last").alias("l"), (F.lit(length) - F.col("first")).cast("int").alias("r"))).alias("spans"))
        found.append(scratch.put(f"whole{turn}", whole))
        mixed = known.where(F.col("open") & (F.col("rid") == rid) & (F.col("low") < F.col("high")))
        mixed = scratch.put(f"mixed{turn}", mixed.select(F.col("core").alias("part"), *key, F.col("own").alias("n"), "low", "high", (F.col("strings") <= CROWD).alias("fits")))
        scratch.drop(f"ranges{turn}", f"spans{turn}", f"cores{turn}")
        shown = classes.select(*key, "l", "ctx").join(mixed, key)
        found.append(scratch.put(f"parts{turn}", _sorted_groups(shown.where("fits"), length)))
        todo = shown.where("not fits").select(*key, "n", "l", "ctx", "low", "high")
        if mixed.where("not fits").isEmpty():
            scratch.drop(f"mixed{turn}")
            return found
    raise RuntimeError("ranges of windows were not cut down to single ones")


def repeated(
    docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): doc_id, th, text, and for (doc_id, th) found, the spans (lo, hi) of bytes to remove, hi exclusive.

    Documents without a repeat have null or no spans; n_echoes counts a
    document's anchors of passages of ECHO words that stand in other documents too.

    ``th`` is a hash of the text; rows alike in id and text share their spans.
    """
    if length < 2 * WORD:
        raise ValueError(f"length must be {2 * WORD} bytes or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    long_enough = docs.where(F.octet_length("text") >= length)
    enough = docs.where(F.octet_length("text") >= min(length, 2 * ECHO - 1))
    places = scratch.put("places", _anchor_rows(enough, length))
    echo = F.col("c") == 0
    often = scratch.put("often", places.groupBy("hash", echo.alias("echo")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("m")).where(F.when(F.col("echo"), F.col("m") > 1).otherwise(F.col("c") > 1)).select("hash", "echo"))
    met = scratch.put(
        "met",
        places.withColumn("echo", echo).join(often, ["hash", "echo"]).groupBy(F.col("doc_id").alias("wid"), F.col("th").alias("wth"))
        .agg(F.collect_set(F.when(~F.col("echo"), F.col("hash"))).alias("hashes"), F.count_if("echo").alias("n_echoes")),
    )
    wanted = met.where(F.size("hashes") > 0).select("wid", "wth", "hashes")
    echoes = scratch.put("echoes", met.select("wid", "wth", "n_echoes"))
    scratch.drop("places", "often")
    same = lambda a, b: a["doc_id"].eqNullSafe(F.col(f"{b}id")) & (a["th"] == F.col(f"{b}th"))
    rows = scratch.put("contexts", _contexts(long_enough.join(wanted, same(long_enough, "w")), length))
    scratch.drop("met")

    classes = rows.where("kind > 0").select("hash", "c1", "n", "l", "ctx")
    # Rows of a hash that many tasks sent are first brought down to one per class.
    sent = scratch.put("sent", rows.where("kind = 1").groupBy("hash").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CROWD).select("hash"))
    key = ["hash", "c1"]
    if sent.isEmpty():
        found = [scratch.put("sorted", _whole_groups(classes, length))]
    else:
        found = [scratch.put("sorted", _whole_groups(classes.join(sent, "hash", "left_anti"), length))]
        inside = classes.join(sent, "hash", "left_semi")
        counted = inside.groupBy(*key).agg(F.sum("n").alias("n"))
        shown = inside.where("ctx is not null").groupBy(*key).agg(F.first("l").alias("l"), F.first("ctx").alias("ctx"))
        once = scratch.put("once", counted.join(shown, key))
        large = scratch.put("large", once.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CROWD).select("hash"))
        found.append(scratch.put("few", _whole_groups(once.join(large, "hash", "left_anti"), length)))
        if not large.isEmpty():
            found += _parted_groups(once.join(large, "hash", "left_semi"), length, scratch)
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    spans = scratch.put("spans", spans.select(*key, F.explode("spans").alias("s")).select(*key, "s.l", "s.r").distinct())
    scratch.drop("sorted", "once", "few", "large", *[f"{name}{turn}" for name in ("whole", "parts") for turn in range(MOST_TURNS)])
    members = rows.where("kind = 0").select("doc_id", "th", *key, "at")
    cut = scratch.put(
        "cut",
        members.join(spans, key)
        .select("doc_id", "th", F.explode("at").alias("p"), "l", "r")
        .groupBy("doc_id", "th")
        .agg(F.collect_set(F.struct((F.col("p") - F.col("l")).alias("lo"), (F.col("p") + F.col("r")).alias("hi"))).alias("found")),
    )
    scratch.drop("contexts", "sent", "spans")
    same_doc = F.col("doc_id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth"))
    found = scratch.put("found", echoes.join(cut, same_doc, "left").select(F.col("wid").alias("doc_id"), F.col("wth").alias("th"), "found", "n_echoes"))
    scratch.drop("cut", "echoes")
    return docs, found


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (binary: what is left), spans (array of lo, hi), n_echoes.

    ``n_echoes`` tells of passages of words, most of which are shorter than
    ``length`` and stay: every ``ECHO`` words in a row that stand in another row
    too, whatever is between the words, have an anchor (``ECHO_GRAM`` words) that is counted.

    Null text counts as empty; texts shorter than ``length`` bytes are left
    alone; repeated rows repeat each other.  ``kept`` can be invalid UTF-8, as a
    repeat may start or end inside a character.
    """
    docs, cut = repeated(docs, length, id_col, text_col)
    gathered = cut.select(F.col("doc_id").alias("sid"), F.col("th").alias("sth"), "found", "n_echoes")
    joined = docs.join(gathered, docs["doc_id"].eqNullSafe(F.col("sid")) & (docs["th"] == F.col("sth")), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                out: list[list] = [[], [], [], [], []]
                for text, found in zip(part.column(1), part.column(2), strict=True):
                    data = (text.as_py() or "").encode()
                    merged: list[list[int]] = []
                    for lo, hi in sorted((s["lo"], s["hi"]) for s in found.as_py() or ()):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], hi)
                        else:
                            merged.append([lo, hi])
                    kept, at = [], 0
                    for lo, hi in merged:
                        kept.append(data[at:lo])
                        at = hi
                    kept.append(data[at:])
                    left = b"".join(kept)
                    for column, value in zip(out, (len(data), len(data) - len(left), len(merged), left, [{"lo": a, "hi": b} for a, b in merged]), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary()), pa.array(out[4], kind), part.column(3)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans", "n_echoes"],
                )

    return joined.select("doc_id", "text", "found", F.coalesce("n_echoes", F.lit(0).cast("bigint")).alias("n_echoes")).mapInArrow(
        work, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<struct<lo:int,hi:int>>, n_echoes bigint"
    )
