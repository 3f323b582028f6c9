"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs.  An n-gram is bound by multiplying
its letters' vectors, each rotated by its place; texts and languages are
bundles (sums) of their n-grams' vectors, and a text gets the language whose
bundle has the largest cosine with its own.  Bundles hold whole numbers, so
sums do not depend on the order in which partitions arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Symbols: 0 stands for any run of non-letters, 1-26 for a-z, the others for further letters by code point.
SYMBOLS, DIM, SEED, CHUNK = 48, 1024, 20, 1 << 20
#: Profiles go to every worker: 8 KB each.
MOST_LANGUAGES = 20_000


class Profiler:
    """Turns text into counts over the rows of a growing table of trigram vectors."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.letters = rng.choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))
        self.symbol = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                self.symbol[c] = 27 + c % (SYMBOLS - 27)
        for k in range(26):
            self.symbol[97 + k] = self.symbol[65 + k] = k + 1
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.vectors = np.zeros((0, DIM), np.int8)
        self.n = 0

    def codes(self, text: str) -> np.ndarray:
        """Trigram codes of a whole text, taken in chunks; empty without letters."""
        parts, tail = [], np.zeros(1, np.int32)
        for at in range(0, len(text), CHUNK):
            chunk = text[at : at + CHUNK].lower()
            s = self.symbol[np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
            s = np.concatenate([tail, s])
            parts.append(s[:-1] if at + CHUNK < len(text) else np.append(s, 0))
            tail = s[-1:]
        if not parts:
            return np.zeros(0, np.int32)
        s = np.concatenate(parts)
        s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]
        if len(s) < 3:
            return np.zeros(0, np.int32)
        return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]

    def rows(self, codes: np.ndarray) -> np.ndarray:
        rows = self.row[codes]
        if len(rows) and rows.min() < 0:
            new = np.unique(codes[rows < 0])
            while self.n + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros((max(4096, len(self.vectors)), DIM), np.int8)])
            a, b, c = new // SYMBOLS**2, new // SYMBOLS % SYMBOLS, new % SYMBOLS
            bound = np.roll(self.letters, 2, 1)[a] * np.roll(self.letters, 1, 1)[b] * self.letters[c]
            self.vectors[self.n : self.n + len(new)] = bound
            self.row[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
            rows = self.row[codes]
        return rows

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = np.bincount(self.rows(self.codes(text)), minlength=1)
        at = np.flatnonzero(found)
        return at, found[at]

    def bundle(self, text: str) -> np.ndarray | None:
        at, n = self.counts(text)
        return n.astype(np.float32) @ self.vectors[at].astype(np.float32) if len(at) else None


_profiler: list[Profiler] = []


def profiler() -> Profiler:
    """One table per worker; it holds SYMBOLS**3 rows of DIM bytes (113 MB) at most."""
    if not _profiler:
        _profiler.append(Profiler())
    return _profiler[0]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(texts: DataFrame) -> dict[str, np.ndarray]:
    """Profiles from rows (text, lang): one bundle of signed n-gram counts per language.

    Every task emits one whole-number vector per language; sums are pre-aggregated
    by (language, dimension).  Rows without text or language teach nothing.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, sums = profiler(), {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                at, n = p.counts(text.as_py())
                if len(at):
                    total = sums.setdefault(lang.as_py(), np.zeros(SYMBOLS**3, np.int64))
                    total[at] += n
        for lang, total in sorted(sums.items()):
            used = total[: p.n].astype(np.float64)
            vector = (used @ p.vectors[: p.n].astype(np.float64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([vector.tolist()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = texts.where("text is not null and lang is not null").mapInArrow(work, "lang string, v array<bigint>")
    summed = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    summed = Scratch(texts.sparkSession, "language").put("profiles", summed)
    if (n := summed.where("k = 0").count()) > MOST_LANGUAGES:
        raise ValueError(f"{n} languages: profiles would outgrow the workers")
    found: dict[str, np.ndarray] = {}
    for r in summed.collect():  # DIM rows per language
        found.setdefault(r["lang"], np.zeros(DIM))[r["k"]] = r["x"]
    return found


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the cosine with the winning profile (below 0 counts as 0).

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned.  Equal cosines: the first language by code point.
    """
    from pyspark.sql import types as T

    names = sorted(profiles)
    unit = np.array([profiles[k] / max(np.linalg.norm(profiles[k]), 1e-12) for k in names], np.float64).reshape(len(names), DIM)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiler()
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(batch.schema.get_field_index(text_col)):
                bundle = p.bundle(text.as_py() or "") if names else None
                if bundle is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                cosine = unit @ (bundle / max(float(np.linalg.norm(bundle)), 1e-12))
                best = int(np.argmax(cosine))
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosine[best]))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(work, schema)


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with held_out, lang_pred and score.

    Profiles come from texts whose id is not held out and whose language is
    given; predictions read the text alone.
    """
    docs = docs.drop("held_out", "lang_pred", "score")  # columns of the caller by these names give way
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    profiles = learn(marked.where("not held_out").select("text", "lang"))
    return predict(marked, profiles)
