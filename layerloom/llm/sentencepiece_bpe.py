"""SentencePiece BPE encoding by a table of last tokens, and decoding.

The table holds, for every prefix of a segment, the one token that ends the
encoding of that prefix.  An Aho-Corasick automaton over the vocabulary names
the pieces ending at each place; such a piece is the last token exactly where
it is compatible with the last token of the prefix it leaves, that is, where
merging the two pieces' characters gives back these two pieces.  One row of the
table follows from the earlier ones, and the ids are read off backwards.

The automaton's states are made as texts reach them.  A state is what later rows
can depend on: the characters of which a piece may still be made, and the last
tokens before, between and after them.  So a step that was taken once costs one
lookup, whatever the number of pieces that end there.

Merges never cross the start of a word (no piece has the space mark after
another character) nor a character without a piece, so segments between those
are encoded on their own and remembered.  Runs of space marks, whose pieces
tie in score, are merged by the plain rule: best score first, leftmost first.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain
from operator import getitem

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Ids, and the same in decimal with commas between.
Part = tuple[tuple[int, ...], str]
#: Words of late, pair tests and states that a worker remembers.
WORDS, PAIRS, STATES = 200_000, 300_000, 200_000


def part(ids: Iterable[int]) -> Part:
    ids = tuple(ids)
    return ids, ",".join(map(str, ids))


class State(dict):
    """A row of the table: the last token, its decimal and size, and by the next character the row after it."""

    __slots__ = ("decimal", "last", "size", "table", "tail", "token")

    def __missing__(self, character: str) -> State:
        return self.table.step(self, character)


class PrefixTable:
    """Encoder and decoder for one model file (BPE, identity normaliser, byte fallback)."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not special(i)}
        self.score = {p: sp.get_score(i) for p, i in self.pieces.items()}
        self.text = {i: p for p, i in self.pieces.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece has a space mark inside a word: segments would not be independent")
        self.known = {p for p in self.pieces if len(p) == 1}
        if any(c not in self.known for p in self.pieces for c in p):
            raise ValueError("a piece has a character that is no piece: segments would not be independent")
        self.open = {p[:i] for p in self.pieces for i in range(1, len(p))}
        self.size = {i: len(p) for i, p in self.text.items()}
        #: For a token (-1: nothing), which tokens may follow it, as far as tested.
        self.follows: dict[int, dict[int, bool]] = {}
        self.tested = 0
        self.states: dict[tuple[str, tuple[int, ...]], State] = {}
        self.start = self.state("", (-1,))
        #: By word, with and without a space mark before it; what was not used of late goes.
        self.marked: dict[str, Part] = {}
        self.bare: dict[str, Part] = {}
        self.older: dict[bool, dict[str, Part]] = {True: {}, False: {}}
        self.runs: dict[int, Part] = {}
        self.feed = part([self.bytes[10]])

    def merged(self, text: str) -> list[int]:
        """The plain rule on a short string of known characters."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return [self.pieces[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay as they are side by side; left -1: whether right stands alone."""
        if left < 0:
            return self.merged(self.text[right]) == [right]
        return self.merged(self.text[left] + self.text[right]) == [left, right]

    def fits(self, left: int, right: int) -> bool:
        known = self.follows.setdefault(left, {})
        found = known.get(right)
        if found is None:
            if self.tested >= PAIRS:
                self.follows.clear()
                self.tested = 0
                known = self.follows.setdefault(left, {})
            found = known[right] = self.compatible(left, right)
            self.tested += 1
        return found

    def state(self, tail: str, last: tuple[int, ...]) -> State:
        """The row after ``tail``, whose places have these last tokens, the one before it included."""
        found = self.states.get((tail, last))
        if found is None:
            found = self.states[tail, last] = State()
            found.table, found.tail, found.last, found.token = self, tail, last, last[-1]
            found.decimal, found.size = str(last[-1]), self.size.get(last[-1], 0)
        return found

    def step(self, state: State, character: str) -> State:
        """The row after one more character: the one piece that fits what it leaves ends there."""
        tail, last = state.tail + character, state.last
        for begin in range(len(tail)):
            token = self.pieces.get(tail[begin:])
            if token is not None and self.fits(last[begin], token):
                break
        else:
            raise ValueError(f"no piece ends the encoding at {character!r}")
        if len(self.states) >= STATES:
            for old in self.states.values():
                old.clear()  # states refer to each other
            self.states = {("", (-1,)): self.start}
        begin = 0
        while begin < len(tail) and tail[begin:] not in self.open:
            begin += 1
        found = state[character] = self.state(tail[begin:], (*last[begin:], token))
        return found

    def segment(self, segment: str) -> Part:
        """The part of a string of known characters with a space mark at its start at most."""
        rows = list(accumulate(segment, getitem, initial=self.start))
        ids, decimals, end = [], [], len(segment)
        while end:
            row = rows[end]
            ids.append(row.token)
            decimals.append(row.decimal)
            end -= row.size
        ids.reverse()
        decimals.reverse()
        return tuple(ids), ",".join(decimals)

    def run(self, n: int) -> Part:
        """Ids of n space marks that no letter follows in a piece.

        All pieces of marks tie, so the leftmost mergeable pair merges first.
        Merges of a tie go on from the left until the string of parts is
        stable; parts are kept as lengths.
        """
        found = self.runs.get(n)
        if found is None:
            if len(self.runs) >= 1000:
                self.runs.clear()
            found = self.runs[n] = part(self._run(n))
        return found

    def _run(self, n: int) -> list[int]:
        import heapq

        can = {len(p): s for p, s in self.score.items() if not p.strip(MARK)}
        size, after, before = [1] * n, [*range(1, n), -1], [*range(-1, n - 1)]
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := can.get(size[i] + size[j])) is not None:
                heapq.heappush(heap, (-s, i, size[i], size[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if size[i] != a or (j := after[i]) < 0 or size[j] != b:
                continue
            size[i], size[j], after[i] = a + b, 0, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [self.pieces[MARK * s] for s in size if s]

    def split(self, text: str) -> Part:
        """The part of a text with a space mark at its start at most: segments between characters without a piece."""
        if self.known.issuperset(text):
            return self.segment(text)
        ids: list[int] = []
        begin = 0
        for i, c in enumerate(text):
            if c not in self.known:
                if i > begin:
                    ids += self.segment(text[begin:i])[0]
                ids += [self.bytes[b] for b in c.encode()]
                begin = i + 1
        if begin < len(text):
            ids += self.segment(text[begin:])[0]
        return part(ids)

    def word(self, word: str, marked: bool) -> Part:
        """What lies between two space marks, with or without the first one; words of lines are remembered."""
        store = self.marked if marked else self.bare
        found = store.get(word)
        if found is not None:
            return found
        found = self.older[marked].get(word)
        lines = "\n" in word
        if found is None:
            found = self.lines(word, marked) if lines else self.split(MARK + word if marked else word)
        if len(word) <= 64 and not lines:
            if len(store) >= WORDS:
                self.older[marked] = store
                store = {}
                if marked:
                    self.marked = store
                else:
                    self.bare = store
            store[word] = found
        return found

    def lines(self, word: str, marked: bool) -> Part:
        ids: list[int] = []
        for k, line in enumerate(word.split("\n")):
            if k:
                ids.append(self.bytes[10])
            if line or marked and not k:
                ids += self.word(line, marked and not k)[0]
        return part(ids)

    def parts(self, text: str) -> list[Part]:
        """Ids in decimal and as numbers, part by part."""
        if not text:
            return []
        text = text.replace(" ", MARK)
        lines = text.split("\n")
        out: list[Part | None] = []
        marked = self.marked.get
        free = True
        for line in lines:
            words = line.split(MARK)
            if out:
                out.append(self.feed)
                if words[0]:
                    out.append(self.word(words[0], False))
                del words[0]
            if "" in words:
                free = False
                break
            at = len(out)
            out += map(marked, words)
            if None in out[at:]:
                for i, w in enumerate(words, at):
                    if out[i] is None:
                        out[i] = self.word(w, True)
        if free:
            return out
        words = text.split(MARK)
        out = list(map(marked, words))
        spaced: list[Part] = []
        gap = 1
        for w, found in zip(words, out, strict=True):
            if not w:
                gap += 1
                continue
            found = found or self.word(w, True)
            if gap == 1:
                spaced.append(found)
            elif found[0][0] != self.pieces[MARK]:
                spaced += [self.run(gap - 1), found]
            else:  # this mark is free to join the run before it
                spaced += [self.run(gap), part(found[0][1:])]
            gap = 1
        if gap > 1:
            spaced.append(self.run(gap - 1))
        return [p for p in spaced if p[0]]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([p[0] for p in self.parts(text)]))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_tables: dict[str, PrefixTable] = {}


def prefix_table(model_file: str) -> PrefixTable:
    """One table per worker and model.

    The stores hold no cycles, so the worker's collector, which would walk all
    of them again and again, is told to come by rarely.
    """
    gc.set_threshold(20_000_000, 100, 1000)
    if model_file not in _tables:
        _tables[model_file] = PrefixTable(model_file)
    return _tables[model_file]


def encode_documents(docs: DataFrame, model_file: str, text_col: str = "text", rows: int = 64) -> DataFrame:
    """``docs`` with ``ids`` array<int> and ``decoded``; null text counts as empty, giving no ids and ''.

    Every worker opens ``model_file`` by itself; the vocabulary is one fixed file.
    Rows pass one by one, so memory holds an Arrow batch and one text's ids.
    """
    from pyspark.sql import types as T

    docs = docs.drop("ids", "decoded")  # columns of the caller by these names give way
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model_file)
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                some = batch.slice(begin, rows)
                texts = some.column(some.schema.get_field_index(text_col)).to_pylist()
                ids = [table.encode(t or "") for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        *some.columns,
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([table.decode(i) for i in ids], pa.string()),
                    ],
                    names=[*some.schema.names, "ids", "decoded"],
                )

    return docs.mapInArrow(work, schema)


def encoded_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``docs``, without moving ids out of the workers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model_file)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for value in batch.column(1):
                parts = table.parts(value.as_py() or "")
                ids = list(chain.from_iterable([p[0] for p in parts]))
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(table.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
