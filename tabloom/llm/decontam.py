"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents become sequences of normalised words. The automaton holds
every run of words of every item; a document's words are streamed through it and
the length of the longest match that ends at each word is known. A word is hit
if it lies in a match of ``window`` words or more, or in a whole item of fewer.

Words that aren't in any item, and pairs of words that follow each other in none,
set the automaton back to its start, so only the stretches between them are
streamed; they are found with array operations.

Items go to the tasks in blocks of at most BLOCK_WORDS words, each a broadcast of
bounded size and an automaton of its own; items longer than that are cut with an
overlap of window - 1 words, which keeps every window. A benchmark of one block takes
one pass over the documents, in which nothing is shuffled. More blocks take a pass
each, one after the other, over documents that were numbered and written; a pass
writes the hits of its block, and the broadcast is given up before the next block is
read, so that driver and workers hold one block at a time. The hits of all passes,
which are few, are joined to the documents by their numbers.

Defined cases: NULL and empty texts have no words; NULL item ids are the empty
string; repeated items and documents count as they are; an empty benchmark hits
nothing; other columns of the documents stay.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.batches import free_name, text_batches
from tabloom.sources.files import materialise

BLOCK_WORDS = 200_000
WINDOW = 10
COVERAGE = 0.5
#: A-Z to a-z; the other ASCII characters but digits and letters to spaces.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PAIR_BITS = 22


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_NORMAL).split() if text else []


class Automaton:
    """A generalised suffix automaton over items of word numbers, and what the windows of the items end in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        coded = [(name, [number(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.ends: dict[int, set[str]] = defaultdict(set)  # by the state of a full window
        self.whole: dict[int, list[tuple[int, str]]] = defaultdict(list)  # by the state of a short item
        self.single: dict[int, set[str]] = defaultdict(set)  # items of one word
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        self.least = window
        for name, ids in coded:
            if len(ids) == 1:
                self.single[ids[0]].add(name)
                continue
            self.least = min(self.least, len(ids))
            a = np.array(ids, np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True
            state = matched = 0
            for c in ids:
                state, matched = self._step(state, matched, c)
                if matched >= window:
                    self.ends[self._cut(state)].add(name)
            if len(ids) < window:
                self.whole[state].append((len(ids), name))
        self.alone = np.zeros(len(self.vocabulary) + 1, bool)
        self.alone[list(self.single)] = True
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.up = [-1] * len(order)  # the nearest state on the way to the start that a short item ends in
        for s in order:
            self.up[s] = s if s in self.whole else self.up[self.link[s]] if s else -1

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the word c after state p, cut off from the longer runs in q."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._new(self.length[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        now = self._new(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = now
            p = self.link[p]
        if p >= 0:
            self.link[now] = self._split(p, c, self.next[p][c])
        return now

    def _step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], matched + 1
        return 0, 0

    def _cut(self, state: int) -> int:
        """The state of the last ``window`` words of a match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA6B) >> 7 & ((1 << _PAIR_BITS) - 1)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The spans of words that are hit, apart and in order, and the items that hit them."""
        n, found = len(words), set()
        marks = np.zeros(n + 1, np.int32)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, n)
        for i in np.flatnonzero(self.alone[ids]) if self.single else ():
            marks[i] += 1
            marks[i + 1] -= 1
            found |= self.single[int(ids[i])]
        if n >= self.least > 1:
            follows = self.pairs[self._pair(ids[:-1], ids[1:])] & (ids[:-1] >= 0) & (ids[1:] >= 0)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], follows.view(np.int8), [0]))))
            for a, b in zip(edges[::2], edges[1::2] + 1, strict=True):
                if b - a >= self.least:
                    self._stream(ids[a:b].tolist(), int(a), marks, found)
        hit = np.cumsum(marks[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
        return list(zip(edges[::2], edges[1::2], strict=True)), found

    def _stream(self, ids: list[int], at: int, marks: np.ndarray, found: set[str]) -> None:
        state = matched = 0
        for i, c in enumerate(ids, at):
            state, matched = self._step(state, matched, c)
            if matched >= self.window:
                marks[i + 1 - self.window] += 1
                marks[i + 1] -= 1
                found |= self.ends[self._cut(state)]
            s = self.up[state]
            while s >= 0:
                for n, name in self.whole[s]:
                    if n <= matched:
                        marks[i + 1 - n] += 1
                        marks[i + 1] -= 1
                        found.add(name)
                s = self.up[self.link[s]] if s else -1


def item_blocks(benchmark: DataFrame, window: int, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of at most about ``most`` words; the driver holds one at a time."""
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").toLocalIterator():
        words = words_of(row["text"])
        for start in range(0, max(1, len(words) - window + 1), most):
            part = words[start : start + most + window - 1]
            if size and size + len(part) > most:
                yield block
                block, size = [], 0
            block.append((row["i"], part))
            size += len(part)
    yield block


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_HITS = T.StructType(
    [
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
        T.StructField("hit_words", T.LongType()),
    ]
)


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cut: bool = False) -> DataFrame:
    """The documents with hit_spans ([first, end) word numbers), hit_items (sorted) and hit_words (their number of words).

    cut: the spans are cut out of the texts, and n_chars kept true.
    """
    docs = text_batches(docs.drop(*_HITS.names))
    sc = docs.sparkSession.sparkContext
    blocks = item_blocks(benchmark, window)
    first, second = next(blocks), next(blocks, None)
    schema = T.StructType([*docs.schema.fields, *_HITS.fields])
    if second is None:
        match = _matcher(sc.broadcast(first), uuid.uuid4().hex, window)
        return docs.mapInArrow(_finisher(match, cut), schema)
    row, own = free_name(docs, "hit_row"), free_name(docs, "hit_of")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hits = []
    for block in chain([first, second], blocks):
        sent = sc.broadcast(block)
        found = numbered.select(F.col(row).alias("row"), "text").mapInArrow(_hits_only(_matcher(sent, uuid.uuid4().hex, window)), "row long, spans array<array<int>>, items array<string>")
        hits.append(materialise(found, "hits"))
        sent.destroy()
    every = reduce(DataFrame.union, hits).groupBy(F.col("row").alias(own))
    every = every.agg(F.flatten(F.collect_list("spans")).alias("hit_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("hit_items"))
    joined = numbered.join(every, F.col(row) == F.col(own), "left")
    joined = joined.select(*docs.columns, *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("hit_spans", "array<array<int>>"), ("hit_items", "array<string>"))))
    return joined.mapInArrow(_finisher(None, cut), schema)


#: The automaton that this process built last, by the block's name.
_BUILT: dict[str, Automaton] = {}


def _matcher(block, name: str, window: int):
    """A function that gives the automaton of a block; a worker builds it once and keeps one at a time."""

    def automaton() -> Automaton:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Automaton(block.value, window)
        return _BUILT[name]

    return automaton


def _hits_only(match):
    def run(batches):
        automaton = match()
        for batch in batches:
            rows, spans, items = [], [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                got, names = automaton.match(words_of(text.as_py()))
                if got:
                    rows.append(row)
                    spans.append([list(x) for x in got])
                    items.append(sorted(names))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))], ["row", "spans", "items"])

    return run


def _finisher(match, cut: bool):
    """Matches each text, or takes the hits of earlier passes; then merges spans, counts words and cuts."""

    def run(batches):
        automaton = match() if match else None
        for batch in batches:
            spans, items, sizes = [], [], []
            for i, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                got, names = automaton.match(words) if match else (map(tuple, batch.column("hit_spans")[i].as_py()), batch.column("hit_items")[i].as_py())
                spans.append([list(x) for x in _merged(list(got))])
                items.append(sorted(names))
                sizes.append(len(words))
            columns = {c: batch.column(c) for c in batch.schema.names if c not in _HITS.names}
            if cut and any(spans):
                texts = [cut_spans(t.as_py(), s) if s else t.as_py() for t, s in zip(columns["text"], spans, strict=True)]
                columns["text"] = pa.array(texts, columns["text"].type)
                if "n_chars" in columns:
                    sizes_now = [len(t) if s else n.as_py() for t, s, n in zip(texts, spans, columns["n_chars"], strict=True)]
                    columns["n_chars"] = pa.array(sizes_now, columns["n_chars"].type)
            columns["hit_spans"] = pa.array(spans, pa.list_(pa.list_(pa.int32())))
            columns["hit_items"] = pa.array(items, pa.list_(pa.string()))
            columns["hit_words"] = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def cut_spans(text: str, spans: list[list[int]]) -> str:
    """The text without these spans of words; what stood around a span is joined by a space."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for first, end in spans:
        out.append(raw[at : places[first][0]].rstrip(b" "))
        at = places[end - 1][1]
    out.append(raw[at:].lstrip(b" "))
    return b" ".join(x for x in out if x).decode()


def _hit_count() -> F.Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The documents without hit spans, n_chars kept true; documents with more than ``coverage`` of their words hit go."""
    found = find_hits(docs, benchmark, window, cut=True)
    return found.where(_hit_count() <= F.lit(coverage) * F.col("hit_words")).select(docs.columns)


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What of each document is hit by which items."""
    found = find_hits(docs.select("doc_id", "text"), benchmark, WINDOW)
    return found.select(
        "doc_id",
        F.col("hit_words").alias("n_words"),
        _hit_count().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )
