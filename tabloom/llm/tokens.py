r"""Token counts that follow edits: a segment tree of pre-tokens for each document.

A text is split into pre-tokens, and each has a number of tokens. Runs of LEAF
pre-tokens are the leaves of a tree whose nodes hold the characters and tokens
below them. An edit finds its place by the characters, splits and encodes anew
only from a little before the edit (LOOK characters, further than the pattern
looks ahead) to the first old boundary behind it on which old and new splits
agree, and corrects the sums on the way up. The pattern looks back at nothing, so
what follows such a boundary is split as before.

The tokenizer's ranks are read once by the driver and broadcast; their size is that
of the file, about a megabyte.

Defined cases: NULL and empty texts have no tokens; NULL edits are none; edits are
applied in their order, each to the text that the one before left; places beyond
the text count as its end, an end before its start as the start.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern of the public byte-level tokenizers.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
LEAF = 64
LOOK = 8
_MEMO = 300_000


class Counter:
    """Splits texts and counts the tokens of pre-tokens; counts of the first _MEMO pre-tokens are kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pattern = regex.compile(pattern)
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._encode = encoding._encode_single_piece
        self._memo: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self._memo.get(piece)
        if n is None:
            n = len(self._encode(piece))
            if len(self._memo) < _MEMO:
                self._memo[piece] = n
        return n


def read_ranks(path: str = TOKENIZER) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_COUNTERS: dict[int, Counter] = {}


def counter(ranks: bytes, pattern: str = PATTERN) -> Counter:
    """The counter of a tokenizer file's bytes; one is kept in each process."""
    key = hash((ranks, pattern))
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, pattern)
    return _COUNTERS[key]


class TokenTree:
    """A text with its pre-tokens; ``tokens`` is the number of tokens of the text as it is now."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        pieces = counter.pattern.findall(text)
        self._build(list(map(len, pieces)), list(map(counter.count, pieces)))

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        """Leaves of LEAF pre-tokens; a leaf that edits have made several times as large has the tree built anew."""
        starts = range(0, len(lengths), LEAF)
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in starts] or [([], [])]
        self.size = 1
        while self.size < len(self.leaves):
            self.size *= 2
        self.chars, self.sums = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (a, b) in enumerate(self.leaves, self.size):
            self.chars[i], self.sums[i] = sum(a), sum(b)
        for i in reversed(range(1, self.size)):
            self._add(i)

    def _add(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that a place lies in, and where the leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return min(node - self.size, len(self.leaves) - 1), start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end."""
        n = len(self.text)
        start = min(max(0, start), n)
        end = min(max(start, end), n)
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        # from the first pre-token that could have seen the edit
        leaf, place = self._find(max(0, start - LOOK))
        lengths, counts = self.leaves[leaf]
        before = 0
        while before < len(lengths) and place + lengths[before] + LOOK <= start:
            place += lengths[before]
            before += 1
        kept = lengths[:before], counts[:before]
        # old boundaries behind the edit, from left to right
        old, at, i = place, leaf, before
        fresh_lengths, fresh_counts, now = [], [], place
        pieces = self.counter.pattern.finditer(self.text, place)
        while True:
            while old < end or old + shift < now:
                if i < len(self.leaves[at][0]):
                    old += self.leaves[at][0][i]
                    i += 1
                elif at + 1 < len(self.leaves):
                    at, i = at + 1, 0
                else:
                    break
            if old >= end and old + shift == now and now >= start + len(new):
                break
            m = next(pieces, None)
            if m is None:
                break
            fresh_lengths.append(len(m[0]))
            fresh_counts.append(self.counter.count(m[0]))
            now = m.end()
            self.encoded += len(m[0])
        rest = self.leaves[at][0][i:], self.leaves[at][1][i:]
        for j in range(leaf + 1, at + 1):
            self._put(j, [], [])
        self._put(leaf, [*kept[0], *fresh_lengths, *(rest[0] if at == leaf else [])], [*kept[1], *fresh_counts, *(rest[1] if at == leaf else [])])
        if at != leaf:
            self._put(at, *rest)
        if len(self.leaves[leaf][0]) > 4 * LEAF:
            lengths, counts = ([x for part in self.leaves for x in part[i]] for i in (0, 1))
            self._build(lengths, counts)

    def _put(self, leaf: int, lengths: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = (lengths, counts)
        node = leaf + self.size
        self.chars[node], self.sums[node] = sum(lengths), sum(counts)
        node //= 2
        while node:
            self._add(node)
            node //= 2


def edited_counts(docs: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_after, n_chars_after, reencoded_chars) from rows (doc_id, text, edits).

    edits is an array of structs (start, end, text), in code points.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = counter(ranks.value, pattern)
        for batch in batches:
            out = []
            for text, edits in zip(batch.column("text"), batch.column("edits"), strict=True):
                tree = TokenTree(text.as_py() or "", own)
                before = tree.tokens
                for e in edits.as_py() or ():
                    tree.edit(e["start"], e["end"], e["text"] or "")
                out.append((before, tree.tokens, len(tree.text), tree.encoded))
            columns = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "reencoded_chars"])

    rows = docs.select("doc_id", "text", "edits")
    return rows.mapInArrow(run, f"doc_id {key}, n_tokens long, n_tokens_after long, n_chars_after long, reencoded_chars long")


def with_sample_edits(docs: DataFrame) -> DataFrame:
    """The documents with three edits each, placed by their ids: words put in, a stretch deleted, one replaced."""
    n = F.length(F.coalesce("text", F.lit("")))

    def edit(i: int, size: int, text: str):
        at = F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(n, F.lit(1))).cast("int")
        return F.struct(at.alias("start"), (at + size).alias("end"), F.lit(text).alias("text"))

    return docs.withColumn("edits", F.array(edit(1, 0, " and a few words more"), edit(2, 40, ""), edit(3, 12, "someone's 2nd draft")))


def token_digest(docs: DataFrame) -> DataFrame:
    """Counts of every document before and after its sample edits."""
    return edited_counts(with_sample_edits(docs.select("doc_id", "text")))
