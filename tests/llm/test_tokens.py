import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import tokens

# Fixed value: the plain pattern.
PLAIN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OWN = tokens.counter(tokens.read_ranks())
FULL = tiktoken.Encoding("full", pat_str=PLAIN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.TOKENIZER, "rb"))}, special_tokens={})
TEXT = st.lists(st.sampled_from(["a", "'", "ll", "l", "s", " ", "  ", "\n", "1", "23", ".", "!", "é", "word", "\t"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-1, 60), st.integers(0, 30), TEXT), max_size=5))
def test_edits(text, edits):
    tree = tokens.TokenTree(text, OWN)
    assert tree.tokens == len(FULL.encode_ordinary(text))
    for start, size, new in edits:
        tree.edit(start, start + size, new)
        assert tree.tokens == len(FULL.encode_ordinary(tree.text))
        assert tree.chars[1] == len(tree.text)


def test_long_text_is_not_encoded_again():
    r = random.Random(0)
    words = ["alpha", "beta's", "12", "gamma!", "\n", "delta"]
    tree = tokens.TokenTree(" ".join(r.choice(words) for _ in range(30_000)), OWN)
    for _ in range(60):
        at = r.randrange(len(tree.text))
        tree.edit(at, at + r.randrange(300), " ".join(r.choice(words) for _ in range(r.randrange(40))))
    assert tree.tokens == len(FULL.encode_ordinary(tree.text))
    assert tree.encoded < 60 * 600


def test_many_edits_at_one_place():
    """Leaves stay bounded however many edits fall on one of them."""
    tree = tokens.TokenTree("one two three", OWN)
    for i in range(2000):
        tree.edit(4, 4, f"w{i} ")
    assert tree.tokens == len(FULL.encode_ordinary(tree.text)) and tree.chars[1] == len(tree.text)
    assert max(len(leaf[0]) for leaf in tree.leaves) <= 4 * tokens.LEAF and len(tree.leaves) > 20


def test_table(spark, sf):
    docs = tokens.with_sample_edits(spark.read.parquet(f"{sf}/documents.parquet"))
    got = {r["doc_id"]: r for r in tokens.edited_counts(docs).collect()}
    for r in docs.collect():
        text = r["text"]
        assert got[r["doc_id"]]["n_tokens"] == len(FULL.encode_ordinary(text))
        for e in r["edits"]:
            text = text[: e["start"]] + e["text"] + text[max(e["start"], e["end"]) :]
        assert (got[r["doc_id"]]["n_tokens_after"], got[r["doc_id"]]["n_chars_after"]) == (len(FULL.encode_ordinary(text)), len(text))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "one", 1), (1, None, 1), (1, "", 1), (2, "x " * 100_000, 1), (2, "x " * 100_000, 1), (3, "z" * 100_000, 1)], "doc_id long, text string, n_tokens int")
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokens.token_digest(df).collect())
    assert [g[0] for g in got] == [0, 1, 1, 2, 2, 3] and got[1][1] == got[2][1] == 0 and got[3] == got[4]
    assert tokens.token_digest(df.limit(0)).count() == 0
