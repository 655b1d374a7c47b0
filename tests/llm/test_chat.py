import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import chat

PART = st.lists(st.sampled_from(["\\", "###", "#", "</turn>", "<", "/turn>", ":", "\n", "a", " "]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), PART), PART), max_size=7), st.integers(1, 4))
def test_round_trip(turns, chunk):
    got = chat.format_turns(chat.default_template, turns, chunk=chunk)
    assert chat.read_back(got["formatted"]) == turns and not got["rewrites"]
    assert [chat.unescape(got["formatted"][a:b]) for a, b in got["loss_spans"]] == [t for r, t in turns if r == "assistant"]
    assert "".join(got["formatted"][a:b] for a, b in got["turn_spans"]) == got["formatted"]


def test_templates_that_rewrite_history():
    last_only = lambda turns: "".join(f"[{r}]{t if i == len(turns) - 1 else '...'}\n" for i, (r, t) in enumerate(turns))
    got = chat.format_turns(last_only, [("user", "a"), ("assistant", "b"), ("user", "c")], plain=str)
    assert got["rewrites"] and got["loss_spans"] == []


def test_template_that_counts_turns():
    counted = lambda turns: "".join(f"<{i}:{r}>{t}" for i, (r, t) in enumerate(turns))
    turns = [("user", "q"), ("assistant", "r")] * 40
    got = chat.format_turns(counted, turns, plain=str, chunk=8)
    assert [got["formatted"][a:b] for a, b in got["loss_spans"]] == ["r"] * 40


def test_digest(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    want = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        want[r["conv_id"]].append((r["role"], r["text"]))
    want[-7] = [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]
    got = {r["conv_id"]: r for r in chat.chat_digest(rows).collect()}
    assert got.keys() == want.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[k]["n_turns"], got[k]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), sha(loss))
        assert got[k]["formatted_chars"] == len(chat.default_template(turns))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 2, "assistant", ""), (1, 2, "assistant", ""), (2, 0, "assistant", "y" * 300_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.chat_digest(df).collect()}
    assert got == {None: (1, 0), 1: (3, 0), 2: (1, 300_000), -7: (2, 26)}
    assert chat.chat_digest(df.limit(0)).count() == 1
