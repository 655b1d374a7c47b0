r"""Format conversations for training by a template that is only called, never looked into.

A template is a function from a list of (role, text) to a string. Successive
prefixes of a conversation are rendered; what a rendering has beyond the one
before is the new turn's span. Rendering one turn with two other texts shows
where its text lies between the turn's marks. A template that changes earlier
output when a turn is added (one that rewrites history) is detected: its
conversations get ``rewrites`` true and no loss spans.

Long conversations are rendered in chunks of CHUNK turns after one turn of
context, so the work is proportional to the text; the joined pieces must equal
the rendering of the whole conversation, else every prefix is rendered.

The default template escapes its control strings in texts with backslashes, so
``read_back`` recovers roles and texts.

Rows are dealt by conversation, sorted, and read as a stream; a task holds one
conversation at a time, like any other single long text. Defined cases: turns in
order of (turn, role, text), NULLs first; NULL role and text are empty; rows
that repeat count again; NULL ids form one conversation; no rows give no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

CHUNK = 16
_CONTROL = re.compile(r"\\|###|</turn>")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def default_template(turns: Turns) -> str:
    """``### role: text</turn>`` and a line break for each turn."""
    return "".join(f"### {escape(role).replace(':', chr(92) + ':')}: {escape(text)}</turn>\n" for role, text in turns)


def read_back(formatted: str) -> Turns:
    """Roles and texts of the default template's output."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _pieces(render: Template, turns: Turns, chunk: int) -> list[str] | None:
    """What each turn adds; None if a rendering doesn't begin with the one before."""
    out = []
    for start in range(0, len(turns), chunk):
        known = turns[max(0, start - 1) : start]
        before = render(known) if known else ""
        for turn in turns[start : start + chunk]:
            known = [*known, turn]
            now = render(known)
            if not now.startswith(before):
                return None
            out.append(now[len(before) :])
            before = now
    return out


def _frame(render: Template, context: Turns, role: str) -> tuple[int, int]:
    """How many characters of a turn come before and after its text."""
    before = len(render(context)) if context else 0
    a, b = (render([*context, (role, x)])[before:] for x in ("0", "1"))
    head = len(os.path.commonprefix([a, b]))
    return head, len(os.path.commonprefix([a[::-1], b[::-1]]))


def format_turns(render: Template, turns: Turns, plain: Callable[[str], str] = unescape, chunk: int = CHUNK, trained: str = "assistant") -> dict:
    """The formatted text of a conversation with turn spans and loss spans (code points, ends exclusive)."""
    whole = render(turns)
    pieces = _pieces(render, turns, chunk)
    if pieces is not None and "".join(pieces) != whole:
        pieces = _pieces(render, turns, max(1, len(turns)))
    if pieces is None:
        return {"formatted": whole, "turn_spans": [], "loss_spans": [], "rewrites": True}
    frames: dict[str, tuple[int, int]] = {}
    spans, loss, at = [], [], 0
    for i, ((role, text), piece) in enumerate(zip(turns, pieces, strict=True)):
        spans.append((at, at + len(piece)))
        if role == trained:
            for context in (None, turns[max(0, i - 1) : i], turns[:i]):
                if context is not None or role not in frames:
                    frames[role] = _frame(render, context or [], role)
                head, tail = frames[role]
                if plain(piece[head : len(piece) - tail]) == text:
                    break
            else:
                raise ValueError(f"the text of turn {i} can't be found in its span")
            loss.append((at + head, at + len(piece) - tail))
        at += len(piece)
    return {"formatted": whole, "turn_spans": spans, "loss_spans": loss, "rewrites": False}


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Turns]]:
    """Conversations of rows that come sorted by conv_id."""
    now, turns = None, None
    for batch in batches:
        for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if turns is None or key != now:
                if turns is not None:
                    yield now, turns
                now, turns = key, []
            turns.append((role, text))
    if turns is not None:
        yield now, turns


def format_conversations(rows: DataFrame, render: Template = default_template, plain: Callable[[str], str] = unescape, trained: str = "assistant") -> DataFrame:
    """A row for each conversation: conv_id, formatted, turn_spans, loss_spans, rewrites."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    key_type = to_arrow_type(rows.schema["conv_id"].dataType)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for key, turns in _conversations(batches):
            got = format_turns(render, turns, plain, trained=trained)
            ends = lambda name: [[{"start": a, "end": b} for a, b in got[name]]]  # noqa: E731,B023
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([key], key_type), "formatted": [got["formatted"]], "turn_spans": pa.array(ends("turn_spans"), span), "loss_spans": pa.array(ends("loss_spans"), span), "rewrites": [got["rewrites"]]})

    spans = "array<struct<start: long, end: long>>"
    empty = F.lit("")
    ordered = rows.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, formatted string, turn_spans {spans}, loss_spans {spans}, rewrites boolean")


def read_back_conversations(formatted: DataFrame) -> DataFrame:
    """The digest of formatted conversations, read from the formatted texts and loss spans alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                turns = read_back(row["formatted"])
                loss = "".join(unescape(row["formatted"][s["start"] : s["end"]]) for s in row["loss_spans"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((row["conv_id"], len(turns), digest(said), len(loss), digest(loss), len(row["formatted"]), row["rewrites"]))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
            if out:
                columns = dict(zip(names, map(list, zip(*out, strict=True)), strict=True))
                yield pa.RecordBatch.from_pydict(columns | {"conv_id": batch.column("conv_id")})

    narrow = formatted.select("conv_id", "formatted", "loss_spans", "rewrites")
    return narrow.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """All conversations and one, -7, whose texts hold the template's control strings."""
    spark = conversations.sparkSession
    tricky = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").union(more)
    return read_back_conversations(format_conversations(rows))
