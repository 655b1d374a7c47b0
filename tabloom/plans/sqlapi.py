"""The row-wise operators as table functions for SQL: ``f(TABLE(select ...))``.

This is the slow path: a Python table function hides its work from Catalyst, so
filters stay above it and its whole input is read. The two over tables work on Arrow
batches as a whole, without a step of Python for each piece. DataFrame code should use
``df.transform``. Operators that fold or iterate aren't offered in this form,
since a table function ends once a partition and not at all without input; give
their results to SQL with ``contract.view``.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from tabloom.operators.generators import PHRASES

_INTEGER = r"\A-?[0-9]+\z"
#: Bytes of a piece that a long holds for certain.
_SURE = 18


class SubstringFilter:
    """(word) -> (word): as operators.rowwise.substring_filter; the needle is the second argument."""

    def eval(self, rows: pa.RecordBatch, needle: pa.Array):
        if rows.num_rows:
            low, words = needle[0].as_py().lower(), rows.column("word")
            yield pa.table({"word": words.filter(pa.array([w is not None and low in w.lower() for w in words.to_pylist()], pa.bool_()))})


class TokenSplit:
    """(name, values) -> (name, value): as operators.rowwise.token_split."""

    def eval(self, rows: pa.RecordBatch):
        lists = pc.split_pattern(rows.column("values"), ",")
        pieces, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
        whole = pc.match_substring_regex(pieces, _INTEGER)
        pieces, owner = pieces.filter(whole), owner.filter(whole)
        short = pc.less_equal(pc.binary_length(pieces), _SURE)
        sure, rest = pieces.filter(short).cast(pa.int64()), pieces.filter(pc.invert(short)).to_pylist()
        longer = pa.array([_long(x) for x in rest], pa.int64())
        values = pa.concat_arrays([sure, longer.drop_null()])
        owner = pa.concat_arrays([owner.filter(short), owner.filter(pc.invert(short)).filter(longer.is_valid())])
        yield pa.table({"name": rows.column("name").take(owner), "value": values})


def _long(piece: str) -> int | None:
    """The number, however many zeros it starts with, if a long holds it."""
    digits = piece.lstrip("-").lstrip("0")
    if len(digits) > 19:
        return None
    value = int(digits or "0") * (-1 if piece[0] == "-" else 1)
    return value if -(2**63) <= value < 2**63 else None


def _uniform(key: int | str, stream: str) -> int:
    """As functions.hashing.u32."""
    return int(hashlib.md5(f"{key}:{stream}".encode()).hexdigest()[:8], 16)


def _normal(key: int, stream: str) -> float:
    """As functions.hashing.normal."""
    radius = math.sqrt(-2.0 * math.log(1.0 - _uniform(key, stream + "r") / 2**32))
    return radius * math.cos(2 * math.pi * (_uniform(key, stream + "a") / 2**32))


class CreateWords:
    """(first, n) -> (word): n rows of operators.generators.words, from row ``first`` on."""

    def eval(self, first: int, n: int):
        for i in range(first, first + n):
            yield (f"{_uniform(i, 'l')} {PHRASES[_uniform(i, 'w') % len(PHRASES)]} {_uniform(i, 'r')}",)


class CreateCurve:
    """(first, n, a, b, c) -> (x, y): n rows of operators.generators.curve, from row ``first`` on."""

    def eval(self, first: int, n: int, a: float, b: float, c: float):
        a, b, c = float(a), float(b), float(c)
        for i in range(first, first + n):
            x = _uniform(i, "x") / 2**32 * 100.0
            yield x, a + b * x + c * x * x + (a + b + c) * _normal(i, "e")


def register_functions(spark: SparkSession) -> None:
    """Give SQL the functions substring_filter, token_split, create_words and create_curve.

    A call with scalar arguments alone is one task; ``from range(0, n, step), lateral create_words(id, step)`` is many.
    """
    spark.udtf.register("substring_filter", arrow_udtf(SubstringFilter, returnType="word string"))
    spark.udtf.register("token_split", arrow_udtf(TokenSplit, returnType="name string, value bigint"))
    spark.udtf.register("create_words", udtf(CreateWords, returnType="word string"))
    spark.udtf.register("create_curve", udtf(CreateCurve, returnType="x double, y double"))
