"""Operators that look at one row at a time: plain narrow transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import contains_ignore_case, is_signed_integer
from tabloom.operators.contract import TableOperator, register


def passthrough(df: DataFrame, a_col: str = "a") -> DataFrame:
    """Each row once, unchanged, as column ``a``."""
    return df.select(F.col(a_col).alias("a"))


def substring_filter(df: DataFrame, needle: str = "database", word_col: str = "word") -> DataFrame:
    """The rows whose text holds the needle in any case; NULL texts go.

    The predicate stays a ``Contains`` that reaches the scan.
    """
    return df.where(contains_ignore_case(F.col(word_col), needle))


def token_split(df: DataFrame, name_col: str = "name", values_col: str = "values", sep: str = ",") -> DataFrame:
    """(name, value): each piece of a delimited text that is a whole base-10 long.

    Empty, malformed and overflowing pieces give no row; repeated pieces stay.
    """
    pieces = df.select(F.col(name_col).alias("name"), F.explode(F.split(F.col(values_col), f"\\Q{sep}\\E")).alias("piece"))
    # the cast rules most out; it also takes " 12 " and "+12", which the pattern doesn't
    numbers = pieces.select("name", "piece", F.expr("try_cast(piece as bigint)").alias("value"))
    return numbers.where(F.col("value").isNotNull() & is_signed_integer(F.col("piece"))).select("name", "value")


register(TableOperator("identity", passthrough, {"a": "any"}))
register(TableOperator("substring_filter", substring_filter, {"word": "text"}))
register(TableOperator("token_split", token_split, {"name": "text", "values": "text"}))
