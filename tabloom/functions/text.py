"""Text predicates and dialect helpers as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_ignore_case(text: Column, needle: str) -> Column:
    """True if the text holds the needle, letters compared in lower case. NULL text gives NULL."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def is_signed_integer(piece: Column) -> Column:
    r"""The whole piece is ``-?[0-9]+``; ``\z`` and not ``$``, as that one allows a trailing line break."""
    return piece.rlike(r"^-?[0-9]+\z")


def drop_left(text: Column, n: Column | int) -> Column:
    """The text without its first n characters: other dialects' ``right(text, -n)``."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.substring(text, n + F.lit(1), F.length(text))


def matches_whole(text: Column, pattern: str) -> Column:
    r"""``SIMILAR TO`` for a pattern that is a regular expression already."""
    return text.rlike(rf"\A(?:{pattern})\z")
