"""What an operator is, and the registry of operators by name.

An operator is a function from a DataFrame and parameters to a DataFrame. It
states the columns that it needs; they are checked by name and type before any
plan is built. Operators compose with ``df.transform`` and with the relational
operations above and below them, so Catalyst sees one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KINDS = {
    "number": T.NumericType,
    "integer": T.IntegralType,
    "text": T.StringType,
    "any": T.DataType,
}


def require(df: DataFrame, columns: dict[str, str]) -> None:
    """Raise ValueError unless each column is there with a type of its kind (see KINDS)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for name, kind in columns.items():
        if name not in have:
            raise ValueError(f"column {name!r} is missing; there are {sorted(have)}")
        if not isinstance(have[name], KINDS[kind]):
            raise ValueError(f"column {name!r} is {have[name].simpleString()}, not a {kind}")


@dataclass(frozen=True)
class TableOperator:
    """A named operator: ``apply(df, **params)``; generators take the session in place of a frame."""

    name: str
    apply: Callable[..., DataFrame]
    requires: dict[str, str] = field(default_factory=dict)
    generator: bool = False

    def __call__(self, source: DataFrame | SparkSession, **params) -> DataFrame:
        if not self.generator:
            require(source, {params.get(f"{k}_col", k): kind for k, kind in self.requires.items()})
        return self.apply(source, **params)


_REGISTRY: dict[str, TableOperator] = {}


def register(op: TableOperator) -> TableOperator:
    if op.name in _REGISTRY:
        raise ValueError(f"operator {op.name!r} is registered already")
    _REGISTRY[op.name] = op
    return op


def get(name: str) -> TableOperator:
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


def view(name: str, op: str, source: DataFrame | SparkSession, **params) -> DataFrame:
    """Apply a registered operator and give the result to SQL under a view's name."""
    out = get(op)(source, **params)
    out.createOrReplaceTempView(name)
    return out
