"""Randomness that depends on row values only.

``rand(seed)`` depends on partitioning; these columns are derived from an md5
digest of an id and a stream name, so that reruns, recomputed tasks and other
SQL engines all get the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def u32(key: Column, stream: str) -> Column:
    """A whole number in [0, 2**32) as a long."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(stream)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def uniform(key: Column, stream: str) -> Column:
    """A double in [0, 1)."""
    return u32(key, stream) / F.lit(4294967296.0)


def normal(key: Column, stream: str) -> Column:
    """A standard normal double, by the Box-Muller transform."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - uniform(key, stream + "r")))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(key, stream + "a"))


def pick(key: Column, stream: str, values: list[str]) -> Column:
    """One of the values, all equally likely."""
    return F.element_at(F.array(*map(F.lit, values)), (u32(key, stream) % len(values) + 1).cast("int"))


def binomial(key: Column, stream: str, n: int, p: float) -> Column:
    """A binomial int, by looking a uniform number up in the cumulative distribution."""
    steps = F.array(*map(F.lit, binomial_cdf(n, p)))
    return F.size(F.filter(steps, lambda x: x <= uniform(key, stream)))


def binomial_cdf(n: int, p: float) -> list[float]:
    total, out = 0.0, []
    for k in range(n):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        out.append(total)
    return out
