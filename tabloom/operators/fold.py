"""Operators that fold all rows into a few: one partial and one final aggregate each."""

from __future__ import annotations

import math

import numpy as np
from numpy.polynomial import Polynomial
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.contract import TableOperator, register


def label_count(df: DataFrame, label: str = "lifestyle", word_col: str = "word") -> DataFrame:
    """Always two rows, (label, n) and ("other", m), also for no input. NULL counts as other."""
    hit = F.coalesce(F.col(word_col) == label, F.lit(False))
    sums = df.agg(F.count_if(hit).alias("n"), F.count_if(~hit).alias("m"))
    return sums.select(F.stack(F.lit(2), F.lit(label), F.col("n"), F.lit("other"), F.col("m")).alias("word", "word_count"))


def linear_fit(df: DataFrame, x_col: str = "x", y_col: str = "y") -> DataFrame:
    """One row (intercept, slope) of the least-squares line; NULLs for no input."""
    return df.agg(
        F.regr_intercept(F.col(y_col), F.col(x_col)).alias("intercept"),
        F.regr_slope(F.col(y_col), F.col(x_col)).alias("slope"),
    )


def _pairs(df: DataFrame, x_col: str, y_col: str) -> DataFrame:
    return df.select(F.col(x_col).cast("double").alias("x"), F.col(y_col).cast("double").alias("y")).where("x is not null and y is not null")


#: Smallest eigenvalue of the scaled system, against 1, below which it counts as singular.
SINGULAR = 1e-10


def moments(df: DataFrame, degree: int, x_col: str = "x", y_col: str = "y", centre: float = 0.0, scale: float = 1.0) -> DataFrame:
    """One row of the sums s0..s2d of powers of u = (x - centre) / scale and t0..td of powers of u times y."""

    def power(k: int):
        out = F.lit(1.0)
        for _ in range(k):
            out = out * F.col("u")
        return out

    sums = [F.coalesce(F.sum(power(k)), F.lit(0.0)).alias(f"s{k}") for k in range(2 * degree + 1)]
    sums += [F.coalesce(F.sum(power(k) * F.col("y")), F.lit(0.0)).alias(f"t{k}") for k in range(degree + 1)]
    return _pairs(df, x_col, y_col).select(((F.col("x") - centre) / scale).alias("u"), "y").agg(*sums)


def coefficients(df: DataFrame, degree: int, x_col: str = "x", y_col: str = "y") -> list[float]:
    """Coefficients by power of the least-squares polynomial; NaN throughout if the system is singular.

    Two aggregates: the centre and spread of x, then the moments of x centred and
    scaled, which stay of one magnitude wherever x lies. The driver gets one row of
    each and solves degree + 1 equations.
    """
    none = [math.nan] * (degree + 1)
    centre, scale = _pairs(df, x_col, y_col).agg(F.avg("x"), F.stddev_pop("x")).first()
    if centre is None or not math.isfinite(centre) or not math.isfinite(scale) or (scale <= 1e-14 * abs(centre) and degree):
        return none
    scale = scale or 1.0
    row = moments(df, degree, x_col, y_col, centre, scale).first()
    system = np.array([[row[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    wanted = np.array([row[f"t{i}"] for i in range(degree + 1)])
    if not (np.isfinite(system).all() and np.isfinite(wanted).all()):
        return none
    unit = 1 / np.sqrt(np.diag(system))
    if np.linalg.eigvalsh(system * np.outer(unit, unit))[0] < SINGULAR:
        return none
    in_u = Polynomial(unit * np.linalg.solve(system * np.outer(unit, unit), unit * wanted))
    in_x = in_u(Polynomial([-centre / scale, 1 / scale])).coef
    return [float(v) for v in np.pad(in_x, (0, degree + 1 - len(in_x)))]


def quadratic_fit(df: DataFrame, x_col: str = "x", y_col: str = "y") -> DataFrame:
    """One row (a, b, c) of the least-squares curve y = a + b x + c x**2.

    Rows with a NULL in x or y take no part. A singular system (no rows, or
    fewer than three values of x) gives NaN for all three, still one row.
    """
    found = coefficients(df, 2, x_col, y_col)
    return df.sparkSession.range(1).select(*(F.lit(v).alias(name) for name, v in zip("abc", found, strict=True)))


def polynomial_fit(df: DataFrame, degree: int = 2, x_col: str = "x", y_col: str = "y") -> DataFrame:
    """Rows (power, coefficient) of the least-squares polynomial; NaN for singular systems."""
    found = coefficients(df, degree, x_col, y_col)
    rows = F.array(*(F.struct(F.lit(i).alias("power"), F.lit(v).alias("coefficient")) for i, v in enumerate(found)))
    return df.sparkSession.range(1).select(F.inline(rows))


register(TableOperator("label_count", label_count, {"word": "text"}))
register(TableOperator("linear_fit", linear_fit, {"x": "number", "y": "number"}))
register(TableOperator("quadratic_fit", quadratic_fit, {"x": "number", "y": "number"}))
register(TableOperator("polynomial_fit", polynomial_fit, {"x": "number", "y": "number"}))
