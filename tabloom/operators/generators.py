"""Operators that make tables. Values depend on the row number alone (see functions.hashing)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.hashing import binomial, normal, pick, u32, uniform
from tabloom.operators.contract import TableOperator, register

# Centre, standard deviation and share of each cluster of points.
CLUSTERS = [
    (0.0, 0.0, 5.0, 1 / 8),
    (40.0, 0.0, 5.0, 1 / 8),
    (0.0, -40.0, 5.0, 1 / 8),
    (-40.0, 0.0, 5.0, 1 / 8),
    (0.0, 40.0, 5.0, 1 / 8),
    (50.0, 44.0, 7.0, 1 / 64),
    (40.0, -80.0, 8.0, 15 / 64),
    (-30.0, -50.0, 1.0, 1 / 8),
]

# 13 of the 59 phrases hold "database": a share of about 22 %.
PHRASES = [f"{place} database {thing}" for place, thing in [("Open", "notes"), ("Small", "server"), ("Shared", "folder"), ("Old", "index"), ("Blue", "backup"), ("New", "manual"), ("Local", "test"), ("Remote", "copy"), ("First", "draft"), ("Last", "page"), ("Main", "log"), ("Spare", "disk")]] + ["Database of birds"]
PHRASES += [f"{what} {where}" for what in ("Garden", "River", "Kitchen", "Winter", "Paper", "Silver", "Morning", "Stone") for where in ("lamp", "walk", "tools", "song", "map")]
PHRASES += ["Bread and salt", "Tea with milk", "A long road", "Two red chairs", "Rain on glass", "The quiet room"]

NAMES = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heath"]
NOT_NUMBERS = ["", "F", "FALSE", "N/A", "NaN", "f", "false", "n/a", "nan"]  # Fixed values.


def points(spark: SparkSession, n: int) -> DataFrame:
    """(x, y, cluster_id): ceil(n * share) normal points around each centre, so a few more than n may come."""
    sizes = [math.ceil(n * c[3]) for c in CLUSTERS]
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    cluster: Column = F.lit(len(CLUSTERS) - 1)
    for i in reversed(range(len(CLUSTERS) - 1)):
        cluster = F.when(F.col("id") < ends[i], F.lit(i)).otherwise(cluster)

    def by_cluster(k: int) -> Column:
        return F.element_at(F.array(*(F.lit(c[k]) for c in CLUSTERS)), F.col("cluster_id") + 1)

    rows = spark.range(ends[-1]).withColumn("cluster_id", cluster)
    return rows.select(*((by_cluster(k) + by_cluster(2) * normal(F.col("id"), s)).alias(s) for k, s in ((0, "x"), (1, "y"))), "cluster_id")


def curve(spark: SparkSession, n: int, a: float = 3.0, b: float = -2.0, c: float = 1.0) -> DataFrame:
    """(x, y): x uniform in [0, 100), y = a + b x + c x**2 with normal noise of deviation a + b + c."""
    rows = spark.range(n).select("id", (uniform(F.col("id"), "x") * 100.0).alias("x"))
    x = F.col("x")
    return rows.select("x", (F.lit(a) + F.lit(b) * x + F.lit(c) * x * x + F.lit(a + b + c) * normal(F.col("id"), "e")).alias("y"))


def words(spark: SparkSession, n: int) -> DataFrame:
    """(word): a phrase between two random numbers."""
    key = F.col("id")
    return spark.range(n).select(F.concat_ws(" ", u32(key, "l").cast("string"), pick(key, "w", PHRASES), u32(key, "r").cast("string")).alias("word"))


def arrays(spark: SparkSession, n: int) -> DataFrame:
    """(name, values): comma-separated lists of binomial(50, 0.2) pieces, nine in ten a number up to a million."""
    key = F.col("id")

    def piece(j: Column) -> Column:
        own = F.concat_ws("-", key.cast("string"), j.cast("string"))
        return F.when(u32(own, "v") % 10 > 0, (u32(own, "n") % 1000001).cast("string")).otherwise(pick(own, "i", NOT_NUMBERS))

    rows = spark.range(n).select("id", pick(key, "m", NAMES).alias("name"), binomial(key, "c", 50, 0.2).alias("n"))
    # sequence(1, 0) would count down
    pieces = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n")), piece)).otherwise(F.array().cast("array<string>"))
    return rows.select("name", F.array_join(pieces, ",").alias("values"))


register(TableOperator("create_points", points, generator=True))
register(TableOperator("create_curve", curve, generator=True))
register(TableOperator("create_words", words, generator=True))
register(TableOperator("create_arrays", arrays, generator=True))
