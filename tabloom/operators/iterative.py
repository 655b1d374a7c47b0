"""Clustering: a driver loop of small aggregates over persisted rows.

Each round is one scan of the persisted features with the k centres as literals
in the plan, and a partial aggregate of k rows a task. Neither rows nor lineage
pile up on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.contract import TableOperator, register, require

Centres = list[tuple[float, ...]]


def nearest(features: Sequence[str], centres: Centres) -> Column:
    """The number of the nearest centre by squared distance; ties go to the lowest number."""

    def distance(centre):
        terms = [(F.col(f) - F.lit(float(v))) * (F.col(f) - F.lit(float(v))) for f, v in zip(features, centre, strict=True)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total

    each = [distance(c) for c in centres]
    least = F.least(*each) if len(each) > 1 else each[0]
    out = F.when(each[0] == least, 0)
    for i, d in enumerate(each[1:], 1):
        out = out.when(d == least, i)
    return out.otherwise(0)


def first_centres(df: DataFrame, features: Sequence[str], k: int, order: Sequence[str]) -> Centres:
    """The features of the first k rows by the order columns: a top-k, not a sort of all rows."""
    return [tuple(float(r[f]) for f in features) for r in df.orderBy(*order).select(*features).limit(k).collect()]


def _start(df: DataFrame, features: Sequence[str], k: int, init, order: Sequence[str] | None, seed: int) -> Centres:
    if not isinstance(init, str):
        centres = [tuple(map(float, c)) for c in init]
    elif init == "first_k":
        centres = first_centres(df, features, k, order or features)
    elif init == "random":
        # by a hash of the row: the same rows whatever the partitions
        drawn = df.orderBy(F.xxhash64(F.lit(seed), *(order or features)), *(order or features)).select(*features).limit(k)
        centres = [tuple(float(r[f]) for f in features) for r in drawn.collect()]
    else:
        raise ValueError(f"init is {init!r}")
    if len(centres) < k:
        raise ValueError(f"clustering needs {k} rows at least; there are {len(centres)}")
    return centres


def kmeans(
    df: DataFrame,
    k: int = 8,
    features: Sequence[str] = ("x", "y"),
    max_iter: int = 10,
    init="first_k",
    order: Sequence[str] | None = None,
    seed: int = 42,
    cluster_col: str = "cluster_id",
) -> DataFrame:
    """All rows and columns with the number of their cluster, by max_iter updates of the means.

    init: "first_k" (by the order columns), "random" (by a seeded hash of the order
    columns, or of the features), or k centres. A
    cluster that loses all its rows keeps its centre. Fewer than k rows, or a
    NULL or NaN among the features, raise ValueError.
    """
    require(df, dict.fromkeys(features, "number"))
    points = df.select(*(F.col(f).cast("double").alias(f) for f in features)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # the pass that fills the cache also looks for what can't be clustered
        bad = reduce(or_, (F.col(f).isNull() | F.isnan(f) for f in features))
        if points.agg(F.count_if(bad)).first()[0]:
            raise ValueError("NULL or NaN among the features")
        centres = _start(df, features, k, init, order, seed)
        for _ in range(max_iter):
            means = points.groupBy(nearest(features, centres).alias("i")).agg(*(F.avg(f).alias(f) for f in features)).collect()
            for row in means:
                centres[row["i"]] = tuple(row[f] for f in features)
    finally:
        points.unpersist()
    return df.withColumn(cluster_col, nearest(features, centres))


def kmeans_library(df: DataFrame, k: int = 8, features: Sequence[str] = ("x", "y"), max_iter: int = 10, seed: int = 42, cluster_col: str = "cluster_id") -> DataFrame:
    """The same by Spark's own estimator, with random start."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="_features").transform(df)
    model = KMeans(k=k, initMode="random", maxIter=max_iter, seed=seed, featuresCol="_features", predictionCol=cluster_col).fit(vectors)
    return model.transform(vectors).drop("_features")


register(TableOperator("kmeans", kmeans))
register(TableOperator("kmeans_library", kmeans_library))
