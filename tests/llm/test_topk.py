import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import topk


def brute(vectors, every=50, k=5):
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, v in usable:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i)
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return {i: x for i, x in out.items() if x}


def check(spark, vectors, every=50, parts=3):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(parts)
    got = {}
    for r in sorted(topk.top_vectors(df, every).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got == brute([(r["vec_id"], r["embedding"]) for r in df.collect()], every)


def test_table(spark, sf):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()])


@pytest.mark.parametrize("shard, leaf, seeds", [(64, 8, 16), (50, 3, 0), (1000, 1000, 3)])
def test_trees(spark, monkeypatch, shard, leaf, seeds):
    r = random.Random(shard)
    centres = [[r.gauss(0, 3) for _ in range(6)] for _ in range(8)]
    vectors = [(i, [x + r.gauss(0, 0.2) for x in r.choice(centres)]) for i in range(600)] + [(1000 + i, [0.5] * 6) for i in range(80)]
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "SEEDS", max(1, seeds))
    monkeypatch.setattr(topk, "LEAST_GROUP", shard)
    monkeypatch.setattr(topk.BallTree.__init__, "__defaults__", (leaf,))
    check(spark, vectors, 10)


def test_branches_are_left_out():
    r = np.random.default_rng(0)
    centres = r.normal(0, 2000, (32, 8))
    rows = np.floor(centres[r.integers(0, 32, 8000)] + r.normal(0, 40, (8000, 8))).astype(np.int64)
    search = topk.Search(np.arange(0, 8000, 50), rows[::50], np.full(160, topk.LOWEST), 5)
    search.visit(topk.BallTree(np.arange(8000), rows))
    assert search.visited < search.possible / 2


def test_too_large(spark):
    df = spark.createDataFrame([(0, [3e7, 3e7, 3e7]), (1, [3e7, 3e7, 3e7]), (2, [1.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="doesn't fit a long"):
        topk.top_vectors(df).collect()


def test_driver_holds_seeds_only(spark, sf, monkeypatch):
    """Many groups and queries make one plan: no union and no broadcast for each."""
    monkeypatch.setattr(topk, "LEAST_GROUP", 16)
    found = topk.top_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2 and plan.count("Union") <= 1


def test_odd_rows(spark):
    inf, nan = math.inf, math.nan
    vectors = [(0, [1.0, 2.0]), (50, None), (100, [nan, 1.0]), (150, [inf, 1.0]), (1, [None, 1.0]), (2, [1.0]), (3, []), (4, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (200, [-1.0, 0.25]), (6, [3e8, 3e8]), (250, [3e8, -3e8])]
    check(spark, vectors)
    check(spark, [(0, [1.0])])
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    assert topk.top_vectors(df.limit(0)).count() == 0
