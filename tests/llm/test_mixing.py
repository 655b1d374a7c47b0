import pytest
from pyspark.sql import functions as F

from oracle import same, twin
from tabloom.llm import mixing, queries


def test_twin(spark, sf):
    same(queries.QUERIES["op10_source_mixing"](spark, sf), twin(sf), queries.ORACLE["op10_source_mixing"])


def reference(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest, share = total - sum(fixed.values()), sum(w[s] for s in open_)
        target = {s: rest * w[s] / share for s in open_} if share else {}
        above = [s for s in open_ if target[s] > most * sizes[s]]
        if not above:
            return target | fixed
        fixed |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, "c": 1000}, {"a": 0, "é": 7, "z": 7, None: 50}, {"only": 5}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 1000, "d": 2, "e": 50, "f": 900}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(reference(sizes, mixing.WEIGHTS, mixing.MOST))


def test_rows_of_the_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix_documents(docs).collect()}
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in taken.items() if v}
    assert max(taken.values()) <= 3


def test_targets_are_met(spark):
    """Each source's taken words miss its target by its largest document at most, strata or not."""
    sf = "/root/testdata/sf0.01"
    for rows in (spark.read.parquet(f"{sf}/documents.parquet"), spark.range(3000).selectExpr("id as doc_id", "concat_ws(' ', array_repeat('w', cast(1 + id % 97 as int))) as text", "case when id % 3 = 0 then 'a' when id % 7 = 0 then null else 'b' end as source")):
        got = mixing.mix_documents(rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect()
        assert all(abs(r["taken"] - r["target"]) <= r["largest"] + 1e-6 for r in got)


def test_strata(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id as doc_id", "'w w' as text", "'a' as source")
    monkeypatch.setattr(mixing, "STRATUM", 100)
    targets = mixing.source_targets(rows.selectExpr("source", "2L as size")).withColumn("rate", F.lit(1.3))
    out, names = mixing.with_copies(rows.withColumn("size", F.lit(2)), targets, "size")
    got = [r["n"] for r in out.groupBy(names["stratum"]).agg((F.sum(names["copies"]) - 1.3 * F.count("*")).alias("n")).collect()]
    assert len(got) == 31 and max(map(abs, got)) <= 1


def test_clashing_names(spark):
    names = ["_n", "_i", "_rate", "_source", "rate", "target", "mix_copies", "mix_size", "mix_draw", "docs", "source_size"]
    docs = spark.createDataFrame([(i, "a b c", "s", *range(100, 100 + len(names))) for i in range(20)], ", ".join(["doc_id long, text string, source string", *(f"{n} int" for n in names)]))
    got = mixing.mix_sources(docs).distinct()
    assert got.columns == docs.columns and got.count() == 20
    assert all(tuple(r)[3:] == tuple(range(100, 100 + len(names))) for r in got.collect())


def test_odd_rows(spark):
    rows = [(1, None, "a", 0.5), (None, "x y", None, 0.5), (2, "", "a", 1.0), (2, "", "a", 1.0), (3, "w " * 50_000, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rate double")
    got = mixing.mix_documents(df).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 0, 2, 50_000]
    assert mixing.mix_sources(df).columns == df.columns
    assert mixing.mix_documents(df.limit(0)).count() == 0
    assert mixing.mix_sources(df.limit(0)).count() == 0
