import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import minhash, quality


def test_gradient():
    r = np.random.default_rng(0)
    where = r.integers(0, 20, 60).astype(np.int32)
    values, starts = r.normal(size=60), np.array([0, 5, 5, 30, 45])
    for k in (2, 3, 4):
        grades = r.integers(0, k, 5)
        params = r.normal(size=20 + k - 1)
        _, got = quality.loss_and_gradient(params, k, where, values, starts, grades)
        for i in range(len(params)):
            d = np.zeros_like(params)
            d[i] = 1e-5
            up, down = (quality.loss_and_gradient(params + s * d, k, where, values, starts, grades)[0] for s in (1, -1))
            assert got[i] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_held_out(spark):
    """Fitted on half the labelled documents, it rejects most bad ones of the other half and keeps the good ones."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    graded = quality.grade_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    model = quality.fit(docs, graded.where("doc_id % 2 = 0"))
    assert (np.diff(model.thresholds) > 0).all()
    out = quality.judge(docs.select("doc_id", "text"), model).join(graded.where("doc_id % 2 = 1"), "doc_id")
    kept = {r["grade"]: r["k"] for r in out.groupBy("grade").agg(F.avg(F.col("accepted").cast("int")).alias("k")).collect()}
    mean = {r["grade"]: r["k"] for r in out.groupBy("grade").agg(F.avg("expected_grade").alias("k")).collect()}
    print(kept, mean)
    assert kept[2] > 0.97 and kept[1] < 0.35 and kept[0] < 0.5
    assert mean[0] < mean[2] and mean[1] < mean[2]


def test_odd_rows(spark):
    rows = [(i, "good words here", "a") for i in range(40)] + [(i, "bad awful thing", "b") for i in range(40, 80)] + [(None, None, None), (90, "", ""), (91, "bad " * 100_000, ""), (0, "good words here", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, accepted string")
    labels = spark.createDataFrame([(i, 1, int(i >= 40)) for i in range(80)] + [(3, None, None), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    kept = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in quality.select_documents(docs, labels).collect())
    assert set(range(40)) <= set(kept) and not set(range(40, 80)) & set(kept) and 91 not in kept
    assert quality.select_documents(docs, labels).columns == docs.columns
    assert quality.quality_grades(docs, labels.limit(0)).count() == len(rows)
    assert quality.quality_grades(docs.limit(0), labels).count() == 0


def test_every_document_is_judged(spark):
    """One row per document, rejected ones with their grades; select_documents keeps what is accepted."""
    docs = spark.createDataFrame([(i, "good words here" if i < 40 else "bad awful thing") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 40)) for i in range(80)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_grades(docs, labels).collect()}
    assert set(got) == set(range(80)) and all(r["accepted"] == (i < 40) for i, r in got.items())
    assert max(got[i]["p_top"] for i in range(40, 80)) < min(got[i]["p_top"] for i in range(40))
    assert {r["doc_id"] for r in quality.select_documents(docs, labels).collect()} == {i for i, r in got.items() if r["accepted"]}


def test_all_labelled_are_fitted_on(spark):
    n = 20_500
    docs = spark.range(n).selectExpr("id as doc_id", "concat('word', id % 7) as text")
    assert quality._featured(docs, spark.range(n).selectExpr("id as doc_id", "cast(id % 3 as int) as grade")).count() == n


def test_the_driver_gets_one_gradient_a_step(spark, monkeypatch):
    """Of the weights that are fitted, however many tasks there are; the same model as by any other number of tasks."""
    got, kind = [], type(spark.range(1))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: got.append(collect(self)) or got[-1])
    docs = spark.createDataFrame([(i, f"good words here w{i % 3}" if i % 2 else f"bad awful thing w{i % 5}") for i in range(400)], "doc_id long, text string")
    labels = spark.range(400).selectExpr("id as doc_id", "cast(id % 2 * 2 as int) as grade")
    models = [quality.fit(docs.repartition(n, "doc_id"), labels) for n in (8, 1)]
    steps = [rows for rows in got if rows and "gradient" in rows[0]]
    assert steps and all(len(rows) == 1 and len(rows[0]["gradient"]) < 8 * 50 for rows in steps)
    assert np.allclose(models[0].weights, models[1].weights, atol=1e-6) and np.count_nonzero(models[0].weights) > 5


def test_many_labels_dont_shuffle_texts(spark, monkeypatch):
    """With more labels than are broadcast, features meet the labels, not texts; the model is the same."""
    docs = spark.createDataFrame([(i, f"good words here w{i % 3}" if i % 2 else f"bad awful thing w{i % 5}") for i in range(200)], "doc_id long, text string")
    graded = spark.createDataFrame([(i, i % 2 * 2) for i in range(0, 300, 3)], "doc_id long, grade int")
    few = quality.fit(docs, graded)
    monkeypatch.setattr(minhash, "MOST_IDS", 10)
    plan = quality._featured(docs, graded)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join") < plan.index("MapInArrow") and "text" not in plan[: plan.index("MapInArrow")]
    many = quality.fit(docs, graded)
    assert np.allclose(few.weights, many.weights, atol=1e-6) and np.isclose(few.cut, many.cut) and np.count_nonzero(many.weights) > 5


def test_texts_are_read_once(spark, tmp_path):
    """The query judges by the features that it has made for the fit."""
    spark.range(80).selectExpr("id as doc_id", "if(id < 40, 'good words here', 'bad awful thing') as text").write.parquet(f"{tmp_path}/texts")
    labels = spark.range(80).selectExpr("id as doc_id", "1 as quality", "cast(id >= 40 as int) as toxic")
    out = quality.quality_grades(spark.read.parquet(f"{tmp_path}/texts"), labels)
    assert out.inputFiles() and not any(f"{tmp_path}" in f for f in out.inputFiles())
    assert {r["doc_id"] for r in out.where("accepted").collect()} == set(range(40))


def test_described(spark):
    """Features come back from their bytes, two for a bucket and, when counts are small and packed, few more."""
    texts = ["", None, " ".join(f"w{i}" for i in range(3000)), "a " * 100_000 + "B b !!", "good words here"]
    rows = quality.described(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).toArrow().to_batches()[0]
    where, counts, sizes = quality._compressed(rows)
    each = [quality.features(t) for t in texts]
    assert (where == np.concatenate([f[0] for f in each])).all() and (counts == np.concatenate([f[1] for f in each])).all()
    assert sizes.tolist() == [len(f[0]) for f in each] and counts.max() == 100_000 and (where >= 1 << 16).any()
    assert len(rows.column("where")[2].as_py()) == 2 * sizes[2] and len(quality._compressed(rows.slice(0, 0))[2]) == 0
