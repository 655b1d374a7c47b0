import math

import pytest
from pyspark.sql import functions as F

from tabloom.functions import text
from tabloom.operators import contract, fold, generators, iterative, rowwise
from tabloom.plans import report, sqlapi
from tabloom.sources import files


def words(spark, values):
    return spark.createDataFrame([(v,) for v in values], "word string")


def test_contract(spark):
    df = spark.createDataFrame([(1, "a")], "a long, word string")
    assert contract.get("identity")(df).collect() == df.select("a").collect()
    with pytest.raises(ValueError, match="missing"):
        contract.get("token_split")(df)
    with pytest.raises(ValueError, match="not a text"):
        contract.get("substring_filter")(df, word_col="a")
    with pytest.raises(ValueError, match="already"):
        contract.register(contract.get("identity"))
    assert {"kmeans", "create_points", "label_count"} <= set(contract.names())


def test_substring_filter(spark):
    df = words(spark, ["DATABASE", "xDataBase1", "data base", "dadatabase", "databas", "", None, "ÄDATABASE"])
    assert [r["word"] for r in rowwise.substring_filter(df).collect()] == ["DATABASE", "xDataBase1", "dadatabase", "ÄDATABASE"]
    odd = words(spark, ["100%", "100x", "a_b", "acb"])
    assert [r["word"] for r in rowwise.substring_filter(odd, "%").collect()] == ["100%"]
    assert [r["word"] for r in rowwise.substring_filter(odd, "A_B").collect()] == ["a_b"]


def test_substring_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("text", "word")
    plan = rowwise.substring_filter(df, "data").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan and "Contains(lower(text" in plan and "Python" not in plan


@pytest.mark.parametrize("values, label, other", [([], 0, 0), (["lifestyle", "Lifestyle", None], 1, 2)])
def test_label_count(spark, values, label, other):
    got = {r["word"]: r["word_count"] for r in fold.label_count(words(spark, values)).collect()}
    assert got == {"lifestyle": label, "other": other}


def test_token_split(spark):
    rows = [("a", "1,,2,"), ("b", "-5,007,+5, 5,5 ,1.5,NaN,12abc,12\n"), ("c", "99999999999999999999,9223372036854775807"), ("d", ""), ("e", ","), ("f", None)]
    df = spark.createDataFrame(rows, "name string, values string")
    want = [("a", 1), ("a", 2), ("b", -5), ("b", 7), ("c", 2**63 - 1)]
    assert sorted(map(tuple, rowwise.token_split(df).collect())) == want
    sqlapi.register_functions(spark)
    df.createOrReplaceTempView("odd_lists")
    assert sorted(map(tuple, spark.sql("select * from token_split(table(odd_lists))").collect())) == want
    piped = spark.createDataFrame([("a", "1|2")], "name string, values string")
    assert rowwise.token_split(piped, sep="|").count() == 2


def test_table_functions_take_batches(spark):
    """The functions over tables are Arrow ones, batch by batch, and agree with the operators on odd rows."""
    sqlapi.register_functions(spark)
    zeros = "0" * 5000
    rows = [("a", f"{zeros}12,-{zeros},-9223372036854775808,-9223372036854775809,-,--1,1\n"), (None, "7,x"), ("b", None), ("c", "é1,１,1"), ("d", "000000000000000000042,999999999999999999,9999999999999999999")]
    rows = spark.createDataFrame(rows * 300, "name string, values string").repartition(2)
    rows.createOrReplaceTempView("batched_lists")
    key = lambda r: (r[0] or "", r[1])
    got = spark.sql("select * from token_split(table(batched_lists))")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, rowwise.token_split(rows).collect()), key=key)
    assert got.count() == 300 * 7 and spark.sql("select * from token_split(table(select * from batched_lists limit 0))").count() == 0
    rows.selectExpr("values as word").createOrReplaceTempView("batched_words")
    got = spark.sql("select * from substring_filter(table(batched_words), 'É1')")
    assert [r["word"] for r in got.collect()] == ["é1,１,1"] * 300
    assert "ArrowEvalPythonUDTF" in got._jdf.queryExecution().executedPlan().toString()


def xy(spark, rows):
    return spark.createDataFrame(rows, "x double, y double")


def test_fits(spark):
    curve = xy(spark, [(float(x), 3.0 - 2 * x + x * x) for x in range(10)] + [(None, 1.0), (1.0, None)])
    assert list(fold.quadratic_fit(curve).first()) == pytest.approx([3, -2, 1])
    assert [r["coefficient"] for r in fold.polynomial_fit(curve, 3).collect()] == pytest.approx([3, -2, 1, 0], abs=1e-6)
    assert fold.linear_fit(xy(spark, [(0.0, 1.0), (2.0, 5.0)])).first().asDict() == {"intercept": 1.0, "slope": 2.0}
    empty = xy(spark, [])
    assert all(math.isnan(v) for v in fold.quadratic_fit(empty).first())
    assert all(math.isnan(r["coefficient"]) for r in fold.polynomial_fit(empty, 1).collect())
    assert list(fold.linear_fit(empty).first()) == [None, None]
    for two in ([(1.0, 1.0), (2.0, 3.0)], [(0.1, 1.0), (0.3, 2.0)] * 50, [(5.0, 1.0)] * 9):
        rows = fold.quadratic_fit(xy(spark, two)).collect()
        assert len(rows) == 1 and all(math.isnan(v) for v in rows[0])
        assert all(math.isnan(r["coefficient"]) for r in fold.polynomial_fit(xy(spark, two)).collect())


def test_fit_far_from_zero(spark):
    """Epoch seconds: curvature and values come out, though powers of x are beyond a double's digits."""
    curve = [(1.7e9 + i, 3.0 - 2 * i + i * i) for i in range(100)]
    a, b, c = fold.quadratic_fit(xy(spark, curve)).first()
    assert c == pytest.approx(1, rel=1e-9) and b + 2 * c * 1.7e9 == pytest.approx(-2, abs=1e-4)
    assert [r["coefficient"] for r in fold.polynomial_fit(xy(spark, curve), 2).collect()] == pytest.approx([a, b, c])
    far = fold.polynomial_fit(xy(spark, [(1e6 + i, 5.0 * i) for i in range(50)]), 1).collect()
    assert [r["coefficient"] for r in far] == pytest.approx([-5e6, 5])


def test_kmeans(spark):
    df = xy(spark, [(float(x), 0.0) for x in range(20)])
    with pytest.raises(ValueError, match="8 rows"):
        iterative.kmeans(df.limit(5))
    with pytest.raises(ValueError, match="NaN"):
        iterative.kmeans(xy(spark, [(math.nan, 1.0)] * 9))
    tie = iterative.kmeans(xy(spark, [(0.0, 0.0)]), k=2, init=[(-1.0, 0.0), (1.0, 0.0)], max_iter=0)
    assert tie.first()["cluster_id"] == 0
    same = iterative.kmeans(xy(spark, [(1.0, 1.0)] * 10))
    assert {r["cluster_id"] for r in same.collect()} == {0}
    a, b = (iterative.kmeans(df.repartition(n), init=[(float(5 * i), 0.0) for i in range(4)], k=4) for n in (1, 8))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    three = df.withColumn("z", F.col("x") * 2)
    assert iterative.kmeans(three, k=3, features=("x", "y", "z")).select("cluster_id").distinct().count() == 3


def test_generators(spark):
    for n, size in ((1000, 1001), (10_000, 10_001), (64, 64)):
        assert generators.points(spark, n).count() == size
    sizes = {r["cluster_id"]: r["count"] for r in generators.points(spark, 6400).groupBy("cluster_id").count().collect()}
    assert sizes == {0: 800, 1: 800, 2: 800, 3: 800, 4: 800, 5: 100, 6: 1500, 7: 800}
    fit = fold.quadratic_fit(generators.curve(spark, 50_000)).first()
    assert list(fit) == pytest.approx([3, -2, 1], abs=0.15)
    assert sum("database" in p.lower() for p in generators.PHRASES) == 13 and len(generators.PHRASES) == 59
    share = rowwise.substring_filter(generators.words(spark, 20_000)).count() / 20_000
    assert share == pytest.approx(13 / 59, abs=0.02)
    lists = generators.arrays(spark, 5000).select(F.size(F.split("values", ",")).alias("n"), "values")
    assert lists.where("values != ''").agg(F.avg("n")).first()[0] == pytest.approx(10, abs=0.3)


def test_report(spark):
    logs = spark.createDataFrame([("kmeans_big_100", "[1.0, 2.5,3]"), ("plain", "[4]")], "full string, times string")
    name, size = report.split_name(F.col("full"))
    got = [tuple(r) for r in report.list_to_rows(logs, "times").select(name, size, "run_id", "runtime").collect()]
    assert got == [("kmeans_big", 100, 1, 1.0), ("kmeans_big", 100, 2, 2.5), ("kmeans_big", 100, 3, 3.0), ("plain", None, 1, 4.0)]


def test_sql_generators(spark):
    sqlapi.register_functions(spark)
    want = [r["word"] for r in generators.words(spark, 50).collect()]
    assert [r["word"] for r in spark.sql("select * from create_words(0, 50)").collect()] == want
    dealt = spark.sql("select w.word from range(0, 50, 10) r, lateral create_words(r.id, 10) w").collect()
    assert sorted(r["word"] for r in dealt) == sorted(want)
    got = spark.sql("select * from create_curve(0, 20, 3, -2, 1)").collect()
    for a, b in zip(got, generators.curve(spark, 20).collect(), strict=True):
        assert tuple(a) == pytest.approx(tuple(b))


def test_load_logs(spark, tmp_path):
    path = tmp_path / "times.csv"
    path.write_text('name,compilation_time,execution_times,db_state\nkmeans_1000,0.5,"[1.5, 2]","{""compilationmode"": ""o"", ""_dop"": 4}"\nother,0.1,[3],"{""compilationmode"": ""a""}"\n')
    got = report.load_logs(spark, f"file://{path}", {"kmeans": "Clusters"})
    rows = sorted((r["name"] or "", r["data_size"], r["run_id"], r["runtime"], r["compilationmode"], r["num_threads"]) for r in got.collect())
    assert rows == [("", None, 1, 3.0, "a", None), ("Clusters", 1000, 1, 1.5, "o", 4), ("Clusters", 1000, 2, 2.0, "o", 4)]


def test_random_start_does_not_depend_on_partitions(spark):
    df = xy(spark, [(float(x * 7 % 40), float(x)) for x in range(40)])
    a, b = (sorted(map(tuple, iterative.kmeans(df.repartition(n), k=4, init="random").collect())) for n in (1, 7))
    assert a == b


def test_text_helpers(spark):
    df = spark.createDataFrame([("abcdef",), ("ab",), ("12\n",), (None,)], "s string")
    assert [r[0] for r in df.select(text.drop_left(F.col("s"), 3)).collect()] == ["def", "", "", None]
    assert [r[0] for r in df.select(text.matches_whole(F.col("s"), "[a-z]+|[0-9]+")).collect()] == [True, True, False, None]


def test_shared_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default=None: "yarn" if key == "spark.master" else default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.shared_folder(type("Session", (), {"conf": Conf}))
