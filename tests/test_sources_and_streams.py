import pandas as pd
from pyspark.sql import functions as F

from tabloom.operators import rowwise
from tabloom.plans import queries
from tabloom.sources import files
from tabloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, 'say "x"', None)], "i int, s string, d double")
    files.write_csv(df, f"file://{tmp_path}/csv")
    assert sorted(files.read_csv(spark, f"file://{tmp_path}/csv", df.schema).collect()) == sorted(df.collect())


def test_tables_and_frames(spark):
    files.write_table(files.from_pandas(spark, pd.DataFrame({"word": ["x", "database"]}), "frame"), "words_saved")
    files.write_table(spark.sql("select word from frame"), "words_saved", mode="append")
    assert rowwise.substring_filter(spark.table("words_saved")).count() == 2
    spark.sql("drop table words_saved")


def test_materialise(spark):
    df = files.materialise(spark.range(5).withColumn("x", F.lit(None).cast("string")))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().executedPlan().toString()
    files.discard(df)


def test_streams(spark, tmp_path):
    events = files.table(spark, SF, "events")
    source = f"{tmp_path}/events"
    events.repartition(4).write.parquet(source)
    stream = jobs.stream_parquet(spark, source, events.schema, files_per_trigger=2)
    lists = stream.select(F.col("event_type").alias("name"), F.concat_ws(",", F.col("event_id").cast("string"), F.lit("x")).alias("values"))
    jobs.run_available(rowwise.token_split(lists), "tokens_out", f"{tmp_path}/c1")
    assert spark.table("tokens_out").count() == events.count()
    jobs.run_available(jobs.windowed_label_count(stream, "error"), "counts_out", f"{tmp_path}/c2", mode="complete")
    assert sorted(spark.table("counts_out").collect()) == sorted(queries.window_label_count(spark, SF).collect())
