"""Streams: row-wise operators run as they are; folds run as aggregates that Spark keeps as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_parquet(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream; each file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_label_count(events: DataFrame, label: str, time_col: str = "ts", word_col: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, label_rows, other_rows) by window of event time; the watermark bounds the state."""
    hit = F.coalesce(F.col(word_col) == label, F.lit(False))
    kind = events.schema[time_col].dataType
    if events.isStreaming:  # watermarks are for times with a zone only
        events = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return (
        events.withWatermark(time_col, late)
        .groupBy(F.window(time_col, window))
        .agg(F.count_if(hit).alias("label_rows"), F.count_if(~hit).alias("other_rows"))
        .select(F.col("window.start").cast(kind).alias("start"), "label_rows", "other_rows")
    )


def run_available(df: DataFrame, table: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what is there now into a table in memory, and end."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
