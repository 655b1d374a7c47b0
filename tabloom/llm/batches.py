"""What several operators need: batches for Python workers that suit long texts, names that aren't taken, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.sources.files import materialise

ROWS = 1000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(df: DataFrame) -> DataFrame:
    """Limit the session's Arrow batches to ROWS rows: texts of some kilobytes make a batch of a few megabytes then.

    The limit is read when a plan runs, so it stays set in the session; it never rises.
    """
    now = int(df.sparkSession.conf.get(_KEY, "10000"))
    if now <= 0 or now > ROWS:
        df.sparkSession.conf.set(_KEY, str(ROWS))
    return df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def running_sums(df: DataFrame, order: str, sums: dict[str, Column]) -> DataFrame:
    """The rows with, for each name of ``sums``, the sum of the column over all rows that come before in the order.

    order is a column without repeated values, or with repeated ones whose rows may come in any order. Rows are dealt
    out by ranges of it and written; a range's rows are summed in one task, and only one number a range is summed in
    a single one.
    """
    part = free_name(df, "_range")
    ranged = df.repartitionByRange(F.col(order).asc_nulls_last()).withColumn(part, F.spark_partition_id())
    ranged = materialise(ranged.select("*", *(c.alias(f"{n}_own") for n, c in sums.items())), "ranges")
    every = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(part).agg(*(F.sum(f"{n}_own").alias(f"{n}_start") for n in sums))
    starts = starts.select(part, *(F.coalesce(F.sum(f"{n}_start").over(every), F.lit(0)).alias(f"{n}_start") for n in sums))
    within = Window.partitionBy(part).orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), part)
    return out.select(*df.columns, *((F.col(f"{n}_start") + F.coalesce(F.sum(f"{n}_own").over(within), F.lit(0))).alias(n) for n in sums))
