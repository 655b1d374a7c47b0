"""Analytics over logs of timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.sources.files import read_csv


def split_name(name: Column) -> tuple[Column, Column]:
    """A name like ``kmeans_large_1000`` at its last underscore: the text before, the number after (NULL if none)."""
    pattern = r"^(.*)_([0-9]+)\z"
    number = F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")).cast("bigint")
    return F.when(number.isNull(), name).otherwise(F.regexp_extract(name, pattern, 1)), number


def list_to_rows(df: DataFrame, column: str, position: str = "run_id", value: str = "runtime") -> DataFrame:
    """A row for each number of a text like ``[1.5,2,3]``, with its place from 1."""
    numbers = F.split(F.regexp_replace(F.col(column), r"[\[\] ]", ""), ",")
    rest = [c for c in df.columns if c != column]
    out = df.select(*rest, F.posexplode(numbers).alias("_p", "_v"))
    return out.select(*rest, (F.col("_p") + 1).alias(position), F.expr("try_cast(_v as double)").alias(value))


# The columns of the logs of timings, as text that ``list_to_rows`` and ``json_columns`` take apart. Fixed values.
LOG_SCHEMA = "name string, compilation_time double, execution_times string, db_state string"


def load_logs(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """(name, data_size, compilation_time, run_id, runtime, compilationmode, num_threads): a row for each run in CSV logs."""
    logs = read_csv(spark, path, LOG_SCHEMA)
    name, size = split_name(F.col("name"))
    logs = logs.withColumns({"name": name, "data_size": size})
    logs = json_columns(logs, "db_state", {"compilationmode": "string", "_dop": "int"}).withColumnRenamed("_dop", "num_threads")
    out = list_to_rows(logs, "execution_times")
    return recode(out, "name", names) if names else out


def json_columns(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """The keys of a column of JSON objects as columns in its place; keys that an object lacks are NULL."""
    parsed = F.from_json(column, ", ".join(f"`{k}` {kind}" for k, kind in fields.items()))
    rest = [c for c in df.columns if c != column and c not in fields]
    return df.select(*rest, *(parsed[k].alias(k) for k in fields))


def recode(df: DataFrame, column: str, labels: dict[str, str]) -> DataFrame:
    """The column's values as their labels; values without one become NULL."""
    out = F.lit(None).cast("string")
    for value, label in labels.items():
        out = F.when(F.col(column) == value, label).otherwise(out)
    return df.withColumn(column, out)


def round_sizes(df: DataFrame, column: str, step: int, most: int | None = None) -> DataFrame:
    """The rows whose size is a multiple of ``step`` and at most ``most``."""
    out = df.where(F.col(column) % step == 0)
    return out if most is None else out.where(F.col(column) <= most)


def medians(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The median of each value column by group."""
    return df.groupBy(*keys).agg(*(F.median(v).alias(v) for v in values))


def throughput(df: DataFrame, rows: str = "data_size", runtime: str = "runtime", threads: str = "num_threads", compilation: str = "compilation_time") -> DataFrame:
    """Runtimes for one thread and with compilation, and rows a second and thread."""
    single = F.col(runtime) * F.col(threads)
    return df.withColumns(
        {
            "runtime_single_threaded": single,
            "runtime_with_compilation": F.col(runtime) + F.col(compilation),
            "runtime_with_compilation_single_threaded": single + F.col(compilation),
            "rows_per_thread_second": F.try_divide(F.col(rows), single + F.col(compilation)),
        }
    )


def bind_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames by column name; columns that a frame lacks are NULL."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
