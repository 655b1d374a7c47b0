"""Parquet and CSV in and out, tables, and the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: Quotes inside quoted values are doubled.
QUOTE = '"'


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """A CSV file or folder with a header line. The schema is a must: inference would read all data twice."""
    return spark.read.csv(path, header=True, schema=schema, sep=sep, mode="FAILFAST", escape=QUOTE)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep, escape=QUOTE)


def write_table(df: DataFrame, name: str, mode: str = "errorifexists") -> None:
    """``create table`` and ``insert into ... select`` (mode="append")."""
    df.write.mode(mode).saveAsTable(name)


def from_pandas(spark: SparkSession, frame, view: str | None = None) -> DataFrame:
    """A pandas frame as a relation, under a view's name if one is given."""
    df = spark.createDataFrame(frame)
    if view:
        df.createOrReplaceTempView(view)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and all runs on one machine, as in tests, a temporary folder is
    taken; on a cluster that raises, as executors don't see each other's folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.tabloom.folder", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.tabloom.folder", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write the rows to the shared folder as Parquet and read them again.

    This cuts the lineage: what comes later starts from files that survive the
    loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tabloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """The files of the shuffles of what runs within are deleted at once instead of when the driver's memory is cleared."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised frame once nothing reads them any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
