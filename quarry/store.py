"""Tables written between the steps of a job, in the folder that all executors share. They go when the driver's Python ends. Rows dealt over tasks."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MADE: list = []
EACH = 5_000  # rows that a task is dealt


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def folder(spark: SparkSession, kind: str = "") -> str:
    """A new folder's path in the shared one, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quarry-{kind}{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    MADE.append((at.getFileSystem(spark._jsc.hadoopConfiguration()), at))
    return path


@atexit.register
def clear() -> None:
    """Delete what folder() has named; a JVM that is gone already keeps its folders for whoever clears the shared one."""
    while MADE:
        files, at = MADE.pop()
        with contextlib.suppress(Exception):
            files.delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own, so that later steps don't work it out again and a lost executor loses none of it."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, key: str, each: int = EACH) -> DataFrame:
    """rows by key over a task for each so many, for work that is long for its bytes: a small file, or one row group, is one task's otherwise,
    and stays one however many its rows."""
    return rows.repartition(rows.count() // each + 1, key)
