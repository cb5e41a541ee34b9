"""Shared plumbing of the corpus operators: document keys, written stages and code shipping."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.store import folder, shared_dir, written  # noqa: F401

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-code-"), "quarry.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    sc.addPyFile(path)
    sc._quarry_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(docs: DataFrame, *extra: str) -> tuple[DataFrame, bool]:
    """(k, doc_id, text, *extra) for each row, and whether k is unique.

    k orders documents as doc_id does. Where ids are all present and unique, k is doc_id. Otherwise
    equal rows of (doc_id, text) are one document with one k, a null id comes before all others,
    and different texts under one id are different documents, ordered by a digest of the text.
    """
    ids = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)
    if ids[0] == ids[1] == ids[2]:
        return base.select(F.col("doc_id").alias("k"), "doc_id", "text", *extra), True
    base = base.withColumn("_d", F.md5("text"))
    order = base.select("doc_id", "_d").distinct().sort("doc_id", "_d")
    ranked = order.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    ranks = written(docs.sparkSession.createDataFrame(ranked, "_id long, _e string, k long"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_e"))
    return base.join(ranks, on).select("k", "doc_id", "text", *extra), False


def text_classes(kd: DataFrame, *extra: str) -> DataFrame:
    """(k, rep, copies, *extra): rep is the smallest k of the copies with this text, by 128 bits of hash. Copies
    are counted before the shuffle, and the join back can be split on a hot text."""
    digest = kd.select("k", *extra, F.xxhash64("text").alias("a"), F.xxhash64(F.lit(17), "text").alias("b"))
    reps = digest.groupBy("a", "b").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return written(digest.join(reps, ["a", "b"]).select("k", "rep", "copies", *extra))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slim() -> None:
    """Give freed memory of this Python worker back to the machine; the worker waits for its next task beside the JVM."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def components(links: DataFrame, label: str = "comp") -> DataFrame:
    """(k, label): the smallest k reachable from each k that has links (a, b).

    Labels move along links and then along labels, so a chain halves each round; every round is one
    grouped aggregation of links and one join, written out, until no label changes.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    now = written(both.groupBy(F.col("a").alias("k")).agg(F.least(F.col("a"), F.min("b")).alias("c")))
    while True:
        seen = both.join(now, F.col("b") == F.col("k")).groupBy("a").agg(F.min("c").alias("m"))
        step = now.join(seen, F.col("k") == F.col("a"), "left").select("k", "c", F.least("c", "m").alias("m"))
        jump = now.select(F.col("k").alias("j"), F.col("c").alias("d"))
        new = written(step.join(jump, F.col("m") == F.col("j"), "left").select("k", F.least("m", "d").alias("c"), (F.col("c") != F.least("m", "d")).alias("moved")))
        moved = new.filter("moved").limit(1).count()
        now = new.select("k", "c")
        if not moved:
            return now.withColumnRenamed("c", label)
