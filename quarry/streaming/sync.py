"""Exactly-once append of a stream by marker, as foreachBatch over a ledger laid out by marker.

Within the stream, markers seen before the watermark are dropped by Spark's own keyed state. The ledger is partitioned by a hash of the marker, so a
batch reads only the buckets of its markers, and it holds what was seen before that, over restarts and under new checkpoints too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 256  # of a ledger; fixed when it is made


def bucket_of(marker: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(marker), F.lit(buckets)).cast("int")


def known(batch: DataFrame, marker: str, ledger: str, buckets: int) -> DataFrame:
    """The markers of the ledger in the buckets of a batch; other buckets' files are not read."""
    mine = [r[0] for r in batch.select(bucket_of(marker, buckets).alias("b")).distinct().collect()]  # at most so many buckets
    return batch.sparkSession.read.parquet(ledger).filter(F.col("bucket").isin(mine)).select(F.col(marker).alias("_known"))


def sync_stream(stream: DataFrame, marker: str, ledger: str, checkpoint: str, event_time: str | None = None, delay: str = "1 hour", buckets: int = BUCKETS) -> StreamingQuery:
    """Append rows with new markers to the Parquet ledger, which gets a column bucket; a batch that is run again adds nothing. A null
    marker is a marker like any other. With event_time, a marker that comes again within the delay is dropped by keyed state before it reaches the
    ledger; a later one, or one after the state was lost, is found in the ledger. A row behind the watermark is dropped; a run without
    event_time takes it."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).withColumn("bucket", F.lit(0)).write.mode("ignore").partitionBy("bucket").parquet(ledger)

    def add(batch: DataFrame, epoch: int) -> None:
        batch = batch.dropDuplicates([marker])
        there = batch.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(ledger).drop("content").limit(1).count()
        if there:
            old = known(batch, marker, ledger, buckets)
            batch = batch.join(old, F.col(marker).eqNullSafe(F.col("_known")), "left_anti")
        batch.withColumn("bucket", bucket_of(marker, buckets)).write.mode("append").partitionBy("bucket").parquet(ledger)

    if event_time:
        stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([marker])
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
