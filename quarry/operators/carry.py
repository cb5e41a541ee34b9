"""Running values along a group, in two levels.

A group is cut into chunks by its order: chunk n has the rows with order from n * width up to the next. A window runs within
each chunk, the last value of each chunk is carried over the chunks of its group, and rows take what their chunk starts with. So a group of
half of all rows is spread over as many tasks as it has chunks, and only a row a chunk meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16  # of a chunk, in units of the order


def chunk_of(order: str, width: int = WIDTH) -> Column:
    """The chunk of a row; rows without a place come first, as they do when sorted."""
    return F.coalesce(F.floor(F.col(order) / width).cast("long"), F.lit(-(1 << 62)))


def started(df: DataFrame, by: list[str], within: Column, over: Column, name: str, width_of: Column) -> DataFrame:
    """df with _chunk and name: what the chunks before a row's chunk carry into it. within makes a chunk's summary, over
    runs along summaries of a group in order of their chunks."""
    cut = df.withColumn("_chunk", width_of)
    sums = cut.groupBy(*by, "_chunk").agg(within.alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_chunk").alias("_at"), over.over(before).alias(name))
    on = F.col("_chunk") == F.col("_at")
    for i, b in enumerate(by):
        on &= F.col(b).eqNullSafe(F.col(f"_by{i}"))
    return cut.join(ahead, on).drop("_at", *[f"_by{i}" for i in range(len(by))])


def carried(df: DataFrame, by: str | list[str], order: str, value: str, width: int = WIDTH) -> DataFrame:
    """The last value seen so far in the group, for rows without one; rows before the first value have none.

    order is a number and decides between rows of a group; rows of one order are taken in any order. Null groups are a group."""
    by = [by] if isinstance(by, str) else by
    last = F.max_by(F.struct(F.col(value).alias("v")), F.when(F.col(value).isNotNull(), F.col(order)))
    some = F.when(F.count(value) > 0, last)
    got = started(df, by, some, F.last_value("_sum", F.lit(True)), "_start", chunk_of(order, width))
    w = Window.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return got.withColumn(value, F.coalesce(F.last_value(value, F.lit(True)).over(w), F.col("_start.v"))).drop("_chunk", "_start")


def running_count(df: DataFrame, by: str | list[str], order: str, flag: Column, name: str, width: int = WIDTH, ties: list[str] | None = None) -> DataFrame:
    """df with name: how many rows of the group up to and with this one have the flag; ties order rows of one place."""
    by = [by] if isinstance(by, str) else by
    got = started(df, by, F.count_if(flag), F.sum("_sum"), "_start", chunk_of(order, width))
    w = Window.partitionBy(*by, "_chunk").orderBy(order, *(ties or ())).rowsBetween(Window.unboundedPreceding, 0)
    return got.withColumn(name, F.coalesce("_start", F.lit(0)) + F.count_if(flag).over(w)).drop("_chunk", "_start")


def running_sum(df: DataFrame, by: str | list[str], order: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """df with name: the sum of the values of the group up to and with this row. Rows of one place are taken in any order."""
    by = [by] if isinstance(by, str) else by
    got = started(df, by, F.sum(value), F.sum("_sum"), "_start", chunk_of(order, width))
    w = Window.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return got.withColumn(name, F.coalesce("_start", F.lit(0)) + F.sum(value).over(w)).drop("_chunk", "_start")
