"""Order over whole tables without one task that holds them: ids in order, exact medians, bounded documents, digests."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.carry import WIDTH, running_sum
from quarry.store import written

BUCKETS = 64  # of a table that is numbered
RANGES, MANY = 1024, 100_000  # ranges that a pass counts in, distinct values that a group may have in the last one


def leading(c: Column, skip: int = 0) -> Column:
    """The first seven bytes of a text behind those to skip as a number, in the order of texts that are the same so far."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), skip + 1, 7)), 14, "0"), 16, 10).cast("long")


def numbered(df: DataFrame, base: Column, order: str, ties: tuple[str, ...] = (), name: str = "new_id", buckets: int = BUCKETS) -> DataFrame:
    """df with ids base + 1, base + 2 .. in the order of a text column, ties after it.

    Bounds of about equal shares are estimated once and become constants, so a row's bucket is a function of the row; a bucket's ids begin behind
    the counts of those before it, and only within a bucket rows are sorted. Rows without a text come first. Only bounds reach the driver."""
    ends = [x.encode() for x in df.agg(F.min(order), F.max(order)).first() if x is not None]
    key = F.coalesce(leading(F.col(order), len(os.path.commonprefix(ends))), F.lit(-1))  # behind what all texts begin with
    cuts = df.agg(F.percentile_approx(key, F.lit([i / buckets for i in range(1, buckets)]), 10_000)).first()[0] or []
    cut = df.withColumn("_bucket", F.size(F.filter(F.lit(sorted(set(cuts)) or [0]), lambda b: b < key)))
    counts = cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # at most a row a bucket
    before = counts.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(order, *ties))
    return cut.join(F.broadcast(before), "_bucket").withColumn(name, base + F.col("_before") + place).drop("_bucket", "_before")


def framed(bullets: DataFrame, there: DataFrame, base: Column) -> DataFrame:
    """(path, place, summary, complexity, slug, refusal, new_id) of unpromoted backlog lines (path, place, summary, complexity) of stages. A stage
    is framed whole or not at all: refusal says of each line why not (no summary, same slug as another line of the stage, a spec of the slug in there
    (project, slug)), or that another line of its stage is refused. The others get ids from base + 1 on by path and place."""
    b = bullets.select("path", "place", "summary", "complexity", X.slugify(F.col("summary")).alias("slug"), F.regexp_extract("path", "(PROJ-[0-9]+)", 1).alias("project"))
    again = b.groupBy("path", "slug").agg((F.count(F.lit(1)) > 1).alias("again"))
    known = there.select("project", "slug").distinct().withColumn("known", F.lit(True))
    b = b.join(again, ["path", "slug"]).join(known, ["project", "slug"], "left")
    b = b.withColumn("refusal", F.when(F.trim("summary") == "", "no summary").when(F.col("again"), "same slug").when(F.col("known"), "exists"))
    bad = b.groupBy("path").agg(F.count("refusal").alias("bad"))
    b = b.join(bad, "path").withColumn("refusal", F.coalesce("refusal", F.when(F.col("bad") > 0, "stage refused")))
    b = written(b.select("path", "place", "summary", "complexity", "slug", "refusal"))
    good = b.filter("refusal IS NULL").withColumn("_at", F.concat("path", F.lit("\0"), F.lpad(F.col("place").cast("string"), 12, "0")))
    return numbered(good, base, "_at").drop("_at").unionByName(b.filter("refusal IS NOT NULL").withColumn("new_id", F.lit(None).cast("long")))


def lower_medians(df: DataFrame, by: list[str], value: str, many: int = MANY) -> DataFrame:
    """(by.., median): the lower median of the values of each group that are not null, exactly.

    Each pass counts the rows of a group in RANGES equal ranges of what is left of its values and keeps the one that holds the middle row,
    until it has at most many rows or one value; then the distinct values in it are counted. A group is never sorted or gathered, and null groups are groups."""
    d = F.col(value).cast("double")
    keys = [F.col(b).alias(f"_by{i}") for i, b in enumerate(by)]
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"), d.alias("d"))
    names = [f"_by{i}" for i in range(len(by))]
    now = written(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).withColumn("rank", ((F.col("n") + 1) / 2).cast("long")))

    def within(params: DataFrame) -> DataFrame:
        p = params.select(*[F.col(n).alias(f"{n}p") for n in names], "lo", "hi", "rank", "n")
        on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}p")) for n in names], F.col("d").between(F.col("lo"), F.col("hi")))
        return rows.join(p, on).drop(*[f"{n}p" for n in names])

    while now.filter((F.col("n") > many) & (F.col("lo") < F.col("hi"))).limit(1).count():
        wide = (F.col("n") > many) & (F.col("lo") < F.col("hi"))
        share = (F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES
        at = F.least(F.floor(share), F.lit(RANGES - 1))
        counted = within(now.filter(wide)).groupBy(*names, "rank", at.alias("at")).agg(F.count(F.lit(1)).alias("m"), F.min("d").alias("lo"), F.max("d").alias("hi"))
        upto = counted.withColumn("upto", F.sum("m").over(Window.partitionBy(*names).orderBy("at")))  # at most RANGES rows a group
        found = upto.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("m") < F.col("rank")))
        found = found.select(*names, F.col("m").alias("n"), "lo", "hi", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"))
        now = written(now.filter(~wide).unionByName(found))
    counted = within(now).groupBy(*names, "rank", "v").agg(F.count(F.lit(1)).alias("m"))
    upto = counted.withColumn("upto", F.sum("m").over(Window.partitionBy(*names).orderBy("v")))
    found = upto.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("m") < F.col("rank")))
    return found.select(*[F.col(n).alias(b) for n, b in zip(names, by, strict=True)], F.col("v").alias("median"))


def documents(rows: DataFrame, by: str, order: str, command: str, generated_at: str, most: int = 1 << 20, width: int = WIDTH) -> DataFrame:
    """(by, part, json): envelopes of the rows of each value of by, in order, cut into parts so that none has more than
    most bytes of rows, but for one row that is longer by itself. part counts from 1. Rows are numbered in order first, so that sizes can be
    added up chunk by chunk, whatever the size of a group."""
    data = F.to_json(F.struct(*[c for c in rows.columns if c != by]), {"ignoreNullFields": "false"})
    placed = numbered(written(rows.select(by, F.col(order).cast("string").alias("_order"), data.alias("_row"))), F.lit(0), "_order", ("_row",), "_place")
    sized = running_sum(placed.withColumn("_size", F.octet_length("_row") + 1), by, "_place", "_size", "_upto", width)
    sized = sized.withColumn("part", (F.floor((F.col("_upto") - F.col("_size")) / most) + 1).cast("int"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_row"))), lambda x: x["_row"]), ",")
    docs = sized.groupBy(by, "part").agg(body.alias("_body"))
    head = F.regexp_replace(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(command).alias("command"), F.lit(generated_at).alias("generated_at"))), "\\}$", "")
    return docs.select(by, "part", F.concat(head, F.lit(',"part":'), F.col("part").cast("string"), F.lit(',"data":['), "_body", F.lit("]}")).alias("json"))


def digest(df: DataFrame) -> DataFrame:
    """One row (n, a, b) of the rows of df, whatever their order and as often as each is there: two sums of hashes, added up in each task."""
    names = sorted(df.columns)
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in names])
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), nulls, *values).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n"), total(0).alias("a"), total(17).alias("b"))


def fresh(stored: DataFrame, now: DataFrame) -> DataFrame:
    """One row (same, stored, now): whether two digests agree, and their numbers of rows."""
    s = stored.select(F.col("n").alias("stored"), F.col("a").alias("sa"), F.col("b").alias("sb"))
    return s.join(now.select(F.col("n").alias("now"), "a", "b")).select(((F.col("stored") == F.col("now")) & (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb"))).alias("same"), "stored", "now")  # one row by one row


def decision_index(decisions: DataFrame) -> DataFrame:
    """(id, line): a line of the index for each decision, with its state."""
    line = F.concat(F.lit("| "), F.col("id"), F.lit(" | "), X.cell(F.col("title")), F.lit(" | "), F.col("effective"), F.lit(" |"))
    return decisions.select("id", line.alias("line"))
