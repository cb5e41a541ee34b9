"""Operators of the ledger reports over DataFrames: joins, two-phase sums, carries and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.carry import WIDTH, carried, running_count  # noqa: F401
from quarry.operators.ordering import digest, fresh, lower_medians
from quarry.store import written


def ready_set(items: DataFrame, needs: DataFrame) -> DataFrame:
    """items (id, done, claimed_by) and needs (id, need): open items with their blockers and state. A need that is
    no item blocks too. Blockers are joined as pairs and gathered for an item only, never for all."""
    done = items.filter("done").select(F.col("id").alias("need"))
    blockers = needs.join(done, "need", "left_anti").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.col("need").cast("string"))), ",").alias("blocked_by"))
    state = F.when(F.col("blocked_by").isNotNull(), "blocked").when(F.col("claimed_by").isNotNull(), "claimed").otherwise("ready")
    return items.filter(~F.col("done")).join(blockers, "id", "left").withColumn("state", state).withColumn("blocked_by", F.coalesce("blocked_by", F.lit("")))


def two_phase(df: DataFrame, file: str, key: str, amount: Column) -> DataFrame:
    """Sums rounded to cents for each file and key, halves to even, then summed by key: cents are lost where files end."""
    part = df.groupBy(file, key).agg(F.bround(F.sum(amount), 2).alias("part"), F.count(F.lit(1)).alias("n"))
    return part.groupBy(key).agg(F.sum("part").alias("usd"), F.sum("n").alias("sessions"))


def zero_filled(domain: DataFrame, df: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    got = df.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()])
    return domain.join(got, key, "left").fillna(0, list(aggregates))


def first_sessions(df: DataFrame, by: list[str], order: str, value: str, floor: float) -> DataFrame:
    """The first value of each group, present or not, and what is wrong with it."""
    first = df.groupBy(*by).agg(F.min_by(value, order).alias("first"))
    verdict = F.when(F.col("first").isNull() | (F.col("first") == 0), "missing").when(F.col("first") < floor, "implausible").otherwise("ok")
    return first.withColumn("verdict", verdict)


def bands(df: DataFrame, by: str, value: str) -> DataFrame:
    """Smallest, lower median, largest and number of values."""
    some = written(df.select(by, value))
    ends = some.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    middle = lower_medians(some, [by], value).withColumnRenamed(by, "_by")
    return ends.join(middle, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "low", "median", "high", "n")


def sync_once(ledger: DataFrame, incoming: DataFrame, marker: str) -> DataFrame:
    """Rows whose marker the ledger does not have, appended; again changes nothing. A null marker is a marker like any other."""
    known = ledger.select(F.col(marker).alias("_known"))
    return ledger.unionByName(incoming.dropDuplicates([marker]).join(known, F.col(marker).eqNullSafe(F.col("_known")), "left_anti"))


def upsert(table: DataFrame, changes: DataFrame, key: str, value: str, insert: bool = True) -> DataFrame:
    """table with the values of changes, which may be null; rows that table lacks are added, or with insert off left out."""
    new = changes.dropDuplicates([key]).select(F.col(key).alias("_key"), F.struct(F.col(value).alias("v")).alias("_new"))
    both = table.join(new, F.col(key).eqNullSafe(F.col("_key")), "full" if insert else "left")
    both = both.withColumns({key: F.coalesce(key, "_key"), value: F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(value))})
    return both.select(*table.columns)


def metadata_diff(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row for each field that differs; absence is compared too."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])).alias("x")).select(key, "x.*")

    both = long(left, "a").join(long(right, "b"), [key, "field"], "full")
    return both.filter(~F.col("a").eqNullSafe(F.col("b")))


def supersede_audit(links: DataFrame) -> DataFrame:
    """links (id, supersedes, superseded_by): what is wrong with each pair of links."""
    other = links.select(F.col("id").alias("o"), F.col("supersedes").alias("back"))
    both = links.join(other, F.col("superseded_by") == F.col("o"), "left")
    problem = F.when(F.col("superseded_by") == F.col("id"), "self").when(F.col("superseded_by").isNotNull() & F.col("o").isNull(), "dangling").when(F.col("superseded_by").isNotNull() & ~F.col("back").eqNullSafe(F.col("id")), "one-sided").otherwise("ok")
    return both.select("id", problem.alias("problem"))


def claims(df: DataFrame, key: str, order: str, who: str, force: str | None = None, width: int = WIDTH) -> DataFrame:
    """(key, holder, refused): the holder of each key after all claims in order, and how many were refused: those of others than
    the holder, unless forced (the column force), which takes the lease over. A null claimant releases it. order is a number; of claims
    at one place the lesser claimant's comes first, a release before both.

    A release or a forced claim begins a stretch, in which one holder stays: the one that forced it, or else the first that claims. So
    stretches are numbered by a running count, and two sums over stretches are all that is left, whatever a key's number of events."""
    if force is None and not df.filter(F.col(who).isNull()).limit(1).count():  # no stretch ends: the first claimant stays
        each = df.groupBy(key, who).agg(F.min(order).alias("at"), F.count(F.lit(1)).alias("n"))
        best = F.min(F.struct("at", F.col(who).alias("holder"), "n"))
        return each.groupBy(key).agg(best.alias("b"), F.sum("n").alias("all")).select(key, F.col("b.holder").alias("holder"), (F.col("all") - F.col("b.n")).alias("refused"))
    forced = F.coalesce(F.col(force), F.lit(False)) if force else F.lit(False)
    e = df.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(who).alias("who"), forced.alias("force"))
    e = e.withColumn("turn", F.struct("who", "force"))
    begins = F.col("who").isNull() | F.col("force")
    e = running_count(e, "key", "at", begins, "stretch", width, ["turn"])
    first = F.min_by("who", F.when(F.col("who").isNotNull(), F.struct("at", "turn")))
    mine = e.groupBy("key", "stretch").agg(first.alias("holder"))
    counted = e.join(mine.withColumnsRenamed({"key": "k", "stretch": "s"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("stretch") == F.col("s")))
    refused = counted.groupBy("key").agg(F.count_if((F.col("who") != F.col("holder")) & ~F.col("force")).alias("refused"), F.max(F.struct("stretch", "holder")).alias("last"))
    return refused.select(F.col("key").alias(key), F.col("last.holder").alias("holder"), "refused")


def transitions(df: DataFrame, key: str, order: str, cycle: str, given: str | None = None) -> DataFrame:
    """Each row with verdict, what a move out of verify says: approved to ship, punch-list back to build, design or frame, else
    nothing; a given verdict (the column given) goes before it."""
    old, new = F.lag(cycle).over(Window.partitionBy(key).orderBy(order)), F.col(cycle)
    said = F.when(new == "ship", "approved").when(new.isin("build", "design", "frame"), "punch-list")
    return df.withColumn("_old", old).withColumn("verdict", F.when(F.col("_old") == "verify", F.coalesce(F.col(given), said) if given else said)).drop("_old")


def differs(stored: DataFrame, now: DataFrame) -> bool:
    """Whether a stored index is out of date: one pass over each, and one row of each is compared."""
    return not fresh(digest(stored), digest(now)).first().same


def envelope(command: str, generated_at: str, rows: DataFrame) -> DataFrame:
    """One JSON document {schema_version, command, generated_at, data}; for report-sized rows."""
    data = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("data"))
    return data.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(command).alias("command"), F.lit(generated_at).alias("generated_at"), "data"), {"ignoreNullFields": "false"}).alias("json"))
