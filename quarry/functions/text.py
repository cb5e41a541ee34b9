"""Scalar functions of the ledger reports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZES = ("XS", "S", "M", "L", "XL", "XXL")


def let(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def slugify(c: Column) -> Column:
    """Lower case, each run of other characters a hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def size_rank(c: Column) -> Column:
    """1 to 6 for XS to XXL, 0 for anything else."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SIZES]), c), F.lit(0)), F.lit(0)).cast("int")


def format_tokens(c: Column) -> Column:
    """Thousands cut off to Nk."""
    return F.when(c >= 1000, F.concat(F.floor(c / 1000).cast("string"), F.lit("k"))).otherwise(c.cast("string"))


def glob_regex(c: Column) -> Column:
    """A pattern of a path glob: ** is anything, * stays within a segment, ? is any one character."""
    dots = F.regexp_replace(c, "\\.", "\\\\.")
    many = F.regexp_replace(dots, "\\*\\*", "\u0001")
    one = F.regexp_replace(F.regexp_replace(many, "\\*", "[^/]*"), "\\?", ".")
    return F.concat(F.lit("^"), F.replace(one, F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def glob_prefix(c: Column) -> Column:
    """The part of a glob before its first wildcard, without a slash at the end."""
    return F.regexp_replace(F.regexp_extract(c, "^([^*?\\[]*)", 1), "/+$", "")


def scope_relation(a: Column, b: Column) -> Column:
    """same, nest or none, of two literal prefixes; an empty prefix is related to nothing."""
    under = a.startswith(F.concat(b, F.lit("/"))) | b.startswith(F.concat(a, F.lit("/")))
    return F.when((a == "") | (b == ""), "none").when(a == b, "same").when(under, "nest").otherwise("none")


def week_id(c: Column) -> Column:
    return F.concat(F.extract(F.lit("yearofweek"), c).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("week"), c).cast("string"), 2, "0"))


def week_bounds(c: Column) -> tuple[Column, Column]:
    monday = F.date_trunc("week", c).cast("date")
    return monday, F.date_add(monday, 6)


def days_between(a: Column, b: Column) -> Column:
    """Null where either is no date."""
    return F.datediff(F.try_to_date(b, "yyyy-MM-dd"), F.try_to_date(a, "yyyy-MM-dd"))


def stale(now: Column, then: Column, days: int) -> Column:
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400) > days


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, cut off; 0 of nothing."""
    return F.when(whole == 0, 0).otherwise(F.floor(part * 100 / whole)).cast("long")


def progress(part: Column, whole: Column) -> Column:
    """Percents to the nearest, halves to even."""
    return F.when(whole == 0, 0.0).otherwise(F.bround(part * 100 / whole, 0))


def drift(actual: Column, estimate: Column) -> Column:
    """How an estimate was: under where the actual is more than a quarter over it, over where it is more than a quarter
    below, else on, in whole numbers; null without a positive estimate and actual."""
    known = (estimate > 0) & (actual > 0)
    return F.when(known, F.when(actual * 100 > estimate * 125, "under").when(actual * 100 < estimate * 75, "over").otherwise("on"))


def size_verdict(expected: Column, actual: Column) -> Column:
    """The same of sizes: under where it took a larger one than expected; unrecorded where either is no size."""
    e, a = size_rank(expected), size_rank(actual)
    return F.when((e == 0) | (a == 0), "unrecorded").when(a > e, "under").when(a < e, "over").otherwise("on")


def days_ago(now: Column, n: int) -> Column:
    return F.date_format(F.date_sub(now.cast("date"), n), "yyyy-MM-dd")


def cell(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, "\\s*\\n\\s*", " "), F.lit("|"), F.lit("\\|"))
