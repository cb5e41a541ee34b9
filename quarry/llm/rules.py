"""Quality rules: counted statistics with fixed limits, then robust multivariate outliers.

Everything is an expression over one document, so the scan needs no shuffle. Counts that spread in ordinary text (letters of words,
punctuation and symbols, capitals, different words) become a vector of logarithms of rates, smoothed by the group's own; vectors are then grouped by language and source. The minimum covariance determinant of a group is sought by
concentration steps from several starts: each step keeps the nearest share of the rows by Mahalanobis distance and
takes mean and covariance of these, made consistent for normal data, until no determinant falls; the start that ends with the least
counts, and is reweighted once. Rows are rejected by a chi-square quantile. Only sums and quantile sketches of groups are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written

AXES = ("x", "y", "u", "w")  # word length, punctuation and symbols, upper case, different words within stretches
SHARE, STARTS = 0.75, 3  # rows kept by a step, starts
ENOUGH = 1e-3  # fall of a log determinant that still counts
PRIOR = 60  # words of the group's ordinary text that a statistic is smoothed with, so that short texts vary no more than long ones
ORDINARY = {"word_chars": 5.0, "marks": 0.15, "capitals": 0.1, "fresh": 0.8}  # counts a word, where no text is known
FEW = 1000  # words that the rates over all rows count for in those of a group
STRETCH = 50  # words of which the different ones are counted
SHRINK = 50  # rows that the estimate over all rows counts for in that of a group
# Quantiles of chi-square with four degrees of freedom.
CHI2 = {0.75: 5.38527, 0.975: 11.14329, 0.999: 18.46683}
# Texts have heavier tails than normal rows: the limit is the quantile that one normal row in 10**12 is beyond.
CUT = 62.28
BROADCAST = 100_000  # groups
SPACES = "[\\x20\\x09-\\x0D]+"


def let(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column) -> Column:
    """Words within windows of five that the text holds twice or more."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[w[i + j] for j in range(5)]))

    def marked(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = let(placed, lambda s: F.sort_array(F.filter(
            F.transform(s, lambda x, i: F.when(
                ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"])), x["i"])),
            lambda x: x.isNotNull())))
        return let(found, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x))

    counted = let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(marked(h)))
    return F.when(F.size(words) < 6, 0).otherwise(counted).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, with the counted statistics."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = [c for c in docs.columns if c != "text"]
    length = F.length(text)
    without = lambda pattern: (length - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    fresh = lambda w: F.aggregate(F.sequence(F.lit(0), F.size(w) - 1, F.lit(STRETCH)), F.lit(0), lambda a, i: a + F.size(F.array_distinct(F.slice(w, i + 1, STRETCH))))
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    got = docs.select(*rest, let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words"), F.when(F.size(w) > 0, fresh(w)).otherwise(0).alias("fresh"))).alias("s"),
        without("[#*$%&|<>]").alias("n_symbols"), without("[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+").alias("marks"), without("\\p{Lu}+").alias("capitals"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"))
    return got.select(*rest, *[F.col(f"s.{c}").alias(c) for c in ("n_words", "word_chars")], "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("s.n_repeat_words").alias("n_repeat_words"), "marks", "capitals", F.col("s.fresh").alias("fresh"))


def rates(good: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, p_*): what a word of ordinary text counts in each group, from the rows that pass the fixed limits, drawn towards the rates over all."""
    own = good.groupBy("g").agg(F.sum("n_words").alias("n"), *[F.sum(c).alias(c) for c in ORDINARY])
    all_ = own.agg(*[((F.coalesce(F.sum(c), F.lit(0)) + FEW * p) / (F.coalesce(F.sum("n"), F.lit(0)) + FEW)).alias(f"w_{c}") for c, p in ORDINARY.items()])  # one row
    none = F.lit(0)
    return groups.join(own.withColumnRenamed("g", "of"), F.col("g") == F.col("of"), "left").join(F.broadcast(all_)).select("g", *[((F.coalesce(c, none) + FEW * F.col(f"w_{c}")) / (F.coalesce("n", none) + FEW)).alias(f"p_{c}") for c in ORDINARY])


def with_axes(rows: DataFrame) -> DataFrame:
    """rows with their vector, and by how much one count more moves each of its axes (r_x ..)."""
    n, count = F.col("n_words"), lambda c: F.col(c) + PRIOR * F.col(f"p_{c}") + 0.5
    chars, marks, capitals, fresh = (count(c) for c in ORDINARY)
    axes = {"x": F.log(chars / (n + PRIOR)), "y": F.log(marks / chars), "u": F.log(capitals / chars), "w": F.log(fresh / (n + PRIOR))}
    return rows.withColumns(axes | {f"r_{a}": 1 / c for a, c in zip(AXES, (chars, marks, capitals, fresh), strict=True)})


def consistency(share: float) -> float:
    """What the covariance of the nearest share of four-dimensional normal rows is to be multiplied by."""
    half = CHI2[share] / 2
    return share / (1 - math.exp(-half) * (1 + half + half * half / 2))


PAIRS = [(a, b) for i, a in enumerate(AXES) for b in AXES[: i + 1]]


def whitened(params: DataFrame) -> DataFrame:
    """params (m_x.., c_xx.., r_x..) with t_ab, the inverse Cholesky factor of the covariance, and its log determinant. A variance below
    what rounding to whole counts makes by itself in the group, r, is raised to it: the axis is singular there."""
    out = params.withColumns({f"c_{a}{a}": F.greatest(F.col(f"c_{a}{a}"), F.col(f"r_{a}")) for a in AXES})
    for i, a in enumerate(AXES):
        for j, b in enumerate(AXES[: i + 1]):
            rest = F.col(f"c_{a}{b}") - sum((F.col(f"l_{a}{k}") * F.col(f"l_{b}{k}") for k in AXES[:j]), F.lit(0.0))
            out = out.withColumn(f"l_{a}{b}", F.sqrt(F.greatest(rest, F.col(f"r_{a}") / 100)) if a == b else rest / F.col(f"l_{b}{b}"))
    for i, a in enumerate(AXES):
        for j, b in enumerate(AXES[: i + 1]):
            top = F.lit(1.0) if a == b else -sum((F.col(f"l_{a}{k}") * F.col(f"t_{k}{b}") for k in AXES[j:i]), F.lit(0.0))
            out = out.withColumn(f"t_{a}{b}", top / F.col(f"l_{a}{a}"))
    return out.withColumn("log_det", sum((2 * F.log(f"l_{a}{a}") for a in AXES), F.lit(0.0))).drop(*[f"l_{a}{b}" for a, b in PAIRS])


def distance() -> Column:
    """Squared Mahalanobis distance of a row from the means m_x.. by the factors t_ab."""
    out = F.lit(0.0)
    for i, a in enumerate(AXES):
        z = sum((F.col(f"t_{a}{b}") * (F.col(b) - F.col(f"m_{b}")) for b in AXES[: i + 1]), F.lit(0.0))
        out += z * z
    return out


def moments(only: Column | None = None, factor: float = 1.0) -> list[Column]:
    of = {a: F.col(a) if only is None else F.when(only, F.col(a)) for a in AXES}
    return [F.avg(of[a]).alias(f"m_{a}") for a in AXES] + [(F.covar_pop(of[a], of[b]) * factor).alias(f"c_{a}{b}") for a, b in PAIRS]


def near(rows: DataFrame, params: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """rows joined to the parameters of their group; these are a row a group, and broadcast where they are few."""
    return rows.join(F.broadcast(params) if few else params, keys).withColumn("d", distance())


def estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Robust mean, covariance, resolution and number of rows of each group: steps go on until no determinant falls any more."""
    half = F.pmod(F.xxhash64("key"), F.lit(8)) == 0
    mid = [F.percentile_approx(a, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias(f"q_{a}") for a in AXES]
    fine = [(F.pow(F.avg(f"r_{a}"), 2) / 12).alias(f"r_{a}") for a in AXES]
    first = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *mid, *fine, F.struct(*moments()).alias("all"), F.struct(*moments(half)).alias("some")))
    few = first.limit(BROADCAST + 1).count() <= BROADCAST
    quartiles = F.struct(*[F.col(f"q_{a}")[1].alias(f"m_{a}") for a in AXES], *[(F.pow((F.col(f"q_{a}")[2] - F.col(f"q_{a}")[0]) / 1.349, 2) if a == b else F.lit(0.0)).alias(f"c_{a}{b}") for a, b in PAIRS])
    names = [f"m_{a}" for a in AXES] + [f"c_{a}{b}" for a, b in PAIRS]
    same = ["rows", *[f"r_{a}" for a in AXES]]
    given = lambda c: F.struct(*[F.coalesce(F.col(f"{c}.{n}"), F.col(f"all.{n}")).alias(n) for n in names])
    starts = first.select(*keys, *same, F.posexplode(F.array(quartiles, given("all"), given("some"))).alias("start", "p")).select(*keys, *same, "start", "p.*")
    now = written(whitened(starts))
    many = rows.select(*keys, *AXES, F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))).alias("start"))
    by = [*keys, "start"]
    kept_same = [F.max(n).alias(n) for n in same]
    went = None
    while True:
        far = near(many, now, by, few)
        limit = far.groupBy(*by).agg(F.percentile_approx("d", SHARE, 10_000).alias("limit"))
        kept = near(many, now.join(F.broadcast(limit) if few else limit, by), by, few).filter(F.col("d") <= F.col("limit"))
        new = written(whitened(kept.groupBy(*by).agg(*kept_same, *moments(None, consistency(SHARE)))))
        if went is not None:  # a group whose determinant no longer falls stays as it was
            was = now.select(*keys, "start", F.col("log_det").alias("was"), F.struct(*[c for c in now.columns if c not in by]).alias("old"))
            both = new.join(F.broadcast(was) if few else was, by)
            falls = F.col("log_det") < F.col("was") - ENOUGH
            went = both.filter(falls).limit(1).count()
            new = written(both.select(*by, *[F.when(falls, F.col(c)).otherwise(F.col(f"old.{c}")).alias(c) for c in now.columns if c not in by]))
        now = new
        if went == 0:
            break
        went = went or 1
    best = now.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("log_det", "start"))).filter("place = 1").drop("place", "start")
    return written(near(rows.select(*keys, *AXES), best, keys, few).filter(F.col("d") <= CHI2[0.975]).groupBy(*keys).agg(*kept_same, *moments(None, consistency(0.975))))


def quality_rules(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """Statistics and verdicts for each row of docs, which has doc_id, text, lang and source.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance and kept.
    Null and empty texts have no words and fail the fixed limits. Rows that fail these take no part in the
    estimates and have a distance all the same. Null languages and sources are groups of their own. A group's mean and covariance are
    drawn towards those of all rows, which count for SHRINK rows in them, so small groups need no other rule; where no
    row passes the limits there is no distance. Repeated rows and ids are judged alike; other columns are ignored.
    """
    low = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    stats = statistics(docs.select("doc_id", "text", F.struct(F.lit(1).alias("level"), "lang", "source").alias("g")))
    stats = written(stats.withColumns({"base_failed": low, "g": F.to_json("g", {"ignoreNullFields": "true"})}))
    ordinary = written(rates(stats.filter(~F.col("base_failed")), stats.select("g").distinct()))
    few = ordinary.limit(BROADCAST + 1).count() <= BROADCAST
    stats = with_axes(stats.join(F.broadcast(ordinary) if few else ordinary, "g"))
    good = stats.filter(~F.col("base_failed"))
    # each row counts in its group and in the one of all rows, so that one set of jobs makes both estimates
    none = F.lit(None).cast("string")
    everything = F.to_json(F.struct(F.lit(0).alias("level"), none.alias("lang"), none.alias("source")), {"ignoreNullFields": "true"})
    key = F.xxhash64("doc_id", *AXES).alias("key")
    fine = [f"r_{a}" for a in AXES]
    grouped = good.select(F.explode(F.array(F.col("g"), everything)).alias("g"), key, *AXES, *fine)
    found = estimates(grouped, ["g"])
    names = [f"m_{a}" for a in AXES] + [f"c_{a}{b}" for a, b in PAIRS] + fine
    whole = found.filter(F.col("g") == everything).select(*[F.col(n).alias(f"w_{n}") for n in names])
    share = F.col("rows") / (F.col("rows") + SHRINK)
    own = found.join(F.broadcast(whole), F.lit(True)).select("g", *[(F.col(n) * share + F.col(f"w_{n}") * (1 - share)).alias(n) for n in names])  # one row
    own = written(whitened(own.unionByName(whole.select(F.lit("").alias("g"), *[F.col(f"w_{n}").alias(n) for n in names]))))
    # groups of which no row passes the limits are judged by the estimate over all rows
    known = own.select(F.col("g").alias("known"))
    few = known.limit(BROADCAST + 1).count() <= BROADCAST
    named = stats.join(F.broadcast(known) if few else known, F.col("g") == F.col("known"), "left").withColumn("g", F.coalesce("known", F.lit(""))).drop("known")
    both = named.join(F.broadcast(own) if few else own, "g", "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import read

    return quality_rules(read(spark, sf_dir, "documents")).drop("distance")
