"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell of source, language and topic, and the cells' weights are raked to the target
shares of each in turn, never above the tokens that a cell has. A document is kept with the calibrated probability of
its cell, by a hash of its id, so a run can be repeated. The fit works on cells alone: on the driver where their
number is checked to be small, and else by the same steps as grouped aggregations and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

AXES = ("source", "lang", "topic")
ROUNDS, EXACT = 200, 1e-13  # rounds at most; change of a share at which a fit is done
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.7}  # targets where none are given: observed shares to this power
CELLS = 100_000  # cells that the driver fits, and that are broadcast
BUDGET = 0.5  # expected share of all tokens that is kept
LEAST = 0.5  # share of the budget to which it is lowered, at most, for goals that are out of reach otherwise
TOPICS = (("legal", "(?i)licen[sc]ed?|copyright|all rights reserved"), ("contact", "@|\\+\\d|https?://"), ("table", " \\| "))


def topic_of(text: Column) -> Column:
    found = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        found = F.when(F.rlike(text, F.lit(pattern)), name).otherwise(found)
    return found


def goals_of(have: dict, power: float, told: dict | None) -> dict:
    """Shares of the categories: told weights (0 for those not named), or shares to the power, of those with tokens."""
    raw = {c: (told.get(c, 0.0) if told is not None else n**power) if n > 0 else 0.0 for c, n in have.items()}
    total = sum(raw.values())
    return {c: x / total if total else 0.0 for c, x in raw.items()}


def within_reach(goal: dict, have: dict, kept: float) -> dict:
    """Goals of which none asks for more than there is; the others share out the rest in proportion."""
    full: set = set()
    while True:
        rest = sum(g for c, g in goal.items() if c not in full)
        free = 1 - sum(have[c] / kept for c in full)
        now = {c: have[c] / kept if c in full else (g * free / rest if rest else 0.0) for c, g in goal.items()}
        over = {c for c, g in now.items() if c not in full and g * kept > have[c] * (1 + 1e-12)}
        if not over:
            return now
        full |= over


def settled(sums: dict[str, dict], budget: float, targets: dict[str, dict] | None, powers: dict[str, float]) -> tuple[float, dict, dict]:
    """(tokens to keep, goals within reach, goals as told) from the tokens of each category."""
    total = sum(sums[AXES[0]].values())
    told = {a: goals_of(sums[a], powers[a], (targets or {}).get(a)) for a in AXES}
    kept = min([budget * total] + [n / told[a][c] for a in AXES for c, n in sums[a].items() if told[a][c] > 0])
    kept = max(kept, LEAST * budget * total)
    return kept, {a: within_reach(told[a], sums[a], kept) if kept else told[a] for a in AXES}, told


def rake(cells: list[tuple], kept: float, goals: dict[str, dict], rounds: int) -> list[float]:
    """The tokens to keep of each cell (source, lang, topic, tokens)."""
    total = sum(c[3] for c in cells)
    v = [c[3] * kept / total if total else 0.0 for c in cells]
    for _ in range(rounds):
        before = list(v)
        for i, a in enumerate(AXES):
            sums: dict = {}
            for c, x in zip(cells, v, strict=True):
                sums[c[i]] = sums.get(c[i], 0.0) + x
            factor = {c: goals[a][c] * kept / s if s > 0 else 0.0 for c, s in sums.items()}
            v = [min(float(c[3]), x * factor[c[i]]) for c, x in zip(cells, v, strict=True)]
        if max((abs(x - y) for x, y in zip(v, before, strict=True)), default=0.0) <= EXACT * max(kept, 1.0):
            break
    return v


def rake_by_joins(cells: DataFrame, kept: float, goals: DataFrame, rounds: int) -> DataFrame:
    """The same over a table of cells of any size: (source, lang, topic, tokens, v); goals are (axis, name, goal)."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.withColumn("v", F.col("tokens") * (kept / total))
    for _ in range(rounds):
        before = F.col("v").alias("was")
        step = now.select(*AXES, "tokens", "v", before)
        for a in AXES:
            one = goals.filter(F.col("axis") == a).select(F.col("name").alias("_c"), "goal")
            sums = step.groupBy(F.col(a).alias("_a")).agg(F.sum("v").alias("_s")).join(one, F.col("_a").eqNullSafe(F.col("_c"))).select("_a", F.when(F.col("_s") > 0, F.col("goal") * kept / F.col("_s")).otherwise(0.0).alias("_f"))
            step = step.join(sums, F.col(a).eqNullSafe(F.col("_a"))).select(*AXES, "tokens", F.least(F.col("tokens").cast("double"), F.col("v") * F.col("_f")).alias("v"), "was")
        step = written(step)
        moved = step.agg(F.max(F.abs(F.col("v") - F.col("was")))).first()[0] or 0.0
        now = step.drop("was")
        if moved <= EXACT * max(kept, 1.0):
            break
    return now


def fitted(cells: DataFrame, budget: float, rounds: int, powers: dict[str, float], targets: dict[str, dict] | None, most: int = CELLS) -> DataFrame:
    """(source, lang, topic, tokens, weight, prob): weight is a cell's share of what is kept over its share of all."""
    spark = cells.sparkSession
    schema = "source string, lang string, topic string, tokens long, v double"
    rows = cells.select(*AXES, "tokens").limit(most + 1).collect()  # at most most + 1 cells
    if len(rows) <= most:
        rows = sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x or "") for x in r[:3]))
        sums = {a: {} for a in AXES}
        for r in rows:
            for i, a in enumerate(AXES):
                sums[a][r[i]] = sums[a].get(r[i], 0) + r[3]
        kept, goals, _ = settled(sums, budget, targets, powers)
        v = spark.createDataFrame([(*r, x) for r, x in zip(rows, rake(rows, kept, goals, rounds), strict=True)], schema)
    else:
        sums = {a: {r[0]: r[1] for r in cells.groupBy(a).agg(F.sum("tokens")).collect()} for a in AXES}  # categories, not cells
        kept, goals, _ = settled(sums, budget, targets, powers)
        flat = [(a, c, g) for a in AXES for c, g in goals[a].items()]
        v = rake_by_joins(cells, kept, spark.createDataFrame(flat, "axis string, name string, goal double"), rounds)
    total = sum(sums["topic"].values())
    share = kept / total if total else 0.0
    prob = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("v") / F.col("tokens"))).otherwise(F.lit(share))
    return v.select(*AXES, "tokens", F.round(prob / share if share else prob, 9).alias("weight"), F.round(prob, 9).alias("prob"))


def with_cells(docs: DataFrame) -> DataFrame:
    """Each row of docs as the struct row, with its cell and tokens, so that no name of docs can clash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), text)), 1, 8), 16, 10).cast("double") / 4294967296.0
    kept = [c for c in docs.columns if c not in ("topic", "tokens", "weight", "prob", "kept")]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "source", "lang", topic_of(text).alias("topic"), tokens.alias("tokens"), draw.alias("draw"))


def mix_sources(docs: DataFrame, budget: float = BUDGET, targets: dict[str, dict] | None = None, rounds: int = ROUNDS, powers: dict[str, float] | None = None, most: int = CELLS) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source, others carried) with topic, tokens, weight, prob and kept.

    targets has weights by category for source, lang or topic (null is the key None); categories that it does not name get 0, and an
    axis without targets gets its observed shares to the power in powers. budget is the expected share of tokens kept; it
    is lowered, to LEAST of it at most, where a goal asks for more tokens than there are. A category that has too
    few even then gives all it has and the others share out the rest. What is missed: see residuals.
    Tokens are the parts between spaces; a null or empty text has none and is kept with its cell's
    probability, or the overall share where the cell has no tokens. Null languages and sources are categories of their own. Equal ids draw
    alike, and rows with a null id draw by their text. Columns of docs with the new names are replaced; any other name is
    carried. most: cells fitted on the driver and broadcast; more are fitted and joined by shuffles, by the same steps to the same end.
    """
    base = with_cells(docs)
    cells = written(base.groupBy(*AXES).agg(F.sum("tokens").alias("tokens")))
    fit = written(fitted(cells, budget, rounds, powers or POWERS, targets, most))
    fit = fit.select(*[F.col(a).alias(f"fit_{a}") for a in AXES], "weight", "prob")
    if fit.limit(most + 1).count() <= most:
        fit = F.broadcast(fit)  # cells, not documents
    on = F.col("topic") == F.col("fit_topic")
    for a in ("source", "lang"):
        on &= F.col(a).eqNullSafe(F.col(f"fit_{a}"))
    return base.join(fit, on).select("row.*", "topic", "tokens", "weight", "prob", (F.col("draw") < F.col("prob")).alias("kept"))


def residuals(docs: DataFrame, budget: float = BUDGET, targets: dict[str, dict] | None = None, rounds: int = ROUNDS, powers: dict[str, float] | None = None) -> DataFrame:
    """(axis, name, goal, share, residual) of each category: the target share as told, the expected share of what is kept, and the difference."""
    cells = written(with_cells(docs).groupBy(*AXES).agg(F.sum("tokens").alias("tokens")))
    sums = {a: {r[0]: r[1] for r in cells.groupBy(a).agg(F.sum("tokens")).collect()} for a in AXES}  # categories
    told = settled(sums, budget, targets, powers or POWERS)[2]
    goals = docs.sparkSession.createDataFrame([(a, c, g) for a in AXES for c, g in told[a].items()], "axis string, name string, goal double")
    kept = fitted(cells, budget, rounds, powers or POWERS, targets).withColumn("x", F.col("tokens") * F.col("prob"))
    long = kept.select(F.explode(F.array(*[F.struct(F.lit(a).alias("at"), F.col(a).alias("of"), "x") for a in AXES])).alias("s")).select("s.*")
    long = long.groupBy("at", "of").agg(F.sum("x").alias("x"))
    total = kept.agg(F.sum("x")).first()[0] or 1.0
    both = goals.join(long, (F.col("axis") == F.col("at")) & F.col("name").eqNullSafe(F.col("of")), "left")
    share = F.coalesce(F.col("x"), F.lit(0.0)) / total
    return both.select("axis", "name", "goal", share.alias("share"), (share - F.col("goal")).alias("residual"))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import read

    out = mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("prob", 6).alias("prob"), "kept")


def op1_sql(passes: int = 8) -> str:
    """The same in SQL by windows and recursion: goals are capped in passes, then raked for ROUNDS."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{t}'" for t, p in TOPICS) + " ELSE 'prose' END"
    ctes = [f"""base AS (SELECT doc_id, source, lang, {topic} AS topic, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS digest,
        CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS tokens FROM documents)""",
        "cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM base GROUP BY ALL)", "whole AS (SELECT sum(tokens) AS t FROM cells)"]
    for a in AXES:
        ctes.append(f"h_{a} AS (SELECT {a} AS c, sum(tokens) AS n FROM cells GROUP BY 1)")
        ctes.append(f"g_{a} AS (SELECT c, n, CASE WHEN n > 0 THEN power(n, {POWERS[a]}) ELSE 0 END / sum(CASE WHEN n > 0 THEN power(n, {POWERS[a]}) ELSE 0 END) OVER () AS g FROM h_{a})")
    reach = " UNION ALL ".join(f"SELECT min(n / g) AS m FROM g_{a} WHERE g > 0" for a in AXES)
    ctes.append(f"kept AS (SELECT greatest(least({BUDGET} * t, (SELECT min(m) FROM ({reach}))), {LEAST * BUDGET} * t) AS b, t FROM whole)")
    for a in AXES:
        last = f"SELECT c, n, g, g AS x, false AS f FROM g_{a}"
        for i in range(passes):
            ctes.append(f"p_{a}_{i} AS ({last})")
            capped = f"(f OR x * (SELECT b FROM kept) > n * (1 + 1e-12)) AS f FROM p_{a}_{i}"
            last = f"""SELECT c, n, g, CASE WHEN f THEN n / (SELECT b FROM kept) ELSE g * (1 - coalesce(sum(CASE WHEN f THEN n / (SELECT b FROM kept) END) OVER (), 0)) / sum(CASE WHEN NOT f THEN g END) OVER () END AS x, f
                FROM (SELECT c, n, g, {capped})"""
        ctes.append(f"goal_{a} AS ({last})")
    step, inner = "", "SELECT * FROM it"
    for a in AXES:
        step = f"SELECT * REPLACE (CASE WHEN sum(v) OVER (PARTITION BY {a}) > 0 THEN least(tokens, v * x_{a} * b / sum(v) OVER (PARTITION BY {a})) ELSE 0 END AS v) FROM ({inner})"
        inner = step
    joins = " ".join(f"JOIN goal_{a} AS z_{a} ON z_{a}.c IS NOT DISTINCT FROM cells.{a}" for a in AXES)
    ctes.append(f"it AS (SELECT 0 AS i, source, lang, topic, tokens, {', '.join(f'z_{a}.x AS x_{a}' for a in AXES)}, b, t, tokens * b / t AS v FROM cells {joins}, kept UNION ALL SELECT * REPLACE (i + 1 AS i) FROM ({step}) WHERE i < {ROUNDS})")
    ctes.append(f"fit AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN least(1, v / tokens) ELSE b / t END, 9) AS prob FROM it WHERE i = {ROUNDS})")
    return f"""WITH RECURSIVE {", ".join(ctes)} SELECT b.doc_id, b.source, b.lang, b.topic, CAST(b.tokens AS BIGINT) AS tokens, round(f.prob, 6) AS prob,
        CAST('0x' || substr(b.digest, 1, 8) AS BIGINT) / 4294967296.0 < f.prob AS kept
        FROM base b JOIN fit f ON b.source IS NOT DISTINCT FROM f.source AND b.lang IS NOT DISTINCT FROM f.lang AND b.topic = f.topic"""
