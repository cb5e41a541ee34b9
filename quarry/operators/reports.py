"""Reports over ledger records: costs, gates, lint, status, roadmap, releases and project close.

Inputs are the DataFrames of quarry.sources.records. Today and thresholds are parameters, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.carry import carried
from quarry.operators.ledger import bands
from quarry.operators.scopes import governed, scope_pairs  # noqa: F401
from quarry.sources import records as R
from quarry.store import written

CYCLES = ("frame", "design", "build", "verify", "ship")
SIZES = X.SIZES
# Numbers of more digits than a ledger can mean count as no numbers, so that no sum of them overflows.
WHOLE, MONEY = "^0*[0-9]{1,12}$", "^0*[0-9]{1,9}(\\.[0-9]+)?$"


def tokens_of(sessions: Column) -> Column:
    """All whole numbers of tokens of the sessions; anything else counts as none."""
    def one(s: Column) -> Column:
        return sum((F.coalesce(F.when(F.rlike(s[n], F.lit(WHOLE)), s[n].cast("long")), F.lit(0)) for n in ("tokens_total", "tokens_input", "tokens_output")), F.lit(0).cast("long"))

    return F.aggregate(sessions, F.lit(0).cast("long"), lambda a, s: a + one(s))


def usd_of(sessions: Column) -> Column:
    """The sum of amounts, to cents for each record, halves to even."""
    amount = lambda s: F.coalesce(F.when(F.rlike(s["estimated_usd"], F.lit(MONEY)), s["estimated_usd"].cast("decimal(18,4)")), F.lit(0).cast("decimal(18,4)"))
    return F.bround(F.aggregate(sessions, F.lit(0).cast("decimal(28,4)"), lambda a, s: (a + amount(s)).cast("decimal(28,4)")), 2).cast("decimal(18,2)")


def recorded_on(sessions: Column, date: Column) -> Column:
    return F.size(F.filter(sessions, lambda s: s["recorded_at"] == date)).cast("long")


def ship_date(sessions: Column) -> Column:
    """The first date of a session of the ship cycle."""
    return F.get(F.filter(sessions, lambda s: (s["cycle"] == "ship") & R.told(s["recorded_at"]).isNotNull()), F.lit(0))["recorded_at"]


def first_tokens(sessions: Column, cycle: str) -> Column:
    """tokens_total of the first session of the cycle that has the field."""
    return F.get(F.filter(sessions, lambda s: (s["cycle"] == cycle) & s["tokens_total"].isNotNull()), F.lit(0))["tokens_total"]


def missing_cycles(sessions: Column, cycles: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(first_tokens(sessions, c), F.lit("")).isin("", "null", "0"), F.lit(c)) for c in cycles]))


def implausible_cycles(sessions: Column, cycles: tuple[str, ...], floor: int = 1000) -> Column:
    """cycle(tokens) of the cycles whose first number of tokens is positive and below the floor."""
    def one(c: str) -> Column:
        t = first_tokens(sessions, c)
        n = F.when(F.rlike(t, F.lit(WHOLE)), t.cast("long"))
        return F.when((n > 0) & (n < floor), F.concat(F.lit(f"{c}("), t, F.lit(")")))

    return F.array_compact(F.array(*[one(c) for c in cycles]))


def costs(records: DataFrame, date: str | None = None) -> DataFrame:
    out = records.select("path", "id", tokens_of(F.col("sessions")).alias("tokens"), usd_of(F.col("sessions")).alias("usd"), F.size("sessions").cast("long").alias("sessions"), ship_date(F.col("sessions")).alias("ship_date"), F.col("sessions").alias("_s"))
    return out.withColumn("on_date", recorded_on(F.col("_s"), F.lit(date))).drop("_s")


def cost_gate(specs: DataFrame, patches: DataFrame | None = None, metering: str = "subagent_tokens", exempt: tuple[str, ...] = (), floor: int = 1000) -> DataFrame:
    """Shipped records with the metered cycles that lack tokens or have too few to be true; nothing where nothing is metered."""
    def one(df: DataFrame, cycles: tuple[str, ...]) -> DataFrame:
        due = df.filter(F.col("shipped") & ~F.col("id").isin(*exempt) & F.lit(metering != "none"))
        return due.select("id", "name", missing_cycles(F.col("sessions"), cycles).alias("missing"), implausible_cycles(F.col("sessions"), cycles, floor).alias("implausible"))

    found = one(specs, ("build", "verify"))
    found = found.unionByName(one(patches, ("patch", "verify"))) if patches is not None else found
    return found.filter((F.size("missing") > 0) | (F.size("implausible") > 0))


def shown(c: Column) -> Column:
    return F.coalesce(c, F.lit("∅"))


def rules_of(kind: str) -> dict[str, tuple[Column, str | None]]:
    """Name of each rule of a kind of record, the condition under which it is broken, and the column to show with it."""
    c = F.col
    outside = lambda n, values: ~F.coalesce(c(n).isin(*values), F.lit(False))
    missing = lambda names: {n: (c(a).isNull(), None) for n, a in names.items()}
    if kind == "spike":
        ends = ("answered", "inconclusive", "graduated", "discarded")
        outcome = ((c("cycle") == "land") | c("outcome").isNotNull()) & outside("outcome", ends)
        return missing({"task.id": "task_id", "task.type": "type", "repo.id": "repo"}) | {"task.cycle": (outside("cycle", ("spike", "land")), "cycle")} | missing({"spike.question": "question", "spike.timebox": "timebox"}) | {
            "spike.mode": (outside("mode", ("question", "build")), "mode"), "spike.outcome": (F.coalesce(outcome, F.lit(False)), "outcome")}
    cycles = {"spec": CYCLES, "patch": ("patch", "verify", "ship")}[kind]
    needed = {"task.id": "task_id", "task.type": "type", "project.id": "project"} | ({"project.stage": "stage"} if kind == "spec" else {}) | {"repo.id": "repo"}
    return missing(needed) | {"task.cycle": (outside("cycle", cycles), "cycle"), "task.complexity": (outside("complexity", SIZES), "complexity")}


def validate(records: DataFrame, kind: str) -> DataFrame:
    """(name, kind, problems) of each record, no problems for a sound one. A value out of its set is shown with it."""
    problems = [F.when(bad, F.lit(n) if value is None else F.concat(F.lit(f"{n}(='"), shown(F.col(value)), F.lit("')"))) for n, (bad, value) in rules_of(kind).items()]
    name = F.col("name") if "name" in records.columns else R.file_stem(F.col("path"))
    return records.select(name.alias("name"), F.lit(kind).alias("kind"), F.array_compact(F.array(*problems)).alias("problems"))


def validate_all(specs: DataFrame, patches: DataFrame, spikes: DataFrame) -> DataFrame:
    return validate(specs, "spec").unionByName(validate(patches, "patch")).unionByName(validate(spikes, "spike"))


def advisories(specs: DataFrame) -> DataFrame:
    """(name, note) that never gates: actual sizes and verdicts out of their sets, and dependencies that do not exist."""
    specs = written(specs.select("name", "id", "project", "complexity_actual", "verify_verdict", "depends_on"))  # parsed once for four uses
    actual = specs.filter(F.col("complexity_actual").isNotNull() & ~F.col("complexity_actual").isin(*SIZES)).select("name", F.concat(F.lit("complexity_actual="), "complexity_actual").alias("note"))
    verdict = specs.filter(F.col("verify_verdict").isNotNull() & ~F.col("verify_verdict").isin("approved", "punch-list", "rejected")).select("name", F.concat(F.lit("verify_verdict="), "verify_verdict").alias("note"))
    there = specs.select(F.col("id").alias("dep"), F.col("project").alias("project")).distinct()
    gone = specs.select("name", "project", F.explode(F.array_distinct("depends_on")).alias("dep")).join(there, ["dep", "project"], "left_anti")
    return actual.unionByName(verdict).unionByName(gone.select("name", F.concat(F.lit("depends_on="), "dep").alias("note")))


def notes(df: DataFrame, name: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """(name, note) for each value of a field that is out of its suggested set; absent values need no note."""
    found = [F.when(F.col(f).isNotNull() & ~F.col(f).isin(*values), F.concat(F.lit(f"{f}="), F.col(f))) for f, values in fields.items()]
    return df.select(F.col(name).alias("name"), F.explode(F.array_compact(F.array(*found))).alias("note"))


def brief_advisories(briefs: DataFrame, activities: tuple[str, ...] = ("requirements", "design", "build", "test", "blocked", "spike")) -> DataFrame:
    """(name, note) that never gates: activity, reason of closing, and kinds and horizons of the declared roadmap out of their sets.
    More activities can be suggested."""
    b = briefs.select(F.element_at(F.split("path", "/"), -2).alias("project"), "activity", "closed_reason", "roadmap")
    items = b.select("project", F.explode("roadmap").alias("r")).select("project", *[R.told(F.col(f"r.{n}")).alias(n) for n in ("item", "kind", "horizon")]).filter("item IS NOT NULL")
    own = notes(b, "project", {"activity": activities, "closed_reason": ("shipped", "abandoned", "superseded", "parked")})
    declared = notes(items.withColumn("of", F.concat_ws(" ", "project", "item")), "of", {"kind": ("framed", "planned", "pillar", "goal"), "horizon": ("now", "next", "later")})
    return own.unionByName(declared)


def decision_advisories(decisions: DataFrame) -> DataFrame:
    """(name, note) that never gates: statuses out of their set, and decisions that no project is named for."""
    some = decisions.filter("insight_id IS NOT NULL")
    odd = notes(some, "insight_id", {"status": ("proposed", "accepted", "superseded", "rejected", "deprecated")})
    return odd.unionByName(some.filter("project IS NULL").select(F.col("insight_id").alias("name"), F.lit("unattributed").alias("note")))


def ready(specs: DataFrame, project: str | None = None) -> DataFrame:
    """Open specs of a scope with state and blockers: dependencies of the same project that have not shipped or do not exist."""
    some = specs.select("id", "project", "shipped", "claimed_by", "depends_on")
    some = written(some if project is None else some.filter(F.col("project") == project))  # parsed once for three uses
    done = some.filter("shipped").select(F.col("id").alias("dep"), "project").distinct()
    edges = some.filter("NOT shipped").select("id", "project", F.explode("depends_on").alias("dep")).join(done, ["dep", "project"], "left_anti")
    blocked = edges.groupBy("id", "project").agg(F.array_join(F.sort_array(F.collect_list("dep")), ",").alias("blocked_by"))
    state = F.when(F.col("blocked_by").isNotNull(), "blocked").when(F.col("claimed_by").isNotNull(), "claimed").otherwise("ready")
    return some.filter("NOT shipped").join(blocked, ["id", "project"], "left").select("id", "project", state.alias("state"), F.coalesce("blocked_by", F.lit("")).alias("blocked_by"))


def calibration(specs: DataFrame) -> DataFrame:
    """Shipped specs with the verdict on size and on tokens (null without both numbers)."""
    est = F.col("tokens_estimate")
    est = F.when(F.rlike(est, F.lit(WHOLE)), est.cast("long"))
    tok = tokens_of(F.col("sessions"))
    return specs.filter("shipped").select("id", "complexity", tok.alias("tokens"), X.size_verdict(F.coalesce("complexity", F.lit("?")), F.coalesce("complexity_actual", F.lit("?"))).alias("size_verdict"), X.drift(tok, est).alias("token_verdict"))


def token_bands(calibrated: DataFrame) -> DataFrame:
    """Least, lower median, most and number of the tokens of each expected size."""
    some = calibrated.filter((X.size_rank(F.coalesce("complexity", F.lit("?"))) != 0) & (F.col("tokens") > 0))
    return bands(some.withColumn("size", F.col("complexity")), "size", "tokens")


def cycle_status(specs: DataFrame) -> DataFrame:
    """(project, cycle, n, ids): archived specs count as ship, but only active ones are named."""
    at = F.when(F.col("archived"), "ship").otherwise(F.col("cycle"))
    some = specs.withColumn("at", at).filter(F.col("at").isin(*CYCLES))
    names = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("archived"), F.col("id")))), ",")
    return some.groupBy("project", F.col("at").alias("cycle")).agg(F.count(F.lit(1)).alias("n"), names.alias("ids"))


def progress(specs: DataFrame) -> DataFrame:
    """(project, shipped, total, pct): percents to the nearest, halves to even."""
    return specs.groupBy("project").agg(F.count_if("shipped").alias("shipped"), F.count(F.lit(1)).alias("total")).withColumn("pct", X.progress(F.col("shipped"), F.col("total")))


def release_notes(specs: DataFrame) -> DataFrame:
    return specs.filter("shipped").withColumn("outcome", R.outcome(F.col("text"))).filter("outcome IS NOT NULL").select("project", "stage", "id", "title", "outcome")


def spread(rows: DataFrame, key: str, domain: tuple[str, ...], width: int = 24) -> DataFrame:
    """(key, n, pct, bar) for each of the domain, zero or not: whole percents of all in it, bars up to width for the most."""
    all_ = rows.sparkSession.createDataFrame([(x,) for x in domain], f"{key} string")
    n = all_.join(rows.filter(F.col(key).isin(*domain)).groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    n = written(n)  # so that the rows are counted once
    totals = n.agg(F.sum("n").alias("t"), F.max("n").alias("m"))  # one row of a few
    return n.join(F.broadcast(totals)).select(key, "n", X.percent(F.col("n"), F.col("t")).alias("pct"), F.when(F.col("m") == 0, 0).otherwise(F.floor(F.col("n") * width / F.col("m"))).cast("long").alias("bar"))


def defects(specs: DataFrame) -> DataFrame:
    """Where the worst defect of each record was caught, spread over the stages."""
    answered = specs.select(R.defect_answer(F.col("text")).alias("stage"))
    return spread(answered, "stage", ("design", "build", "verify", "ship", "escaped", "none"))


def pushback(specs: DataFrame) -> DataFrame:
    """(approved, punch_list, rejected, unrecorded, pct): how often verify did not approve, in whole percents of what it recorded."""
    v = F.coalesce("verify_verdict", F.lit(""))
    count = lambda x: F.count_if(v == x)
    out = specs.agg(count("approved").alias("approved"), count("punch-list").alias("punch_list"), count("rejected").alias("rejected"), F.count_if(~v.isin("approved", "punch-list", "rejected")).alias("unrecorded"))
    return out.withColumn("pct", X.percent(F.col("punch_list") + F.col("rejected"), F.col("approved") + F.col("punch_list") + F.col("rejected")))


def shipped_between(specs: DataFrame, first: str, last: str) -> DataFrame:
    """Shipped specs whose ship date is in the closed range; dates compare as text."""
    return specs.withColumn("ship_date", ship_date(F.col("sessions"))).filter(F.col("shipped") & F.col("ship_date").between(first, last))


def cost_rollup(specs: DataFrame) -> DataFrame:
    """(n, tokens, usd, avg_usd, linked, unlinked): cents are summed as rounded for each record; the average is 0 of none."""
    one = specs.select(tokens_of(F.col("sessions")).alias("t"), usd_of(F.col("sessions")).alias("u"), F.col("value_link").isNotNull().alias("l"))
    out = one.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("u"), F.lit(0)).cast("double").alias("usd"), F.count_if("l").alias("linked"), F.count_if(~F.col("l")).alias("unlinked"))
    return out.withColumn("avg_usd", F.when(F.col("n") == 0, 0.0).otherwise(F.round(F.col("usd") / F.col("n"), 2)))


def cost_by(specs: DataFrame, field: str, domain: tuple[str, ...] | None = None) -> DataFrame:
    """(field, usd) of sessions by cycle or interface: cents for each record and value, then summed. An interface
    carries on to later sessions of the record that name none; sessions before the first one count for nothing."""
    s = specs.select("path", F.posexplode("sessions").alias("place", "s")).select("path", "place", R.told(F.col(f"s.{field}")).alias(field), F.when(F.rlike("s.estimated_usd", F.lit(MONEY)), F.col("s.estimated_usd").cast("decimal(18,4)")).alias("usd"))
    s = carried(written(s), "path", "place", field, 4096).filter(F.col(field).isNotNull() & F.col("usd").isNotNull())
    out = s.groupBy("path", field).agg(F.bround(F.sum("usd"), 2).alias("part")).groupBy(field).agg(F.sum("part").cast("double").alias("usd"))
    if domain is None:
        return out
    all_ = specs.sparkSession.createDataFrame([(x,) for x in domain], f"{field} string")
    return all_.join(out, field, "left").fillna(0.0, ["usd"])


def active_first(df: DataFrame, by: str | None, status: str, name: str) -> DataFrame:
    """The first active one by name of each group, else the first."""
    best = F.min(F.struct((~F.coalesce(F.col(status) == "active", F.lit(False))).alias("late"), F.col(name).alias("name")))
    return df.groupBy(*([by] if by else [])).agg(best.alias("b")).select(*([by] if by else []), F.col("b.name").alias(name))


def roadmap(stages: DataFrame, lines: DataFrame, declared: DataFrame) -> DataFrame:
    """Framed stages with bucket, counts of their backlog, cost of orchestration and what the brief declares of them, then
    planned rows without a stage and declared items that are no stage. declared: (place, item, kind, horizon, resume_when, target)."""
    project = F.regexp_extract("path", "(PROJ-[0-9]+)", 1)
    own = stages.withColumn("project", project)
    active = active_first(own, "project", "status", "id").select("project", F.col("id").alias("active"))
    bucket = F.when(F.col("status").isin("shipped", "cancelled"), F.col("status")).when((F.col("status") == "active") & (F.col("id") == F.col("active")), "active").otherwise("upcoming")
    open_ = R.bullets(lines).groupBy("path").agg(F.count_if("unpromoted").alias("backlog"))
    first = declared.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("place"))).filter("r = 1").select(F.col("item").alias("id"), "horizon", "resume_when", F.col("target").alias("declared_target"))
    return own.join(active, "project").join(open_, "path", "left").join(first, "id", "left").select("project", "id", bucket.alias("bucket"), F.coalesce("backlog", F.lit(0)).alias("backlog"), tokens_of(F.col("sessions")).alias("tokens"), usd_of(F.col("sessions")).cast("double").alias("usd"), "horizon", "resume_when", "declared_target")


def planned(plan: DataFrame, stages: DataFrame) -> DataFrame:
    """Rows of the stage plan that no stage file is framed for yet; a file is a stage's where its name begins with the id."""
    there = stages.select(R.file_stem(F.col("path")).alias("file"))
    there = there.select(F.explode(F.transform(F.sequence(F.lit(7), F.length("file")), lambda n: F.substr("file", F.lit(1), n))).alias("stage")).distinct()
    return plan.join(there, "stage", "left_anti")


def declared_items(briefs: DataFrame) -> DataFrame:
    """(path, place, item, kind, horizon, resume_when, target) of the roadmap blocks."""
    r = briefs.select("path", F.posexplode("roadmap").alias("place", "r"))
    return r.select("path", "place", *[R.told(F.col(f"r.{n}")).alias(n) for n in ("item", "kind", "horizon", "resume_when", "target")]).filter("item IS NOT NULL")


def declared_rows(declared: DataFrame) -> DataFrame:
    """Items that are no stages; the kind is pillar where none is given."""
    return declared.filter(~F.rlike("item", F.lit("^STAGE-[0-9]"))).withColumn("kind", F.coalesce("kind", F.lit("pillar")))


def lint_decisions(decisions: DataFrame) -> DataFrame:
    """(name, problem): each structural fault of a decision, its links and, as scope, names that can match nothing."""
    c = F.col
    again = F.count(F.lit(1)).over(Window.partitionBy("insight_id")) > 1
    first = F.row_number().over(Window.partitionBy("insight_id").orderBy("path")) == 1
    d = decisions.withColumn("again", c("insight_id").isNotNull() & again & ~first)
    has = c("insight_id").isNotNull()
    own = [F.when(~has, "missing id"), F.when(has & (c("insight_id") != c("file_id")), "id differs from file"), F.when(c("again"), "duplicate id"), F.when(has & c("created_at").isNull(), "missing created_at"), F.when(has & c("type").isNull(), "missing type"),
        F.when(has & (c("status") == "superseded") & c("superseded_by").isNull(), "superseded by nothing"), F.when(has & (c("status") != "superseded") & c("superseded_by").isNotNull(), "status contradicts superseded_by")]
    faults = d.select("name", F.explode(F.array_compact(F.array(*own))).alias("problem"))
    known = d.filter(has).groupBy(c("insight_id").alias("other")).agg(F.min_by("superseded_by", "path").alias("back"))

    def link(field: str, mirror: bool) -> DataFrame:
        both = d.filter(has & c(field).isNotNull()).join(known, c(field) == c("other"), "left")
        fault = F.when(c(field) == c("insight_id"), f"{field} itself").when(c("other").isNull(), f"{field} does not exist")
        if mirror:
            fault = fault.when(~c("back").eqNullSafe(c("insight_id")), f"{field} is one-sided")
        return both.select("name", fault.alias("problem")).filter("problem IS NOT NULL")

    bare = d.filter(has & c("superseded_by").isNull()).select("name", F.explode("scope").alias("g")).filter(~F.rlike("g", F.lit("[/*?]"))).select("name", F.concat(F.lit("scope "), "g").alias("problem"))
    return faults.unionByName(link("supersedes", True)).unionByName(link("superseded_by", False)).unionByName(bare)


def low_confidence(decisions: DataFrame, floor: float = 0.7) -> DataFrame:
    """Active decisions with a confidence below the floor."""
    return decisions.filter(F.col("superseded_by").isNull() & (F.expr("try_cast(confidence AS double)") < floor))


def proposed_references(specs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(name, decision): specs built on a decision that is only proposed."""
    open_ = decisions.filter("status = 'proposed' AND insight_id IS NOT NULL").select(F.col("insight_id").alias("decision")).distinct()
    return specs.select("name", F.explode("decisions").alias("decision")).distinct().join(open_, "decision").select("name", "decision")


def ordered(df: DataFrame, field: str, ranks: tuple[str, ...], *ties: str) -> DataFrame:
    """df with rank: the place of the field's value among ranks, others last; sorted by it and the ties."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col(field)), F.lit(0)), F.lit(len(ranks) + 1)).cast("int")
    return df.withColumn("rank", place).orderBy("rank", *ties)


def latest(df: DataFrame, at: str, name: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc(at), F.desc(name)).limit(n)


def next_version(tags: DataFrame, scheme: str, month: str = "") -> DataFrame:
    """One row version, from tags (tag): the next patch of the month, the next number, or the greatest semantic version."""
    t, none = F.col("tag"), F.lit(None)
    if scheme == "calver":
        n = F.regexp_extract(t, "^v?" + month.replace(".", "\\.") + "\\.([0-9]+)$", 1)
        return tags.agg(F.concat(F.lit(f"v{month}."), (F.coalesce(F.max(F.when(n != "", n.cast("long"))), F.lit(-1)) + 1).cast("string")).alias("version"))
    if scheme == "monotonic":
        n = F.regexp_extract(t, "^v?([0-9]+)$", 1)
        return tags.agg(F.concat(F.lit("v"), (F.coalesce(F.max(F.when(n != "", n.cast("long"))), F.lit(0)) + 1).cast("string")).alias("version"))
    if scheme == "semver":
        part = [F.regexp_extract(t, "^v?([0-9]+)\\.([0-9]+)\\.([0-9]+)$", i) for i in (1, 2, 3)]
        top = F.max(F.when(part[0] != "", F.struct(*[p.cast("long").alias(f"p{i}") for i, p in enumerate(part)])))
        return tags.agg(F.coalesce(F.concat(F.lit("v"), F.concat_ws(".", *[top[f"p{i}"].cast("string") for i in range(3)])) if none is not None else none, F.lit("v0.1.0")).alias("version"))
    return tags.agg(F.lit("v0.0.0").alias("version"))


def script_gaps(template: DataFrame, instances: DataFrame, cross: tuple[str, ...]) -> DataFrame:
    """(instance, present, missing, missing_cross) from template (script) and instances (instance, script, null for an empty one)."""
    names = template.agg(F.sort_array(F.collect_set("script")).alias("all"))  # the scripts of one template
    have = instances.groupBy("instance").agg(F.collect_set("script").alias("have"))
    both = have.join(F.broadcast(names))
    missing = F.array_except("all", "have")
    return both.select("instance", F.size(F.array_intersect("all", "have")).cast("long").alias("present"), F.array_join(missing, ",").alias("missing"), F.array_join(F.filter(missing, lambda x: x.isin(*cross)), ",").alias("missing_cross"))


def close_project(brief: DataFrame, specs: DataFrame, stages: DataFrame, decisions: DataFrame, signals: DataFrame, today: str) -> DataFrame:
    """A row for each brief: the numbers of its project, refusals and warnings of closing it. Archived specs count once. Here shipped is what
    stands at cycle ship: an archived spec at another cycle holds the close up, though every other report takes it as shipped."""
    c = F.col
    s = specs.groupBy("project").agg(F.count(F.lit(1)).alias("specs"), F.count_if(c("cycle") == "ship").alias("shipped"), F.sum(tokens_of(c("sessions"))).alias("tokens"), F.sum(usd_of(c("sessions"))).cast("double").alias("usd"))
    o = stages.groupBy(F.regexp_extract("path", "(PROJ-[0-9]+)", 1).alias("project")).agg(F.sum(tokens_of(c("sessions"))).alias("orchestration"))
    d = decisions.groupBy("project").agg(F.count(F.lit(1)).alias("decisions"), F.count_if(c("superseded_by").isNotNull()).alias("superseded"))
    open_ = signals.filter("disposition_at = 'project-close' AND status IN ('open', 'watch')").agg(F.count(F.lit(1)).alias("signals"))  # one row
    zero = lambda n: F.coalesce(n, F.lit(0))
    b = brief.withColumnRenamed("id", "project").join(s, "project", "left").join(o, "project", "left").join(d, "project", "left").join(F.broadcast(open_))
    claims = ~F.coalesce(c("closed_reason").isin("abandoned", "superseded", "parked"), F.lit(False))
    refusals = F.array(F.when(claims & (zero("specs") > zero("shipped")), "in-flight"), F.when(~R.reflection_filled(c("text")), "reflection"), F.when(c("signals") > 0, "signals"), F.when(claims & c("thesis").isNotNull() & c("thesis_held").isNull(), "thesis"))
    warnings = F.array(F.when(c("closed_reason").isNull(), "closed_reason"), F.when(c("thesis").isNull(), "no thesis"), F.when(~c("thesis_held").isin("yes", "partly", "no", "too-early"), "thesis_held"), F.when(c("thesis_held").isNotNull() & c("evidence").isNull(), "evidence"), F.when((zero("decisions") == 0) & (zero("shipped") > 3), "no decisions"))
    total = zero("orchestration") + zero("tokens")
    return b.select("project", zero("specs").alias("specs"), zero("shipped").alias("shipped"), zero("tokens").alias("tokens"), F.coalesce("usd", F.lit(0.0)).alias("usd"), F.when(zero("shipped") > 0, F.round(zero("decisions") / c("shipped"), 2)).alias("density"), X.percent(zero("superseded"), zero("decisions")).alias("superseded_pct"),
        X.percent(zero("orchestration"), total).alias("orchestration_pct"), X.days_between(c("created_at"), F.coalesce("shipped_at", F.lit(today))).alias("days"), F.array_join(F.array_compact(refusals), ",").alias("refusals"), F.array_join(F.array_compact(warnings), ",").alias("warnings"))


def lifetime(files: DataFrame, commits: DataFrame) -> DataFrame:
    """One row of counts: briefs, stages, decisions and release headings among files (path, text), commits (date) and their span."""
    p = F.col("path")
    releases = F.size(F.filter(F.split("text", "\n"), lambda x: F.startswith(x, F.lit("## "))))
    counts = files.agg(F.count_if(F.rlike(p, F.lit("/PROJ-[^/]*/brief\\.md$"))).alias("projects"), F.count_if(F.rlike(p, F.lit("/stages/STAGE-[^/]*\\.md$"))).alias("stages"), F.count_if(F.rlike(p, F.lit("/DEC-[^/]*\\.md$"))).alias("decisions"), F.coalesce(F.sum(F.when(F.endswith(p, F.lit("CHANGELOG.md")), releases)), F.lit(0)).alias("releases"))
    return counts.join(commits.agg(F.count(F.lit(1)).alias("commits"), F.min("date").alias("first"), F.max("date").alias("last")))  # one row by one row


def archive(specs: DataFrame, ids: list[str]) -> DataFrame:
    """The files as they are after the named specs are archived: under done/, at cycle ship."""
    go = F.col("id").isin(*ids)
    return specs.withColumns({"path": F.when(go & ~F.col("archived"), F.regexp_replace("path", "/([^/]*)$", "/done/$1")).otherwise(F.col("path")), "cycle": F.when(go, "ship").otherwise(F.col("cycle"))})


def with_scalar(files: DataFrame, key: str, value: Column, insert: bool = True) -> DataFrame:
    """files (path, text) with a scalar of the front matter set, a comment behind it kept; where the key is absent it is put last,
    or with insert off the text stays. A null value leaves the text as it is."""
    parent, _, leaf = key.rpartition(".")
    tail = "[ \\t]*[^\\n#]*?([ \\t]*#[^\\n]*)?(?=\\n)"
    line = f"((?:^|\\n){parent}:[^\\n]*\\n(?:[ \\t][^\\n]*\\n)*?[ \\t]+{leaf}:){tail}" if parent else f"((?:^|\\n){leaf}:){tail}"
    quoted = F.regexp_replace(value, "([\\\\$])", "\\\\$1")

    def changed(parts: Column) -> Column:
        head, rest = parts["head"], parts["rest"]
        set_ = F.regexp_replace(head, F.lit(line), F.concat(F.lit("$1 "), quoted, F.lit("$2")))
        added = F.regexp_replace(head, F.lit(f"((?:^|\\n){parent}:[^\\n]*)"), F.concat(F.lit(f"$1\n  {leaf}: "), quoted)) if parent else F.concat(head, F.lit(f"{leaf}: "), value, F.lit("\n"))
        return F.concat(F.when(F.rlike(head, F.lit(line)), set_).otherwise(added if insert else head), rest)

    def divided(text: Column) -> Column:
        head = F.regexp_extract(text, "(?s)^(---\\n.*?\\n)---", 1)
        return X.let(head, lambda h: F.struct(h.alias("head"), F.substr(text, F.length(h) + 1, F.length(text)).alias("rest")))

    # each text is named once, so that several calls in a row do not multiply
    new = F.transform(F.transform(F.array("text"), divided), lambda p: F.when(value.isNull() | (p["head"] == ""), F.concat(p["head"], p["rest"])).otherwise(changed(p)))
    return files.withColumn("text", F.get(new, F.lit(0)))


def envelopes(rows: DataFrame, command: str, generated_at: str, by: str | None = None) -> DataFrame:
    """JSON documents {schema_version, command, generated_at, data}: one for each value of by, with nulls kept, or with
    by null a line for each row, so that no report has to fit into one document."""
    data = F.struct(*rows.columns)
    doc = lambda d: F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(command).alias("command"), F.lit(generated_at).alias("generated_at"), d.alias("data")), {"ignoreNullFields": "false"})
    if by is None:
        return rows.select(doc(data).alias("json"))
    return rows.groupBy(by).agg(F.sort_array(F.collect_list(data)).alias("d")).select(by, doc(F.col("d")).alias("json"))


def markdown(rows: DataFrame, heading: str) -> DataFrame:
    """(place, line) of a Markdown table; cells are escaped."""
    head = rows.sparkSession.createDataFrame([(-3, f"# {heading}"), (-2, "| " + " | ".join(rows.columns) + " |"), (-1, "|" + "---|" * len(rows.columns))], "place long, line string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(X.cell(F.col(f"`{c}`").cast("string")), F.lit("")) for c in rows.columns]), F.lit(" |"))
    body = rows.select(line.alias("line")).withColumn("place", F.monotonically_increasing_id()).select("place", "line")
    return head.unionByName(body)


def write_report(lines: DataFrame, folder: str) -> None:
    """One text file of a report-sized table of lines, over the one of the same key."""
    lines.orderBy("place").select("line").coalesce(1).write.mode("overwrite").text(folder)


def cut(c: Column, chars: int = 60) -> Column:
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("…"))).otherwise(c)


def reflections(files: DataFrame, lines: int = 12) -> DataFrame:
    """(path, text): the first lines of ## Reflection."""
    body = F.regexp_extract("text", "(?s)(?:^|\\n)## Reflection[^\\n]*\\n(.*?)(?=\\n## [A-Z]|$)", 1)
    return files.select("path", F.array_join(F.slice(F.split(body, "\n"), 1, lines), "\n").alias("text")).filter("text <> ''")
