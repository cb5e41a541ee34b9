"""Typed records of ledger files: specs, stages, decisions, briefs and guidance lists as columns.

Front matter is parsed once into text scalars, as null, absent and empty are one value and numbers are recognised
where they are used. Everything after that is expressions.
"""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.carry import carried
from quarry.sources.frontmatter import with_front_matter

SESSION = "array<struct<cycle:string,agent:string,interface:string,tokens_total:string,tokens_input:string,tokens_output:string,estimated_usd:string,duration_minutes:string,recorded_at:string,notes:string>>"
TASK = "struct<id:string,type:string,cycle:string,blocked:string,priority:string,complexity:string,complexity_actual:string,verify_verdict:string,spec_id:string>"
SPEC = f"task {TASK}, project struct<id:string,stage:string>, repo struct<id:string>, depends_on array<string>, references struct<decisions:array<string>>, claimed_by string, value_link string, cost struct<tokens_estimate:string,sessions:{SESSION}>"
STAGE = f"stage struct<id:string,status:string,priority:string,target_complete:string>, created_at string, shipped_at string, value_contribution struct<advances:string>, orchestration_cost struct<sessions:{SESSION}>"
DECISION = "insight struct<id:string,type:string,confidence:string>, project struct<id:string>, created_at string, supersedes string, superseded_by string, status string, deciders array<string>, affected_scope array<string>, tags array<string>"
BRIEF = "project struct<id:string,status:string,activity:string>, created_at string, shipped_at string, closed_reason string, value struct<thesis:string>, value_realized struct<thesis_held:string,evidence:string>, roadmap array<struct<item:string,kind:string,horizon:string,resume_when:string,target:string>>"
SPIKE = "task struct<id:string,type:string,cycle:string>, spike struct<question:string,mode:string,timebox:string,outcome:string,landed_at:string>, project struct<id:string>, repo struct<id:string>"
HANDOFF = "handoff struct<id:string,cycle:string,to_agent:string,status:string>, task struct<spec_id:string>, project struct<id:string>, handback struct<status:string,tokens_total:string,estimated_usd:string,duration_minutes:string,notes:string,completed_at:string,synced_at:string>"
GUIDANCE = {
    "questions": "id string, question string, priority string, status string",
    "signals": "id string, type string, status string, disposition_at string, bar string, summary string",
    "constraints": "id string, severity string, paths string, added_by string, rule string",
}


def told(c: Column) -> Column:
    """A scalar, or null where it is null, absent or empty."""
    return F.when((F.trim(c) != "") & (c != "null"), F.trim(c))


def listed(c: Column) -> Column:
    """A list without its empty values; never null."""
    return F.coalesce(F.filter(F.transform(c, told), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.md$", "")


def file_id(path: Column, kind: str) -> Column:
    return F.regexp_extract(file_stem(path), f"^({kind}-[0-9]+)", 1)


def title(path: Column, text: Column, kind: str) -> Column:
    """The first heading of the record without its id and separator, else the words of the file name."""
    heading = F.regexp_extract(text, f"(?m)^#[ \\t]*{kind}-[0-9]+[ \\t]*(?::[ \\t]*)?(?:—[ \\t]*)?(?:-[ \\t]*)?(.*?)[ \\t]*$", 1)
    return F.coalesce(F.nullif(heading, F.lit("")), F.translate(F.regexp_replace(file_stem(path), f"^{kind}-[0-9]+-?", ""), "-", " "))


def records(files: DataFrame, schema: str) -> DataFrame:
    """files (path, text) with the typed front matter m; without front matter all of m is null."""
    return with_front_matter(files).withColumn("m", F.from_json("matter", schema)).drop("matter")


def countable(path: Column) -> Column:
    """Whether a file is a record of its kind: no timeline and no prompt."""
    return ~F.rlike(path, F.lit("-timeline\\.md$|/prompts/"))


def archived(path: Column) -> Column:
    return F.contains(path, F.lit("/done/"))


def specs(files: DataFrame, kind: str = "SPEC") -> DataFrame:
    """The accessors of specs, or with kind PATCH of patches, a row a file that counts."""
    m, c = records(files.filter(countable(F.col("path"))), SPEC), F.col
    cycle = told(c("m.task.cycle"))
    return m.select("path", "text", file_stem(c("path")).alias("name"), file_id(c("path"), kind).alias("id"), title(c("path"), c("text"), kind).alias("title"),
        *[told(c(f"m.task.{n}")).alias(a) for n, a in (("id", "task_id"), ("type", "type"), ("complexity", "complexity"), ("complexity_actual", "complexity_actual"), ("verify_verdict", "verify_verdict"))],
        cycle.alias("cycle"), told(c("m.project.id")).alias("project"), told(c("m.project.stage")).alias("stage"), told(c("m.repo.id")).alias("repo"), listed(c("m.depends_on")).alias("depends_on"),
        listed(c("m.references.decisions")).alias("decisions"), told(c("m.claimed_by")).alias("claimed_by"), told(c("m.value_link")).alias("value_link"), told(c("m.cost.tokens_estimate")).alias("tokens_estimate"),
        F.coalesce(c("m.cost.sessions"), F.array().cast(SESSION)).alias("sessions"), archived(c("path")).alias("archived"), (archived(c("path")) | F.coalesce(cycle == "ship", F.lit(False))).alias("shipped"))


def stages(files: DataFrame) -> DataFrame:
    m, c = records(files.filter(countable(F.col("path"))), STAGE), F.col
    return m.select("path", "text", file_id(c("path"), "STAGE").alias("id"), *[told(c(f"m.{n}")).alias(a) for n, a in (("stage.status", "status"), ("stage.target_complete", "target"), ("created_at", "created_at"), ("shipped_at", "shipped_at"), ("value_contribution.advances", "advances"))],
        F.coalesce(c("m.orchestration_cost.sessions"), F.array().cast(SESSION)).alias("sessions"))


def decisions(files: DataFrame) -> DataFrame:
    """insight_id is as declared; id falls back to the file's. status is as declared, effective is derived where it is not."""
    m, c = records(files, DECISION), F.col
    declared, by = told(c("m.status")), told(c("m.superseded_by"))
    return m.select("path", file_stem(c("path")).alias("name"), file_id(c("path"), "DEC").alias("file_id"), told(c("m.insight.id")).alias("insight_id"), F.coalesce(told(c("m.insight.id")), file_id(c("path"), "DEC")).alias("id"),
        F.regexp_extract("text", "(?m)^# DEC-[0-9]+:[ \\t]*(.*)$", 1).alias("title"), told(c("m.insight.type")).alias("type"), told(c("m.insight.confidence")).alias("confidence"), told(c("m.project.id")).alias("project"), told(c("m.created_at")).alias("created_at"),
        told(c("m.supersedes")).alias("supersedes"), by.alias("superseded_by"), declared.alias("status"), F.coalesce(declared, F.when(by.isNotNull(), "superseded").otherwise("active")).alias("effective"), listed(c("m.deciders")).alias("deciders"), listed(c("m.affected_scope")).alias("scope"))


def briefs(files: DataFrame) -> DataFrame:
    m, c = records(files, BRIEF), F.col
    return m.select("path", "text", *[told(c(f"m.{n}")).alias(a) for n, a in (("project.id", "id"), ("project.status", "status"), ("project.activity", "activity"), ("created_at", "created_at"), ("shipped_at", "shipped_at"), ("closed_reason", "closed_reason"), ("value.thesis", "thesis"), ("value_realized.thesis_held", "thesis_held"), ("value_realized.evidence", "evidence"))], c("m.roadmap").alias("roadmap"))


def spikes(files: DataFrame) -> DataFrame:
    """Spikes that are not archived; task.id, type and cycle are as those of specs, the rest is under spike."""
    m = records(files.filter(countable(F.col("path")) & ~archived(F.col("path"))), SPIKE)
    names = [("task.id", "task_id"), ("task.type", "type"), ("task.cycle", "cycle"), ("project.id", "project"), ("repo.id", "repo"), *((f"spike.{n}", n) for n in ("question", "mode", "timebox", "outcome", "landed_at"))]
    return m.select("path", file_stem(F.col("path")).alias("name"), file_id(F.col("path"), "SPIKE").alias("id"), *[told(F.col(f"m.{n}")).alias(a) for n, a in names])


def handoffs(files: DataFrame) -> DataFrame:
    """Handoffs: spec, cycle (build where none is given) and what the agent handed back."""
    m, c = records(files.filter(countable(F.col("path"))), HANDOFF), F.col
    names = [("task.spec_id", "spec"), ("handoff.to_agent", "agent"), *((f"handback.{n}", n) for n in ("status", "tokens_total", "estimated_usd", "duration_minutes", "notes", "synced_at"))]
    return m.select("path", "text", file_id(c("path"), "HANDOFF").alias("id"), F.coalesce(told(c("m.handoff.cycle")), F.lit("build")).alias("cycle"), *[told(c(f"m.{n}")).alias(a) for n, a in names])


def guidance(files: DataFrame, kind: str) -> DataFrame:
    """(path, place, columns of the kind): the entries of a YAML list file of questions, signals or constraints."""
    wrapped = files.select("path", F.concat(F.lit("---\n"), F.col("text"), F.lit("\n---\n")).alias("text"))
    m = with_front_matter(wrapped).select("path", F.from_json("matter", f"{kind} array<struct<{GUIDANCE[kind].replace(' string', ':string')}>>")[kind].alias("rows"))
    rows = m.select("path", F.posexplode("rows").alias("place", "r")).filter(told(F.col("r.id")).isNotNull())
    return rows.select("path", "place", *[told(F.col(f"r.{n.split()[0]}")).alias(n.split()[0]) for n in GUIDANCE[kind].split(", ")])


def numbered_lines(files: DataFrame, width: int = 4096) -> DataFrame:
    """(path, place, line, section): each line with the ## heading that it stands under, null before the first. Headings are
    carried from chunk to chunk of a file, so the work grows with its lines and a long file is spread over tasks."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    heads = lines.withColumn("section", F.when(F.startswith("line", F.lit("## ")), F.substring("line", 4, 1_000_000)))
    return carried(heads, "path", "place", "section", width)


def bullets(lines: DataFrame) -> DataFrame:
    """The checkbox bullets of ## Spec Backlog with bucket: shipped, active or pending, and unpromoted: not yet written."""
    item = lines.filter(F.startswith("section", F.lit("Spec Backlog")) & F.rlike("line", F.lit("^-\\s*\\[")))
    bucket = F.when(F.rlike("line", F.lit("^-\\s*\\[x\\]")), "shipped").when(F.rlike("line", F.lit("SPEC-[0-9]")), "active").otherwise("pending")
    return item.select("path", "place", "line", bucket.alias("bucket"), F.contains("line", F.lit("(not yet written)")).alias("unpromoted"))


def parsed_bullet(line: Column) -> Column:
    """(summary, complexity) of a bullet: without box and marker, and with a size in brackets lifted out."""
    bare = F.regexp_replace(F.regexp_replace(line, "^\\s*-\\s*\\[[ x~?]\\]\\s*", ""), "\\(not yet written\\)\\s*[—-]\\s*", "")
    size = F.regexp_extract(bare, "\\[(XS|S|M|L|XL|XXL)\\]", 1)
    return F.struct(F.trim(F.regexp_replace(bare, "\\s*\\[(XS|S|M|L|XL|XXL)\\]\\s*", " ")).alias("summary"), F.nullif(size, F.lit("")).alias("complexity"))


def stage_plan(lines: DataFrame) -> DataFrame:
    """(path, place, stage, checked, title) of the checkbox lines under ## Stage Plan; stage is null for one not yet defined."""
    item = lines.filter(F.startswith("section", F.lit("Stage Plan")) & F.rlike("line", F.lit("^\\s*-\\s*\\[[ xX~?]\\]")))
    rest = F.regexp_replace("line", "^\\s*-\\s*\\[[ xX~?]\\]\\s*", "")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "^STAGE-[0-9]+\\s*", ""), "^\\([^)]*\\)\\s*", ""), "^(—\\s*)?(-\\s*)?", "")
    return item.select("path", "place", F.nullif(F.regexp_extract(rest, "^(STAGE-[0-9]+)", 1), F.lit("")).alias("stage"), F.rlike("line", F.lit("\\[[xX]\\]")).alias("checked"), F.rtrim(name).alias("title"))


def defect_answer(text: Column) -> Column:
    """The answer to where the worst defect was caught: the first bare word within ten lines of the question that hold no backtick."""
    after = F.regexp_extract(text, "(?s)(?:Where was the worst defect caught[^\\n]*\\n|(?=\\*\\*Defect-catch-stage:\\*\\*))(.*)$", 1)
    lines = F.slice(F.filter(F.split(after, "\n"), lambda x: ~F.contains(x, F.lit("`"))), 1, 10)
    words = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, "^[^a-z]*", ""), "\\s*$", ""))
    return F.get(F.filter(words, lambda w: w.isin("design", "build", "verify", "ship", "escaped", "none")), F.lit(0))


def outcome(text: Column) -> Column:
    """The answer to what a user can do now: the first dash line of its block, unless it is none or a placeholder."""
    block = F.regexp_extract(text, "(?s)(?:^|\\n)5\\. \\*\\*What can a user do now[^\\n]*\\n(.*?)(?=\\n[0-9]+\\. \\*\\*|\\n## |$)", 1)
    answer = F.regexp_extract(F.concat(F.lit("\n"), block), "\\n\\s*—\\s+([^\\n]*?)\\s*(?:\\n|$)", 1)
    return F.when((answer != "") & (answer != "none") & ~F.startswith(answer, F.lit("<")), answer)


def reflection_filled(text: Column) -> Column:
    """Whether a bullet of ## Project-Level Reflection says anything beside its question and placeholders."""
    body = F.regexp_extract(text, "(?s)(?:^|\\n)## Project-Level Reflection[^\\n]*\\n(.*?)(?=\\n## |$)", 1)

    def said(x: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(x, "^\\s*-\\s*", ""), "^\\*\\*[^*]*\\*\\*\\s*", "")
        return F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", ""), "[\\s*_.:?—-]", "") != ""

    return F.exists(F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit("^\\s*-\\s"))), said)


def manifest_rows(text: str) -> list[dict]:
    """The [[file]] entries of one manifest; each with fault, the first rule that it breaks, or null. Extra keys do not matter."""
    try:
        files = tomllib.loads(text).get("file")
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"manifest is not valid TOML: {e}") from None
    if not isinstance(files, list):
        raise ValueError("manifest has no [[file]] entries" if files is None else "manifest key file is not an array of tables")
    rows = []
    for i, entry in enumerate(files):
        row = {"place": i + 1, "fault": None}

        def text_of(table, key, row=row):
            value = table.get(key)
            if row["fault"] is None:
                row["fault"] = f"missing required key {key}" if value is None else f"{key} is not a string" if not isinstance(value, str) else f"{key} is empty" if not value.strip() else None
            return value if isinstance(value, str) else None

        def whole(table, key, needed, row=row):
            value = table.get(key)
            good = isinstance(value, int) and not isinstance(value, bool)
            if row["fault"] is None:
                row["fault"] = (f"missing required key {key}" if needed else None) if value is None else f"{key} is not an integer" if not good else f"{key} is negative" if value < 0 else None
            return value if good and value >= 0 else None

        row["path"] = text_of(entry, "path")
        if row["fault"] is None and row["path"].startswith("/"):
            row["fault"] = "path is absolute"
        row["sha256"] = text_of(entry, "sha256")
        if row["fault"] is None and (len(row["sha256"]) != 64 or set(row["sha256"].lower()) - set("0123456789abcdef")):
            row["fault"] = "sha256 is not 64 hex characters"
        oracle = entry.get("oracle")
        if row["fault"] is None and oracle is None:
            row["fault"] = "missing oracle table"
        for key in ("tier", "bytes", "licence", "source"):
            row[key] = whole(entry, key, True) if key == "bytes" else text_of(entry, key)
        row["sha256"] = row["sha256"] and row["sha256"].lower()
        row["raw_checksum"] = text_of(oracle or {}, "raw_checksum")
        row["pgm_bytes"], row["strip_bytes"] = (whole(oracle or {}, k, False) for k in ("pgm_bytes", "strip_bytes"))
        rows.append(row)
    return rows


MANIFEST = "place int, path string, tier string, bytes long, sha256 string, licence string, source string, raw_checksum string, pgm_bytes long, strip_bytes long, fault string"


def manifest(spark: SparkSession, text: str) -> DataFrame:
    """The entries of one small manifest as rows."""
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in manifest_rows(text)], MANIFEST)


def manifests(files: DataFrame) -> DataFrame:
    """The entries of many manifests (path, text); one that is no manifest is a row with place 0 and its fault."""
    import pyarrow as pa

    names = [f.split()[0] for f in MANIFEST.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}

    def scan(batches):
        for batch in batches:
            out, keys = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = manifest_rows(text or "")
                except ValueError as e:
                    rows = [{"place": 0, "fault": str(e)}]
                out += rows
                keys += [key] * len(rows)
            yield pa.record_batch([pa.array(keys, pa.string()), *(pa.array([r.get(n) for r in out], kinds[f.split()[1]]) for n, f in zip(names, MANIFEST.split(", "), strict=True))], ["manifest", *names])

    return files.select("path", "text").mapInArrow(scan, f"manifest string, {MANIFEST}")


def corpus_root(default: str, variable: str = "QUARRY_CORPUS_DIR") -> tuple[str, bool]:
    """(folder, whether the environment names it)."""
    found = os.environ.get(variable, "")
    return (found, True) if found.strip() else (default, False)


def settings(text: str) -> dict:
    """The scalars of a configuration file: metering source, version scheme, default model and the models of cycles."""
    import yaml

    found = yaml.safe_load(text) if text else None

    def at(*keys):
        value = found
        for k in keys:
            value = value.get(k) if isinstance(value, dict) else None
        return value

    tiers = at("spec", "agent", "tier_map")
    default = at("spec", "agent", "default_model")
    return {"metering_source": str(at("spec", "cost", "metering_source") or "subagent_tokens"), "version_scheme": str(at("spec", "version", "scheme") or "calver"), "default_model": default, "models": {str(k): str(v) for k, v in tiers.items()} if isinstance(tiers, dict) else {}}


def model_of(config: dict, cycle: str) -> str | None:
    return config["models"].get(cycle) or config["default_model"]
