"""Edits of texts, on files written by hand in the forms that ledgers have."""

from pyspark.sql import functions as F

from quarry.operators import editing as E
from quarry.operators import reports as P
from quarry.sources import records as R

SPEC = """---
# A comment at the top.
task:
  id: SPEC-002
  cycle: build        # frame | design | build | verify | ship
project: {id: PROJ-001, stage: STAGE-001}
repo:
  id: r
cost:
  tokens_estimate: null
  sessions:
    - cycle: design   # by hand
      tokens_total: 100
      estimated_usd: 1.25

    - {cycle: build, tokens_total: 50, notes: "a: # b"}
  # what is summed
  totals:
    tokens_total: 1   # all of them
    estimated_usd: 0.00
    session_count: 0
value_link: "x"
---

# SPEC-002: Title

cost:
  totals:
    tokens_total: 7
"""
EMPTY = "---\ntask:\n  id: SPEC-003\ncost:\n  sessions: []   # none yet\n  totals:\n    session_count: 0\n---\nbody\n"
LATE = "---\ntask:\n  id: SPEC-004\ncost:\n  totals:\n    tokens_total: 0\n  sessions:\n  - cycle: build\n    tokens_total: 3\n---"
HANDOFF = """---
handoff:
  id: HANDOFF-{n}
  cycle: {cycle}                 # build | verify
  to_agent: some-agent
task:
  spec_id: {spec}
handback:
  status: {status}                # completed | blocked | rejected
  tokens_total: {tokens}         # REAL count
  estimated_usd: 0.5
  duration_minutes: 30
  notes: "he said \\"no\\" # really: yes"
  synced_at: null                  # stamped, do not edit
---

# HANDOFF
  synced_at: null
"""


def files(spark, **texts):
    return spark.createDataFrame([(f"projects/PROJ-001/{n.replace('__', '/').replace('_', '-')}.md", t) for n, t in texts.items()], "path string, text string")


def handoffs(spark):
    of = lambda n, spec, cycle="build", status="completed", tokens="9498150": HANDOFF.format(n=n, spec=spec, cycle=cycle, status=status, tokens=tokens)
    return files(spark, handoffs__HANDOFF_010=of("010", "SPEC-002", "verify"), handoffs__HANDOFF_008=of("008", "SPEC-002"), handoffs__HANDOFF_009=of("009", "SPEC-002", status="null"), handoffs__HANDOFF_011=of("011", "SPEC-003", tokens="null"), handoffs__HANDOFF_012=of("012", "SPEC-404"), handoffs__HANDOFF_013=of("013", "SPEC-004", cycle="null"))


def sync(spark, specs, hands, metering="subagent_tokens"):
    a, b, report = E.handback_sync(specs, hands, "2026-08-20", metering)
    return {r.path: r.text for r in a.collect()}, {r.path: r.text for r in b.collect()}, {r.id: r.state for r in report.collect()}


def test_handbacks_are_transcribed_once(spark):
    specs = files(spark, specs__SPEC_002_x=SPEC, specs__SPEC_003_y=EMPTY, specs__SPEC_004_z=LATE, specs__SPEC_005_none="no front matter\ncost:\n  sessions:\n")
    a, b, report = sync(spark, specs, handoffs(spark))
    assert report == {"HANDOFF-010": "due", "HANDOFF-008": "due", "HANDOFF-009": "no status", "HANDOFF-011": "no tokens", "HANDOFF-012": "no spec", "HANDOFF-013": "due"}
    new = a["projects/PROJ-001/specs/SPEC-002-x.md"]
    entry = lambda cycle: f'    - cycle: {cycle}\n      agent: some-agent\n      interface: other\n      tokens_total: 9498150\n      estimated_usd: 0.5\n      duration_minutes: 30\n      recorded_at: 2026-08-20\n      notes: "he said \\"no\\" # really: yes"\n'
    want = SPEC.replace('notes: "a: # b"}\n', 'notes: "a: # b"}\n' + entry("build") + entry("verify")).replace("tokens_total: 1   # all", f"tokens_total: {150 + 2 * 9498150}   # all").replace("estimated_usd: 0.00", "estimated_usd: 2.25").replace("session_count: 0", "session_count: 4")
    assert new == want
    assert a["projects/PROJ-001/specs/SPEC-003-y.md"] == EMPTY
    assert a["projects/PROJ-001/specs/SPEC-004-z.md"] == LATE.replace("    tokens_total: 3\n", "    tokens_total: 3\n" + entry("build").replace("\n  ", "\n")[2:]).replace("tokens_total: 0", "tokens_total: 9498153")
    assert b["projects/PROJ-001/handoffs/HANDOFF-008.md"].count("  synced_at: 2026-08-20                  # stamped") == 1 and b["projects/PROJ-001/handoffs/HANDOFF-008.md"].endswith("# HANDOFF\n  synced_at: null\n")
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, text string")
    again = sync(spark, frame(a), frame(b))
    assert again[0] == a and again[1] == b and again[2]["HANDOFF-008"] == "synced"


def test_handbacks_without_a_meter(spark):
    a, _, report = sync(spark, files(spark, specs__SPEC_003_y=EMPTY), handoffs(spark), "none")
    assert report["HANDOFF-011"] == "due" and report["HANDOFF-008"] == "no spec"
    text = a["projects/PROJ-001/specs/SPEC-003-y.md"]
    assert "  sessions:   # none yet\n    - cycle: build\n" in text and "      tokens_total: null\n" in text and "    session_count: 1\n" in text and text.endswith("---\nbody\n")
    got = R.specs(spark.createDataFrame([("a/SPEC-003-y.md", text)], "path string, text string")).first()
    assert got.sessions[0].notes == 'he said "no" # really: yes'


def test_flow_lists_are_left_alone(spark):
    flow = "---\ncost:\n  sessions: [{cycle: build}]\n---\n"
    df = files(spark, specs__SPEC_1=flow, specs__SPEC_2="---\nother: 1\n---\n").withColumn("e", F.array(F.lit("    - x: 1")))
    assert {r.text for r in E.appended(df, "cost", "sessions", "e").collect()} == {flow, "---\nother: 1\n---\n"}


def test_totals_of_every_spec(spark):
    got = {r.path: r.text for r in E.with_totals(files(spark, specs__SPEC_002_x=SPEC, specs__SPEC_003_y=EMPTY)).collect()}
    assert got["projects/PROJ-001/specs/SPEC-002-x.md"] == SPEC.replace("tokens_total: 1   # all", "tokens_total: 150   # all").replace("estimated_usd: 0.00", "estimated_usd: 1.25").replace("session_count: 0", "session_count: 2")
    assert got["projects/PROJ-001/specs/SPEC-003-y.md"] == EMPTY


def test_backlog_counts(spark):
    text = "---\nstage: {id: STAGE-1}\n---\n## Spec Backlog\n- [x] SPEC-001 (shipped)\n- [ ] SPEC-002 more\n- [ ] (not yet written) — x\n- [~] y\n  - [x] nested\n\n**Count:** 0 shipped / 0 active / 9 pending\n\n## Next\n**Count:** stays\n- [x] other\n"
    got = E.with_backlog_count(files(spark, stages__STAGE_1=text, stages__STAGE_2="no section\n**Count:** x")).orderBy("path").collect()
    assert [r.text for r in got] == [text.replace("0 shipped / 0 active / 9 pending", "1 shipped / 1 active / 2 pending"), "no section\n**Count:** x"]


SPIKE = """---
task:
  id: SPIKE-001
  type: spike                      # kind
  cycle: {cycle}                      # spike | land
spike:
  question: Can we do it?
                                   # REQUIRED.
  mode: {mode}                   # question | build
  timebox: {timebox}
  outcome: {outcome}                # set at land
repo:
  id: r
---
# SPIKE-001
"""


def test_spike_rules(spark):
    of = lambda cycle="land", mode="question", timebox="3 sessions", outcome="answered": SPIKE.format(cycle=cycle, mode=mode, timebox=timebox, outcome=outcome)
    texts = {"SPIKE_001_ok": of(), "SPIKE_002_open": of("spike", outcome="null"), "SPIKE_003_unlanded": of(outcome="null"), "SPIKE_004_odd": of("spike", "guess", "null", "maybe"), "done__SPIKE_005": of("bogus"), "SPIKE_006": "---\nspike: {}\n---\n"}
    got = {r.name: list(r.problems) for r in P.validate(R.spikes(files(spark, **texts)), "spike").collect()}
    assert got == {
        "SPIKE-001-ok": [], "SPIKE-002-open": [], "SPIKE-003-unlanded": ["spike.outcome(='∅')"], "SPIKE-004-odd": ["spike.timebox", "spike.mode(='guess')", "spike.outcome(='maybe')"],
        "SPIKE-006": ["task.id", "task.type", "repo.id", "task.cycle(='∅')", "spike.question", "spike.timebox", "spike.mode(='∅')"]}


def test_advisories_of_briefs_and_decisions(spark):
    brief = "---\nproject: {id: PROJ-001, activity: dancing}\nclosed_reason: bored\nroadmap:\n  - item: STAGE-001\n    kind: dream\n    horizon: now\n  - item: Goal\n    horizon: someday\n---\n"
    got = {(r.name, r.note) for r in P.brief_advisories(R.briefs(files(spark, brief=brief))).collect()}
    assert got == {("PROJ-001", "activity=dancing"), ("PROJ-001", "closed_reason=bored"), ("PROJ-001 STAGE-001", "kind=dream"), ("PROJ-001 Goal", "horizon=someday")}
    dec = "---\ninsight: {id: DEC-001}\nstatus: %s\n%s---\n"
    d = R.decisions(files(spark, DEC_001_a=dec % ("odd", ""), DEC_001_b=dec % ("rejected", "project: {id: P}\n")))
    assert {(r.name, r.note) for r in P.decision_advisories(d).collect()} == {("DEC-001", "status=odd"), ("DEC-001", "unattributed")}


def test_hostile_numbers_count_as_none(spark):
    huge = "9" * 25
    rows = [SPEC.replace("tokens_total: 100", f"tokens_total: {huge}").replace("estimated_usd: 1.25", f"estimated_usd: {huge}.5").replace("tokens_estimate: null", f"tokens_estimate: {huge}"), SPEC]
    s = R.specs(files(spark, specs__SPEC_002_x=rows[0], specs__done__SPEC_003_y=rows[1], specs__done__SPEC_004_z=rows[0]))
    assert {r.id: (r.tokens, float(r.usd)) for r in P.costs(s, "2026-01-01").collect()} == {"SPEC-002": (50, 0.0), "SPEC-003": (150, 1.25), "SPEC-004": (50, 0.0)}
    assert {r.id: r.token_verdict for r in P.calibration(s).collect()} == {"SPEC-003": None, "SPEC-004": None}
    assert {r.id: (list(r.missing), list(r.implausible)) for r in P.cost_gate(s).collect()}["SPEC-004"] == (["verify"], ["build(50)"])
    assert {r.cycle: float(r.usd) for r in P.cost_by(s, "cycle").collect()} == {"design": 1.25}
    assert P.cost_rollup(s).first().usd == 1.25
