"""Steps whose tasks, batches and rows have to stay in proportion as tables grow."""

import json
import random

import pyarrow as pa
import yaml
from pyspark.sql import functions as F

from quarry.operators import editing as E
from quarry.operators import ordering as N
from quarry.operators import reports as P
from quarry.operators import scopes as S
from quarry.plans import decoding, records, texts
from quarry.sources import frontmatter as M
from quarry.sources import planes
from quarry.sources import records as R
from quarry.sources.frontmatter import front_matter
from quarry.store import dealt


def test_rows_are_dealt_over_tasks(spark):
    for n, tasks in ((0, 1), (999, 1), (20_000, 21)):
        rows = dealt(spark.range(n).coalesce(1), "id", 1000)
        assert rows.rdd.getNumPartitions() == tasks and rows.count() == n
    assert max(len(x) for x in dealt(spark.range(20_000).coalesce(1), "id", 1000).rdd.glom().collect()) < 1200


class Direct:
    """What a step of Arrow batches does, without Spark."""

    dtypes = (("path", "int"),)

    def mapInArrow(self, step, schema):
        return step


def test_small_strips_share_a_batch(monkeypatch):
    n = 100
    column = lambda v: pa.array([v] * n, pa.int32())
    batch = pa.record_batch({"path": column(1), "width": column(2), "bits": column(12), "byte_order": ["MM"] * n, "strip": column(0), "first_row": column(0), "rows": column(1), "packed": pa.array([b"\0\x10\xff"] * n)})
    assert [x.num_rows for x in planes.unpacked(Direct())(iter([batch]))] == [n]
    monkeypatch.setattr(planes, "MOST", 50)
    out = list(planes.unpacked(Direct())(iter([batch.slice(7)])))
    assert [x.num_rows for x in out] == [24, 25, 25, 19]
    assert all(r["samples"] == b"\1\0\xff\0" and (r["n"], r["low"], r["high"], r["total"]) == (2, 1, 255, 256) for x in out for r in x.to_pylist())


def decided(spark, n=60, ids=40):
    """Decisions of few scopes, some ids twice."""
    r = random.Random(7)
    scopes = [[r.choice(["src/*", "src/a/**", "src/a/b/*.rs", "docs/x", "*", "src"]) for _ in range(r.randrange(0, 4))] for _ in range(9)]
    rows = [(f"D{i % ids}", f"d/D{i:03}", scopes[i * i % 9], "E" if i % 11 == 0 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id string, path string, scope array<string>, superseded_by string").repartition(3)


def test_paths_meet_scopes_once(spark):
    d = decided(spark)
    paths = spark.createDataFrame([(p,) for p in ("src/x", "src/a/b/c.rs", "src/a/y", "docs/x", "top", "src", "src/x", "no/no")], "path string")
    ids = d.filter("superseded_by IS NULL").withColumn("id", F.col("path"))  # a decision is its file
    want = {(x.id, x.glob): x["count"] for x in S.governed(paths, ids).groupBy("id", "glob").count().collect()}
    got = S.governed_counts(paths, d)
    assert {(x.path, x.glob): x.paths for x in got.collect()} == want and len(want) > 40
    assert all(int(x.path[-3:]) % 40 == int(x.id[1:]) for x in got.collect())


def test_classes_give_all_pairs(spark):
    for d in (decided(spark), decided(spark).filter("path < 'd/D012'")):
        of = {x.path: tuple(x.scope) for x in S.scope_members(d).collect()}
        want = {}
        for x in S.scope_pairs(d.withColumn("id", F.col("path"))).collect():
            a, b = of[x.a], of[x.b]
            row = want.setdefault((a, b) if a <= b else (b, a), [x.relation, 0, None, None])
            row[1] += 1
            row[2 if a <= b else 3] = x.pair
        got = {(tuple(x.a), tuple(x.b)): [x.relation, x.n, x.pair, x.turned] for x in S.scope_class_pairs(d).collect()}
        assert got == want and {x[0] for x in want.values()} == {"same", "nest"}
        assert len(got) <= len(set(of.values())) ** 2


def parsed(df):
    """How often a plan parses or decodes rows in Python."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_edits_parse_each_text_once(spark):
    files = spark.createDataFrame([("specs/SPEC-001-x.md", "---\ncost:\n  sessions: []\n  totals:\n    session_count: 9\n---\n")], "path string, text string").repartition(2)
    totals = E.with_totals(files)
    assert parsed(totals) == 1 and "Join" not in totals._jdf.queryExecution().optimizedPlan().toString()
    assert "session_count: 0\n" in totals.first().text
    assert parsed(E.handback_sync(files, files, "2024-05-05")[0]) == 2  # the handoffs, and the specs for their totals


def test_tables_of_small_files_are_dealt(spark):
    sf = "/root/testdata/sf0.1"
    assert records.spec_files(spark, sf).rdd.getNumPartitions() == 4
    assert decoding.part_of(spark, sf).rdd.getNumPartitions() == 11


def test_deep_and_looped_front_matter():
    assert front_matter("---\na: " + "[" * 3000 + "]" * 3000 + "\n---\n") is None and front_matter("---\na: &x [*x]\n---\n") is None
    assert front_matter("---\n[a]: 1\n---\n") is None and front_matter("---\na: &x {b: ~}\nc: *x\na: !!int 2\n---\n") == '{"a": "2", "c": {"b": "~"}}'


def test_reports_parse_each_record_once(spark):
    text = "---\ntask:\n  cycle: build\nproject:\n  id: P\ndepends_on: [SPEC-002]\ncost:\n  sessions:\n    - cycle: build\n      estimated_usd: 1.5\n---\nWhere was the worst defect caught\n- none\n"
    specs = R.specs(spark.createDataFrame([("specs/SPEC-001-x.md", text)], "path string, text string").repartition(2))
    found = {
        "advisories": P.advisories(specs), "ready": P.ready(specs), "cost_by": P.cost_by(specs, "cycle"), "defects": P.defects(specs),
        "documents": N.documents(specs.select("project", "id"), "project", "id", "ready", "2024-01-01T00:00:00Z"),
    }
    assert {n: parsed(d) for n, d in found.items()} == dict.fromkeys(found, 0)  # written before they are used again
    assert {n: d.count() for n, d in found.items()} == {"advisories": 1, "ready": 1, "cost_by": 1, "defects": 6, "documents": 1}


def test_edits_are_not_repeated_by_filters(spark):
    plan = records.QUERIES["scalar_update"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    asked = [x for x in plan.split("\n") if "Filter" in x and "cycle: verify" in x]
    assert asked and not any("regexp_" in x for x in asked)


def test_ids_with_one_beginning_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(2000).select(F.format_string("projects/PROJ-%09d", "id").alias("t"), "id").repartition(3)
        out = N.numbered(rows, F.lit(0), "t").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({x.task for x in out}) > 1 and all(x.new_id == x.id + 1 for x in out)


HANDED = """---
handoff:
  id: HANDOFF-7
  cycle: build   # build | verify
task: {spec_id}
handback:
  notes: "it said \\"a # b\\""
  tags: [a, b-c]
  worst: 'it''s'
  when: 2024-01-01T10:00:00   # stamped
  files:
  - x.md
  - path: a b
    size:
  none: []
---
# Handoff
"""


def test_usual_front_matter_is_read_without_libyaml(monkeypatch):
    monkeypatch.setattr(M.yaml, "CBaseLoader", None)
    want = {"handoff": {"id": "HANDOFF-7", "cycle": "build"}, "task": {"spec_id": "S"}, "handback": {"notes": 'it said "a # b"', "tags": ["a", "b-c"], "worst": "it's", "when": "2024-01-01T10:00:00", "files": ["x.md", {"path": "a b", "size": ""}], "none": []}}
    text = HANDED.replace(" {spec_id}", "\n  spec_id: S")
    for _ in range(2):  # a line that was read before says the same again
        assert json.loads(front_matter(text)) == want
    assert M.usual(HANDED.split("\n---", 1)[0][3:]) is None  # a flow mapping is left to libyaml
    lines = [f"k{i}: {i}" for i in range(2 * M.MOST)]
    assert len(M.usual("\n" + "\n".join(lines))) == len(lines) and len(M.SEEN) <= M.MOST and M.usual("\n" + "\n".join("  " * i + "a:" for i in range(300))) is None


def test_odd_front_matter_reads_as_libyaml_does():
    r = random.Random(3)
    lines = ["", "  # c", "k:", "k:   # c", "j: v", "j: a: b", "j: a:", "j: a:b", "j: a #b", "j: a#b", 'j: "q"', 'j: "q"#c', 'j: "\\n"', 'j: ""', "j: 'it''s'", "j: []", "j: [a, b]", "j: [a ,b]", "j: {a: b}", "j: &x y", "j: |", "j: \tv", "j: a\r", "j: a\x85b", "j: -5", "v", "1a: x", "j:v", "? a", "é: ü", "..."]
    known = 0
    for _ in range(6000):
        head = "".join("\n" + "  " * r.randrange(3) + r.choice(["", "", "- "]) + r.choice(lines if r.random() < 0.4 else lines[:12]) for _ in range(r.randrange(1, 6)))
        got = M.usual(head)
        if got is not None:
            known += 1
            assert json.dumps(got) == json.dumps(M.plain(yaml.CBaseLoader(head).get_single_node())), head
    assert known > 300


def test_edits_are_not_worked_out_line_by_line(spark):
    n = 20_000
    text = "---\ncost:\n  sessions:\n" + "    - cycle: build\n      tokens_total: 2\n" * n + "  totals:\n    tokens_total: 1   # all\n    session_count: 0\n---\n"
    files = spark.createDataFrame([("specs/SPEC-001-x.md", text)], "path string, text string").withColumn("e", F.array(F.lit("    - cycle: ship"), F.lit("      tokens_total: 5")))
    new = E.with_totals(E.appended(files, "cost", "sessions", "e"))
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "split(" in plan  # lines were filtered by a pattern, five times over, for each place that was sought
    assert new.first().text == text.replace("  totals:\n", "    - cycle: ship\n      tokens_total: 5\n  totals:\n").replace("tokens_total: 1   # all", f"tokens_total: {2 * n + 5}   # all").replace("session_count: 0", f"session_count: {n + 1}")


def test_short_handoffs_share_a_task(spark):
    assert texts.handoff_files(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 11
