"""Functions, sources and operators that no query exercises, on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import ledger as L
from quarry.operators import reports as P
from quarry.sources import container as C
from quarry.sources import encode as E
from quarry.sources import records as R
from quarry.streaming.sync import sync_stream


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_scalar_functions(spark):
    lit = F.lit
    assert values(spark, X.glob_prefix(lit("src/a[bc]/*.rs")), X.glob_prefix(lit("a/b/")), X.glob_prefix(lit("**/x"))) == ["src/a", "a/b", ""]
    assert values(spark, X.scope_relation(lit(""), lit("")), X.scope_relation(lit("a"), lit("a/b")), X.scope_relation(lit("a"), lit("ab"))) == ["none", "nest", "none"]
    assert values(spark, X.format_tokens(lit(201141)), X.format_tokens(lit(950)), X.days_between(lit("2024-01-01"), lit("2024-03-01")), X.days_between(lit("x"), lit("2024-03-01"))) == ["201k", "950", 60, None]
    assert values(spark, X.progress(lit(1), lit(8)), X.progress(lit(3), lit(8)), X.size_rank(lit("XXL")), X.size_rank(lit("?")), X.cell(lit("a|b\n c"))) == [12.0, 38.0, 6, 0, "a\\|b c"]
    assert values(spark, X.days_ago(lit("2024-03-01"), 2), P.cut(lit("x" * 70))) == ["2024-02-28", "x" * 60 + "…"]
    assert values(spark, X.drift(lit(126), lit(100)), X.drift(lit(74), lit(100)), X.drift(lit(100), lit(0))) == ["under", "over", None]


def test_containers_from_files(spark, tmp_path):
    (tmp_path / "a.dng").write_bytes(E.container("<", 8, {8: (E.plane("<"), 0)}))
    (tmp_path / "b.dng").write_bytes(b"XX")
    got = {r.path[-5:]: r.fault for r in C.sensors(C.read_containers(spark, str(tmp_path), "*.dng")).collect()}
    assert got == {"a.dng": None, "b.dng": "NotTiff"}


def test_stream_appends_once(spark, tmp_path):
    source, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    for i in range(2):  # the second run of the same rows under new checkpoints adds nothing
        spark.createDataFrame([(1,), (2,), (2,), (None,)], "m int").write.mode("append").parquet(source)
        sync_stream(spark.readStream.schema("m int").parquet(source), "m", ledger, str(tmp_path / f"c{i}")).awaitTermination()
    assert sorted((r.m for r in spark.read.parquet(ledger).collect()), key=str) == [1, 2, None]


def test_manifest():
    good = '[[file]]\npath = "a.dng"\ntier = "b"\nbytes = 3\nsha256 = "' + "AB" * 32 + '"\nlicence = "x"\nsource = "y"\n[file.oracle]\nraw_checksum = "z"\nstrip_bytes = 7\n'
    row = R.manifest_rows(good)[0]
    assert row["fault"] is None and row["sha256"] == "ab" * 32 and row["strip_bytes"] == 7 and row["pgm_bytes"] is None
    with pytest.raises(ValueError, match="not an array"):
        R.manifest_rows("file = 1")
    with pytest.raises(ValueError, match="not valid TOML"):
        R.manifest_rows("[[file")


def test_configuration(monkeypatch):
    config = R.settings("spec:\n  cost:\n    metering_source: none\n  agent:\n    default_model: m\n    tier_map:\n      build: big\n")
    assert (config["metering_source"], config["version_scheme"], R.model_of(config, "build"), R.model_of(config, "ship")) == ("none", "calver", "big", "m")
    assert R.settings("")["metering_source"] == "subagent_tokens"
    monkeypatch.setenv("QUARRY_CORPUS_DIR", " ")
    assert R.corpus_root("d") == ("d", False)
    monkeypatch.setenv("QUARRY_CORPUS_DIR", "/x")
    assert R.corpus_root("d") == ("/x", True)


def test_report_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 1), ("c", None)], "name string, n int")
    P.write_report(P.markdown(rows, "Week"), str(tmp_path / "w"))
    P.write_report(P.markdown(rows.limit(1), "Week"), str(tmp_path / "w"))  # over the one of the same key
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["# Week", "| name | n |", "|---|---|", "| a\\|b | 1 |"]
    docs = [json.loads(r.json) for r in P.envelopes(rows, "x", "t").collect()]
    assert {"schema_version": 1, "command": "x", "generated_at": "t", "data": {"name": "c", "n": None}} in docs
    assert json.loads(P.envelopes(rows.withColumn("k", F.lit(1)), "x", "t", "k").first().json)["data"][0]["name"] == "a|b"
    assert json.loads(L.envelope("x", "t", rows).first().json)["data"]


def test_patches_spikes_and_gate(spark):
    patch = "---\ntask: {id: PATCH-1, type: fix, cycle: ship, complexity: S}\nproject: {id: P}\nrepo: {id: r}\ncost:\n  sessions:\n    - {cycle: patch, tokens_total: 10}\n---\n# PATCH-1 — Fix it\n"
    spike = "---\ntask: {id: SPIKE-1, type: spike, cycle: spike}\nrepo: {id: r}\nspike: {question: why, mode: build, timebox: a day, outcome: maybe}\n---\n"
    files = spark.createDataFrame([("p/patches/PATCH-1-x.md", patch), ("p/patches/PATCH-1-timeline.md", patch)], "path string, text string")
    patches, spikes = R.specs(files, "PATCH"), R.spikes(spark.createDataFrame([("s/SPIKE-1-x.md", spike)], "path string, text string"))
    assert [(r.id, r.title, r.shipped) for r in patches.collect()] == [("PATCH-1", "Fix it", True)]
    assert [(r.missing, r.implausible) for r in P.cost_gate(patches.limit(0), patches).collect()] == [(["verify"], ["patch(10)"])]
    assert P.cost_gate(patches, patches, "none").count() == 0
    assert {(r.kind, tuple(r.problems)) for r in P.validate_all(patches.limit(0), patches, spikes).collect()} == {("patch", ()), ("spike", ("spike.outcome(='maybe')",))}


def test_guidance_and_reflections(spark):
    text = 'constraints:\n  - id: c1\n    severity: blocking\n    rule: "no x"\n  - id: null\n'
    got = R.guidance(spark.createDataFrame([("c.yaml", text)], "path string, text string"), "constraints").collect()
    assert [(r.id, r.severity, r.rule, r.paths) for r in got] == [("c1", "blocking", "no x", None)]
    long = "## Reflection\n" + "\n".join(f"l{i}" for i in range(20)) + "\n## Next\nx"
    assert P.reflections(spark.createDataFrame([("a", long)], "path string, text string")).first().text == "\n".join(f"l{i}" for i in range(12))


def test_null_markers_are_kept_once(spark):
    a, b = spark.createDataFrame([(1,), (None,)], "m int"), spark.createDataFrame([(None,), (2,)], "m int")
    assert sorted((r.m or 0) for r in L.sync_once(L.sync_once(a, b, "m"), b, "m").collect()) == [0, 1, 2]


def test_leases(spark):
    rows = [("s", 1, "a", False), ("s", 2, "a", False), ("s", 3, "b", False), ("s", 4, "b", True), ("s", 5, None, False), ("s", 6, "c", False)]
    got = L.claims(spark.createDataFrame(rows, "k string, at int, who string, force boolean"), "k", "at", "who", "force").first()
    assert (got.holder, got.refused) == ("c", 1)


def test_leases_against_a_loop(spark):
    """Forced claims and releases, whatever the width of a chunk; without force a release frees the lease too."""
    import random

    r = random.Random(3)
    rows = [(f"k{r.randrange(4)}" if r.random() < 0.9 else None, i, r.choice(["a", "b", "c", None]), r.random() < 0.2) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at int, who string, force boolean").repartition(3)
    for forced in (True, False):
        want = {}
        for k, _, who, force in rows:
            holder, refused = want.get(k, (None, 0))
            taken = holder is not None and who is not None and who != holder and not (force and forced)
            want[k] = (holder if taken else who, refused + taken)
        for width in (1 << 16, 7):
            got = L.claims(df, "k", "at", "who", "force" if forced else None, width)
            assert {x.k: (x.holder, x.refused) for x in got.collect()} == want
    plain = df.filter("who IS NOT NULL")
    assert {x.k: x.holder for x in L.claims(plain, "k", "at", "who").collect()} == {k: next(w for q, _, w, _ in rows if q == k and w) for k in {x[0] for x in rows}}


@pytest.mark.parametrize("width", [1 << 16, 5])
def test_carries_over_chunks(spark, width):
    import random

    r = random.Random(4)
    rows = [(r.choice(["x", "y", None]), i, r.choice([None, None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "f string, at int, v int").repartition(3)
    last, want, count = {}, {}, {}
    for f, i, v in rows:
        last[f] = v if v is not None else last.get(f)
        count[f] = count.get(f, 0) + (v is not None)
        want[i] = (last[f], count[f])
    got = L.running_count(df, "f", "at", F.col("v").isNotNull(), "n", width)
    assert {x.at: (x.v, x.n) for x in L.carried(got, "f", "at", "v", width).collect()} == want


def test_lines_stand_under_their_headings(spark):
    text = "a\n## One\nb\n### no\nc\n## Two\nd"
    got = R.numbered_lines(spark.createDataFrame([("p", text), ("q", ""), ("r", None)], "path string, text string"), 2).orderBy("path", "place").collect()
    assert [(x.place, x.line, x.section) for x in got if x.path == "p"] == [(0, "a", None), (1, "## One", "One"), (2, "b", "One"), (3, "### no", "One"), (4, "c", "One"), (5, "## Two", "Two"), (6, "d", "Two")]
