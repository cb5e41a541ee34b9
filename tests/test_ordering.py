"""Order over whole tables, scopes, strips and the stream, against brute force on small inputs."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ledger as L
from quarry.operators import ordering as N
from quarry.operators import scopes as S
from quarry.sources import planes
from quarry.streaming import sync


def test_ids_in_order(spark):
    r = random.Random(1)
    rows = [("".join(r.choice("abÉ日\u0001z") for _ in range(r.randrange(0, 12))) if r.random() < 0.9 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "t string, i int").repartition(4)
    want = {i: 11 + n for n, (_, i) in enumerate(sorted(rows, key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1])))}
    for buckets in (64, 3):
        out = N.numbered(df, F.lit(10), "t", ("i",), buckets=buckets)
        assert {x.i: x.new_id for x in out.collect()} == want
    assert N.numbered(df.limit(0), F.lit(10), "t", ("i",)).count() == 0
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_stages_are_framed_whole_or_not(spark):
    at = lambda n: f"projects/PROJ-001/stages/STAGE-00{n}-x.md"
    rows = [(at(2), 1, "A thing", "M"), (at(2), 3, "Other: thing", None), (at(1), 5, "One", None), (at(1), 6, "one!", None), (at(1), 7, "Two", None), (at(3), 1, " ", None), (at(4), 1, "Known", None), (at(5), 9, "Known too", None)]
    b = spark.createDataFrame(rows, "path string, place int, summary string, complexity string")
    got = {(x.path[-6], x.place): (x.slug, x.refusal, x.new_id) for x in N.framed(b, spark.createDataFrame([("PROJ-001", "known"), ("PROJ-002", "known-too")], "project string, slug string"), F.lit(41)).collect()}
    assert got == {("2", 1): ("a-thing", None, 42), ("2", 3): ("other-thing", None, 43), ("5", 9): ("known-too", None, 44), ("1", 5): ("one", "same slug", None), ("1", 6): ("one", "same slug", None), ("1", 7): ("two", "stage refused", None), ("3", 1): ("", "no summary", None), ("4", 1): ("known", "exists", None)}


@pytest.mark.parametrize("many", [100_000, 4])
def test_medians_by_narrowing(spark, many):
    r = random.Random(2)
    rows = [(r.choice(["x", "y", None]), float(x)) for x in [*(r.expovariate(0.001) for _ in range(300)), *[7.5] * 200, -1e300, 1e300]] + [("x", None)] + [("same", 3.0)] * 50 + [("one", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    want = {}
    for g in {x[0] for x in rows}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        want[g] = v[(len(v) + 1) // 2 - 1]
    assert {x.g: x.median for x in N.lower_medians(df, ["g"], "v", many).collect()} == want
    whole = df.selectExpr("CAST(CASE WHEN abs(v) < 1e20 THEN v END AS DECIMAL(30, 4)) AS v", "1 AS all").filter("v IS NOT NULL")
    v = sorted(x.v for x in whole.collect())
    assert N.lower_medians(whole, ["all"], "v", many).first().median == v[(len(v) + 1) // 2 - 1]


def test_documents_are_bounded(spark):
    r = random.Random(3)
    rows = [("p" if i % 3 else "q", f"id{i:05d}", "x" * r.randrange(40) if i % 7 else None) for i in range(300)] + [("r", "long", "y" * 900)]
    docs = N.documents(spark.createDataFrame(rows, "project string, id string, note string").repartition(4), "project", "id", 'say "x"', "t", 500, 16).collect()
    for project in "pqr":
        mine = sorted((d for d in docs if d.project == project), key=lambda d: d.part)
        assert [d.part for d in mine if len(mine) > 1] == list(range(1, len(mine) + 1)) * (len(mine) > 1)
        told = [json.loads(d.json) for d in mine]
        assert [x["id"] for t in told for x in t["data"]] == sorted(i for p, i, _ in rows if p == project)
        assert all(t["command"] == 'say "x"' and t["schema_version"] == 1 for t in told)
        assert all(len(d.json) <= 500 + 200 for d in mine if project != "r")
    assert any(x["note"] is None for d in docs for x in json.loads(d.json)["data"])


def test_digests(spark):
    d = lambda rows: spark.createDataFrame(rows, "a string, b string")
    base = [("x", None), ("y", "z"), ("y", "z"), (None, None)]
    assert not L.differs(d(base), d(base[::-1]).repartition(3))
    for other in ([*base, ("y", "z")], [(None, "x"), *base[1:]], [("x", ""), *base[1:]], base[1:], [("xz", None), *base[1:]]):
        assert L.differs(d(base), d(other))
    assert not L.differs(d(base).limit(0), d(base).limit(0))
    one = N.fresh(N.digest(d(base)), N.digest(d(base[1:]))).first()
    assert (one.same, one.stored, one.now) == (False, 4, 3)


GLOBS = ["src/**", "src/a/*.rs", "src/a/b.rs", "**/*.ts", "*.md", "**", "*x*", "docs/?.md", "a.b/c", "src/*/b.rs", "_headers", "**/sub/*", "src", "*/b.rs", "**/b.rs", "sr?/a/b.rs"]


def like(glob, path):
    pattern = re.escape(glob).replace("\\*\\*", "\0").replace("\\*", "[^/]*").replace("\\?", ".").replace("\0", ".*")
    return re.fullmatch(pattern, path, re.S) is not None


def test_globs_meet_paths(spark):
    r = random.Random(5)
    paths = ["/".join(r.choice(["src", "a", "b.rs", "sub", "docs", "x.ts", "a.b", "c", "y.md", "_headers"]) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    d = spark.createDataFrame([(f"D{i}", [g, GLOBS[(i + 5) % len(GLOBS)]], "E" if i == 3 else None) for i, g in enumerate(GLOBS)], "id string, scope array<string>, superseded_by string")
    want = {}
    for i, g in enumerate(GLOBS):
        for p in set(paths) if i != 3 else ():
            hit = [x for x in (g, GLOBS[(i + 5) % len(GLOBS)]) if like(x, p)]
            if hit:
                want[f"D{i}", p] = hit[0]
    got = S.governed(spark.createDataFrame([(p,) for p in paths], "path string"), d)
    assert {(x.id, x.path): x.glob for x in got.collect()} == want and len(want) > 300


def test_scope_classes_count_pairs(spark):
    r = random.Random(6)
    rows = [(f"D{i}", f"d/D{i}", [r.choice(["src/*", "src/a/**", "src/a/b/*.rs", "docs/x", "*"]) for _ in range(r.randrange(0, 4))], "E" if i % 9 == 0 else None) for i in range(60)]
    d = spark.createDataFrame(rows, "id string, path string, scope array<string>, superseded_by string")
    have = {p: {re.match(r"[^*?\[]*", g)[0].rstrip("/") for g in s} - {""} for _, p, s, by in rows if not by}
    some = sorted({x for s in have.values() for x in s})
    want = {}
    for x in some:
        for y in some:
            if x == y or x.startswith(y + "/"):
                met = {frozenset((p, q)) if x == y else (p, q) for p in have for q in have if p != q and x in have[p] and y in have[q]}
                want[x, y] = ("same" if x == y else "nest", sum(x in s for s in have.values()), sum(y in s for s in have.values()), len(met))
    assert {(c.prefix, c.over): (c.relation, c.decisions, c.others, c.pairs) for c in S.scope_classes(d).collect()} == want
    all_ = {(x.a, x.b): (x.relation, x.pair) for x in S.scope_pairs(d).collect()}
    chosen = spark.createDataFrame([("d/D1",), ("d/D7",)], "path string")
    assert {(x.a, x.b): (x.relation, x.pair) for x in S.scope_pairs(d, chosen).collect()} == {k: v for k, v in all_.items() if {"D1", "D7"} & set(k)}


@pytest.mark.parametrize("bits", [1, 8, 10, 12, 14, 16])
def test_strips(spark, bits):
    r = np.random.default_rng(bits)
    rows, want = [], {}
    for k, (w, h) in enumerate([(1, 1), (7, 5), (3, 64), (64, 40), (13, 9)]):
        x = r.integers(0, 1 << bits, w * h)
        order = "II" if k % 2 else "MM"
        raw = x.astype({"II": "<u2", "MM": ">u2"}[order]).tobytes() if bits == 16 else x.astype("u1").tobytes() if bits == 8 else np.packbits((x[:, None] >> np.arange(bits - 1, -1, -1)) & 1).tobytes()
        rows.append((k, w, h, bits, order, bytearray(raw)))
        want[k] = x
    rows += [(90, 4, 0, bits, "II", bytearray(b"")), (91, 4, 4, bits, "II", None), (92, 8, 4, bits, "II", bytearray(b"\1" * bits))]  # no rows, no content, and one row of four
    df = spark.createDataFrame(rows, "path int, width int, height int, bits int, byte_order string, content binary").repartition(2)
    for most in (1 << 18, 16):
        got = {}
        for s in planes.unpacked(planes.strips(df, "path", most)).orderBy("path", "strip").collect():
            x = np.frombuffer(s.samples, "<u2")
            assert (s.n, s.low, s.high, s.total) == (len(x), x.min(), x.max(), x.sum())
            got.setdefault(s.path, []).append(x)
        assert set(got) == {*want, 92} and len(got[92][0]) == 8
        assert all(np.array_equal(np.concatenate(got[k]), x) for k, x in want.items())
        assert most > 16 or len(got[3]) > 1


def test_stream_reads_only_its_buckets(spark, tmp_path):
    source, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    schema = "m int, at timestamp"

    def run(rows, checkpoint, **more):
        spark.createDataFrame(rows, "m int, at string").selectExpr("m", "CAST(at AS TIMESTAMP) AS at").write.mode("append").parquet(source)
        q = sync.sync_stream(spark.readStream.schema(schema).parquet(source), "m", ledger, str(tmp_path / checkpoint), buckets=8, **more)
        q.awaitTermination()
        assert q.exception() is None

    timed = {"event_time": "at", "delay": "10 minutes"}
    run([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:01:00"), (2, "2024-01-01 00:01:30")], "c", **timed)
    run([(1, "2024-01-01 00:02:00"), (3, "2024-01-01 05:00:00")], "c", **timed)  # a restart with the same checkpoint; 1 comes again
    run([(4, "2024-01-01 00:00:30"), (1, "2024-01-01 06:00:00"), (None, "2024-01-01 06:00:00")], "c", **timed)  # 4 is late, 1 is past its state
    assert sorted((r.m for r in spark.read.parquet(ledger).collect()), key=str) == [1, 2, 3, None]
    run([(2, "2024-01-01 07:00:00"), (5, "2024-01-01 07:00:00")], "new")  # another checkpoint reads all again, without a watermark
    assert sorted((r.m for r in spark.read.parquet(ledger).collect()), key=str) == [1, 2, 3, 4, 5, None]
    batch = spark.createDataFrame([(1,)], "m int")
    plan = sync.known(batch, "m", ledger, 8)
    assert "bucket" in plan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
    assert {r.b for r in plan.select(sync.bucket_of("_known", 8).alias("b")).distinct().collect()} == {batch.select(sync.bucket_of("m", 8).alias("b")).first().b}
