import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.operators import ledger as L
from quarry.operators import reports as P
from quarry.plans import catalog
from quarry.sources import encode as E
from quarry.sources import frontmatter as M
from quarry.sources import records as R
from quarry.sources.container import containers, sensors, walk

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    a, b = catalog.queries()[name](spark, DIR).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)


@pytest.mark.parametrize("order", "<>")
def test_every_prefix_and_byte_returns(order):
    good = E.container(order, 8, {8: (E.plane(order), 0)})
    for n in range(len(good)):
        walk(good[:n])
        for x in (0, 1, 127, 128, 255):
            walk(good[:n] + bytes([x]) + good[n + 1 :])


def test_hostile_shapes(spark):
    o = "<"
    rows = {
        "ok": E.container(o, 8, {8: (E.plane(o), 0)}), "empty": b"", "none": E.container(o, 0, {}),
        "self": E.container(o, 8, {8: ([E.pointer(o, 330, 4, 1, 8)], 0)}),
        "overflow": E.container(o, 8, {8: (E.plane(o, more=[E.pointer(o, 273, 4, 0xFFFFFFFF, 64)]), 0)}),
        "past": E.container(o, 0xFFFF0000, {}),
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows.items()] + [("null", None)], "path string, content binary")
    got = {r.path: r.fault for r in sensors(containers(df)).collect()}
    assert got == {"ok": None, "empty": "Truncated", "null": "Truncated", "none": "NoSensorIfd", "self": "CyclicIfd", "overflow": "TagTooLarge", "past": "Truncated"}


def test_front_matter(spark, tmp_path):
    (tmp_path / "done").mkdir()
    (tmp_path / "SPEC-001.md").write_text("---\ntask:\n  id: SPEC-001\n  cycle: build\ncost:\n  sessions:\n    - {tokens_total: 10, notes: 'a # b'}\n    - {tokens_total: 12k}\n    - {tokens_total: null, tokens_input: 5}\n---\n## Stage Plan\n- [x] one\n- [ ] two\n## Next\n- three\n")
    (tmp_path / "done" / "SPEC-002.md").write_text("---\ntask: {id: SPEC-002}\n---\n")
    (tmp_path / "SPEC-001-timeline.md").write_text("---\ntask: {id: no}\n---\n")
    files = M.scan(spark, str(tmp_path), "SPEC-*.md")
    got = {r.id: (r.shipped, r.tokens) for r in R.specs(files).select("id", "shipped", P.tokens_of(F.col("sessions")).alias("tokens")).collect()}
    assert got == {"SPEC-001": (False, 15), "SPEC-002": (True, 0)}
    assert [(r.checked, r.title) for r in R.stage_plan(R.numbered_lines(files)).orderBy("place").collect()] == [(True, "one"), (False, "two")]
    assert M.scan(spark, str(tmp_path), "SPEC-*.md", active=True).count() == 1
    assert all(r.mtime is not None and r.mtime.year > 2000 for r in files.collect())


def test_sync_is_idempotent(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "m int"), spark.createDataFrame([(2,), (3,), (3,)], "m int")
    once = L.sync_once(a, b, "m")
    assert sorted(r.m for r in L.sync_once(once, b, "m").collect()) == [1, 2, 3]
    assert not L.differs(once, L.sync_once(a, b, "m")) and L.differs(a, b)
