"""The stages of the pipeline, each against brute force on its own input, with nulls, repeated rows and an empty table."""

from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quarry.llm.common import read  # noqa: E402

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with null columns, repeated rows, null ids and empty texts."""
    some = read(spark, SF, "documents")
    odd = spark.createDataFrame([(None, "no id at all", "en", "src0", 12), (None, None, None, None, None), (10**6, "", None, "src1", 0), (10**6 + 1, "a b c d e f g", "en", None, 13)], some.schema)
    return some.union(odd).union(some.filter("doc_id IN (1, 4)")).repartition(3)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_names_and_order():
    assert list(STAGES) == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing sources to target weights", "best-fit packing"]


def test_quality_stage(spark, docs):
    from quarry.llm.quality import quality_scores

    got = STAGES["quality classifier"](spark, docs, SF)
    good = {r.doc_id for r in quality_scores(docs, read(spark, SF, "labels")).collect() if r.predicted}
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert {r[0] for r in rows_of(got)} <= good and rows_of(got) == [r for r in rows_of(docs) if r[0] in good or r[0] is None and r in rows_of(got)]
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    assert all(labels.get(d, 1) == 1 for d in {r[0] for r in rows_of(got)})


def test_jaccard_stage(spark, docs):
    from tests.llm.test_operators import components_by_pairs

    known = docs.filter("doc_id IS NOT NULL")
    got = STAGES["n-gram Jaccard join"](spark, known, SF)
    rows = {d: t or "" for d, t in rows_of(known)}
    stay = [d for d, (_, c) in components_by_pairs(list(rows.items())).items() if c == d]
    assert got.columns == list(corpus_pipeline.COLUMNS) and sorted(r.doc_id for r in got.collect()) == sorted(stay)
    assert STAGES["n-gram Jaccard join"](spark, docs, SF).filter("doc_id IS NULL").count() == 2


def test_substring_stage(spark, docs):
    known = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    seen, want = set(), []
    for d, t in sorted(((r.doc_id, r.text or "") for r in known.collect())):
        words = t.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            if (key := tuple(words[i : i + 20])) in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        want.append((d, b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    got = STAGES["substring dedup"](spark, known, SF)
    assert got.columns == list(corpus_pipeline.COLUMNS) and rows_of(got) == sorted(want, key=str)
    assert STAGES["substring dedup"](spark, docs, SF).count() == docs.count()


def test_mixing_stage(spark, docs):
    from quarry.llm.mixing import mix_sources

    got = STAGES["mixing sources to target weights"](spark, docs, SF)
    drawn = mix_sources(docs).collect()
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert rows_of(got) == sorted(((r.doc_id, r.text) for r in drawn if r.kept), key=str) and 0 < got.count() < docs.count()


def test_packing_stage(spark, docs):
    got, bins = defaultdict(int), defaultdict(list)
    out = STAGES["best-fit packing"](spark, docs, SF).collect()
    for r in out:
        got[r.doc_id] += r.piece == 0
        bins[r.sequence_id].append((r.offset, r.length))
    assert sum(got.values()) == docs.count()
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_tables(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
