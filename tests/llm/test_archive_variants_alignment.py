"""The archive, the spelling variants and the alignment against versions written out by brute force."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quarry.llm import alignment, variants, warc  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BIG = "é" * 600
PAGES = [(1, "http://a/", BIG), (2, "http://b/", BIG), (3, None, BIG), (4, "x\r\nWARC-Type: evil", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", BIG), (8, "u", "a\r\n\r\nWARC/1.1\r\nb" * 100), (9, "u", "a\r\n\r\nWARC/1.1\r\nb" * 100), (9, "u", "a\r\n\r\nWARC/1.1\r\nb" * 100)]
PAGE = "page_id long, url string, html string, digest string, payload string"


def pages(spark):
    return spark.createDataFrame([(*x, "clash", "clash") for x in PAGES], PAGE).repartition(3)


def test_archive(spark, tmp_path):
    pages(spark).drop("digest", "payload").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = warc.op11_warc_archive(spark, str(tmp_path))
    want = con.sql(f"select {','.join(got.columns)} from ({warc.op11_sql()})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {r.page_id: r.refers_to for r in got.collect() if r.record_type == "revisit"} == {1: 3, 2: 3, None: 3, 8: 9}


def test_archive_round_trip(spark, tmp_path):
    folder, files = str(tmp_path / "a"), str(tmp_path / "w")
    warc.archive(pages(spark), folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4  # each payload once
    found = warc.records(spark, folder)
    assert found.filter("fault IS NOT NULL").count() == 0
    assert {(r.page_id, bytes(r.payload).decode()) for r in found.collect()} == {(i, h or "") for i, _, h in PAGES}
    assert {r.target for r in found.filter("page_id = 4").collect()} == {"x WARC-Type: evil"}
    warc.export(found, files, 3)
    back = sorted((r.header, bytes(r.payload)) for r in warc.load(spark, files).collect())
    assert back == sorted((r.header, b"" if r.record_type == "revisit" else bytes(r.payload)) for r in found.collect())


def test_archive_finds_faults(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.archive(pages(spark), folder)
    bad = spark.read.parquet(f"{folder}/payloads").selectExpr("digest", "CASE WHEN length(payload) = 5 THEN CAST('shirt' AS BINARY) ELSE payload END AS payload").filter("length(payload) <> 0")
    rows = bad.collect()
    spark.createDataFrame(rows, bad.schema).write.mode("overwrite").parquet(f"{folder}/payloads")
    faults = {r.page_id if r.page_id else str(r.header)[:0]: r.fault for r in warc.records(spark, folder).collect()}
    assert faults[6] == faults[7] == "payload differs from its digest" and faults[4] == faults[5] == "no payload" and faults[1] is None


def test_archive_of_nothing(spark, tmp_path):
    warc.archive(pages(spark).limit(0), str(tmp_path / "a"))
    assert warc.records(spark, str(tmp_path / "a")).count() == 0


def variants_by_pairs(rows):
    count = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def close(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in words if close(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items()}


def test_variants(spark):
    r = random.Random(7)
    base = ["aaaaa", "aaaaaa", "aaaab", "baaaa", "straße", "strasse", "ÉTÉÉTÉ", "colour", "color", "colours", "kolour", "theatre", "theater", "mississippi", "missisippi", "abcde", "abcdef", "abcdeg", "abde", "bcdef", "naïveté", "naiveté"]
    words = base + ["".join(r.choice("ab") for _ in range(r.randrange(5, 8))) for _ in range(60)]
    rows = [(i if i % 9 else None, " ".join(r.choice(words).title() if r.random() < 0.2 else r.choice(words) for _ in range(60)) + r.choice([".", "1", "×", " ¿x"])) for i in range(80)] + [(3, None), (4, ""), (5, "one two")]
    rows += [(i, "color " * (i + 3)) for i in range(20)] + [(7, "colour " * 20)] * 3
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, n long, word string").repartition(3)
    got = {x.word: (x.n, x.n_near, x.form, x.form_n, x.root) for x in variants.spelling_variants(df).collect()}
    want = variants_by_pairs(rows)
    assert got == want and sum(x[2] is not None for x in want.values()) > 5
    assert variants.spelling_variants(df.limit(0)).count() == 0


def test_light_subtrees_are_few(spark):
    """A word is light at no more branching nodes than the logarithm of the number of words, and once where it ends."""
    words = [(f"{i:010b}".replace("0", "a").replace("1", "b"), 3) for i in range(1024)] + [("aaaaaaaaaa" + "a" * i, 3) for i in range(1, 40)]
    light = variants.light_words(spark.createDataFrame(words, "word string, n long")).filter("c <> ''").groupBy("word").count()
    assert light.agg({"count": "max"}).first()[0] <= 11


def test_roots_of_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(50)]
    assert {(r.word, r.root) for r in variants.rooted(spark.createDataFrame(chain, "word string, form string")).collect()} == {(f"w{i}", "w50") for i in range(50)}


def aligned_by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_level(A)
    first.encode_special_tokens = True

    def groups(text):
        if not text:
            return None
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        ta = [table[i] for i in a]
        tb = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(ta) == (" " + text).encode() == b"".join(tb):
            return None
        ea, eb = ([int(x) for x in np.cumsum([len(x) for x in t])] for t in (ta, tb))
        out, i, j = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            x, y = ea.index(cut) + 1, eb.index(cut) + 1
            out.append((a[i:x], b[j:y]))
            i, j = x, y
        return out

    all_ = [groups(t) for t in rows]
    count = collections.Counter()
    for g in all_:
        count.update({(x, y) for a, b in g or () for x in a for y in b})
    most = collections.Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for g in all_:
        links = [(x, y) for a, b in g or () for x in a for y in b]
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or ())
        out.append((sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(told.encode()).hexdigest() if g else ""))
    return out


TEXTS = ["", None, "one", "one", " a  b", "x▁y and more", "  lead\n\n new", "\U0001f389\U0001f389 <|endoftext|> <s> <unk>", "a  b c　 d", "aaaa" * 50 + " 日本語テキスト", "\x00 a\r\n;\r b\t", "don't stop. can't", "▁", " ", "naïve façade " * 30, "x" * 3000, "the same words again and again the same words"]


@pytest.mark.parametrize("size", [1 << 22, 64])
def test_alignment(spark, monkeypatch, size):
    monkeypatch.setattr(alignment, "BLOCK", size)
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, a long, chunk string").repartition(3)
    got = {r.doc_id: tuple(r[n] for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in alignment.align(df, A, B).collect()}
    assert [got[i] for i in range(len(TEXTS))] == aligned_by_hand(TEXTS)


def test_alignment_of_untidy_rows(spark):
    rows = [(None, "one two"), (None, "one two"), (1, "one"), (1, "two"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, aligned_by_hand([t for _, t in rows])))
    got = alignment.align(df, A, B)
    assert sorted(str(tuple(r[n] for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in got.collect()) == want
    assert alignment.align(df.limit(0), A, B).count() == 0


def test_long_groups_are_summed_before_pairs_are_made(monkeypatch):
    """Groups of many tokens: links are products of the counts of equal ids, whatever the slice."""
    r = np.random.default_rng(3)
    group_a, group_b = np.sort(r.integers(0, 4, 300)), np.sort(r.integers(0, 4, 200))
    a, b, of = r.integers(0, 9, 300), r.integers(0, 30, 200), np.array([0, 0, 1, 2])
    want = collections.Counter((int(of[g]), int(x), int(y)) for g, x in zip(group_a, a, strict=True) for h, y in zip(group_b, b, strict=True) if g == h)
    for size in (1 << 22, 50, 7):
        monkeypatch.setattr(alignment, "SLICE", size)
        keys, n = alignment.linked(group_a, a, group_b, b, of)
        assert {(k >> 40, k >> 20 & (1 << 20) - 1, k & (1 << 20) - 1): v for k, v in zip(keys.tolist(), n.tolist(), strict=True)} == want
