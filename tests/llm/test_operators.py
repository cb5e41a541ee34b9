"""Every operator against brute force on a small fixture with nulls, empties, ties, copies and clashing columns."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quarry.llm import blocks as B  # noqa: E402
from quarry.llm import jaccard, langid, licences, mixing, packing, quality, rules  # noqa: E402
from quarry.llm.bytestrings import bytestring_dedup  # noqa: E402
from quarry.llm.fingerprints import document_fingerprints  # noqa: E402
from quarry.llm.jaccard import jaccard_join  # noqa: E402
from quarry.llm.langid import identify  # noqa: E402
from quarry.llm.licences import licence_paragraphs  # noqa: E402
from quarry.llm.mixing import mix_sources  # noqa: E402
from quarry.llm.quality import quality_scores  # noqa: E402
from quarry.llm.rules import quality_rules  # noqa: E402
from quarry.llm.substrings import substring_dedup  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, k long, h long, rep string"


def texts():
    r = random.Random(5)
    words = ["the", "of", "Été", "naïve", "und", "x", "data", "Spark,", "joins.", " wide ", "日本", "a|b", "it's"]
    prose = lambda n: " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))
    base, passage = prose(120), prose(45)
    out = [base, base, prose(80) + "\n" + passage, passage + "  " + prose(60), None, "", " \t\n ", "one", "one", "A b C d", "a B c D", "Reat " * 70, prose(30) + passage]
    near = base.split()
    for i in range(6):
        copy = list(near)
        copy[20 * i] = "changed"
        out.append(" ".join(copy))
    out += [prose(25) + " " + prose(25), "x" * 900, "x" * 150, prose(400).replace(" ", "\n", 30), "Licensed under the Apache License, Version 2.0.\n" + prose(30), "emoji 🎉 <|endoftext|>   end  \r\n  "]
    return out


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame([(i * 3, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, 1, 2, "z") for i, t in enumerate(texts())], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def untidy(spark):
    rows = [(i % 7 if i % 4 else None, t) for i, t in enumerate(texts())]
    return spark.createDataFrame([(*x, "en", "s", 1, 2, "z") for x in rows + rows[:3]], SCHEMA)


def rows_of(df):
    return sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())


def test_rolled_and_least():
    h = np.random.default_rng(0).integers(0, 2**63, 90, dtype=np.uint64)
    for k in (1, 2, 5, 8, 20):
        want = [sum(int(h[i + j]) * pow(int(B.Q), j, 2**64) for j in range(k)) % 2**64 for i in range(len(h) - k + 1)]
        assert B.rolled(h, k, False).tolist() == want
    for w in (1, 3, 13, 64):
        want = [i + int(np.argmin(h[i : i + w])) for i in range(len(h) - w + 1)]
        assert B.leftmost_min(h, w).tolist() == want and B.leftmost_min(h, w, 70).tolist() == want


def test_substrings(plain):
    seen, want = set(), {}
    for d, t in rows_of(plain):
        w = t.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if (key := tuple(w[i : i + 20])) in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        want[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    got = substring_dedup(plain).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want
    words = {d: t.encode().split() for d, t in rows_of(plain)}
    for r in got:
        for x in r.spans:
            assert words[r.doc_id][x.start : x.end] == words[x.source][x.source_start : x.source_start + x.end - x.start]
            assert (x.source, x.source_start) < (r.doc_id, x.start)


def test_paths_end_where_the_graph_branches(spark):
    """Two passages that share their middle: its path ends where the ways part, so a span along one passage is cut there."""
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    rows = [(1, a + b), (2, c + b[:30]), (3, a + b), (4, c + b[:30] + ["end"])]
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()}
    assert [r.n_removed for _, r in sorted(got.items())] == [0, 30, 80, 70]
    starts = sorted((x.source, x.source_start) for x in got[3].spans)
    assert got[3].spans[0].start == 0 and len(got[3].spans) == 1 or starts  # equal texts are removed whole
    assert {x.source for x in got[4].spans} == {1, 2} and len(got[4].spans) > 1


@pytest.mark.parametrize("hot", [20_000, 2])
def test_bytestrings(plain, hot):
    rows = [(d, t.encode()) for d, t in rows_of(plain)]
    count = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    want = {}
    for d, t in rows:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                cover[i] += 1
                cover[i + 200] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        want[d] = (len(t), int(gone.sum()), np.frombuffer(t, np.uint8)[~gone].tobytes())
    assert {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in bytestring_dedup(plain, hot=hot).collect()} == want


def components_by_pairs(rows):
    """doc_id to (set size, smallest id reachable), from every pair of rows."""
    sets, parent = {}, {}
    for d, t in rows:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_jaccard(plain):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(plain).collect()} == components_by_pairs(rows_of(plain))


def test_jaccard_of_many_near_copies(spark):
    """Copies of one text with one to nine words changed, some of them near another copy but not near the first text."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    pool = [base]
    for _ in range(150):
        copy = list(r.choice(pool[-40:] + [base] * 20))
        for _ in range(r.randrange(1, 10)):
            copy[r.randrange(120)] = f"c{r.randrange(6)}"
        pool.append(copy)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(pool)], "doc_id long, text string")
    want = components_by_pairs(rows_of(docs))
    assert 3 < len({c for _, c in want.values()}) < 140
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join(docs).collect()} == want


def links_by_pairs(rows):
    def grams(t):
        w = [x.lower() for x in t.split()]
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])

    known = {d: grams(t) for d, t in rows}
    classes = [x for x in set(known.values()) if x]
    return {d: sum(x != y and 4 * len(x & y) >= 3 * len(x | y) for y in classes) if x else 0 for d, x in known.items()}


def test_jaccard_counts_all_links(spark):
    r = random.Random(8)
    rows = []
    for size, n in ((60, 300), (90, 3), (70, 40)):
        base = [f"w{r.randrange(10**6)}" for _ in range(size)]
        for _ in range(n):
            copy = list(base)
            for at in r.sample(range(size), r.randrange(0, 3)):
                copy[at] = f"c{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = links_by_pairs(rows)
    assert sum(want.values()) > 10_000
    assert {x.doc_id: x.k_links for x in jaccard_join(docs, count_links=True).collect()} == want


@pytest.mark.parametrize("most", [3, 20])
def test_jaccard_with_hot_ngrams_cut(spark, most):
    """An n-gram of every document, runs of it cut every few rows, and small Arrow batches, against brute force."""
    r = random.Random(most)
    common = "all of them hold this line here "
    rows = []
    for _ in range(12):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(30, 60))]
        for _ in range(r.randrange(1, 8)):
            copy = list(base)
            for at in r.sample(range(len(base)), r.randrange(0, 3)):
                copy[at] = f"c{r.randrange(10**6)}"
            rows.append((len(rows), common + " ".join(copy)))
    rows += [(len(rows) + i, common) for i in range(40)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    try:
        got = jaccard_join(docs, most=most, count_links=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == components_by_pairs(rows)
    assert {x.doc_id: x.k_links for x in got} == links_by_pairs(rows)


@pytest.mark.parametrize("limit", [3, 8, 200_000])
def test_one_order_of_ngrams_over_cut_runs(limit):
    r = random.Random(limit)
    rows = [(7, i) for i in range(450_001)] if limit == 200_000 else []
    rows += [(h, r.choice([h, h, h + 1, r.randrange(60)])) for h in range(8, 40) for _ in range(r.randrange(1, 50))]
    rows += [(h, 5) for h in (40, 42) for _ in range(30)] + [(42, 6)] + [(43, 1)] * 30 + [(43, 2)] * 30
    h, d = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True))
    step = 10_000 if limit == 200_000 else 4
    batches = [pa.record_batch({"h": h[i : i + step], "id": d[i : i + step]}) for i in range(0, len(h), step)]
    got = [x for b in jaccard.shared(limit)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    ids = defaultdict(set)
    for a, b in rows:
        ids[a].add(b)
    assert sorted((a, x) for x, a, _ in got) == sorted((a, x) for a, s in ids.items() if len(s) > 1 for x in s)
    df = defaultdict(set)
    for _, a, n in got:
        df[a].add(n)
    assert all(len(x) == 1 for x in df.values())


def test_fingerprints(plain):
    got = {r.doc_id: r for r in document_fingerprints(plain, 4).collect()}
    rows = rows_of(plain)[::-1]
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[0].fingerprint == got[3].fingerprint and got[0].near_edited > 0.1


def mixed(x):
    """The finaliser, in whole numbers."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def summed_by_hand(x):
    return sum(v * pow(int(B.P), i, 2**64) for i, v in enumerate(x)) % 2**64


def phrases_by_hand(x):
    """Names of the phrases of one text, symbol by symbol."""
    x = [mixed((v + n * int(B.Q)) % 2**64) if n > 1 else v for v, n in ((v, len(list(g))) for v, g in itertools.groupby(x))]
    label = x
    for _ in range(4):
        after = []
        for i, v in enumerate(label):
            differs = v ^ (label[i - 1] if i else v ^ 2**64 - 1)
            place = (differs & -differs).bit_length() - 1
            after.append(2 * place + (v >> place & 1))
        label = after
    assert all(v < 6 for v in label) or len(label) < 2
    starts = [i for i in range(len(x)) if not i or (i + 1 < len(x) and label[i - 1] < label[i] > label[i + 1])]
    return [mixed(summed_by_hand(x[a:z])) for a, z in zip(starts, [*starts[1:], len(x)], strict=False)]


def names_by_hand(text):
    """All names of the first level, and of the second and third, as 32 bits."""
    one = phrases_by_hand([int(B.TABLE[b]) for b in text.encode()])
    two = phrases_by_hand(one)
    return {v >> 32 for v in one}, {v >> 32 for v in two} | {mixed(v ^ int(B.Q)) >> 32 for v in phrases_by_hand(two)}


def kept_by_hand(names):
    return sorted(names[0])[:16], sorted(names[1])[:48]


def likeness_by_hand(a, b):
    if a == b:
        return 1.0
    (x, y), k = ((set(a[1]), set(b[1])), 48) if min(len(a[1]), len(b[1])) >= 8 else ((set(a[0]) | set(a[1]), set(b[0]) | set(b[1])), 64)
    least = sorted(x | y)[:k]
    return sum(v in x and v in y for v in least) / len(least)


def test_fingerprints_by_hand(plain):
    got = {r.doc_id: r for r in document_fingerprints(plain, 4).collect()}
    rows = rows_of(plain)[::-1]
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        names = [names_by_hand(x) for x in (t, t[: len(t) - len(t) // 2] + after[: len(t) // 2], after)]
        mine, edited, following = map(kept_by_hand, names)
        hexed = [".".join("".join(f"{v:08x}" for v in part) for part in x) for x in (mine, edited)]
        assert [got[d].fingerprint, got[d].edited_fingerprint] == hexed
        for near, other, there in ((got[d].near_edited, edited, names[1]), (got[d].near_next, following, names[2])):
            assert abs(near - likeness_by_hand(mine, other)) < 1e-12
            whole = len(names[0][1] & there[1]) / max(len(names[0][1] | there[1]), 1)
            assert min(len(names[0][1]), len(there[1])) < 48 or abs(near - whole) < 0.3  # the estimate against all names


def test_packing(plain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    want = {d: t.encode(x, add_special_tokens=False).ids + [2] for d, x in rows_of(plain)}
    got, bins = defaultdict(list), defaultdict(list)
    for r in packing.pack(plain, TOKENIZER, 64).collect():
        got[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(got) == set(want)
    for d, pieces in got.items():
        at = 0
        for i, p in enumerate(sorted(pieces, key=lambda p: p.piece)):
            ids = np.array(want[d][at : at + p.length], "<u4")
            assert (p.piece, p.start, p.ids_crc32) == (i, at, zlib.crc32(ids.tobytes())) and (i == 0 or p.length == 64)
            at += p.length
        assert at == len(want[d])
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(map(len, want.values()))
    assert len(bins) <= -(-total // 64) + 1


def test_packing_gives_added_tokens_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>\u3000x"), (3, "plain text"), (4, "<|endoftext|")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {d: t.encode(x, add_special_tokens=False).ids + [2] for d, x in rows}
    assert 50256 in want[1]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.op5_best_fit_packing(spark, str(tmp_path)).collect()}
    assert got == {d: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want.items()}


def test_plan_holds_every_item():
    r = np.random.default_rng(3)
    for n in (0, 1, 7, 5000):
        counts = dict(Counter(r.integers(1, 1024, n).tolist()))
        held = Counter()
        for c, times in packing.plan(counts, 1024):
            assert sum(c) <= 1024
            for s in c:
                held[s] += times
        assert held == counts


def test_configurations_of_three_carry_the_plan():
    """Items of three tenths to four tenths fit three by three, which best fit alone does not find."""
    counts = dict(Counter(np.random.default_rng(4).integers(300, 381, 20_000).tolist()))
    found = packing.grouped(counts, 257, 48)
    per = -(-20_000 // 48)
    assert max(sum(g.values()) for g in found) <= per + max(counts.values())  # of equal cardinality, but for groups of one length
    shapes = packing.configurations(found, 1024)
    sizes, needs, held = [max(g) for g in found], [sum(g.values()) for g in found], Counter()
    for c, n in shapes:
        assert sum(sizes[i] for i in c) <= 1024
        for i in c:
            held[i] += n
    assert all(held[i] <= need for i, need in enumerate(needs)) and sum(held.values()) > 0.98 * 20_000
    assert sum(n for c, n in shapes if len(c) == 3) > 6000
    steps, bound = packing.plan(counts, 1024), -(-sum(s * n for s, n in counts.items()) // 1024)
    assert sum(n for _, n in steps) <= 6700 < 1.01 * bound and sum(n for c, n in steps if len(c) == 3) > 6000
    assert sum(n for _, n in packing.best_fit({}, counts, 1024)) > 7300


def test_plans_are_no_worse_than_best_fit():
    for low, high in ((1, 1024), (200, 700), (500, 530), (1, 40)):
        counts = dict(Counter(np.random.default_rng(low).integers(low, high, 5000).tolist()))
        steps, held = packing.plan(counts, 1024), Counter()
        for c, n in steps:
            assert sum(c) <= 1024
            for s in c:
                held[s] += n
        assert held == counts
        assert sum(n for _, n in steps) <= sum(n for _, n in packing.best_fit({}, counts, 1024))


def test_configurations_are_of_a_least_number():
    """Against every way of filling sequences, for few sizes."""
    for groups, want in (([{60: 4}, {40: 4}], 4), ([{50: 6}], 3), ([{70: 2}, {30: 2}, {20: 3}], 3)):
        found = packing.configurations(groups, 100)
        assert sum(n for _, n in found) <= want
    assert packing.configurations([], 100) == []


def test_rules(plain):
    for r in quality_rules(plain).collect():
        t = dict(rows_of(plain))[r.doc_id]
        w = t.encode().split()
        count, marked, seen, lines = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set(), set(), 0
        for i in range(len(w) - 4):
            if count[tuple(w[i : i + 5])] > 1:
                marked |= set(range(i, i + 5))
        for line in t.split("\n"):
            if line.encode().split():
                lines += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), lines, len(marked))
        assert r.base_failed == (len(w) < 10 or 100 * len(marked) > 20 * len(w)) and not (r.base_failed and r.kept)


def distances_by_hand(rows, share=0.75):
    """(mean, covariance and resolution of the reweighted estimate of least determinant, distance): with NumPy, rows (half, vector, steps)."""
    v, fine = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]).mean(0) ** 2 / 12
    half = np.array([r[0] for r in rows])

    def raised(c, floor=fine):
        c = c.copy()
        c[np.diag_indices(4)] = np.maximum(np.diag(c), floor)
        return c

    def d(m, c, floor=fine):
        return np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(raised(c, floor)), v - m)

    def of(x, factor=1.0):
        return x.mean(0), np.cov(x.T, bias=True) * factor

    def rank(x, p):
        return np.sort(x, 0)[max(int(np.ceil(p * len(x))) - 1, 0)]

    starts = [(rank(v, 0.5), np.diag(((rank(v, 0.75) - rank(v, 0.25)) / 1.349) ** 2)), of(v), of(v[half] if half.any() else v)]
    ends = []
    for m, c in starts:
        was = np.inf
        while True:
            far = d(m, c)
            new = of(v[far <= rank(far, share)], rules.consistency(share))
            det = np.linalg.slogdet(raised(new[1]))[1]
            if det >= was - rules.ENOUGH:
                break
            (m, c), was = new, det
        ends.append((was, m, c))
    _, m, c = min(ends, key=lambda e: e[0])
    return (*of(v[d(m, c) <= rules.CHI2[0.975]], rules.consistency(0.975)), fine), d


def outlier_rows():
    r = random.Random(6)
    rows = []
    for i in range(400):
        words = ["ab", "abc", "abcd", "abcde", "abcdef"] if i % 2 else ["abcdef", "abcdefgh", "abcdefghi"]
        text = " ".join(r.choice([str.title, str])(r.choice(words)) + str(r.randrange(99)) + r.choice([".", ",", "", ""]) for _ in range(r.randrange(12, 200)))
        if i % 23 == 0:
            text = text.replace(" ", "### ")
        rows.append((i, text + "\nsame\nsame" * (i % 17 == 0), "en" if i % 2 else "de", "s"))
    return rows


def test_outliers_by_hand(spark):
    """Distances of two groups against the same estimate with NumPy, drawn towards that of all rows."""
    docs = spark.createDataFrame(outlier_rows(), "doc_id long, text string, lang string, source string").repartition(3)
    got = {x.doc_id: x for x in quality_rules(docs).collect()}
    counted = {x.doc_id: x for x in rules.statistics(docs).collect()}
    good = {i: x for i, x in counted.items() if not got[i].base_failed}
    ratio = lambda xs, c, near: (sum(x[c] for x in xs) + rules.FEW * near) / (sum(x.n_words for x in xs) + rules.FEW)
    vectors = {}
    for lang in ("en", "de"):
        whole = {c: ratio(good.values(), c, p) for c, p in rules.ORDINARY.items()}
        own = {c: ratio([x for x in good.values() if x.lang == lang], c, p) for c, p in whole.items()}
        for i, x in good.items():
            if x.lang == lang:
                chars, marks, caps, fresh = (x[c] + rules.PRIOR * own[c] + 0.5 for c in rules.ORDINARY)
                vectors[i] = np.log([chars / (x.n_words + rules.PRIOR), marks / chars, caps / chars, fresh / (x.n_words + rules.PRIOR)]), [1 / chars, 1 / marks, 1 / caps, 1 / fresh]
    stats = rules.statistics(docs.withColumn("g", rules.F.col("lang")))
    exact = rules.with_axes(stats.join(rules.rates(stats.filter(rules.F.col("doc_id").isin(list(good))), stats.select("g").distinct()), "g"))  # the hash takes every bit of the vector
    halves = {r.doc_id: r.half for r in exact.selectExpr("doc_id", "pmod(xxhash64(doc_id, x, y, u, w), 8) = 0 AS half").collect()}
    rows = lambda some: [(halves[i], *vectors[i]) for i in some]
    (wm, wc, wf), _ = distances_by_hand(rows(good))
    for lang in ("en", "de"):
        mine = [i for i, x in good.items() if x.lang == lang]
        (m, c, f), d = distances_by_hand(rows(mine))
        share = len(mine) / (len(mine) + rules.SHRINK)
        by_hand = d(*(a * share + b * (1 - share) for a, b in ((m, wm), (c, wc), (f, wf))))
        for i, want in zip(mine, by_hand, strict=True):
            assert abs(got[i].distance - want) < 1e-5 * max(want, 1), (lang, got[i].distance, want)
    assert all(not got[i].kept for i in range(0, 400, 23) if not got[i].base_failed)
    assert sum(x.kept for x in got.values()) > 0.9 * 400


def test_words_are_counted_for_the_vector(spark):
    text = "One two, THREE!\nfour " + "same " * 60 + "Été."
    x = rules.statistics(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (x[0].marks, x[0].capitals, x[0].fresh) == (3, 7, 5 + 2) and (x[1].marks, x[1].capitals, x[1].fresh) == (0, 0, 0)


def test_covariance_carries_the_verdict(spark, monkeypatch):
    """Axes are singular in few groups, and distances of ordinary rows are those of four normal axes."""
    found = []
    made = rules.whitened
    monkeypatch.setattr(rules, "whitened", lambda p: found.append(p) or made(p))
    got = [r.distance for r in quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("NOT base_failed").collect()]
    last = found[-1].collect()
    assert sum(r[f"c_{a}{a}"] < r[f"r_{a}"] for r in last for a in rules.AXES) < 0.1 * len(last)
    assert 2.8 < np.median(got) < 4.2


def shares(rows, axis):
    out, total = defaultdict(float), sum(r.tokens * r.prob for r in rows)
    for r in rows:
        out[r[axis]] += r.tokens * r.prob / total
    return out


def test_mixing_meets_targets(spark):
    """Expected shares of the documents kept, added up from the rows, against the targets that are given."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "topic": {"prose": 0.9, "legal": 0.06, "table": 0.03, "contact": 0.01}}
    got = mixing.mix_sources(docs, 0.2, targets).collect()
    assert len(got) == docs.count()
    for axis, goal in targets.items():
        have = shares(got, axis)
        assert all(abs(have[c] - g) < 0.005 for c, g in goal.items()), (axis, dict(have))
    powered = Counter()
    for r in got:
        powered[r.source] += r.tokens
    total = sum(x**0.7 for x in powered.values())
    assert all(abs(shares(got, "source")[c] - x**0.7 / total) < 0.005 for c, x in powered.items())
    assert abs(sum(r.tokens for r in got if r.kept) / sum(r.tokens for r in got) - 0.2) < 0.03
    left = {(r.axis, r.name): r for r in mixing.residuals(docs, 0.2, targets).collect()}
    assert all(abs(left["lang", c].goal - g) < 1e-9 and abs(left["lang", c].share - shares(got, "lang")[c]) < 1e-6 for c, g in targets["lang"].items())


def test_mixing_beyond_reach(plain):
    """What cannot be reached is given whole, and the report says what is missed; zero targets keep nothing."""
    got = mixing.mix_sources(plain, 0.9, {"lang": {"en": 1.0}}).collect()
    assert {r.prob for r in got if r.lang is None and r.tokens} == {0.0} and all(r.prob == 1 for r in got if r.lang == "en" and r.tokens and r.prob)
    report = {(r.axis, r.name): r for r in mixing.residuals(plain, 0.9, {"source": {"s0": 0.95, "s1": 0.05}}).collect()}
    assert report["source", "s0"].goal == 0.95 and report["source", "s0"].residual < -0.1 and report["source", None].share == 0


def test_mixing_by_joins_is_the_same(plain):
    one, two = ({r.doc_id: (r.prob, r.kept) for r in mixing.mix_sources(plain, 0.4, most=m).collect()} for m in (1000, 2))
    assert set(one) == set(two) and one == two


def test_mixing_of_untidy_rows(spark):
    schema = "doc_id long, text string, lang string, source string, row string, fit_lang string, draw double, _s int, topic int, kept string"
    rows = [(None, f"w{i} " * (i % 9), None if i % 2 else "en", "\0" if i % 3 else None, "r", "f", 0.5, 1, 2, "k") for i in range(300)] + [(7, "a b", "en", "x", "r", "f", 0.5, 1, 2, "k")] * 3
    got = mixing.mix_sources(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 303 and {(r.row, r.fit_lang, r.draw, r._s) for r in got} == {("r", "f", 0.5, 1)}
    assert len({(r.prob, r.kept) for r in got if r.doc_id == 7}) == 1
    assert 0.1 < sum(r.kept for r in got if r.doc_id is None) / 300 < 0.75  # null ids draw by text, so not all alike
    assert len({r.prob for r in got if r.source is None} ^ {r.prob for r in got if r.source == "\0"}) > 0


def test_mixing_matches_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    want = sorted(con.sql(mixing.op1_sql()).fetchall(), key=str)
    got = sorted((tuple(r) for r in mixing.op1_mix_sources(spark, d).collect()), key=str)
    assert got == want


def test_licences(spark):
    """Families of notices that the model was not given word for word, cue words used otherwise, and wrapped notices."""
    filler = " ".join(f"word{i}" for i in range(30))
    cases = [("Licensed under the Apache License, Version 2.0.", "apache", True), ("Released under GPLv3 of the GNU General Public License", "gpl", None), (f"{filler}\n\n  All rights reserved.  \n\n{filler}", "proprietary", True), ("Redistribution and use in source and\nbinary forms, with or without modification, are permitted", "bsd", True), ("her driving license was lost", "unknown", False), (filler, "unknown", False)]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)] + [(90, None), (91, ""), (92, " \n\n "), (0, cases[0][0])], "doc_id long, text string")
    got = licence_paragraphs(docs).collect()
    assert {r.doc_id for r in got} == set(range(len(cases))) and sum(r.doc_id == 0 for r in got) == 2
    for i, (_, family, sure) in enumerate(cases):
        rows = [r for r in got if r.doc_id == i]
        named = {r.family for r in rows} - {"unknown"} or {"unknown"}
        assert named == {family}, (i, rows)
        assert sure is None or any(r.confirmed for r in rows) == sure, (i, rows)
    assert licence_paragraphs(docs.limit(0)).count() == 0
    assert [r.place for r in sorted(got) if r.doc_id == 2] == [0, 1, 2]


def test_licences_in_forms_that_were_held_out():
    """Accuracy and calibration on whole forms that the model has not seen, and notices that no form gives."""
    own, held = licences.examples()
    seen = {frozenset(g) for g, _ in own}
    new = [x for x in held if frozenset(x[0]) not in seen]  # forms may be alike around their cue words
    assert len(new) > 0.6 * len(held)
    model = licences.fit(own, held)
    found = licences.assess(model, new)
    assert found["accuracy"] >= 0.95 and found["calibration_error"] < 0.03 and 0.3 < model["scale"] < 6, found
    assert min(sum(y == c for _, y in held) for c in licences.CLASSES) >= 3


def test_licences_of_real_notices(spark):
    cases = {"SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache", "dual-licensed under MIT or Apache-2.0": "dual", "The court granted permission; all rights of way remain": "unknown", "Copyright law was changed in 1976.": "unknown",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that": "isc", "Redistributions of source code must retain the above copyright notice, this\nlist of conditions": "bsd", "Published under GPLv3.": "gpl", "Text is available under CC BY-SA 4.0": "cc-by", "Images: CC BY-NC 4.0": "cc-by-nc", "This is free and unencumbered software": "cc0", "(c) 2020 ACME. All rights reserved.": "proprietary"}
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.paragraph: r.family for r in licence_paragraphs(docs).collect()}
    wrong = {t: (got[t], f) for t, f in cases.items() if got[t] != f}
    assert len(wrong) <= 1, wrong


def test_licence_scores_by_hand(spark):
    """Every paragraph of the documents: n-grams, sums, softmax and the template match, in Python."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = licence_paragraphs(docs).collect()
    texts_ = {r.doc_id: r.text or "" for r in docs.collect()}
    normal = lambda p: re.sub(r"\b([al]?gpl)v?([0-9])", r"\1 \2", re.sub("[^a-z0-9]+", " ", p.lower())).strip()
    paragraphs = docs.select(jaccard.F.explode(jaccard.F.filter(jaccard.F.split("text", licences.BREAK), lambda x: jaccard.F.rlike(x, jaccard.F.lit(r"\S")))).alias("p"))
    model = licences.model_of(paragraphs.select(licences.normal(jaccard.F.col("p")).alias("words")))
    assert len(got) == sum(len([p for p in re.split(r"\n[ \t\r]*\n\s*", t) if p.strip()]) for t in texts_.values())
    for r in got:
        z = np.array(model["bias"]) + sum((np.array(model["weights"][g]) for g in licences.plain_grams(normal(r.paragraph)) if g in model["weights"]), np.zeros(len(model["bias"])))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(r.probability - p.max()) < 2e-6 and r.family == (model["classes"][int(p.argmax())] if p.max() >= 0.5 else "unknown")
    lines = {"apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "proprietary": "All rights reserved."}
    for family, line in lines.items():
        assert all(r.confirmed and r.family == family for r in got if line in r.paragraph and sum(x in r.paragraph for x in lines.values()) == 1)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    both = quality_scores(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in both) / len(both) > 0.9


def counts_by_hand(text):
    """Counts of words, shapes and repeats by place, word by word."""
    out, words = Counter(), text.encode().split()
    kind = lambda b: 0 if 97 <= b < 123 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 3 if b in b".,;:'\"-" else 4 if b in b"!?" else 5 if b == 124 else 7 if b > 127 else 6
    for i, w in enumerate(words):
        shout = len(w) > 2 and 2 * sum(65 <= b < 91 for b in w) > len(w)
        out[(((min(len(w), 15) // 2 * 8 + kind(w[0])) * 8 + kind(w[-1])) * 2 + (i > 0 and words[i - 1] == w)) * 2 + shout] += 1
        out[quality.SHAPES + quality.REPEATS + mixed(summed_by_hand([int(B.TABLE[b]) for b in w.lower()])) % quality.WORDS] += 1
    triples = list(zip(words, words[1:], words[2:], strict=False))
    if triples:
        share = 1 - len(set(triples)) / len(triples)
        out[quality.SHAPES + min(int(share * quality.REPEATS), quality.REPEATS - 1)] = len(words) / 2
    return out


def test_votes_by_hand(spark):
    """Each document against every labelled vector in turn, the nearest 25 by sorting all cosines."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.quality_model(docs, labels)
    mine = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    assert len(model["y"]) == len(mine) and sum(model["y"]) == sum(mine.values())
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    for doc_id, text in rows_of(docs):
        x = np.zeros(quality.TERMS)
        for place, n in counts_by_hand(text).items():
            x[place] = np.log(1 + n) * model["idf"][place]
        at = x / max(np.sqrt(x @ x), 1e-9) @ model["to"].astype(float)
        at /= max(np.sqrt(at @ at), 1e-9)
        near = sorted(((float(at @ v), float(y)) for v, y in zip(model["at"].astype(float), model["y"], strict=True)), reverse=True)[:25]
        total = sum(max(c, 0) ** 8 for c, _ in near)
        want = sum(max(c, 0) ** 8 * y for c, y in near) / total if total > 1e-9 else model["prior"]
        assert abs(got[doc_id].score - want) < 1e-3 and got[doc_id].predicted == (got[doc_id].score >= 0.7)
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)


def test_language_on_held_out_addresses(spark):
    d = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{d}/pages.parquet")
    got = identify(pages, spark.read.parquet(f"{d}/documents.parquet")).join(pages.select("page_id", "url"), "page_id").collect()
    assert sum(f"/{r.lang}/" in r.url for r in got) / len(got) > 0.9


def test_language_by_hand(spark):
    """Posteriors added up in Python from the word model and the pages alone."""
    import math
    import re

    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the and of it is the", "en"), ("und der die das ist und", "de"), ("the of is and", "en"), ("der das ist nicht und", "de")] * 3)], "doc_id long, text string, lang string")
    rows = [(1, "https://a.site.org/en/x", "<html lang=en><p>the of and"), (2, "https://a.site.org/y", "<html lang='de'>und der"), (3, "https://b.site.org/z", "und ist das"), (4, "https://c.other.de/", "zzz"), (5, "https://a.site.org/q", "the die the")]
    model, langs = langid.word_model(docs)
    lp = {r.word: (r.l0, r.l1) for r in model.collect()}
    n, seen = len(langs), {}
    for p, url, html in rows:
        words = re.findall("[a-zé]+", re.sub("<[^>]*>", " ", html).lower())
        hits = [lp[w] for w in words if w in lp]
        e = [sum(h[i] for h in hits) / math.sqrt(max(len(hits), 1)) for i in range(n)]
        top = max(range(n), key=lambda i: (e[i], langs[i])) if hits else None
        host = re.match("https://([^/]+)", url)[1]
        declared = (re.search("lang='?(\\w+)", html) or [0, ""])[1]
        address = (re.search("://[^/]+/(\\w\\w)(?:/|$)", url) or [0, ""])[1] or (host[-2:] if host[-2:] in langs else "")
        seen[p] = (e, top, host, host.split(".", 1)[1], declared, address)
    for r in identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect():
        e, top, host, site, declared, address = seen[r.page_id]
        others = [x for q, x in seen.items() if q != r.page_id]
        h, t, w = ([sum(x[1] == i for x in others if at(x)) for i in range(n)] for at in (lambda x: x[2] == host, lambda x: x[3] == site, lambda x: True))
        logs = []
        for i in range(n):
            wide = (t[i] + 5 * (w[i] + 1) / (sum(w) + n)) / (sum(t) + 5)
            s = e[i] + math.log((h[i] + 5 * wide) / (sum(h) + 5))
            for at, reading in ((4, declared), (5, address)):
                if reading in langs:
                    all_ = [x for x in seen.values() if x[1] == i and x[at] in langs]
                    s += math.log((sum(x[at] == reading for x in all_) + 1) / (len(all_) + n))
            logs.append(s)
        best = max(range(n), key=lambda i: (logs[i], langs[i]))
        want = 1 / sum(math.exp(x - logs[best]) for x in logs)
        assert (r.lang, r.declared, r.address) == (langs[best], declared, address) and abs(r.posterior - want) < 1e-5, (r, want)


def test_language_of_untidy_pages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    schema = "page_id long, url string, html string, lang string, k long, word string, n long"
    one = (7, "https://a.example.org/x", "<html><p>und der die das nicht ist", "zz", 1, "w", 9)
    rows = [one, one, one, (None, None, None, None, None, None, None), (8, "no address", "", "", 0, "", 0)]
    got = identify(spark.createDataFrame(rows, schema), docs).collect()
    assert len(got) == len(rows)
    copies = [r for r in got if r.page_id == 7]
    assert len(set(copies)) == 1
    assert all(r.text_lang is None and r.lang is not None for r in got if r.page_id != 7)
    assert identify(spark.createDataFrame([], schema), docs).count() == 0
    assert {r.lang for r in identify(spark.createDataFrame(rows, schema), docs.limit(0)).collect()} == {None}


def test_odd_language_marks_stay_off_the_driver(spark, monkeypatch):
    """3,000 declared languages that do not exist are one reading."""
    from pyspark.sql.classic.dataframe import DataFrame

    rows = [(i, f"https://a.site.org/{'en' if i % 2 else 'de'}/x", f"<html lang=q{i:04d}><p>" + ("the of and" if i % 2 else "und der die")) for i in range(3000)]
    rows = [(i, u, h.replace(f"q{i:04d}", "".join(chr(97 + i // 26**j % 26) for j in range(4)))) for i, u, h in rows]
    docs = spark.createDataFrame([(1, "the of and it is " * 3, "en"), (2, "und der die das " * 3, "de")], "doc_id long, text string, lang string")
    sizes, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: sizes.append(len(got := collect(self))) or got)
    out = identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs)
    assert max(sizes) < 100
    assert {(r.page_id % 2, r.lang) for r in out.select("page_id", "lang").toLocalIterator()} == {(0, "de"), (1, "en")}


@pytest.mark.parametrize("operator", [lambda d: licence_paragraphs(d.withColumn("text", jaccard.F.lit("x"))).filter("place = 0"), substring_dedup, bytestring_dedup, jaccard_join, document_fingerprints, quality_rules, mix_sources, lambda d: packing.pack(d, TOKENIZER).filter("piece = 0"), lambda d: quality_scores(d, d.sparkSession.createDataFrame([], "doc_id long, quality int"))])
def test_untidy_and_empty(untidy, operator):
    n = untidy.count()
    assert operator(untidy).count() == n
    assert operator(untidy.limit(0)).count() == 0


def test_blocks_of_nulls():
    batch = pa.record_batch({"text": pa.array([None, "a b", None])})
    assert [len(B.word_hashes(b, o)[0]) for _, _, b, o in B.blocks(batch)] == [2]
