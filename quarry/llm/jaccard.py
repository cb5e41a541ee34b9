"""N-gram Jaccard join by vertical partitioning of a global n-gram order.

A document is its set of distinct word n-grams, known by 64-bit hashes; documents with one set are one
class. The n-grams stand in one global order, which is cut into fragments. First the candidates: a document's lower
half of the order has to share n-grams with a partner's, at 3/4 as many as a quarter of its set. That leaves the classes
that can have partners, and of these only sets of which three quarters are repeated go on; their repeated n-grams, rarest
first, name candidates. The sets that are left are stored by fragment. An overlap is counted
fragment by fragment, each from its own rows, and the parts are summed per pair: no row holds a pair's whole sets.

Candidates of one n-gram are first compared with a pivot of its group, and groups that then hold more
than one component go on with more pivots, 64 times as many each round, until every group is settled. A set's
overlap with its first pivot, its home, bounds its overlap with other sets of that home, and pairs that cannot reach
the threshold by this bound are not compared. Nor is a pair compared for an n-gram so late in both sets' orders that,
were it the first they share, the rest could not reach the threshold: for the first they do share, a link's rest can.
These links give the components. On request all links are then counted inside them, block against block and again fragment by
fragment: work that grows with the square of a component, as the number of its links does, so nothing asks for it by default.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import blocks as B
from quarry.llm.common import components, keyed, release, ship, written

FRAGMENTS = 4  # of the global order, equal ranges of hashes
BLOCK = 128  # sets of a component that one task compares with as many others
WIDTH = 4096  # n-grams of a slice of two blocks' matrices
MANY = 1 << 40  # stands for the count of ids of a run too long for one piece


def sets(batch: pa.RecordBatch, gram: int):
    """(row, sorted distinct n-gram hashes) of each text; a text with fewer words is one n-gram."""
    for i, _, buf, off in B.blocks(batch):
        h, first = B.word_hashes(buf, off, lower=True)
        rolled = B.rolled(h, gram)
        for j in range(len(off) - 1):
            a, n = first[j], first[j + 1] - first[j]
            if n >= gram:
                yield i + j, np.unique(rolled[a : a + n - gram + 1])
            elif n:
                yield i + j, B.mix(B.rolled(h[a : a + n], int(n)) + np.uint64(n))
            else:
                yield i + j, np.zeros(0, np.uint64)


def least(n, part: tuple[int, int]):
    """ceil(n * part) in whole numbers."""
    return -(-n * part[0] // part[1])


def summary(gram: int):
    def scan(batches):
        for batch in batches:
            got = [(len(x), np.sum(B.mix(x)), np.sum(B.mix(x ^ B.Q))) for _, x in sets(batch, gram)]
            n, a, b = (np.array(x, t) for x, t in zip(zip(*got, strict=True), (np.int64, np.uint64, np.uint64), strict=True)) if got else (np.zeros(0, np.int64),) * 3
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(B.signed(a)), pa.array(B.signed(b))], ["k", "n", "a", "b"])

    return scan


def lowest(gram: int, part: tuple[int, int], share: int):
    """Rows (h, id): the n-grams in the lower fragment of each text's set, a half (share 2) or all (1) of
    them. The id is the set's own at first, so that equal sets count once, then k."""

    def scan(batches):
        for batch in batches:
            hs, ids = [], []
            keys = batch.column(0).to_numpy()
            for row, x in sets(batch, gram):
                n = len(x)
                if n:
                    take = max(n - least(n, part) + 1, least(n, (1, share)))
                    hs.append(x[:take])
                    ids.append(np.full(take, keys[row] if share == 1 else B.signed(np.sum(B.mix(x), keepdims=True))[0]))
            if hs:
                yield pa.record_batch({"h": B.signed(np.concatenate(hs)), "id": np.concatenate(ids)})

    return scan


def shared(most: int | None = None):
    """Of rows sorted by h and id: (id, h, df) where df different ids have h, two or more. A run of over most rows is
    cut and has df MANY in every piece, so that (df, h) is one order for all, and its ids count over the cuts."""

    def scan(batches):
        one = last = None  # of a run that goes on: its only id so far, held back, and its last id
        for batch, before, after in B.runs(batches, ["h"], most=most):
            h, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if before and one is not None:
                h, d = np.append(h[:1], h), np.append(one, d)
            new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
            known = before and one is None
            if known:
                new[0] = d[0] != last
            key, last = h[0], d[-1]
            h, d = h[new], d[new]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            df = np.diff(np.append(start, len(h)))
            df = np.repeat(df, df)
            if before or after:
                mine = h == key
                several = known or np.count_nonzero(mine) > 1
                df[mine] = MANY if several else 1
                one = None if several else last
            yield pa.record_batch({"id": d[df > 1], "h": h[df > 1], "df": df[df > 1]})

    return scan


def met(most: int | None = None):
    """As shared, but (id, how often) once for each id of a batch."""

    def scan(batches):
        for batch in shared(most)(batches):
            ids, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
            yield pa.record_batch({"id": ids, "m": n})

    return scan


def fragments(gram: int):
    """Rows (k, n, f, grams): a set's n-grams in each fragment of the order that it reaches, with the size of the set."""

    def scan(batches):
        for batch in batches:
            keys, ks, ns, fs, lists = batch.column(0).to_numpy(), [], [], [], []
            for row, x in sets(batch, gram):
                cut = np.searchsorted(x, [np.uint64(i * (2**64 // FRAGMENTS)) for i in range(1, FRAGMENTS)])
                for f, part in enumerate(np.split(x, cut)):
                    if len(part):
                        ks.append(keys[row])
                        ns.append(len(x))
                        fs.append(f)
                        lists.append(B.signed(part))
            off = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
            values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.record_batch({"k": pa.array(ks, pa.int64()), "n": pa.array(ns, pa.int64()), "f": pa.array(fs, pa.int32()), "grams": pa.ListArray.from_arrays(pa.array(off), pa.array(values))})

    return scan


def measured(pairs: DataFrame, frags: DataFrame) -> DataFrame:
    """The pairs (a, b) that share n-grams, with the sizes of their sets and of the overlap: (a, b, n_a, n_b, o).
    Each fragment's part of an overlap is counted from that fragment's rows alone; the parts are then added up."""
    left = frags.select(F.col("k").alias("a"), "f", F.col("n").alias("n_a"), F.col("grams").alias("left"))
    right = frags.select(F.col("k").alias("b"), "f", F.col("n").alias("n_b"), F.col("grams").alias("right"))
    parts = pairs.join(left, "a").join(right, ["b", "f"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("left", "right")).alias("part"))
    return parts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("o")).filter("o > 0")


def alike(overlap, n, m, part: tuple[int, int]):
    """Whether an overlap is at least part of the union of sets of n and m."""
    return overlap * part[1] >= (n + m - overlap) * part[0]


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the overlaps of each of left with each of right, added up over slices of the n-grams of both sides."""
    out = np.zeros((len(left), len(right)), np.int64)
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for side in (left, right):
        x = np.concatenate(side)
        row = np.repeat(np.arange(len(side)), [len(y) for y in side])
        at = np.searchsorted(both, x)
        here = at < len(both)
        here[here] = both[at[here]] == x[here]
        row, at = row[here], at[here]
        order = np.argsort(at, kind="stable")
        sides.append((len(side), row[order], at[order]))
    for low in range(0, len(both), WIDTH):
        dense = []
        for n, row, at in sides:
            i, j = np.searchsorted(at, (low, low + WIDTH))
            x = np.zeros((n, min(WIDTH, len(both) - low)), np.float32)
            x[row[i:j], at[i:j] - low] = 1
            dense.append(x)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def linked(part: tuple[int, int]):
    """Of the fragments of sets, sorted by comp, i and j, two blocks of a component, and by f: (k, links between the
    blocks). A fragment's overlaps of all pairs are one partial matrix, and the matrices of the fragments are added up."""

    def counted(i: int, j: int, sides: list[dict], total: np.ndarray):
        (rows, n), (cols, m) = ((np.array(list(s)), np.array([x[1] for x in s.values()], np.int64)) for s in sides)
        are = alike(total[: len(rows), : len(cols)], n[:, None], m[None, :], part)
        if i == j:
            np.fill_diagonal(are, False)
            return rows, are.sum(1)
        return np.append(rows, cols), np.append(are.sum(1), are.sum(0))

    def scan(batches):
        now, sides, total = None, [{}, {}], np.zeros((0, 0), np.int64)
        for batch, _, _ in B.runs(batches, ["comp", "i", "j", "f"], lambda _: False):
            comp, i, j, f, own, k, size = (batch.column(c).to_numpy() for c in ("comp", "i", "j", "f", "own", "k", "n"))
            grams = batch.column(batch.schema.get_field_index("grams"))
            values, off = grams.values.to_numpy().view(np.uint64), grams.offsets.to_numpy()
            new = np.flatnonzero(np.append(True, (comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (f[1:] != f[:-1])))
            for a, z in zip(new, np.append(new[1:], len(k)), strict=True):
                group = (comp[a], i[a], j[a])
                if group != now:
                    if now and sides[0] and sides[1]:
                        ks, ns = counted(now[1], now[2], sides, total)
                        yield pa.record_batch({"k": ks, "links": ns})
                    now, sides, total = group, [{}, {}], np.zeros((0, 0), np.int64)
                here = [a + np.flatnonzero(own[a:z] == x) for x in group[1:]]
                for side, rows in zip(sides, here, strict=True):
                    for r in rows:
                        side.setdefault(int(k[r]), (len(side), int(size[r])))
                grown = np.zeros((len(sides[0]), len(sides[1])), np.int64)
                grown[: total.shape[0], : total.shape[1]] = total
                total = grown
                if len(here[0]) and len(here[1]):
                    at = [[side[int(k[r])][0] for r in rows] for side, rows in zip(sides, here, strict=True)]
                    total[np.ix_(*at)] += common(*[[values[off[r] : off[r + 1]] for r in rows] for rows in here])
        if now and sides[0] and sides[1]:
            ks, ns = counted(now[1], now[2], sides, total)
            yield pa.record_batch({"k": ks, "links": ns})

    return scan


def degrees(comps: DataFrame, frags: DataFrame, part: tuple[int, int]) -> DataFrame:
    """(class, k_links): links of each set. Both ends of a link are in one component, so all pairs of a component are
    compared, dealt out by pairs of its blocks; pairs are counted where they are compared and no row is made of them."""
    many = comps.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    own = comps.join(many, "comp").select("k", "comp", "blocks", F.pmod(F.xxhash64("k"), "blocks").alias("own"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("k", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = dealt.join(frags, "k").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "f")
    counted = rows.mapInArrow(linked(part), "k long, links long")
    return counted.groupBy(F.col("k").alias("class")).agg(F.sum("links").alias("k_links"))


def jaccard_join(docs: DataFrame, gram: int = 5, part: tuple[int, int] = (3, 4), most: int | None = None, count_links: bool = False) -> DataFrame:
    """Link documents whose n-gram sets have |A & B| * part[1] >= |A | B| * part[0], and return one row a
    document: doc_id, n_shingles, class_id and component_id, with count_links also k_links (how many other classes it is linked with).

    docs has doc_id and text; other columns are ignored. part is 3/4: the rounds above rest on it.
    Letters A-Z are lower-cased. A null text or one without words has the empty set and is linked
    with nothing; one with fewer words than gram has one n-gram, all its words. class_id and component_id are the smallest doc_id
    with the same set and reachable by links. Null and repeated ids: see common.keyed; rows equal in id and text
    are one document. No pair is lost: caps and samples are not used anywhere. most: rows of one n-gram that a
    task holds at once (blocks.RUN); the result does not depend on it.
    """
    if part != (3, 4):
        raise ValueError("the candidate rounds are worked out for 3/4")
    spark = docs.sparkSession
    ship(spark)
    kd, unique = keyed(docs)
    text = (kd if unique else kd.dropDuplicates(["k"])).select("k", "text")
    # classes of equal sets
    info = written(text.mapInArrow(summary(gram), "k long, n long, a long, b long"))
    same = info.filter("n > 0").groupBy("n", "a", "b").agg(F.min("k").alias("class"))
    classes = written(info.join(same, ["n", "a", "b"], "left").select("k", "n", "a", F.coalesce("class", "k").alias("class")))
    # the lower half of the order: a partner shares n-grams there, as many as a quarter of the set or more
    low = text.mapInArrow(lowest(gram, part, 2), "h long, id long").repartition("h").sortWithinPartitions("h", "id")
    hit = low.mapInArrow(met(most), "id long, m long").groupBy(F.col("id").alias("a")).agg(F.sum("m").alias("m"))
    able = classes.filter("n > 0 and k = class").join(hit, "a").filter(F.col("m") * 4 >= F.col("n"))
    able = written(able.select("k", "n"))
    del low, hit
    release(spark)
    texts = written(text.join(able, "k"))
    release(spark)
    # the whole order: three quarters of the set are repeated; of these, rarest first, the first are candidates
    low = texts.select("k", "text").mapInArrow(lowest(gram, part, 1), "h long, id long").repartition("h").sortWithinPartitions("h", "id")
    found = low.mapInArrow(shared(most), "id long, h long, df long").groupBy(F.col("id").alias("k")).agg(F.collect_list(F.struct("df", "h")).alias("grams"))
    most = F.ceil(F.col("n") * 3 / 4)
    kept = texts.select("k", "n").join(found, "k").filter(F.size("grams") >= most)
    kept = kept.select("k", "n", (F.col("n") - F.size("grams")).alias("alone"), F.slice(F.array_sort("grams"), F.lit(1), F.greatest(F.size("grams") - most + 1, F.lit(0)).cast("int")).alias("grams"))
    none = F.lit(None).cast("long")
    groups = written(kept.select("k", "n", "alone", F.posexplode("grams").alias("pos", "g")).select(F.col("g.h").alias("h"), "k", "n", "alone", "pos", none.alias("home"), none.alias("inside")))
    del low, found, kept
    release(spark)
    frags = texts.join(groups.select("k").distinct(), "k").select("k", "text").mapInArrow(fragments(gram), "k long, n long, f int, grams array<long>")
    frags = written(frags)
    comps = tested = links = None
    pivots = 1
    while True:
        rows = groups.withColumn("comp", F.col("k")) if comps is None else groups.join(comps, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
        sides = rows.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("h")
        by_size = rows.join(sides, "h").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("h", "comp")))
        rows = written(by_size.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("size", "alone", "k"))).drop("size"))
        if not rows.limit(1).count():
            break
        p = rows.filter(F.col("rank") <= pivots).select("h", F.col("k").alias("p"), F.col("comp").alias("pc"), F.col("n").alias("pn"), F.col("alone").alias("pa"), F.col("pos").alias("pp"), F.col("home").alias("ph"), F.col("inside").alias("pi"))
        close = (F.col("n") * 4 >= F.col("pn") * 3) & (F.col("pn") * 4 >= F.col("n") * 3)
        # n-grams that no other set has are in no overlap; where this is the first that both have, nor are those before it
        top = F.least(F.col("n") - F.col("alone") - F.col("pos"), F.col("pn") - F.col("pa") - F.col("pp"))
        close &= alike(top, F.col("n"), F.col("pn"), part)
        # sets with one home share no more of it than the lesser has, and outside it no more than the lesser has there
        top = F.least("inside", "pi") + F.least(F.col("n") - F.col("alone") - F.col("inside"), F.col("pn") - F.col("pa") - F.col("pi"))
        close &= F.coalesce((F.col("home") != F.col("ph")) | alike(top, F.col("n"), F.col("pn"), part), F.lit(True))
        pairs = rows.join(p, "h").filter((F.col("comp") != F.col("pc")) & close)
        if tested is None:  # first, each set with the one pivot that most of its n-grams name
            votes = pairs.groupBy("k", "p").agg(F.count(F.lit(1)).alias("v"), F.min("pa").alias("pa"))
            pairs = homes = written(votes.groupBy("k").agg(F.max_by("p", F.struct("v", -F.col("pa"), -F.col("p"))).alias("p")))
        pairs = pairs.select(F.least("k", "p").alias("a"), F.greatest("k", "p").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
            groups = rows.filter(F.col("rank") > pivots).drop("comp", "rank")
            pivots *= 64
        pairs = written(pairs)
        new = written(measured(pairs, frags))
        if tested is None:
            at = homes.select("k", F.col("p").alias("home"), F.least("k", "p").alias("a"), F.greatest("k", "p").alias("b")).join(new, ["a", "b"])
            groups = written(groups.drop("home", "inside").join(at.select("k", "home", F.col("o").alias("inside")), "k", "left"))
        new = new.filter(alike(F.col("o"), F.col("n_a"), F.col("n_b"), part)).select("a", "b")
        tested = pairs if tested is None else tested.union(pairs)
        links = new if links is None else links.union(new)
        if new.limit(1).count():
            comps = components(links)
    if comps is None:
        comps = spark.createDataFrame([], "k long, comp long")
    result = classes.join(comps.withColumnRenamed("k", "class"), "class", "left")
    columns = [F.col("n").alias("n_shingles"), F.col("class").alias("class_id"), F.coalesce("comp", "class").alias("component_id")]
    if count_links:
        result = result.join(degrees(comps, frags, part), "class", "left")
        columns.append(F.coalesce("k_links", F.lit(0)).alias("k_links"))
    result = result.select("k", *columns)
    if unique:
        return result.withColumnRenamed("k", "doc_id")
    names = kd.select("k", "doc_id").distinct()
    for c in ("class_id", "component_id"):
        result = result.join(names.select(F.col("k").alias(c), F.col("doc_id").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return kd.select("k", "doc_id").join(result, "k").drop("k")


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import read

    return jaccard_join(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
