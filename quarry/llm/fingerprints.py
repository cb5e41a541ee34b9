"""Document fingerprints by locally consistent parsing.

Each level names the phrases of the level below: runs of one symbol are joined, deterministic coin tossing
turns the rest into labels under six in which neighbours differ, local maxima start phrases and a phrase is
named by the hash of its symbols. A cut depends on a few symbols to either side only, so equal substrings have
the same phrases inside, wherever they stand. A fingerprint holds the smallest names of the second and third level and, for
short texts, of the first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import blocks as B
from quarry.llm.common import keyed, ship

SHORT, LONG, ENOUGH = 16, 48, 8  # names kept of level 1, of levels 2 and 3; fewer long ones: level 1 counts too
OUT = "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited string"


def tossed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: twice the place of the lowest bit that differs from the symbol before, and that bit."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = ~x[first]
    d = x ^ before
    place = ((d & (~d + np.uint64(1))).astype(np.float64).view(np.int64) >> 52) - 1023
    place = place.astype(np.uint64)
    return place * np.uint64(2) + ((x >> place) & np.uint64(1))


def phrases(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names of the next level, its offsets); symbols x are 64-bit, texts are cut at off."""
    n = len(x)
    if not n:
        return x, off
    begin = np.zeros(n + 1, bool)
    begin[off] = True
    new = begin[:-1].copy()
    new[0] = True
    new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, n)).astype(np.uint64)
    off = np.searchsorted(at, off)
    x = np.where(run > 1, B.mix(x[at] + run * B.Q), x[at])
    first = np.unique(off[:-1][off[:-1] < off[1:]])
    label = x
    for _ in range(4):
        label = tossed(label, first)
    top = np.zeros(len(x), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    edge = np.zeros(len(x) + 1, bool)
    edge[off] = True
    top[1:] &= ~edge[1:-1]  # a phrase starts at each text's first symbol
    top[:-1] &= ~edge[1:-1]
    top[first] = True
    starts = np.flatnonzero(top)
    ends = np.append(starts[1:], len(x))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * B.powers(len(x))[0][: len(x)], out=sums[1:])
    return B.span_hash(sums, starts, ends), np.searchsorted(starts, off)


def fingerprints(batch: pa.RecordBatch, name: str = "text") -> list[tuple[np.ndarray, np.ndarray]]:
    """(smallest names of level 1, of levels 2 and 3) of each text, 32 bits each."""
    out = []
    for _, _, buf, off in B.blocks(batch, name):
        one, off1 = phrases(B.TABLE[buf], off)
        two, off2 = phrases(one, off1)
        three, off3 = phrases(two, off2)
        three = B.mix(three ^ B.Q)
        for i in range(len(off) - 1):
            low = np.unique(one[off1[i] : off1[i + 1]] >> np.uint64(32))[:SHORT]
            high = np.unique(np.concatenate([two[off2[i] : off2[i + 1]], three[off3[i] : off3[i + 1]]]) >> np.uint64(32))[:LONG]
            out.append((low.astype(">u4"), high.astype(">u4")))
    return out


def text_of(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    return ".".join(x.tobytes().hex() for x in fingerprint)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of the phrase sets as the smallest names estimate it; 1 for equal fingerprints."""
    if all(np.array_equal(x, y) for x, y in zip(a, b, strict=True)):
        return 1.0
    x, y = a[1], b[1]
    k = LONG
    if min(len(x), len(y)) < ENOUGH:
        x, y, k = np.union1d(*a), np.union1d(*b), SHORT + LONG
    least = np.union1d(x, y)[:k]
    return float(np.isin(least, x).__and__(np.isin(least, y)).sum() / len(least)) if len(least) else 1.0


def pairs(batches):
    """Rows of a bucket by descending k, its last one a tail, to a row for each but the tail."""

    def done(rows):
        text = [r[2] for r in rows]
        edited = []
        for a, b in zip(text[:-1], text[1:], strict=True):
            half = len(a) // 2
            edited.append(a[: len(a) - half] + b[:half])
        found = fingerprints(pa.record_batch({"text": pa.array(text, pa.large_string())}))
        other = fingerprints(pa.record_batch({"text": pa.array(edited, pa.large_string())}))
        cols = {n: [] for n in ("k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited")}
        for i, e in enumerate(edited):
            if rows[i][3]:
                continue
            values = rows[i][1], len(text[i]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), text_of(found[i]), text_of(other[i]), likeness(found[i], other[i]), likeness(found[i], found[i + 1]), e
            for c, v in zip(cols.values(), values, strict=True):
                c.append(v)
        return pa.record_batch([pa.array(v, t) for v, t in zip(cols.values(), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()), strict=True)], list(cols))

    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += len(row[2])
            if size > B.BLOCK and len(held) > 1:
                yield done(held)
                held, size = held[-1:], len(held[-1][2])
    if len(held) > 1:
        yield done(held)


def bucket(k: Column, splits: list[int], low: int = 0) -> Column:
    """The number of splits over k, by a balanced tree of comparisons."""
    if not splits:
        return F.lit(low)
    m = len(splits) // 2
    return F.when(k < splits[m], bucket(k, splits[:m], low + len(splits) - m)).otherwise(bucket(k, splits[m + 1 :], low))


def document_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text: its last half replaced by the start of the next
    document by descending id (after the last comes the first).

    docs has doc_id and text; other columns are ignored. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next and edited, a row for each row. A null text is empty;
    two empty texts are alike by 1, an empty and another by 0. Likeness is that of the names of levels two and three, or
    of all levels where one of the texts has fewer than ENOUGH of these. A single document is its own next. Null and
    repeated ids: see common.keyed; rows equal in id and text are one document. Texts are dealt out once, by
    ranges of ids cut at quantiles; each range also gets the document that follows it.
    """
    spark = docs.sparkSession
    ship(spark)
    kd, unique = keyed(docs)
    rows = (kd if unique else kd.dropDuplicates(["k"])).select("k", "text")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = kd.select("k")
    splits = sorted({int(x) for x in ids.approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    tops = sorted((r[0], r[1]) for r in ids.groupBy(bucket(F.col("k"), splits).alias("b")).agg(F.max("k")).collect())  # a row for each part
    tails = [(top, tops[i - 1][0]) for i, (_, top) in enumerate(tops)]  # the first of each part ends the part before
    tails = spark.createDataFrame(tails, "k long, after int")
    both = rows.join(F.broadcast(tails), "k", "left").select("k", "text", F.explode(F.array_compact(F.array(
        F.struct(bucket(F.col("k"), splits).alias("b"), F.lit(False).alias("tail")),
        F.when(F.col("after").isNotNull(), F.struct(F.col("after").alias("b"), F.lit(True).alias("tail"))),
    ))).alias("at")).select("at.b", "k", "text", "at.tail")
    sorted_ = both.repartitionByRange(max(len(tops), 1), "b").sortWithinPartitions(F.col("b"), F.col("tail"), F.col("k").desc())
    result = sorted_.mapInArrow(pairs, OUT)
    if unique:
        return result.withColumnRenamed("k", "doc_id")
    return kd.select("k", "doc_id").join(result, "k").drop("k")


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import read

    return document_fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("edited")
