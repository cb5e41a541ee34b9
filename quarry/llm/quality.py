"""Quality classifier: nearest labelled neighbours in a latent space.

A document's terms are its words, by hashed code, and their written shapes (length, first and last character,
case, whether the word stands just before too), with how often words come back. Executors count the terms of a
bounded labelled sample and factor the weighted counts by block power iteration: each round they multiply
their rows with a thin basis, and the driver only adds and orthogonalises matrices of terms by latent
dimensions. Texts and counts never reach it. The sample's latent vectors go to every task, and each
document is compared with all of them, block by block. Neighbours vote with a power of their cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import blocks as B
from quarry.llm.common import ship, written

SAMPLE = 1500  # labelled documents of each class, at most
LATENT, NEIGHBOURS = 48, 25
SHAPES, REPEATS, WORDS = 2048, 32, 2048
TERMS = SHAPES + REPEATS + WORDS
ROUNDS, SPARE = 5, 16  # of the power iteration; columns of its basis beyond the latent ones
TASKS = 4  # that hold the sample's counts in a round
ROWS = 1024  # texts counted at once
SHARPNESS = 8  # the power of the cosine that a neighbour votes with
_K = np.full(256, 6, np.uint8)  # classes of bytes: lower, upper, digit, stop, mark, bar, other, beyond ASCII
_K[97:123], _K[65:91], _K[48:58] = 0, 1, 2
_K[list(b".,;:'\"-")], _K[list(b"!?")], _K[ord("|")] = 3, 4, 5
_K[128:] = 7


def term_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Term counts, a row for each text."""
    n = len(off) - 1
    starts, ends, first = B.word_spans(buf, off)
    out = np.zeros((n, TERMS), np.float32)
    if not len(starts):
        return out
    h = B.span_hash(B.prefix(buf), starts, ends)
    text = np.repeat(np.arange(n), np.diff(first))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    upper = np.append(0, np.cumsum((buf >= 65) & (buf <= 90)))
    size = ends - starts
    shout = (upper[ends] - upper[starts]) * 2 > size
    code = np.minimum(size, 15) >> 1
    code = (((code * 8 + _K[buf[starts]]) * 8 + _K[buf[ends - 1]]) * 2 + same) * 2 + (shout & (size > 2))
    out[:, :SHAPES] = np.bincount(text * SHAPES + code, minlength=n * SHAPES).reshape(n, SHAPES)
    lower = B.span_hash(B.prefix(B.LOWER[buf]), starts, ends) % np.uint64(WORDS)
    out[:, SHAPES + REPEATS :] = np.bincount(text * WORDS + lower.astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    words = np.diff(first)
    runs = B.rolled(h, 3)
    for i in np.flatnonzero(words >= 3):  # how much of the text are word triples seen before in it
        x = runs[first[i] : first[i + 1] - 2]
        share = 1 - len(np.unique(x)) / len(x)
        out[i, SHAPES + min(int(share * REPEATS), REPEATS - 1)] = words[i] / 2
    return out


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def all_counts(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, ROWS):
        for _, _, buf, off in B.blocks(batch.slice(at, ROWS)):
            yield term_counts(buf, off)


def counted(batches):
    """Rows (y, text) to (y, place, often): the terms that a text has and how often, as bytes."""
    for batch in batches:
        found = [(np.flatnonzero(x), x) for block in all_counts(batch) for x in block]
        yield pa.record_batch({"y": batch.column(0), "place": pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary()), "often": pa.array([x[p].astype("<f4").tobytes() for p, x in found], pa.binary())})


def matrix(batches) -> tuple[np.ndarray, np.ndarray]:
    """(labels, counts) of a task's rows of the sample, which sample bounds."""
    y, rows = [np.zeros(0, np.float32)], [np.zeros((0, TERMS), np.float32)]
    for batch in batches:
        x = np.zeros((batch.num_rows, TERMS), np.float32)
        for i, (p, c) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            x[i, np.frombuffer(p.as_py(), "<i4")] = np.frombuffer(c.as_py(), "<f4")
        y.append(batch.column(0).to_numpy().astype(np.float32))
        rows.append(x)
    return np.concatenate(y), np.concatenate(rows)


def summed(sample: DataFrame, part, *shape: int) -> np.ndarray:
    """The sum over tasks of part(labels, counts), a matrix of the shape."""

    def scan(batches):
        yield pa.record_batch({"m": pa.array([part(*matrix(batches)).astype("<f8").tobytes()], pa.binary())})

    got = sample.mapInArrow(scan, "m binary").collect()  # a row for each of TASKS
    return sum((np.frombuffer(r[0], "<f8").reshape(shape) for r in got), np.zeros(shape))


def fit(sample: DataFrame, latent: int = LATENT) -> dict:
    """The model from rows (y, place, often): idf, projection, and unit vectors and labels of the sample."""
    seen = summed(sample, lambda y, x: np.append((x > 0).sum(0), [len(y), y.sum()]), TERMS + 2)
    n = int(seen[-2])
    if not n:
        return {"idf": np.zeros(TERMS, np.float32), "to": np.zeros((TERMS, 1), np.float32), "at": np.zeros((0, 1), np.float32), "y": np.zeros(0, np.float32), "prior": 0.5}
    idf = np.log((1 + n) / (1 + seen[:TERMS])).astype(np.float32) + np.float32(0.1)
    width = min(latent + SPARE, n)
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((TERMS, width)))[0]

    def multiplied(q: np.ndarray) -> np.ndarray:
        def part(y, x):
            w = weights(x, idf)
            return w.T @ (w @ q.astype(np.float32))

        return summed(sample, part, TERMS, width)

    for _ in range(ROUNDS):
        basis = np.linalg.qr(multiplied(basis))[0]
    size, turn = np.linalg.eigh(basis.T @ multiplied(basis))
    keep = np.argsort(-size)[: min(latent, int((size > 1e-4).sum()) or 1)]
    to = (basis @ turn[:, keep]).astype(np.float32)

    def project(batches):
        y, x = matrix(batches)
        at = weights(x, idf) @ to
        at /= np.maximum(np.sqrt((at * at).sum(1, keepdims=True)), 1e-9)
        yield pa.record_batch({"y": y, "at": pa.array([a.astype("<f4").tobytes() for a in at], pa.binary())})

    got = sorted((r[0], bytes(r[1])) for r in sample.mapInArrow(project, "y float, at binary").collect())  # latent values of a sample
    return {"idf": idf, "to": to, "at": np.frombuffer(b"".join(a for _, a in got), "<f4").reshape(n, -1), "y": np.array([y for y, _ in got], np.float32), "prior": float(seen[-1] / n)}


def vote(counts: np.ndarray, model: dict, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The share of label 1 among the nearest of the sample, each weighted by its cosine to the power of SHARPNESS;
    the sample's own share where nothing is similar."""
    m = min(neighbours, len(model["y"]))
    if not m:
        return np.full(len(counts), model["prior"])
    x = weights(counts, model["idf"]) @ model["to"]
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    cos = x @ model["at"].T
    near = np.argpartition(-cos, m - 1, axis=1)[:, :m]
    w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** SHARPNESS
    total = w.sum(1)
    return np.where(total > 1e-9, np.clip((w * model["y"][near]).sum(1) / np.maximum(total, 1e-9), 0, 1), model["prior"])


def scorer(model):
    def scan(batches):
        m = model.value
        for batch in batches:
            got = [vote(x, m) for x in all_counts(batch.select(["text"]))]
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.record_batch([*rest, pa.array(np.concatenate(got) if got else np.zeros(0))], [*names, "score"])

    return scan


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on at most sample labelled rows of each class, the first by hash of the id, none held out.
    The ids are chosen from labels alone and go to the scan of docs, which writes the terms that the chosen texts have."""
    one = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = None
    for q in (0, 1):
        some = one.filter(F.col("quality") == q).orderBy(*order).limit(sample)
        ids = some if ids is None else ids.union(some)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.col("quality").cast("int").alias("y"), "text")  # at most two samples of ids
    return fit(written(rows.mapInArrow(counted, "y int, place binary, often binary")).coalesce(TASKS))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from cut) for each row.

    docs has doc_id and text, labels doc_id and quality; other columns are ignored. A null text is empty,
    and texts without terms get the share of label 1 in the sample; so does everything where no label is given.
    Rows with a null id are scored and not held out; repeated rows get equal scores; of several labels of an
    id the smaller counts. The classifier sees each whole text, its words and their shapes, never ids or columns.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(quality_model(docs, labels, sample))  # bounded by sample
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(scorer(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose score is at least cut; see quality_scores."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(quality_model(docs, labels, sample))

    def scan(batches):
        m = model.value
        for batch in batches:
            got = [vote(x, m) for x in all_counts(batch)]
            yield batch.filter(pa.array(np.concatenate(got) >= cut)) if got else batch

    return docs.mapInArrow(scan, docs.schema)


def op9_quality_knn(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import read

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
