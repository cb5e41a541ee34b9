"""Substring dedup by de Bruijn compaction.

An edge of the graph is a window of words and goes from the node of its first words to that of its last, all but one of
each; two 64-bit node names are the edge. An edge is found again through its anchor (see anchors.py), and only
edges whose anchor occurs again are sent, each with its source coordinate. Repeated edges get the coordinate of their
first occurrence. Degrees of the nodes come from grouped aggregations; edges joined to nodes of one way in and
one way out compact into nonbranching paths, which are intervals of their source. Runs of repeated edges along a document
are joined to the paths they follow and give spans with both coordinates. A span counts only if the
digest of its words equals that of the words at its source.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import blocks as B
from quarry.llm.anchors import among, repeated_anchors, word_anchors
from quarry.llm.common import keyed, release, ship, text_classes, written

STRETCH = 64  # places of a source within which runs and paths meet
OUT = "k long, n_words long, n_removed long, spans array<struct<start:long,end:long,source:long,source_start:long>>, kept_text string"


def edges(window: int, kmer: int):
    def scan(batches):
        for batch in batches:
            keys, lists = batch.column(0).to_numpy(), batch.column(2)
            for i, _, buf, off in B.blocks(batch):
                h, _, starts, text, place, kmers = word_anchors(buf, off, window, kmer)
                if not len(starts):
                    continue
                hit = among(text, kmers[place], lists, i)
                s, t = starts[hit], text[hit]
                node = B.rolled(h, window - 1)
                yield pa.record_batch({"u": B.signed(node[s]), "v": B.signed(node[s + 1]), "k": keys[t + i], "pos": (s - word_first(text, starts)[t]).astype(np.int32)})

    return scan


def word_first(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first window start of each text."""
    out = np.zeros(int(text[-1]) + 1, np.int64)
    new = np.append(True, text[1:] != text[:-1])
    out[text[new]] = starts[new]
    return out


def first_seen(batches):
    """Of edges sorted by node names and coordinate, the repeated ones with the coordinate of their first occurrence; only
    that one carries the names. An edge alone is not passed on."""
    first = (0, 0)
    for batch, before, after in B.runs(batches, ["u", "v"]):
        u, v, k, pos = (batch.column(i).to_numpy() for i in range(4))
        new = np.append(not before, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(u)), -1))
        src, src_pos = np.where(at < 0, first[0], k[at]), np.where(at < 0, first[1], pos[at])
        first = (src[-1], src_pos[-1])
        take = ~new | np.append(~new[1:], after)  # goes on from the one before, or in the next
        name = pa.array(~new[take])  # a mask: where the names are null
        yield pa.record_batch({"u": pa.array(u[take], mask=name.to_numpy(zero_copy_only=False)), "v": pa.array(v[take], mask=name.to_numpy(zero_copy_only=False)), "k": k[take], "pos": pos[take], "src": src[take], "src_pos": src_pos[take]})


def nonbranching(seen: DataFrame) -> DataFrame:
    """(source, low, high): the paths, intervals of the places of their edges in the source.

    An edge goes on to the next one of its source where the node between has one way in and one way out."""
    edge = seen.filter("u IS NOT NULL").select("u", "v", "src", "src_pos")
    ways_out = edge.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("node")
    ways_in = edge.groupBy(F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("node")
    plain = ways_out.join(ways_in, "node").select(F.col("node").alias("v"), F.lit(True).alias("on"))
    edge = edge.select("v", "src", "src_pos").join(plain, "v", "left").select("src", "src_pos", F.coalesce("on", F.lit(False)).alias("on"))
    place = Window.partitionBy("src").orderBy("src_pos")
    starts = ~F.coalesce(F.lag("on").over(place) & (F.lag("src_pos").over(place) == F.col("src_pos") - 1), F.lit(False))
    low = F.max(F.when(F.col("starts"), F.col("src_pos"))).over(place.rowsBetween(Window.unboundedPreceding, 0))
    return edge.withColumn("starts", starts).withColumn("low", low).groupBy(F.col("src").alias("source"), "low").agg(F.max("src_pos").alias("high"))


def along_documents(seen: DataFrame) -> DataFrame:
    """(k, pos, end, source, source_pos): runs of repeated edges whose first occurrences follow each other, without those
    that are themselves the first."""
    again = seen.filter(~((F.col("k") == F.col("src")) & (F.col("pos") == F.col("src_pos")))).select("k", "pos", "src", "src_pos")
    place = Window.partitionBy("k").orderBy("pos")
    follows = (F.lag("pos").over(place) == F.col("pos") - 1) & (F.lag("src").over(place) == F.col("src")) & (F.lag("src_pos").over(place) == F.col("src_pos") - 1)
    run = F.max(F.when(~F.coalesce(follows, F.lit(False)), F.col("pos"))).over(place.rowsBetween(Window.unboundedPreceding, 0))
    runs = again.withColumn("run", run).groupBy("k", "run").agg(F.max("pos").alias("end"), F.min("src").alias("source"), F.min("src_pos").alias("source_pos"))
    return runs.select("k", F.col("run").alias("pos"), "end", "source", "source_pos")


def spans_of(seen: DataFrame, window: int) -> DataFrame:
    """(k, start, end, source, source_start) in words: each run cut where it passes from one path to another."""
    runs = along_documents(seen).withColumn("source_end", F.col("source_pos") + F.col("end") - F.col("pos"))
    low, high = F.greatest("low", "source_pos"), F.least("high", "source_end")
    # runs and paths of a source meet by the stretches of places that both touch, and count in the first one of these alone, so that
    # one much repeated passage of a source does not bring all its runs to all its paths
    touched = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / STRETCH), F.floor(F.col(b) / STRETCH))).alias("stretch")
    runs, paths = runs.select("*", touched("source_pos", "source_end")), nonbranching(seen).select("*", touched("low", "high"))
    both = runs.join(paths, ["source", "stretch"]).filter((F.col("low") <= F.col("source_end")) & (F.col("high") >= F.col("source_pos")) & (F.col("stretch") == F.floor(low / STRETCH)))
    start = F.col("pos") + low - F.col("source_pos")
    return both.select("k", start.cast("long").alias("start"), (start + high - low + window).cast("long").alias("end"), "source", low.cast("long").alias("source_start"))


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def at_sources(batches):
    """Texts with their intervals (start, end) to (source, source_start, length, digest)."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        rows = []
        for i, key in enumerate(batch.column("k").to_pylist()):
            words = texts[i].as_py().split()
            rows += [(key, x["start"], x["end"] - x["start"], digest(words[x["start"] : x["end"]])) for x in batch.column("at")[i].as_py()]
        k, start, length, found = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.record_batch({"source": pa.array(k, pa.int64()), "source_start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "digest": pa.array(found, pa.binary())})


def cut_out(window: int):
    def apply(batches):
        for batch in batches:
            texts, reps, lists = batch.column("text").cast(pa.large_binary()), batch.column("rep").to_numpy(), batch.column("found")
            keys, out = batch.column("k").to_numpy(), {n: [] for n in ("n_words", "n_removed", "spans", "kept_text")}
            for i, key in enumerate(keys):
                words = texts[i].as_py().split()
                n, spans, gone = len(words), [], 0
                if reps[i] != key:
                    if n >= window:
                        spans, gone, words = [{"start": 0, "end": n, "source": int(reps[i]), "source_start": 0}], n, []
                elif lists[i].is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    for x in sorted(lists[i].as_py(), key=lambda x: (x["start"], x["source"], x["source_start"])):
                        if digest(words[x["start"] : x["end"]]) == x.pop("digest"):  # the words at both coordinates
                            spans.append(x)
                            edge[x["start"]] += 1
                            edge[x["end"]] -= 1
                    kept = np.flatnonzero(np.cumsum(edge)[:n] == 0)
                    gone, words = n - len(kept), [words[j] for j in kept]
                for name, x in zip(out, (n, gone, spans, b" ".join(words).decode("utf-8", "surrogatepass")), strict=True):
                    out[name].append(x)
            span = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "source", "source_start")]))
            rest = batch.schema.names[4:]
            yield pa.record_batch([pa.array(keys), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], span), pa.array(out["kept_text"], pa.string()), *(batch.column(n) for n in rest)], ["k", "n_words", "n_removed", "spans", "kept_text", *rest])

    return apply


def substring_dedup(docs: DataFrame, window: int = 20, kmer: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each word covered by a window of words that also starts earlier in the corpus.

    docs has doc_id and text; other columns are ignored but for those named in carry. Returns doc_id,
    carry, n_words, n_removed, spans (start and end in words, and the key and start of the source: its
    doc_id where ids are unique) and kept_text (kept words joined by one space), a row for each row.
    A null or empty text has no words; a text shorter than the window keeps all of them. Null and
    repeated ids: see common.keyed; rows equal in id and text are one document and get equal results.
    """
    ship(docs.sparkSession)
    kd, unique = keyed(docs, *carry)
    rows = kd if unique else kd.dropDuplicates(["k"])
    carried = carry if unique else ()  # with repeated ids, joined at the end
    classes = text_classes(rows, *carried)
    text = rows.select("k", "text").repartition("k")
    own = classes.filter("k = rep").select("k")
    found = repeated_anchors(text.join(own, "k"), window, kmer, "word")
    sent = text.join(found, "k").select("k", "text", "anchors").mapInArrow(edges(window, kmer), "u long, v long, k long, pos int")
    seen = sent.repartition("u", "v").sortWithinPartitions("u", "v", "k", "pos").mapInArrow(first_seen, "u long, v long, k long, pos int, src long, src_pos int")
    seen = written(seen)
    del sent, found
    release(docs.sparkSession)
    spans = written(spans_of(seen, window))
    release(docs.sparkSession)
    # the words at the sources, each interval once, and then at the spans
    length = F.col("end") - F.col("start")
    wanted = spans.select(F.col("source").alias("k"), F.struct(F.col("source_start").alias("start"), (F.col("source_start") + length).alias("end")).alias("at")).distinct()
    wanted = wanted.groupBy("k").agg(F.collect_list("at").alias("at"))
    there = text.join(wanted, "k").select("k", "text", "at").mapInArrow(at_sources, "source long, source_start long, length long, digest binary")
    known = spans.withColumn("length", length).join(there, ["source", "source_start", "length"])
    marks = known.groupBy("k").agg(F.collect_list(F.struct("start", "end", "source", "source_start", "digest")).alias("found"))
    kinds = dict(docs.dtypes)
    both = text.join(classes, "k").join(marks, "k", "left").select("k", "text", "rep", "found", *carried)
    result = both.mapInArrow(cut_out(window), OUT + "".join(f", `{c}` {kinds[c]}" for c in carried))
    if unique:
        return result.withColumnRenamed("k", "doc_id")
    return kd.select("k", "doc_id", *carry).join(result, "k").drop("k")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import read

    out = substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
