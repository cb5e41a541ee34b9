"""Which sampled k-mers of the corpus occur more than once.

Every window of a text has an anchor: its smallest k-mer by hash, the leftmost of equals. Equal
windows have equal anchors, so only windows whose anchor occurs again can themselves occur again, and
anchors are a small part of all k-mers. A text sends each of its anchors once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import blocks as B


def word_anchors(buf, off, window: int, k: int):
    """(word hashes, first words, window starts, their texts, anchor place of each, k-mer hashes)."""
    h, first = B.word_hashes(buf, off)
    starts, text = B.inside_texts(first, window)
    kmers = B.rolled(h, k)
    if not len(starts):
        return h, first, starts, text, starts, kmers
    return h, first, starts, text, B.leftmost_min(kmers, window - k + 1)[starts], kmers


def byte_anchors(buf, off, window: int, k: int):
    """(prefix sums, window starts, their texts, anchor place of each, k-mer hashes) over bytes."""
    sums = B.prefix(buf)
    starts, text = B.inside_texts(off, window)
    if not len(starts):
        return sums, starts, text, starts, np.zeros(0, np.uint64)
    kmers = B.mix((sums[k:] - sums[:-k]) * B.powers(len(sums))[1][: len(sums) - k])
    return sums, starts, text, B.leftmost_min(kmers, window - k + 1)[starts], kmers


def once_a_text(text: np.ndarray, place: np.ndarray, kmers: np.ndarray):
    """(text, hash, whether it is there twice) for the distinct anchors of each text."""
    if not len(place):
        return text, np.zeros(0, np.uint64), np.zeros(0, bool)
    new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]))
    t, h = text[new], kmers[place[new]]
    order = np.lexsort((h, t))
    t, h = t[order], h[order]
    new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])))
    return t[new], h[new], np.diff(np.append(new, len(t))) > 1


def among(text: np.ndarray, h: np.ndarray, lists: pa.Array, i: int) -> np.ndarray:
    """Whether h is in the list of its text; the lists of a block start at row i."""
    values, off = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
    n = int(text[-1]) + 1 if len(text) else 0
    off = off[i : i + n + 1]
    owner = np.repeat(np.arange(n), np.diff(off)).astype(np.uint64)
    return np.isin(h ^ B.mix(text.astype(np.uint64)), values[off[0] : off[-1]] ^ B.mix(owner)) if n else np.zeros(0, bool)


def repeated_anchors(texts: DataFrame, window: int, k: int, unit: str, hot: int | None = None) -> DataFrame:
    """(k, anchors): for each text with any, those of its anchors that occur again in the corpus or in it;
    with hot, also the list hot of those that more than so many texts have.

    texts has k and text, k unique. The hashes are dealt out and sorted by Spark and read as a sorted
    stream; as a text sends a hash once, one hash is at most one row of every text."""
    anchors = word_anchors if unit == "word" else byte_anchors

    def scan(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, _, buf, off in B.blocks(batch):
                got = anchors(buf, off, window, k)
                text, place, kmers = (got[3], got[4], got[5]) if unit == "word" else (got[2], got[3], got[4])
                t, h, twice = once_a_text(text, place, kmers)
                yield pa.record_batch({"h": B.signed(h), "k": keys[t + i], "twice": twice})

    def keep(batches):
        for batch, before, after in B.runs(batches, ["h"]):
            h = batch.column(0).to_numpy()
            again = np.zeros(len(h), bool)
            again[1:] = h[1:] == h[:-1]
            again[:-1] |= again[1:]
            again |= batch.column(2).to_numpy(zero_copy_only=False)
            if before:
                again |= h == h[0]
            if after:
                again |= h == h[-1]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(start, len(h)))
            many = np.repeat(size, size) > (hot or len(h))
            if hot and (before or after):
                many |= (h == h[0]) & before | (h == h[-1]) & after
            yield pa.record_batch({"h": h[again], "k": batch.column(1).to_numpy()[again], "many": many[again]})

    rows = texts.select("k", "text").mapInArrow(scan, "h long, k long, twice boolean")
    found = rows.repartition("h").sortWithinPartitions("h").mapInArrow(keep, "h long, k long, many boolean")
    lists = [F.collect_list("h").alias("anchors")] + [F.collect_list(F.when(F.col("many"), F.col("h"))).alias("hot")] * bool(hot)
    return found.groupBy("k").agg(*lists)
