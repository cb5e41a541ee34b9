"""Suffix-array dedup by column-wise multi-document construction.

Inserting one symbol of every document a round over whole documents takes as many passes over the
collection as its longest document has bytes. Here the strings of the collection are the regions around
anchors that occur again (see anchors.py): all windows with one anchor at one occurrence, so at most two
windows long. Regions with the same anchor stand on one line, and each round inserts one column from the right:
a stable sort by the new symbol is the next Burrows-Wheeler order, and the common prefixes of neighbours
follow from range minima of the round before. A window is repeated where a neighbour shares all of it.
Regions stream in anchor order, whole groups at a time; anchors in very many texts are compared window by
window through the shuffle instead, so that no group has to fit into memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import blocks as B
from quarry.llm.anchors import among, byte_anchors, repeated_anchors
from quarry.llm.common import keyed, ship, text_classes

HOT = 20_000
ROWS = 8192
OUT = "k long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
REGION = "h long, lead int, k long, at binary, body binary"  # at: where the text has it, 4 bytes each


def gathered(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array of the slices."""
    off = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    idx = np.arange(off[-1]) + np.repeat(starts - off[:-1], lengths)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(buf[idx]))])


def places(at: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(at.astype(np.int32))])


def other(buf: np.ndarray) -> np.ndarray:
    """Prefix sums with other values for the bytes."""
    return np.append(np.uint64(0), np.cumsum(B.mix(B.TABLE[buf]) * B.powers(len(buf))[0][: len(buf)], dtype=np.uint64))


def regions(window: int, kmer: int):
    def scan(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, _, buf, off in B.blocks(batch):
                sums, starts, text, place, kmers = byte_anchors(buf, off, window, kmer)
                if not len(starts):
                    continue
                hit = among(text, kmers[place], batch.column(2), i)
                s, t, p = starts[hit], text[hit], place[hit]
                hot = among(t, kmers[p], batch.column(3), i) if len(s) else hit[:0]
                if hot.any():  # a row for each window, by its own hash
                    plain = (sums[s[hot] + window] - sums[s[hot]]) * B.powers(len(sums))[1][s[hot]]
                    a, b = B.mix(plain), B.span_hash(other(buf), s[hot], s[hot] + window)
                    body = np.frombuffer(b.tobytes(), np.uint8)
                    yield pa.record_batch([pa.array(B.signed(a)), pa.array(np.full(len(a), -1, np.int32)), pa.array(keys[t[hot] + i]), places(s[hot] - off[t[hot]], np.arange(len(a) + 1)), gathered(body, np.arange(len(a)) * 8, np.full(len(a), 8))], ["h", "lead", "k", "at", "body"])
                    s, t, p = s[~hot], t[~hot], p[~hot]
                if len(s):
                    new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (t[1:] != t[:-1])))
                    last = s[np.append(new[1:], len(s)) - 1] + window
                    s, t, p = s[new], t[new], p[new]
                    kind = B.mix(B.span_hash(sums, s, last) + (p - s).astype(np.uint64)) ^ B.mix(t.astype(np.uint64))
                    order, cut = B.grouped(kind)  # a text sends equal regions once
                    at, one = places((s - off[t])[order], cut), order[cut[:-1]]
                    s, t, p, last = s[one], t[one], p[one], last[one]
                    yield pa.record_batch([pa.array(B.signed(kmers[p])), pa.array((p - s).astype(np.int32)), pa.array(keys[t + i]), at, gathered(buf, s, last - s)], ["h", "lead", "k", "at", "body"])

    return scan


def columns(group: np.ndarray, lead: np.ndarray, buf: np.ndarray, off: np.ndarray, window: int, kmer: int) -> np.ndarray:
    """For regions in order of group: flags[row, c], whether the window that starts at byte c of the
    region also starts in another region of the group. Rounds go from the last column to the first."""
    size = np.diff(off)
    left, width = int(lead.max()), int((size - lead).max())
    n = len(group)
    cells = np.zeros((n, left + width), np.uint16)  # 0: no byte here
    row = np.repeat(np.arange(n), size)
    cells[row, np.arange(len(buf)) - np.repeat(off[:-1] - left + lead, size)] = buf.astype(np.uint16) + 1
    cells = np.ascontiguousarray(cells.T)
    flags = np.zeros((n, left + 1), bool)
    order, base = np.arange(n), group.astype(np.int64) << 9
    shared = np.zeros(n + 1, np.int64)  # bytes in common with the row before in order
    for c in range(left + width - 1, -1, -1):
        if left <= c < left + kmer - 1 and c + 1 < left + width:  # within the anchor all symbols agree
            same = np.append(base[order][1:] == base[order][:-1], False)
            shared[1:][same] += 1
            if c > left:
                continue
        else:
            key = base[order] | cells[c][order]
            turn = np.argsort(key, kind="stable")
            least = np.minimum.reduceat(shared, turn + 1)
            key, order = key[turn], order[turn]
            goes = (key[1:] == key[:-1]) & ((key[1:] & 511) != 0)
            shared = np.zeros(n + 1, np.int64)
            shared[1:-1] = np.where(goes, least[:-1] + 1, 0)
        if c <= left:
            whole = shared >= window
            flags[order, c] = whole[:-1] | whole[1:]
    # from columns on the common line to bytes of each region
    c = np.arange(left + 1) + (left - lead)[:, None]
    return np.where(c <= left, np.take_along_axis(flags, np.minimum(c, left), 1), False)


def repeated(window: int, kmer: int):
    """Rows of REGION sorted by h and lead to (k, cover): byte intervals that repeated windows cover."""

    def compare(batch: pa.RecordBatch):
        h, lead = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        buf, off = B.raw(batch.column(4))
        body = B.span_hash(B.prefix(buf), off[:-1], off[1:])
        order = np.lexsort((body, lead, h))
        h_, l_, b_ = h[order], lead[order], body[order]
        new = np.append(True, (h_[1:] != h_[:-1]) | (l_[1:] != l_[:-1]) | (b_[1:] != b_[:-1]))
        start = np.flatnonzero(new)
        copies = np.diff(np.append(start, len(h)))
        one, which = order[start], np.empty(len(h), np.int64)  # a region of each kind; the kind of each
        which[order] = np.cumsum(new) - 1
        group = np.cumsum(np.append(True, h[one][1:] != h[one][:-1])) - 1
        mates = np.bincount(group)[group]
        flags = {}
        todo = np.flatnonzero(mates > 1)
        bounds = np.flatnonzero(np.append(True, group[todo][1:] != group[todo][:-1])) if len(todo) else todo
        while len(todo):
            cut = bounds[bounds <= ROWS][-1] if len(todo) > ROWS and (bounds[1:] <= ROWS).any() else (bounds[1] if len(todo) > ROWS and len(bounds) > 1 else len(todo))
            part, todo, bounds = todo[:cut], todo[cut:], bounds[bounds >= cut] - cut
            rows = one[part]
            sizes = off[rows + 1] - off[rows]
            o = np.append(0, np.cumsum(sizes))
            got = columns(group[part], lead[rows], buf[np.arange(o[-1]) + np.repeat(off[rows] - o[:-1], sizes)], o, window, kmer)
            r, c = np.nonzero(got)
            cuts = np.searchsorted(r, np.arange(len(part) + 1))
            flags |= {int(x): c[cuts[j] : cuts[j + 1]] for j, x in enumerate(part) if cuts[j + 1] > cuts[j]}
        k, (at, cuts) = batch.column(2).to_numpy(), B.raw(batch.column(3))
        at, cuts = at.view(np.int32), cuts // 4
        often = np.diff(cuts)
        full = (copies[which] > 1) | (often > 1)
        starts = at[np.repeat(full, often)]
        out_k, out_at = [np.repeat(k[full], often[full])], [np.stack([starts, starts + np.repeat(np.diff(off)[full], often[full])], 1)]
        for j in np.flatnonzero(~full):
            if (c := flags.get(int(which[j]))) is not None:
                first = np.flatnonzero(np.append(True, np.diff(c) > 1))
                last = np.append(first[1:], len(c)) - 1
                out_k.append(np.repeat(k[j], len(first)))
                out_at.append(np.stack([c[first], c[last] + window], 1) + at[cuts[j]])
        return np.concatenate(out_k), np.concatenate(out_at).astype(np.int32)

    def windows(batch: pa.RecordBatch, before: bool, after: bool):
        a, b = batch.column(0).to_numpy(), B.raw(batch.column(4))[0].view(np.uint64)
        same = np.append((a[1:] == a[:-1]) & (b[1:] == b[:-1]), after)
        again = same | np.append(before, same[:-1])
        at = B.raw(batch.column(3))[0].view(np.int32)[again]
        return batch.column(2).to_numpy()[again], np.stack([at, at + window], 1).astype(np.int32)

    def packed(k: np.ndarray, at: np.ndarray):
        order, cut = B.grouped(k)
        at, k = at[order], k[order]
        return pa.record_batch({"k": k[cut[:-1]], "cover": pa.array([at[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    def apply(batches):
        for batch, before, after in B.runs(batches, ["hot", "h"], lambda b: b.column(5)[0].as_py()):
            n = int((~batch.column(5).to_numpy(zero_copy_only=False)).sum())  # regions come first, then windows
            if n < batch.num_rows:
                yield packed(*windows(batch.slice(n), before and not n, after))
            if n:
                yield packed(*compare(batch.slice(0, n)))

    return apply


def cut_bytes(window: int):
    def apply(batches):
        for batch in batches:
            texts, copies, lists = (batch.column(n) for n in ("text", "copies", "cover"))
            out = {n: [] for n in ("n_bytes", "n_removed", "spans", "kept")}
            for i, text in enumerate(texts.cast(pa.large_binary())):
                text = text.as_py()
                n, spans, gone, kept = len(text), [], 0, text
                if copies[i].as_py() > 1:
                    if n >= window:
                        spans, gone, kept = [{"start": 0, "end": n}], n, b""
                elif lists[i].is_valid:
                    at = np.frombuffer(b"".join(lists[i].as_py()), np.int32).reshape(-1, 2)
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, at[:, 0], 1)
                    np.add.at(edge, at[:, 1], -1)
                    cover = np.cumsum(edge)[:n] > 0
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8))).reshape(-1, 2)
                    spans, gone = [{"start": int(a), "end": int(b)} for a, b in turns], int(cover.sum())
                    kept = np.frombuffer(text, np.uint8)[~cover].tobytes()
                for name, x in zip(out, (n, gone, spans, kept), strict=True):
                    out[name].append(x)
            span = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end")]))
            yield pa.record_batch([batch.column(0), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], span), pa.array(out["kept"], pa.binary())], ["k", "n_bytes", "n_removed", "spans", "kept"])

    return apply


def bytestring_dedup(docs: DataFrame, window: int = 200, kmer: int = 32, hot: int = HOT) -> DataFrame:
    """Remove each byte covered by a string of window bytes that also starts anywhere else.

    docs has doc_id and text; other columns are ignored. Returns doc_id, n_bytes, n_removed, spans
    (maximal removed runs, in bytes of the UTF-8) and kept (the other bytes; it may cut code points),
    a row for each row. A null text is empty; texts shorter than window keep all bytes. Repeated
    texts of window bytes or more lose all bytes, the first too. Null and repeated ids: see
    common.keyed; rows equal in id and text are one document. hot: regions around an anchor that more than so many texts have go as a
    row for each window, sorted by its 128-bit hash; the result does not depend on it.
    """
    ship(docs.sparkSession)
    kd, unique = keyed(docs)
    rows = kd if unique else kd.dropDuplicates(["k"])
    classes = text_classes(rows)
    text = rows.select("k", "text").repartition("k")
    own = classes.filter("k = rep").select("k")
    found = repeated_anchors(text.join(own, "k"), window, kmer, "byte", hot)
    sent = text.join(found, "k").select("k", "text", "anchors", "hot").mapInArrow(regions(window, kmer), REGION)
    sent = sent.withColumn("hot", F.col("lead") < 0)
    cover = sent.repartition("h").sortWithinPartitions("hot", "h", "body").mapInArrow(repeated(window, kmer), "k long, cover binary")
    cover = cover.groupBy("k").agg(F.collect_list("cover").alias("cover"))
    result = text.join(classes, "k").join(cover, "k", "left").select("k", "text", "copies", "cover").mapInArrow(cut_bytes(window), OUT)
    if unique:
        return result.withColumnRenamed("k", "doc_id")
    return kd.select("k", "doc_id").join(result, "k").drop("k")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import read

    out = bytestring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
