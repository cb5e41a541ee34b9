"""Alignment of two tokenizers over the same bytes.

Every byte of a text has an owner among the tokens of A and one among those of B. Where both owners change at
once, both tokenizers cut, and the bytes between two such cuts are a group. Tokens of A and B that share a group are linked.

Texts are cut before each space that follows no white space; both tokenizers cut there too, so a part is encoded and
aligned once and remembered. A block of texts becomes its documents as counts of parts, its parts as counts of
pairs, and its pairs with the number of its documents that hold them. Only these pairs are added up over
the corpus and sent back to their block, where the sums of documents are linear in their parts.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import blocks as B
from quarry.llm.common import ship, slim, written
from quarry.llm.packing import WIDE, encoder

BLOCK = 1 << 20  # bytes of text, or one longer text
CACHE = 150_000  # parts
SLICE = 1 << 22  # links that are spelt out at a time
ID_BITS, PAIR_BITS = 20, 40  # of a token id and of a pair of them
SOME = 4096  # parts or pairs of a row
LISTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
# Rows of a block: kind 0 a document with its parts (each as the step from the one before) and how often it has each; 1 some parts with the places of their pairs and the links of
# each; 2 some pairs with the number of documents that hold them. No row grows with the block.
ROW = "chunk long, kind int, at int, doc_id long, " + ", ".join(f"{n} long" for n in LISTS) + ", sha string, ids array<int>, n array<int>, links array<long>, sizes array<int>, a array<int>, b array<int>, docs array<int>"


def byte_level(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    shown = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174]
    byte = {chr(i): i for i in shown} | {chr(256 + n): i for n, i in enumerate(i for i in range(256) if i not in set(shown))}
    out = [b""] * (max(vocabulary.values()) + 1)
    for t, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
    return out


def piece_bytes(model) -> list[bytes]:
    """The bytes of each piece; U+2581 is a space and a byte piece its byte."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def pooled(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, size of each token, where it begins)."""
    size = np.array([len(x) for x in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), size, np.cumsum(size) - size


def owners(a_len: np.ndarray, b_len: np.ndarray):
    """(group of each A token, group of each B token, whether a byte begins a new pair of owners): tokens over the same bytes."""
    a, b = (np.repeat(np.arange(len(n)), n) for n in (a_len, b_len))
    new_a, new_b = a[1:] != a[:-1], b[1:] != b[:-1]
    group = np.append(0, np.cumsum(new_a & new_b))
    return group[np.cumsum(a_len) - a_len], group[np.cumsum(b_len) - b_len], np.append(True, new_a | new_b)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of n."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.add.reduceat(n, new)


def stretch(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin[0] ... begin[0] + size[0] - 1, begin[1] ..."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def linked(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((of the group, A id, B id) as one key, links) for all pairs of tokens of a group; equal ids of a group are counted
    before pairs are made, and pairs are made a slice at a time. of: a number of each group, below 2**23."""
    ka, na = summed(group_a.astype(np.int64) << ID_BITS | a, np.ones(len(a), np.int64))
    kb, nb = summed(group_b.astype(np.int64) << ID_BITS | b, np.ones(len(b), np.int64))
    g = ka >> ID_BITS
    bounds = np.searchsorted(kb >> ID_BITS, np.arange(len(of) + 1))
    begin, size = bounds[g], (bounds[1:] - bounds[:-1])[g]
    ends, keys, links = np.cumsum(size), [], []
    at = 0
    while at < len(ka):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        for low in range(0, int(size[at:to].max()), SLICE) or (0,):  # one A id with more B ids than a slice is cut too
            part = np.minimum(size[at:to] - low, SLICE).clip(0)
            i, j = np.repeat(np.arange(at, to), part), stretch(begin[at:to] + low, part)
            key, n = summed(of[g[i]].astype(np.int64) << PAIR_BITS | (ka[i] & (1 << ID_BITS) - 1) << ID_BITS | kb[j] & (1 << ID_BITS) - 1, na[i] * nb[j])
            keys.append(key)
            links.append(n)
        at = to
    return summed(np.concatenate(keys), np.concatenate(links)) if keys else (ka, na)


class Aligner:
    """Parts of texts, encoded by both tokenizers and aligned once each, up to CACHE of them."""

    def __init__(self, first: str, second: str):
        from sentencepiece import SentencePieceProcessor

        self.first, self.second = encoder(first), SentencePieceProcessor(model_file=second)
        first_bytes, second_bytes = byte_level(first), piece_bytes(self.second)
        self.pool_a, self.pool_b = pooled(first_bytes), pooled(second_bytes)
        spaced = any(b" " in p.lstrip(b" ") for p in second_bytes)
        self.texts = [f"{i}{x}" for i in range(max(len(first_bytes), len(second_bytes))) for x in ",|;"]
        self.widths = np.array([len(x) for x in self.texts])
        self.whole = spaced  # a piece with a space inside could span two parts: then texts are encoded whole
        self.forget()

    def forget(self):
        self.known, self.told = {}, []
        self.columns = {n: array("q") for n in (*LISTS, "ok", "begin", "n")}
        self.keys, self.links = array("q"), array("q")

    def learn(self, names: list, parts: list[bytes]):
        """Encode and align parts that are not known yet; each begins with a space."""
        texts = [p.decode("utf-8", "replace") for p in parts]
        got = [self.first(t) for t in texts], self.second.encode([t[1:] for t in texts], num_threads=1)
        if " " in texts:  # the space that a text ends with: the library adds none before nothing
            got[1][texts.index(" ")] = [self.second.piece_to_id("▁")]
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in got)
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in zip(got, (n_a, n_b), strict=True))
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        buf = np.frombuffer(b"".join(parts), np.uint8)
        ok = self.spelt(self.pool_a, a, n_a, buf, length) & self.spelt(self.pool_b, b, n_b, buf, length)
        if not ok.all():  # those that tokens do not spell have none
            a, b, n_a, n_b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)], n_a * ok, n_b * ok
        size_a, size_b = self.pool_a[1], self.pool_b[1]
        group_a, group_b, begins = owners(size_a[a], size_b[b]) if len(a) else (a, b, np.zeros(0, bool))
        count = int(group_a[-1]) + 1 if len(a) else 0
        m, n = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
        part_of_a = np.repeat(np.arange(len(parts)), n_a)
        last_a, last_b = np.cumsum(m) - 1, np.cumsum(n) - 1
        of = part_of_a[last_a]
        per = lambda w: np.bincount(of, w, minlength=len(parts)).astype(np.int64)
        byte_part = np.repeat(part_of_a, size_a[a])
        columns = {"n_a": n_a, "n_b": n_b, "n_groups": per(np.ones(count)), "n_links": per((m * n).astype(float)), "n_overlaps": np.bincount(byte_part[begins], minlength=len(parts)), "ok": ok.astype(np.int64)}
        keys, links = linked(group_a, a, group_b, b, of)
        cut = np.searchsorted(keys >> PAIR_BITS, np.arange(len(parts) + 1))
        columns |= {"begin": cut[:-1] + len(self.keys), "n": np.diff(cut)}
        for name, values in columns.items():
            self.columns[name].frombytes(np.ascontiguousarray(values, np.int64).tobytes())
        self.keys.frombytes((keys & (1 << PAIR_BITS) - 1).tobytes())
        self.links.frombytes(links.tobytes())
        # ids as text, each with what follows it: a comma, or behind the last of its group a bar or a semicolon
        shown = np.empty(len(a) + len(b), np.int64)
        before = np.cumsum(m + n) - (m + n)
        place_a = before[group_a] + np.arange(len(a)) - (last_a - m + 1)[group_a]
        place_b = (before + m)[group_b] + np.arange(len(b)) - (last_b - n + 1)[group_b]
        shown[place_a], shown[place_b] = a * 3, b * 3
        shown[place_a[last_a]] += 1
        shown[place_b[last_b]] += 2
        big = "".join(map(self.texts.__getitem__, shown.tolist()))
        ends = np.append(0, np.cumsum(self.widths[shown]))[np.append(0, np.cumsum(n_a + n_b))].tolist()
        first = len(self.told)
        self.known.update(zip(names, range(first, first + len(names)), strict=True))
        self.told += [big[x : y - 1] for x, y in zip(ends, ends[1:], strict=False)]

    @staticmethod
    def spelt(pool, ids: np.ndarray, n: np.ndarray, buf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the bytes of the ids of each part are the part."""
        data, size, begin = pool
        of = np.repeat(np.arange(len(n)), n)
        ok = np.bincount(of, size[ids], minlength=len(n)) == length
        ids, has = ids[ok[of]], ok[np.repeat(np.arange(len(n)), length)]
        wrong = data[stretch(begin[ids], size[ids])] != buf[has]
        ok[np.repeat(np.arange(len(n)), length)[has][wrong]] = False
        return ok

    def parts(self, buf: np.ndarray, off: np.ndarray):
        """(bytes with a space before each text, starts and ends of the parts, first part of each text)."""
        n = np.diff(off)
        off = np.append(0, np.cumsum(n + (n > 0)))
        out = np.full(off[-1], 0x20, np.uint8)
        out[stretch(off[:-1] + (n > 0), n)] = buf
        cut = np.zeros(len(out) + 1, bool)
        if not self.whole:
            cut[1:-1] = (out[1:] == 0x20) & ~B.SPACE[out[:-1]]
            raw = out.tobytes()
            for wide in WIDE:  # texts with other white space are taken whole
                at = raw.find(wide)
                while at >= 0:
                    i = int(np.searchsorted(off, at, "right")) - 1
                    cut[off[i] : off[i + 1]] = False
                    at = raw.find(wide, int(off[i + 1]))
        cut[off[:-1][n > 0]] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        return out, starts, np.append(starts[1:], len(out)), np.searchsorted(starts, off)

    def block(self, buf: np.ndarray, off: np.ndarray) -> dict:
        """What the texts of a block say: the columns of its row."""
        out, starts, ends, first = self.parts(buf, off)
        texts = len(off) - 1
        h = B.span_hash(B.prefix(out), starts, ends) ^ B.mix((ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
        uniq, at, which = np.unique(h, return_index=True, return_inverse=True)
        names, raw = uniq.tolist(), out.tobytes()
        if len(self.known) > CACHE:
            self.forget()
        new = [i for i, x in enumerate(names) if x not in self.known]
        for k in range(0, len(new), 1 << 20):
            self.learn([names[i] for i in new[k : k + (1 << 20)]], [raw[starts[at[i]] : ends[at[i]]] for i in new[k : k + (1 << 20)]])
        mine = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        col = {n: np.frombuffer(x, np.int64)[mine] if len(mine) else np.zeros(0, np.int64) for n, x in self.columns.items()}
        doc = np.repeat(np.arange(texts), np.diff(first))
        good = np.ones(texts, bool)
        good[doc[col["ok"][which] == 0]] = False
        good &= np.diff(first) > 0
        use = good[doc]
        seen, n = summed(doc[use] << 32 | which[use], np.ones(int(use.sum()), np.int64))
        d, p = seen >> 32, seen & (1 << 32) - 1
        total = {name: np.bincount(d, col[name][p] * n, minlength=texts).astype(np.int64) for name in LISTS}
        told, sha = [self.told[i] for i in mine.tolist()], []
        for i in range(texts):
            sha.append(hashlib.sha256(";".join([told[x] for x in which[first[i] : first[i + 1]].tolist()]).encode()).hexdigest() if good[i] else "")
        keys, links = (np.frombuffer(x, np.int64)[stretch(col["begin"], col["n"])] if len(mine) else np.zeros(0, np.int64) for x in (self.keys, self.links))
        pairs, pair = np.unique(keys, return_inverse=True)
        pair_off = np.append(0, np.cumsum(col["n"]))
        held = np.unique(np.repeat(d, col["n"][p]) * max(1, len(pairs)) + pair[stretch(pair_off[:-1][p], col["n"][p])])  # each pair once a document
        docs = np.bincount(held % max(1, len(pairs)), minlength=len(pairs))
        return total | {"sha": sha, "part_off": np.searchsorted(d, np.arange(texts + 1)), "part": p, "part_n": n, "pair_off": pair_off, "pair": pair, "pair_n": links, "a": pairs >> ID_BITS, "b": pairs & (1 << ID_BITS) - 1, "docs": docs}


def lists(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off - off[0], pa.int32()), pa.array(values[off[0] : off[-1]], kind))


def stepped(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Values as steps from the one before in each list, which are small where values are in order."""
    out = np.diff(values, prepend=0)
    first = off[:-1][np.diff(off) > 0]
    out[first] = values[first]
    return out


def unstepped(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps)
    first = np.cumsum(sizes) - sizes
    before = np.append(0, total)[first]
    return total - np.repeat(before, sizes)


def rows_of(chunk: int, doc_id: pa.Array, of: dict):
    """The rows of a block as record batches."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    fields = [(n, kinds[k]) for n, k in (f.split(" ") for f in ROW.split(", "))]

    def batch(kind: int, size: int, **told) -> pa.RecordBatch:
        told |= {"chunk": pa.array(np.full(size, chunk)), "kind": pa.array(np.full(size, kind, np.int32)), "at": pa.array(np.arange(size, dtype=np.int32))}
        return pa.record_batch([told.get(name, pa.nulls(size, type_)) for name, type_ in fields], [name for name, _ in fields])

    yield batch(0, len(doc_id), doc_id=doc_id, sha=pa.array(of["sha"], pa.string()), ids=lists(stepped(of["part"], of["part_off"]), of["part_off"], pa.int32()), n=lists(of["part_n"], of["part_off"], pa.int32()), **{n: pa.array(of[n], pa.int64()) for n in LISTS})
    parts = np.append(np.arange(0, len(of["pair_off"]) - 1, SOME), len(of["pair_off"]) - 1)
    off = of["pair_off"][parts]
    yield batch(1, len(parts) - 1, ids=lists(of["pair"], off, pa.int32()), links=lists(of["pair_n"], off, pa.int64()), sizes=lists(np.diff(of["pair_off"]), parts, pa.int32()))
    pairs = np.append(np.arange(0, len(of["a"]), SOME), len(of["a"]))
    yield batch(2, len(pairs) - 1, **{n: lists(of[n], pairs, pa.int32()) for n in ("a", "b", "docs")})


def scan(first: str, second: str):
    def run(batches):
        aligner, chunk = Aligner(first, second), TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, buf, off in B.blocks(batch, size=BLOCK):
                chunk += 1
                yield from rows_of(chunk, batch.column(0).slice(i, j - i), aligner.block(buf, off))
        del aligner
        slim()

    return run


def settle(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one block, from its rows of kind 0 and 1 and the counts of its pairs (pos, c, best)."""
    order = np.argsort(right.column("pos").to_numpy())
    c, best = (right.column(n).to_numpy(zero_copy_only=False)[order] for n in ("c", "best"))
    left = left.sort_by([("kind", "ascending"), ("at", "ascending")]).combine_chunks()
    cut = int(np.searchsorted(left.column("kind").to_numpy(), 1))
    docs, parts = left.slice(0, cut), left.slice(cut)

    def flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        if not table.num_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        column = table.column(name).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())

    (pair, _), (links, _), (sizes, _) = (flat(parts, n) for n in ("ids", "links", "sizes"))
    (steps, per_doc), (times, _) = flat(docs, "ids"), flat(docs, "n")
    part = unstepped(steps, per_doc)
    of_part, of_doc = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(docs.num_rows), per_doc)

    def over(w: np.ndarray) -> np.ndarray:
        by_part, by_doc = np.zeros(len(sizes), np.int64), np.zeros(docs.num_rows, np.int64)
        np.add.at(by_part, of_part, w[pair] * links)
        np.add.at(by_doc, of_doc, by_part[part] * times)
        return by_doc

    out = {n: docs.column(n) for n in ("doc_id", *LISTS)} | {"n_best": over(best.astype(np.int64)), "count_sum": over(c), "groups_sha256": docs.column("sha")}
    return pa.table({n: x if isinstance(x, pa.ChunkedArray) else pa.array(x, pa.int64()) for n, x in out.items()})


def align(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Align the tokens of two tokenizers in every text and count their links over all documents.

    docs has doc_id (a whole number) and text; other columns are ignored. first is a byte-level tokenizer file that gets a space and
    the text, second a sentencepiece model that gets the text and adds the space itself; all executors have both. Special tokens are
    ordinary text. Returns a row for each row: doc_id, n_a and n_b (tokens), n_groups, n_links, n_overlaps (pairs of tokens that share
    bytes), n_best (links whose count is the highest of their A id in the corpus, ties included), count_sum (of the counts of links) and
    groups_sha256. The count of a pair of ids is the number of rows that hold it linked. A null or empty text, and
    one whose tokens do not spell it (it holds U+2581), has no tokens: zeros and ''. Every row is a document of its own, so a null or
    repeated id and equal rows need no rule. An empty table gives no rows. No text is cut: one over BLOCK bytes is a block by itself.
    """
    ship(docs.sparkSession)
    rows = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan(first, second), ROW))
    pairs = rows.filter("kind = 2").select("chunk", "at", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("i", "p"))
    pairs = pairs.select("chunk", (F.col("at") * SOME + F.col("i")).alias("pos"), "p.a", "p.b", "p.docs")
    counts = written(pairs.groupBy("a", "b").agg(F.sum("docs").alias("c")))
    most = counts.groupBy("a").agg(F.max("c").alias("most"))  # at most a row for each id of the first vocabulary
    counts = counts.join(F.broadcast(most), "a").select("a", "b", "c", (F.col("c") == F.col("most")).alias("best"))
    back = pairs.select(F.col("chunk").alias("of"), "pos", "a", "b").join(counts, ["a", "b"]).select("of", "pos", "c", "best")
    out = "doc_id long, " + ", ".join(f"{n} long" for n in LISTS) + ", n_best long, count_sum long, groups_sha256 string"
    return rows.filter("kind < 2").drop("a", "b", "docs").groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(settle, out)


def op13_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm.common import read

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
