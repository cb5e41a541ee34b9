"""Best-fit packing by linear grouping.

Documents become tokens once; from then on only lengths move. What remains of a document after its full
sequences is an item of 1 to capacity - 1 tokens, so the items are a histogram of bounded size.
The plan is made on it: large items fall into groups of equal cardinality and count at the longest of their
group, configurations of a few group sizes are optimised against the counts, and as actual items take the
places of a group's, from the longest, what they leave free becomes known. Small items then go, longest first, where they
fit best. The plan is a list of configurations with counts; items find their place by rank.
"""

from __future__ import annotations

import bisect
import itertools
import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import blocks as B
from quarry.llm.common import keyed, ship, written

SALTS = 64  # at least, of the pieces of one length
GROUPS = (48, 96)  # of large items, of equal cardinality
LIMITS = (1 / 4, 1 / 3, 1 / 2)  # shares of the capacity beyond which an item is large
WASTES = (0, 2, 8, None)  # tokens free in a sequence beyond which its items are packed again
CACHE = 200_000
WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")  # white space beyond ASCII
PIECES = "k long, piece int, start long, length int, ids_crc32 long"


# Fixed value: how byte-level tokenizers cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str):
    """A function from a text to its token ids, special tokens being ordinary text.

    A byte-level file whose ids follow the order of its merges is read into the quicker of two
    libraries, which give the same ids; any other file is left to the library it is made for."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, cut = told["model"], told.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not told.get("normalizer")
    vocabulary = model.get("vocab", {})
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    ids = [vocabulary.get(a + b, -1) for a, b in pairs]
    if plain and ids == list(range(256, 256 + len(ids))):
        import tiktoken

        shown = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174]
        byte = {chr(i): i for i in shown} | {chr(256 + n): i for n, i in enumerate(i for i in range(256) if i not in set(shown))}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(ids)}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


def marked(path: str):
    """The file's added tokens as bytes, and a function from a text to its ids as the library gives them, added tokens being themselves."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    marks = [t.content.encode() for t in found.get_added_tokens_decoder().values() if t.content]
    return marks, lambda text: found.encode(text, add_special_tokens=False).ids


class Encoder:
    """Token ids of texts. The tokenizer never joins a character with white space after it, so a text is cut before
    each run of ASCII white space and each different part is encoded once and remembered, up to CACHE of them. With added, a text that holds an added
    token of the file goes to the library whole."""

    def __init__(self, path: str, added: bool = False):
        self.encode = encoder(path)
        self.marks, self.whole = marked(path) if added else ((), None)
        self.forget()

    def forget(self):
        self.known, self.pool, self.begin, self.size = {}, array("I"), array("q"), array("q")

    def parts(self, buf: np.ndarray, off: np.ndarray):
        """(part hashes, starts, ends, first part of each text)."""
        n = len(buf)
        gap = B.SPACE[buf]
        cut = np.zeros(n + 1, bool)
        cut[1:-1] = gap[1:] & ~gap[:-1]
        cut[off] = True
        cut[n] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        return B.span_hash(B.prefix(buf), starts, ends) ^ B.mix((ends - starts).astype(np.uint64)), starts, ends, np.searchsorted(starts, off)

    def block(self, buf: np.ndarray, off: np.ndarray):
        """The ids of each text of the block."""
        h, starts, ends, first = self.parts(buf, off)
        uniq, at, which = np.unique(h, return_index=True, return_inverse=True)
        keys = uniq.tolist()
        if len(self.known) > CACHE:
            self.forget()
        raw = buf.tobytes()
        for i, x in enumerate(keys):
            if x not in self.known:
                ids = self.encode(raw[starts[at[i]] : ends[at[i]]].decode("utf-8", "replace"))
                self.known[x] = len(self.begin)
                self.begin.append(len(self.pool))
                self.size.append(len(ids))
                self.pool.extend(ids)
        mine = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        begin, size, pool = (np.array(x) for x in (self.begin, self.size, self.pool))
        begin, size = begin[mine], size[mine]
        n = size[which]
        idx = np.arange(n.sum()) + np.repeat(begin[which] - (np.cumsum(n) - n), n)
        out = pool[idx] if len(idx) else np.zeros(0, np.uint32)
        bounds = np.append(0, np.cumsum(n))[first]
        for i in range(len(off) - 1):
            text = raw[off[i] : off[i + 1]]
            if any(x in text for x in self.marks):
                yield np.array(self.whole(text.decode("utf-8", "replace")), np.uint32)
            elif any(x in text for x in WIDE):
                yield np.array(self.encode(text.decode("utf-8", "replace")), np.uint32)
            else:
                yield out[bounds[i] : bounds[i + 1]]


def cut_up(path: str, capacity: int, end: int, added: bool):
    def scan(batches):
        enc = Encoder(path, added)
        for batch in batches:
            keys, rows = batch.column(0).to_numpy(), []
            for i, _, buf, off in B.blocks(batch):
                for j, ids in enumerate(enc.block(buf, off)):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    start = 0
                    for piece in range(-(-len(ids) // capacity)):
                        n = first if piece == 0 else capacity
                        rows.append((keys[i + j], piece, start, n, zlib.crc32(ids[start : start + n])))
                        start += n
            k, piece, start, n, crc = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch({"k": pa.array(k, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(n, pa.int32()), "ids_crc32": pa.array(crc, pa.int64())})

    return scan


def grouped(counts: dict[int, int], large: int, n: int) -> list[dict[int, int]]:
    """Items of at least large, longest first, in n groups of equal cardinality: {length: items} each. Groups of one
    longest length are one: a length of many items fills several."""
    todo = [[s, counts[s]] for s in sorted(counts, reverse=True) if s >= large and counts[s]]
    total = sum(c for _, c in todo)
    per, out = max(1, -(-total // n)), []
    room = 0
    for s, c in todo:
        while c:
            if not room:
                out.append({})
                room = per
            x = min(c, room)
            out[-1][s] = out[-1].get(s, 0) + x
            c, room = c - x, room - x
    one: list[dict[int, int]] = []
    for g in out:
        if one and max(one[-1]) == max(g):
            for s, x in g.items():
                one[-1][s] = one[-1].get(s, 0) + x
        else:
            one.append(g)
    return one


def worthiest(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of most worth and that worth: an unbounded knapsack, by the number of its items."""
    lengths = np.arange(capacity + 1)
    single, which = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    np.maximum.at(single, sizes, worth)
    which[sizes[np.lexsort((-np.arange(len(sizes)), worth))]] = np.lexsort((-np.arange(len(sizes)), worth))  # of equal sizes the worthiest
    used, at = single[sizes.min() :], lengths[sizes.min() :]
    used, at = used[used > 0], at[used > 0]
    best, chosen = [np.zeros(capacity + 1)], []
    if len(at):
        for _ in range(capacity // int(at[0])):
            room = lengths[at[0] :, None] - at[None, :]
            values = np.where(room >= 0, best[-1][np.maximum(room, 0)] + used[None, :], -np.inf)
            pick = values.argmax(1)
            top = values[np.arange(len(pick)), pick]
            new, take = best[-1].copy(), np.full(capacity + 1, -1)
            better = top > new[at[0] :] + 1e-12
            new[at[0] :][better], take[at[0] :][better] = top[better], at[pick[better]]
            if not better.any():
                break
            best.append(new)
            chosen.append(take)
    out, left = np.zeros(len(sizes)), capacity
    for take in reversed(chosen):
        if take[left] >= 0:
            out[which[take[left]]] += 1
            left -= take[left]
    return out, float(best[-1][capacity])


def configurations(groups: list[dict[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole configurations of groups (with how many sequences), of a least number of sequences for all items.

    An item counts at the longest of its group. The linear program over all configurations is solved by column generation:
    the duals of the present basis price groups, a knapsack finds the worthiest configuration, and it enters until none is
    worth more than one sequence. What fractions leave is solved too: the program's configurations, largest fraction
    first, take it while they can be filled; the rest is for best fit."""
    if not groups:
        return []
    sizes, need = np.array([max(g) for g in groups]), np.array([sum(g.values()) for g in groups], np.int64)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / basis.diagonal())
    apart = need * (1 + 1e-7 * np.arange(1, len(need) + 1) / len(need))  # groups are equal, so that steps of no length would abound
    amount = inverse @ apart
    for i in itertools.count(1):
        new, top = worthiest(sizes, inverse.sum(0), capacity)
        if top <= 1 + 1e-6:
            break
        if i > 1000 * (len(sizes) + 10):
            raise RuntimeError("the linear program of configurations does not end")
        step = inverse @ new
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = new
        if i % 100 == 0:
            inverse = np.linalg.inv(basis)
            amount = np.maximum(inverse @ apart, 0)
            continue
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    whole = np.floor(amount + 1e-4).astype(np.int64)
    left = need - (basis @ whole).astype(np.int64)
    for j in np.argsort(whole - amount, kind="stable"):
        while whole[j] and (left < 0).any():  # a rounding error took one too many
            if not (basis[:, j] * (left < 0)).any():
                break
            whole[j] -= 1
            left = left + basis[:, j].astype(np.int64)
    for j in np.argsort(whole - amount, kind="stable"):
        while (left >= basis[:, j]).all():
            whole[j] += 1
            left = left - basis[:, j].astype(np.int64)
    return [(tuple(i for i in range(len(sizes)) for _ in range(int(basis[i, j]))), int(whole[j])) for j in range(len(basis)) if whole[j]]


def substituted(shapes: list[tuple[tuple[int, ...], int]], groups: list[dict[int, int]]) -> tuple[dict[tuple[int, ...], int], dict[int, int]]:
    """({lengths in a sequence: sequences like it}, {length: items left}): actual items in the places of their groups,
    from the longest; places that no item is left for stay free."""
    stock = [[list(x) for x in sorted(g.items())] for g in groups]  # the longest last
    open_: dict[tuple[int, ...], int] = {}
    for c, times in shapes:
        while times:
            heads = {i: stock[i][-1] for i in set(c) if stock[i]}
            run = min([times] + [x[1] // c.count(i) for i, x in heads.items()])
            if run and len(heads) == len(set(c)):  # as many sequences alike as the heads of the stock allow
                lengths = [heads[i][0] for i in c]
                for i, x in heads.items():
                    x[1] -= run * c.count(i)
            else:  # a length runs out within this sequence
                run, lengths = 1, []
                for i in c:
                    while stock[i] and not stock[i][-1][1]:
                        stock[i].pop()
                    if stock[i]:
                        lengths.append(stock[i][-1][0])
                        stock[i][-1][1] -= 1
            for i in set(c):
                while stock[i] and not stock[i][-1][1]:
                    stock[i].pop()
            key = tuple(sorted(lengths, reverse=True))
            open_[key] = open_.get(key, 0) + run
            times -= run
    left: dict[int, int] = {}
    for g in stock:
        for s, n in g:
            left[s] = left.get(s, 0) + n
    return {c: n for c, n in open_.items() if c}, left


def plan(counts: dict[int, int], capacity: int, groups: tuple[int, ...] = GROUPS, limits: tuple[float, ...] = LIMITS) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one sequence, sequences like it)] that hold exactly counts items of each length.

    Items over a share of the capacity are grouped. Rounding lengths up leaves room where small items are few, so sequences with
    more than some waste are taken apart again and best fit packs their items. All limits, numbers of groups and wastes are
    tried and the plan of fewest sequences stays, the first of equals. The work depends on the number of lengths and groups, not of items."""
    best = None
    for limit, n in sorted({(int(capacity * x) + 1, n) for x in limits for n in groups}):
        found = grouped(counts, limit, n)
        open_, left = substituted(configurations(found, capacity), found)
        for s, x in counts.items():
            if s < limit and x:
                left[s] = left.get(s, 0) + x
        first = best_fit(open_, left, capacity)
        for waste in WASTES:
            steps = first if waste is None else again(first, waste, capacity)
            if best is None or sum(x for _, x in steps) < sum(x for _, x in best):
                best = steps
    return best


def again(steps: list[tuple[tuple[int, ...], int]], waste: int, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The steps that leave no more than waste free, and the items of the others by best fit."""
    loose: dict[int, int] = {}
    for c, n in steps:
        if capacity - sum(c) > waste:
            for s in c:
                loose[s] = loose.get(s, 0) + n
    return [(c, n) for c, n in steps if capacity - sum(c) <= waste] + best_fit({}, loose, capacity)


def best_fit(open_: dict[tuple[int, ...], int], small: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Put small items, longest first, each where the least room is left after it; many alike at once."""
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    for c, n in open_.items():
        by_room.setdefault(capacity - sum(c), {})[c] = n
    rooms = sorted(by_room)
    for s in sorted(small, reverse=True):
        left = small[s]
        while left:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                fit = capacity // s
                c, n = ((s,) * fit, left // fit) if left >= fit else ((s,) * left, 1)
                left -= len(c) * n
                rest = capacity - s * len(c)
            else:
                room = rooms[i]
                was, n = by_room[room].popitem()
                use = min(n, left)
                if n > use:
                    by_room[room][was] = n - use
                if not by_room[room]:
                    del by_room[room], rooms[i]
                c, n, rest = (*was, s), use, room - s
                left -= use
            if rest not in by_room:
                by_room[rest] = {}
                bisect.insort(rooms, rest)
            by_room[rest][c] = by_room[rest].get(c, 0) + n
    return [(c, n) for room in sorted(by_room) for c, n in sorted(by_room[room].items())]


def places(steps: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (rank from, sequence from, offset) in order of rank: the item of rank r in a
    row is in sequence r - rank from + sequence from."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    base = 0
    for c, n in steps:
        offset = 0
        for s in c:
            r = used.get(s, 0)
            out.setdefault(s, []).append((r, base, offset))
            used[s] = r + n
            offset += s
        base += n
    return {s: np.array(x, np.int64) for s, x in out.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, added: bool = False) -> DataFrame:
    """Pack every document into sequences of at most capacity tokens.

    docs has doc_id and text; other columns are ignored. tokenizer is the path of a tokenizer file
    that all executors have; its added tokens are ordinary text, or with added have their own ids, as the library gives by default. Returns a row for each piece: doc_id, piece, start (ids of the document before
    it), length, ids_crc32 (of its ids as little-endian unsigned 32-bit), sequence_id (negative: a full piece) and offset in the sequence. A
    null or empty text is the end id alone. Only documents over capacity are cut, so that all pieces but
    the first are full. Null and repeated ids: see common.keyed; rows equal in id and text are each packed.
    """
    ship(docs.sparkSession)
    kd, unique = keyed(docs)
    if not unique:  # each row is packed: number the rows of one key
        kd = kd.withColumn("again", F.row_number().over(Window.partitionBy("k").orderBy("text")))
        kd = written(kd.withColumn("key", F.col("k") * (kd.agg(F.max("again")).first()[0] or 1) + F.col("again")))
        names, kd = kd.select(F.col("key").alias("k"), "doc_id"), kd.select(F.col("key").alias("k"), "text")
    pieces = written(kd.select("k", "text").mapInArrow(cut_up(tokenizer, capacity, end, added), PIECES))
    salts = max(SALTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.filter(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("k", "piece"), F.lit(salts)))
    tally = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    tally = written(tally.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))))
    counts = {r[0]: r[1] for r in tally.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    steps = plan(counts, capacity)
    table = places(steps)
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("k", "piece")) - 1

    def put(batches):
        for batch in batches:
            length, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            seq, offset = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            order, cut = B.grouped(length)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                rows = order[a:b]
                t = table[int(length[rows[0]])]
                at = np.searchsorted(t[:, 0], r[rows], "right") - 1
                seq[rows], offset[rows] = t[at, 1] + r[rows] - t[at, 0], t[at, 2]
            yield pa.record_batch([pa.array(seq), pa.array(offset), *batch.columns[2:], batch.column(0)], ["sequence_id", "offset", "k", "piece", "start", "ids_crc32", "length"])

    ranked = salted.join(tally.select("length", "salt", "before"), ["length", "salt"]).withColumn("r", rank + F.coalesce("before", F.lit(0)))
    placed = ranked.select("length", F.col("r").cast("long"), "k", "piece", "start", "ids_crc32").mapInArrow(put, "sequence_id long, offset long, k long, piece int, start long, ids_crc32 long, length int")
    whole = pieces.filter(F.col("length") == capacity)  # a full piece is a sequence by itself
    whole = whole.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    placed = placed.unionByName(whole).select("k", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
    if unique:
        return placed.withColumnRenamed("k", "doc_id")
    return names.join(placed, "k").drop("k")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm.common import read

    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), added=True)
