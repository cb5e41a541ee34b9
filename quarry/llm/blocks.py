"""Vectorised hashing of texts held in Arrow buffers: words, word windows and byte windows.

A block is the concatenated UTF-8 of some whole texts with their offsets. Hashes are polynomial
over a table of odd random values modulo 2**64, taken from prefix sums and then mixed, so each costs
a few array operations a byte, whatever the window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_R = np.random.default_rng(20240229)
TABLE = _R.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
P = np.uint64(0x9E3779B97F4A7C15)
P_INV = np.uint64(pow(int(P), -1, 2**64))
Q = np.uint64(0xC2B2AE3D27D4EB4F)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
POS_BITS = np.uint64(28)
POS_MASK = np.uint64((1 << 28) - 1)
BLOCK = 1 << 21
RUN = 200_000
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        m = max(n, BLOCK + 1024)
        for name, base in (("p", P), ("q", P_INV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets from 0; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def blocks(batch: pa.RecordBatch, name: str = "text", size: int = BLOCK):
    """(rows from, rows to, bytes, offsets) over whole texts, of about size bytes or one longer text."""
    buf, off = raw(batch.column(batch.schema.get_field_index(name)))
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and one past the last) of the words [^\\x20\\x09-\\x0D]+."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(TABLE[buf] * powers(len(buf))[0][: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def word_hashes(buf: np.ndarray, off: np.ndarray, lower: bool = False):
    """(hash of each word, first word of each text ...)."""
    if lower:
        buf = LOWER[buf]
    starts, ends, first = word_spans(buf, off)
    return span_hash(prefix(buf), starts, ends), first


def rolled(h: np.ndarray, k: int, mixed: bool = True, q: np.uint64 = Q) -> np.ndarray:
    """Hash of each run of k items: sum of h[i + j] * q**j, by doubling; len(h) - k + 1 values."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, done, power, have = None, 0, q, h
    width, step, scale = 1, int(q), 1
    bits = k
    while bits:
        if bits & 1:
            if out is None:
                out, done, scale = have, width, step
            else:
                m = min(len(out), len(have) - done)
                out = out[:m] + have[done : done + m] * np.uint64(scale)
                scale = scale * step % 2**64
                done += width
        bits >>= 1
        if bits:
            have = have[:-width] + have[width:] * np.uint64(step)
            step = step * step % 2**64
            width *= 2
    out = out[: len(h) - k + 1]
    return mix(out) if mixed else out


def leftmost_min(keys: np.ndarray, w: int, most: int = 1 << 28) -> np.ndarray:
    """Place of the smallest of each w consecutive keys, the leftmost of equals; len(keys) - w + 1 places.
    Keys are compared by their upper 36 bits, which equal windows share; places have the other 28, so more keys than
    that are taken a stretch at a time."""
    if len(keys) > most:
        step = most - w + 1
        return np.concatenate([at + leftmost_min(keys[at : at + most], w, most) for at in range(0, len(keys) - w + 1, step)])
    v = (keys & ~POS_MASK) | np.arange(len(keys), dtype=np.uint64)
    width = 1
    while width * 2 <= w:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < w:
        v = np.minimum(v[: len(v) - (w - width)], v[w - width :])
    return (v & POS_MASK).astype(np.int64)


def inside_texts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, text) of the runs of k items that lie within one text."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    starts = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    return starts, text


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts) that bring equal integers together; starts ends with len(keys)."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    return order, np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64), len(s))


def runs(batches, keys: list[str], divisible=lambda batch: True, most: int | None = None):
    """Record batches of rows sorted by keys, cut anew so that equal keys stay together; with (batch, goes
    on from the one before, goes on in the next). Only divisible runs of over most (RUN) rows are cut."""
    held, most = None, most or RUN

    def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in keys)

    before = False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is None:
            held = batch
            continue
        if not same(held, held.num_rows - 1, batch, 0):
            yield held, before, False
            held, before = batch, False
            continue
        cols = [held.column(k).to_numpy(zero_copy_only=False) for k in keys]
        differs = np.zeros(held.num_rows, bool)
        for c in cols:
            differs[:-1] |= c[:-1] != c[1:]
        cut = np.flatnonzero(differs)
        if len(cut):  # the last run of held moves on to the next batch
            at = int(cut[-1]) + 1
            yield held.slice(0, at), before, False
            held, before = pa.Table.from_batches([held.slice(at), batch]).combine_chunks().to_batches()[0], False
        elif held.num_rows < most or not divisible(held):
            held = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        else:
            yield held, before, True
            held, before = batch, True
    if held is not None:
        yield held, before, False
