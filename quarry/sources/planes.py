"""Packed planes as strips: rows of samples that begin and end on a byte, unpacked apart from each other."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIP = 1 << 18  # packed bytes of a strip, about
MOST = 1 << 20  # samples of strips that are unpacked together
OUT = "strip int, first_row int, rows int, n long, low int, high int, total long, samples binary"


def rows_of_strip(width: Column, bits: Column, most: int) -> Column:
    """How many rows a strip has: at least so many that it ends on a byte, else as many as most bytes hold."""
    whole = F.array(*[F.lit(8 // math.gcd(8, i)) for i in range(8)])[F.pmod(width * bits, F.lit(8)).cast("int")]
    return (whole * F.greatest(F.floor(F.lit(most) * 8 / (width * bits * whole)), F.lit(1))).cast("int")


def strips(planes: DataFrame, key: str = "path", most: int = STRIP) -> DataFrame:
    """(key, width, bits, byte_order, strip, first_row, rows, packed) of planes (key, width, height, bits, byte_order, content). A plane that
    is too short gives the whole rows that it has; one without a size, bits or content gives none."""
    bits = F.col("width").cast("long") * F.col("bits")
    there = F.least(F.col("height").cast("long"), F.floor(F.octet_length("content").cast("long") * 8 / bits)).cast("int")
    p = planes.filter("width > 0 AND bits > 0 AND bits <= 16 AND content IS NOT NULL").withColumns({"_have": there, "_per": rows_of_strip(F.col("width").cast("long"), F.col("bits"), most)}).filter("_have > 0")
    p = p.withColumn("first_row", F.explode(F.sequence(F.lit(0), F.col("_have") - 1, F.col("_per"))))
    rows = F.least(F.col("_per"), F.col("_have") - F.col("first_row"))
    begin, size = (F.col("first_row") * bits / 8).cast("int"), F.ceil(rows * bits / 8).cast("int")
    return p.select(key, "width", "bits", "byte_order", (F.col("first_row") / F.col("_per")).cast("int").alias("strip"), "first_row", rows.alias("rows"), F.substr("content", begin + 1, size).alias("packed"))


def samples(data: np.ndarray, begin: np.ndarray, n: np.ndarray, bits: np.ndarray, little: np.ndarray) -> np.ndarray:
    """The samples of strips, one strip behind the other: n samples from the byte begin of data each, as a bit stream from the high bit; those
    of 16 bits have their low byte first where little is set."""
    at, wide = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(bits, n)
    at *= wide
    first = np.repeat(begin, n) + (at >> 3)
    three = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
    out = (three[first] << 16 | three[first + 1] << 8 | three[first + 2]) >> (24 - wide - (at & 7)) & (1 << wide) - 1
    return np.where(np.repeat(little & (bits == 16), n), out >> 8 | (out & 255) << 8, out).astype("<u2")


def unpacked(found: DataFrame, key: str = "path") -> DataFrame:
    """The strips with their samples as little-endian unsigned 16-bit numbers, how many, the least, the greatest and their sum. Small strips
    are unpacked together, as many as have MOST samples; a larger strip is all that a step holds, however large its plane is."""

    def scan(batches):
        for batch in batches:
            packed = batch.column("packed").cast(pa.large_binary())
            bounds, data = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset :][: len(packed) + 1], np.frombuffer(packed.buffers()[2] or b"", np.uint8)
            width, bits, rows = (batch.column(x).to_numpy().astype(np.int64) for x in ("width", "bits", "rows"))
            little, n = np.array(batch.column("byte_order").to_pylist()) == "II", width * rows
            some = np.cumsum(n) // MOST
            cuts = [0, *(np.flatnonzero(np.diff(some)) + 1).tolist(), len(n)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                x = samples(data[bounds[a] : bounds[b]], bounds[a:b] - bounds[a], n[a:b], bits[a:b], little[a:b])
                ends = np.concatenate([[0], np.cumsum(n[a:b])])
                told = {f: batch.column(f).slice(a, b - a) for f in (key, "strip", "first_row", "rows")} | {"n": pa.array(n[a:b]), "low": pa.array(np.minimum.reduceat(x, ends[:-1]).astype(np.int32)), "high": pa.array(np.maximum.reduceat(x, ends[:-1]).astype(np.int32)), "total": pa.array(np.add.reduceat(x, ends[:-1], dtype=np.int64))}
                held = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(x)])
                yield pa.record_batch(told | {"samples": held})

    return found.mapInArrow(scan, f"{key} {dict(found.dtypes)[key]}, {OUT}")


def levels(value: Column, black: Column, white: Column) -> Column:
    """A sample between the black level, 0, and the white level, 1."""
    return F.when(white > black, (value - black) / (white - black).cast("double"))
