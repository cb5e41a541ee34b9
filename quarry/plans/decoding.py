"""Queries that encode rows of part as containers and decode them again; the SQL works on the rows alone."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from quarry.sources import encode as E
from quarry.sources.container import closure, containers, packed_bits, refused, sensors
from quarry.store import dealt


def synthesized(part, build):
    def scan(batches):
        for batch in batches:
            keys, sizes = batch.column(0), batch.column(1)
            yield pa.record_batch({"p_partkey": keys, "content": pa.array([build(k.as_py(), s.as_py()) for k, s in zip(keys, sizes, strict=True)], pa.binary())})

    return containers(part.select("p_partkey", "p_size").mapInArrow(scan, "p_partkey long, content binary"), "p_partkey")


def part_of(spark, sf_dir):
    return dealt(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", 2_000)


def shape(k: int, size: int):
    return "<" if k % 2 == 0 else ">", size + 1, k % 97 + 1, (12, 14, 16)[k % 3]


def sensor_file(k: int, size: int) -> bytes:
    o, w, h, b = shape(k, size)
    strip = (w * h * b + 7) // 8
    plane = E.plane(o, w, h, b, strip + (k % 5 == 0), (1, 1, 1, 7)[k % 4], [E.inline(o, 50714, 3, k % 512), E.inline(o, 50717, 3, 4095), E.inline(o, 274, 3, k % 8 + 1)])
    if k % 3 == 0:
        return E.container(o, 8, {8: ([E.inline(o, 254, 4, 1), E.pointer(o, 330, 4, 1, 200), E.inline(o, 274, 3, 3)], 0), 200: (plane, 0)})
    return E.container(o, 8, {8: (plane, 0)})


def sensor_extract(spark, sf_dir):
    s = sensors(synthesized(part_of(spark, sf_dir), sensor_file), "p_partkey")
    return s.select("p_partkey", "byte_order", "width", "height", "bits_per_sample", "samples_per_pixel", "photometric", "compression", "black_level", "white_level", F.coalesce("fault", F.lit("")).alias("fault"))


def sensor_subifd(spark, sf_dir):
    s = sensors(synthesized(part_of(spark, sf_dir), sensor_file), "p_partkey")
    return s.select("p_partkey", "n_ifds", "ifd_index", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"), "orientation")


def layer0_check(spark, sf_dir):
    s = sensors(synthesized(part_of(spark, sf_dir), sensor_file), "p_partkey")
    return s.groupBy(closure().alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.sum(packed_bits()).alias("bits"))


def hostile_file(k: int, size: int) -> bytes:
    o, w, h, b = shape(k, size)
    plane = E.plane(o, w, h, b)
    typed = lambda tag, kind, n=1: (tag, kind, n, b"\0\0\0\1")
    return {
        0: lambda: E.container(o, 8, {8: (plane, 0)}),
        1: lambda: E.container(o, 8, {8: (plane, 0)}, mark=b"XX"),
        2: lambda: E.container(o, 8, {8: (plane, 0)}, version=43),
        3: lambda: E.container(o, 8, {8: (plane, 8)}),
        4: lambda: E.container(o, 8, {8 + 40 * i: ([E.pointer(o, 330, 4, 1, 48 + 40 * i)], 0) for i in range(12)}),
        5: lambda: E.container(o, 8, {8: (plane, 0)})[: 9 + k % 5],
        6: lambda: E.container(o, 8, {8: (E.plane(o, w, h, b, more=[typed(259, 250)]), 0)}),
        7: lambda: E.container(o, 8, {8: (plane + [E.pointer(o, 330, 5, 1, 400)], 0)}, {400: struct.pack(o + "II", 400, 2)}),
        8: lambda: E.container(o, 8, {8: (E.plane(o, w, h, b, more=[typed(262, 250)]), 0)}),
        9: lambda: E.container(o, 8, {8 + 6 * i: ([], 14 + 6 * i if i < 513 else 0) for i in range(514)}),
        10: lambda: E.container(o, 8, {8: ([], 0)}),
    }[k % 11]()


def container_errors(spark, sf_dir):
    s = sensors(synthesized(part_of(spark, sf_dir), hostile_file), "p_partkey")
    return s.groupBy(F.coalesce("fault", F.lit("ok")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def walk_faults(spark, sf_dir):
    """The faults of the walk with all that they say: place, length, tag, type and number."""
    c = synthesized(part_of(spark, sf_dir), hostile_file).filter("error IS NOT NULL")
    return c.select("p_partkey", "error.code", *[F.coalesce(f"error.{n}", F.lit(-1)).cast("long").alias(n) for n in ("at", "len", "tag", "field_type", "number")])


def marked_file(k: int, size: int) -> bytes:
    """Opcode lists by number, a photometric entry of no type, an entry that is missing, compressions, and strings of some length."""
    o, w, h, b = shape(k, size)
    more = [E.pointer(o, t, 7, k % 9 + 1, 600) for t, n in ((51008, 2), (51009, 3), (51022, 5)) if k % n == 0]
    more += [(262, 250, 1, b"\0\0\0\1")] if k % 7 == 0 else []
    plane = [e for e in E.plane(o, w, h, b, compression=(1, 7, 5)[k % 3], more=more) if k % 11 or e[0] != 256]
    return E.container(o, 8, {8: (plane, 0)}, {600: bytes(16)})


def sensor_marks(spark, sf_dir):
    """Opcode lists, candidates, missing tags and refusals of sensors, and the declared bytes of an opcode list."""
    c = synthesized(part_of(spark, sf_dir), marked_file)
    length = c.select(F.col("p_partkey").alias("k"), F.get(F.filter(F.col("ifds")[0]["entries"], lambda e: e["tag"] == 51008), F.lit(0))["byte_len"].alias("opcode_bytes"))
    s = sensors(c, "p_partkey").withColumn("refused", refused())
    lists = F.array_join(F.transform("opcode_lists", lambda x: x.cast("int").cast("string")), "")
    return s.join(length, F.col("p_partkey") == F.col("k")).select("p_partkey", F.coalesce("candidates", F.lit("")).alias("candidates"), F.coalesce(lists, F.lit("")).alias("opcodes"), F.coalesce("refused", F.lit("")).alias("refused"), F.coalesce("opcode_bytes", F.lit(0)).alias("opcode_bytes"))


def malformed_file(k: int, size: int) -> bytes:
    o, w, h, b = shape(k, size)
    more = {0: [], 1: [E.inline(o, 50713, 3, 1)], 2: [E.pointer(o, 50720, 5, 2, 600)], 3: [E.pointer(o, 50720, 5, 2, 608)], 4: [E.pointer(o, 50720, 5, 2, 624)], 5: [(50714, 250, 1, b"\0\0\0\1")], 6: [(274, 250, 1, b"\0\0\0\1")]}[k % 7]
    ratio = struct.pack(o + "8I", 5, 0, 5, 2, 2, 1, 2 * size, 2)  # at 600: 5/0 and 5/2; at 624: size on the second
    return E.container(o, 8, {8: (E.plane(o, w, h, b, more=more), 0)}, {600: ratio[:24], 624: struct.pack(o + "4I", 8, 2, 2 * size, 2)})


def malformed_tags(spark, sf_dir):
    s = sensors(synthesized(part_of(spark, sf_dir), malformed_file), "p_partkey")
    return s.select("p_partkey", F.array_join(F.col("malformed_tags").cast("array<string>"), ",").alias("malformed"), F.coalesce(F.get("default_crop_size", F.lit(1)), F.lit(-1)).alias("crop_height"))


def unpack(raw: bytes, bits: int, order: str) -> list[int]:
    """Samples of a plane: whole bytes in file order, else a bit stream from the high bit."""
    import numpy as np

    if bits % 8 == 0:
        return np.frombuffer(raw, f"{order}u{bits // 8}").tolist()
    flat = np.unpackbits(np.frombuffer(raw, np.uint8))
    rows = flat[: len(flat) // bits * bits].reshape(-1, bits).astype(np.int64)
    return (rows @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).tolist()


def unpack_levels(spark, sf_dir):
    """Eight samples of 14 or 16 bits are packed for each part and unpacked; levels 100 and 16000 go to 0 and 1."""

    def scan(batches):
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                bits, order = (14, "<") if k % 2 else (16, ">")
                samples = [(k * 37 + i * 1009) % 16000 for i in range(8)]
                if bits == 16:
                    raw = struct.pack(">8H", *samples)
                else:
                    raw = int("".join(f"{x:014b}" for x in samples), 2).to_bytes(14, "big")
                rows.append(unpack(raw, bits, order))
            yield pa.record_batch({"p_partkey": batch.column(0), "samples": pa.array(rows, pa.list_(pa.int64()))})

    s = part_of(spark, sf_dir).select("p_partkey").mapInArrow(scan, "p_partkey long, samples array<long>")
    level = lambda x: F.round((x - 100) / F.lit(15900.0), 6)
    return s.select("p_partkey", F.array_min("samples").alias("low"), F.array_max("samples").alias("high"), F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        level(F.array_min("samples")).alias("low_level"), level(F.array_max("samples")).alias("high_level"), (F.array_max("samples") <= 16000).alias("in_range"))


_W, _H, _B = "(p_size + 1)", "(p_partkey % 97 + 1)", "(CASE p_partkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 14 ELSE 16 END)"
_SAMPLES = ", ".join(f"(p_partkey * 37 + {i * 1009}) % 16000" for i in range(8))
QUERIES = {f.__name__: f for f in (sensor_extract, sensor_subifd, layer0_check, container_errors, walk_faults, sensor_marks, malformed_tags, unpack_levels)}
ORACLES = {
    "sensor_extract": f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'II' ELSE 'MM' END AS byte_order, CAST({_W} AS BIGINT) AS width, CAST({_H} AS BIGINT) AS height, CAST({_B} AS BIGINT) AS bits_per_sample, CAST(1 AS BIGINT) AS samples_per_pixel, CAST(34892 AS BIGINT) AS photometric, CAST(CASE WHEN p_partkey % 4 = 3 THEN 7 ELSE 1 END AS BIGINT) AS compression, CAST(p_partkey % 512 AS BIGINT) AS black_level, CAST(4095 AS BIGINT) AS white_level, '' AS fault FROM part",
    "sensor_subifd": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS n_ifds, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS ifd_index, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS depth, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE -1 END AS parent, CAST(CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE p_partkey % 8 + 1 END AS BIGINT) AS orientation FROM part",
    "layer0_check": f"SELECT CASE WHEN p_partkey % 4 = 3 THEN 'not applicable' WHEN p_partkey % 5 <> 0 AND ({_W} * {_H} * {_B}) % 8 = 0 THEN 'CLOSES' ELSE 'differs' END AS verdict, count(*) AS n, CAST(sum({_W} * {_H} * {_B}) AS BIGINT) AS bits FROM part GROUP BY 1",
    "container_errors": "SELECT CASE p_partkey % 11 WHEN 0 THEN 'ok' WHEN 1 THEN 'NotTiff' WHEN 2 THEN 'UnsupportedTiffVersion' WHEN 3 THEN 'CyclicIfd' WHEN 4 THEN 'IfdDepthExceeded' WHEN 5 THEN 'Truncated' WHEN 6 THEN 'UnexpectedFieldType' WHEN 7 THEN 'UnexpectedFieldType' WHEN 8 THEN 'NoSensorIfdCandidatesMalformed' WHEN 9 THEN 'TooManyIfds' ELSE 'NoSensorIfd' END AS code, count(*) AS n FROM part GROUP BY 1",
    "walk_faults": """SELECT p_partkey, CASE k WHEN 1 THEN 'NotTiff' WHEN 2 THEN 'UnsupportedTiffVersion' WHEN 3 THEN 'CyclicIfd' WHEN 4 THEN 'IfdDepthExceeded' WHEN 5 THEN 'Truncated' WHEN 7 THEN 'UnexpectedFieldType' ELSE 'TooManyIfds' END AS code, CAST(CASE WHEN k = 5 THEN CASE WHEN p_partkey % 5 = 0 THEN 8 ELSE 10 END ELSE -1 END AS BIGINT) AS at,
        CAST(CASE WHEN k = 5 THEN CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 108 END ELSE -1 END AS BIGINT) AS len, CAST(CASE WHEN k = 7 THEN 330 ELSE -1 END AS BIGINT) AS tag, CAST(CASE WHEN k = 7 THEN 5 ELSE -1 END AS BIGINT) AS field_type, CAST(CASE k WHEN 2 THEN 43 WHEN 3 THEN 8 WHEN 4 THEN 8 WHEN 9 THEN 512 ELSE -1 END AS BIGINT) AS number FROM (SELECT p_partkey, p_partkey % 11 AS k FROM part) WHERE k IN (1, 2, 3, 4, 5, 7, 9)""",
    "sensor_marks": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '0:262' ELSE '' END AS candidates, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat(CAST(p_partkey % 2 = 0 AS INT), CAST(p_partkey % 3 = 0 AS INT), CAST(p_partkey % 5 = 0 AS INT)) END AS opcodes,
        CASE WHEN p_partkey % 7 = 0 THEN 'NoSensorIfdCandidatesMalformed' WHEN p_partkey % 11 = 0 THEN 'MissingTag' WHEN p_partkey % 3 = 1 THEN 'UnsupportedCompression(jpeg)' WHEN p_partkey % 3 = 2 THEN 'UnsupportedCompression(other(5))' ELSE '' END AS refused, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 9 + 1 ELSE 0 END AS BIGINT) AS opcode_bytes FROM part""",
    "malformed_tags": "SELECT p_partkey, CASE p_partkey % 7 WHEN 1 THEN '50713' WHEN 2 THEN '50720' WHEN 3 THEN '50720' WHEN 5 THEN '50714' WHEN 6 THEN '274' ELSE '' END AS malformed, CAST(CASE WHEN p_partkey % 7 = 4 THEN p_size ELSE -1 END AS BIGINT) AS crop_height FROM part",
    "unpack_levels": f"SELECT p_partkey, list_min(s) AS low, list_max(s) AS high, CAST(list_sum(s) AS BIGINT) AS total, round((list_min(s) - 100) / 15900.0::DOUBLE, 6) AS low_level, round((list_max(s) - 100) / 15900.0::DOUBLE, 6) AS high_level, list_max(s) <= 16000 AS in_range FROM (SELECT p_partkey, [{_SAMPLES}] AS s FROM part)",
}
