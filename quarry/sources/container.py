"""Tagged binary containers: a bounded walk of the directory graph, with errors as data.

Only the walk is Python, as it follows pointers through bytes; it sends one row a file, and everything after it is
expressions over that row. A hostile file costs its own row an error and nothing else.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
DEPTH, DIRECTORIES, VALUES, VERSION = 8, 512, 1 << 20, 42
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
SUB_IFDS, LINEAR_RAW = 330, 34892
STRUCTURAL = frozenset((254, 256, 257, 258, 259, 262, 273, 277, 278, 279, 330))
KNOWN = STRUCTURAL | {274, 50713, 50714, 50717, 50719, 50720, 50829, 51008, 51009, 51022}
DECODED = {1: "B", 7: "B", 3: "H", 4: "I", 13: "I", 5: "I"}

ENTRY = pa.struct([("tag", pa.int32()), ("field_type", pa.int32()), ("count", pa.int64()), ("value", pa.binary()), ("byte_len", pa.int64()), ("vals", pa.list_(pa.int64())), ("fault", pa.string())])
IFD = pa.struct([("ifd_index", pa.int32()), ("offset", pa.int64()), ("depth", pa.int32()), ("parent", pa.int32()), ("next", pa.int64()), ("entries", pa.list_(ENTRY))])
ERROR = pa.struct([("code", pa.string()), ("at", pa.int64()), ("len", pa.int64()), ("tag", pa.int32()), ("field_type", pa.int32()), ("number", pa.int64())])
OUT = [("byte_order", pa.string()), ("ifd0_offset", pa.int64()), ("ifds", pa.list_(IFD)), ("error", ERROR)]
DDL = ("byte_order string, ifd0_offset long, ifds array<struct<ifd_index:int,offset:long,depth:int,parent:int,next:long,entries:array<struct<tag:int,field_type:int,"
       "count:long,value:binary,byte_len:long,vals:array<long>,fault:string>>>>, error struct<code:string,at:long,len:long,tag:int,field_type:int,number:long>")


class Fault(Exception):
    def __init__(self, code: str, **context: int):
        super().__init__(code)
        self.row = {"code": code} | context


def part(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise Fault("Truncated", at=at, len=n)
    return data[at : at + n]


def payload(data: bytes, order: str, field_type: int, count: int, value: bytes, tag: int) -> bytes:
    if field_type not in SIZES:
        raise Fault("UnexpectedFieldType", tag=tag, field_type=field_type)
    n = SIZES[field_type] * count
    return value[:n] if n <= 4 else part(data, struct.unpack(order + "I", value)[0], n)


def numbers(data: bytes, order: str, tag: int, field_type: int, count: int, value: bytes) -> list[int]:
    """Whole numbers of an entry. Type faults come before size faults, and these before bounds."""
    if field_type not in DECODED or field_type == 5 and tag in STRUCTURAL:
        raise Fault("UnexpectedFieldType", tag=tag, field_type=field_type)
    if count > VALUES:
        raise Fault("TagTooLarge", tag=tag, number=count)
    raw = payload(data, order, field_type, count, value, tag)
    code = DECODED[field_type]
    found = list(struct.unpack(f"{order}{len(raw) // struct.calcsize(order + code)}{code}", raw))
    if field_type != 5:
        return found
    for top, bottom in zip(found[::2], found[1::2], strict=True):
        if not bottom or top % bottom:
            raise Fault("MalformedRationalValue", tag=tag, number=top)
    return [top // bottom for top, bottom in zip(found[::2], found[1::2], strict=True)]


def directory(data: bytes, order: str, at: int) -> tuple[list[dict], int]:
    n = struct.unpack(order + "H", part(data, at, 2))[0]
    table = part(data, at + 2, 12 * n)
    rows = []
    for tag, field_type, count, value in struct.iter_unpack(order + "HHI4s", table):
        row = {"tag": tag, "field_type": field_type, "count": count, "value": value, "byte_len": SIZES[field_type] * count if field_type in SIZES else None, "vals": None, "fault": None}
        if tag in KNOWN:
            try:
                row["vals"] = numbers(data, order, tag, field_type, count, value)
            except Fault as fault:
                row["fault"] = fault.row["code"]
        rows.append(row)
    return rows, struct.unpack(order + "I", part(data, at + 2 + 12 * n, 4))[0]


def walk(data: bytes) -> dict:
    """One container. Pending work is a stack of (chain offset, depth, parent): a directory's children go
    on top of its successor, so directories come in preorder and the first fault in that order is reported."""
    out = {"byte_order": None, "ifd0_offset": None, "ifds": [], "error": None}
    try:
        if len(data) < 2:
            raise Fault("Truncated", at=0, len=8)
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None:
            raise Fault("NotTiff")
        version = struct.unpack(order + "H", part(data, 2, 2))[0]
        if version != VERSION:
            raise Fault("UnsupportedTiffVersion", number=version)
        first = struct.unpack(order + "I", part(data, 4, 4))[0]
        out["byte_order"], out["ifd0_offset"] = {"<": "II", ">": "MM"}[order], first
        seen, pending = set(), [(first, 0, None)]
        while pending:
            at, depth, parent = pending.pop()
            if depth > DEPTH:
                raise Fault("IfdDepthExceeded", number=DEPTH)
            if not at:
                continue
            if at in seen:
                raise Fault("CyclicIfd", number=at)
            seen.add(at)
            if len(out["ifds"]) >= DIRECTORIES:
                raise Fault("TooManyIfds", number=DIRECTORIES)
            entries, after = directory(data, order, at)
            index = len(out["ifds"])
            out["ifds"].append({"ifd_index": index, "offset": at, "depth": depth, "parent": parent, "next": after, "entries": entries})
            child = next((e for e in entries if e["tag"] == SUB_IFDS), None)
            children = numbers(data, order, child["tag"], child["field_type"], child["count"], child["value"]) if child else []
            pending.append((after, depth, parent))
            pending += [(c, depth + 1, index) for c in reversed(children)]
    except Fault as fault:
        out["ifds"], out["error"] = None, fault.row
    return out


def containers(files: DataFrame, key: str = "path") -> DataFrame:
    """The walk of each row of files (key, content): key, byte_order, ifd0_offset, ifds, error. A null content is empty."""

    def scan(batches):
        for batch in batches:
            rows = [walk(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], t) for n, t in OUT)], [key, *(n for n, _ in OUT)])

    return files.select(key, "content").mapInArrow(scan, f"{key} {dict(files.dtypes)[key]}, {DDL}")


def read_containers(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return containers(files)


def entry(ifd: Column, tag: int) -> Column:
    """The first entry with the tag, or null."""
    return F.get(F.filter(ifd["entries"], lambda e: e["tag"] == tag), F.lit(0))


def has(ifd: Column, tag: int) -> Column:
    """Presence alone; the payload is not looked at."""
    return F.exists(ifd["entries"], lambda e: e["tag"] == tag)


def sensors(found: DataFrame, key: str = "path") -> DataFrame:
    """The sensor record of each container: key, fault (null where there is a record) and its columns.

    The sensor directory is the first with NewSubfileType 0 or absent, LinearRaw and one sample; a
    directory that cannot be read is unreadable only as far as these tests go. Structural faults are fatal, faults of
    interpretation cost their field and are named in malformed_tags.
    """

    def state(d: Column) -> Column:
        a, b, c = (entry(d, t) for t in (254, 262, 277))
        zero, raw, one = F.coalesce(F.get(a["vals"], F.lit(0)), F.lit(0)), F.get(b["vals"], F.lit(0)), F.coalesce(F.get(c["vals"], F.lit(0)), F.lit(1))
        return (F.when(a["fault"].isNotNull(), 254).when(zero != 0, -1).when(b["fault"].isNotNull(), 262)
                .when(F.coalesce(raw, F.lit(-1)) != LINEAR_RAW, -1).when(c["fault"].isNotNull(), 277).when(one == 1, 0).otherwise(-1))

    states = found.withColumn("states", F.transform("ifds", state))
    index = F.array_position("states", F.lit(0)) - 1
    bad = F.filter(F.transform("states", lambda s, i: F.when(s > 0, F.concat_ws(":", i, s))), lambda x: x.isNotNull())
    one = states.withColumns({"ifd_index": F.when(index >= 0, index).cast("int"), "candidates": bad})
    one = one.withColumns({"d": F.get("ifds", F.col("ifd_index")), "d0": F.get("ifds", F.lit(0))})
    d, d0 = F.col("d"), F.col("d0")
    tags = {"width": 256, "height": 257, "bits_per_sample": 258, "samples_per_pixel": 277, "photometric": 262, "compression": 259, "rows_per_strip": 278, "strip_offsets": 273, "strip_byte_counts": 279, "black_level": 50714, "white_level": 50717, "black_level_repeat_dim": 50713, "active_area": 50829, "default_crop_origin": 50719, "default_crop_size": 50720}
    one = one.withColumns({f"e_{n}": entry(d, t) for n, t in tags.items()} | {"e_o0": entry(d0, 274), "e_o1": F.when(F.col("ifd_index") > 0, entry(d, 274))})
    value = {n: F.get(F.col(f"e_{n}")["vals"], F.lit(0)) for n in (*tags, "o0", "o1")}
    lengths = {"black_level_repeat_dim": 2, "active_area": 4, "default_crop_origin": 2, "default_crop_size": 2}
    fixed = {n: F.when(F.size(F.col(f"e_{n}")["vals"]) == k, F.col(f"e_{n}")["vals"]) for n, k in lengths.items()}
    structural = ("width", "height", "bits_per_sample", "samples_per_pixel", "photometric", "compression", "rows_per_strip", "strip_offsets", "strip_byte_counts")
    fatal = F.lit(None).cast("string")
    for n in reversed(structural):
        missing = F.when(value[n].isNull(), F.lit("MissingTag")) if n in ("width", "height", "bits_per_sample", "photometric") else F.lit(None).cast("string")
        fatal = F.coalesce(F.col(f"e_{n}")["fault"], missing, fatal)
    orientation = F.coalesce(value["o0"], value["o1"])
    marks = [F.when(orientation.isNull() & (F.col("e_o0")["fault"].isNotNull() | F.coalesce(F.col("e_o1")["fault"].isNotNull(), F.lit(False))), 274)]
    marks += [F.when(F.col(f"e_{n}")["fault"].isNotNull(), tags[n]) for n in ("black_level", "white_level")]
    marks += [F.when(F.col(f"e_{n}")["tag"].isNotNull() & fixed[n].isNull(), tags[n]) for n in lengths]
    none = F.when(F.size("candidates") > 0, "NoSensorIfdCandidatesMalformed").otherwise("NoSensorIfd")
    fault = F.coalesce(F.col("error.code"), F.when(F.col("ifd_index").isNull(), none), fatal)
    return one.select(key, "byte_order", F.size("ifds").alias("n_ifds"), fault.alias("fault"), F.array_join("candidates", ",").alias("candidates"), "ifd_index", d["depth"].alias("depth"), d["parent"].alias("parent"),
        *[value[n].alias(n) for n in ("width", "height", "bits_per_sample")], F.coalesce(value["samples_per_pixel"], F.lit(1)).alias("samples_per_pixel"), value["photometric"].alias("photometric"),
        F.coalesce(value["compression"], F.lit(1)).alias("compression"), value["rows_per_strip"].alias("rows_per_strip"),
        *[F.coalesce(F.col(f"e_{n}")["vals"], F.array().cast("array<long>")).alias(n) for n in ("strip_offsets", "strip_byte_counts")], value["black_level"].alias("black_level"), value["white_level"].alias("white_level"),
        *[fixed[n].alias(n) for n in lengths], orientation.alias("orientation"), F.array(*[has(d, t) for t in (51008, 51009, 51022)]).alias("opcode_lists"), F.array_compact(F.array(*marks)).alias("malformed_tags"))


def refused() -> Column:
    """Why the plane of a sensor record is not to be unpacked: its own fault, or a compression that is not read, by name; null otherwise."""
    return F.coalesce("fault", F.when(F.col("compression") != 1, F.concat(F.lit("UnsupportedCompression("), compression_name(F.col("compression")), F.lit(")"))))


def packed_bits() -> Column:
    """width * height * bits, or null where that passes 63 bits."""
    return F.try_multiply(F.try_multiply(F.col("width"), F.col("height")), F.col("bits_per_sample"))


def closure() -> Column:
    """Whether the first strip has as many bytes as the declared plane; only uncompressed planes have to."""
    return F.when(F.col("compression") != 1, "not applicable").when(packed_bits() == F.get("strip_byte_counts", F.lit(0)) * 8, "CLOSES").otherwise("differs")


def compression_name(code: Column) -> Column:
    return F.when(code == 1, "uncompressed").when(code == 7, "jpeg").otherwise(F.concat(F.lit("other("), code.cast("string"), F.lit(")")))
