"""Small containers by name, each with what it decodes to."""

import struct

import pytest

from quarry.sources import encode as E
from quarry.sources.container import containers, refused, sensors

O = "<"  # noqa: E741


def own(order=O, without=(), **more):
    extra = more.pop("more", [])
    return [e for e in E.plane(order, more=extra, **more) if e[0] not in without]


def one(entries, after=0, blobs={}, order=O):  # noqa: B006
    return E.container(order, 8, {8: (entries, after)}, blobs)


def odd(tag, kind=250, n=1):
    return tag, kind, n, b"\0\0\0\1"


def patched(data, at, value):
    return data[:at] + value + data[at + len(value) :]


def ratio(*numbers):
    return {600: struct.pack(f"<{len(numbers)}I", *numbers)}


VALID, SUB = one(own()), E.container(O, 8, {8: ([E.inline(O, 254, 4, 1), E.pointer(O, 330, 4, 1, 200)], 0), 200: (own(), 0)})
THUMB = [E.inline(O, 254, 4, 1), odd(262), E.pointer(O, 330, 4, 1, 200)]
OK = {"fault": None, "ifd_index": 0, "width": 4, "height": 2, "bits_per_sample": 14}
CASES = {
    "valid-sensor-ii": (VALID, OK | {"byte_order": "II", "malformed_tags": []}),
    "valid-sensor-mm": (one(own(">"), order=">"), OK | {"byte_order": "MM"}),
    "valid-subifd-ii": (SUB, OK | {"n_ifds": 2, "ifd_index": 1, "parent": 0, "depth": 1}),
    "valid-subifd-mm": (E.container(">", 8, {8: ([E.inline(">", 254, 4, 1), E.pointer(">", 330, 4, 1, 200)], 0), 200: (own(">"), 0)}), OK | {"n_ifds": 2, "ifd_index": 1, "parent": 0, "depth": 1}),
    "empty": (b"", {"fault": "Truncated"}),
    "truncated-header": (b"II*\0", {"fault": "Truncated"}),
    "truncated-ifd0-offset": (b"II*\0\x08\0", {"fault": "Truncated"}),
    "bad-magic": (b"XX" + VALID[2:], {"fault": "NotTiff"}),
    "bad-version": (E.container(O, 8, {8: (own(), 0)}, version=43), {"fault": "UnsupportedTiffVersion", "number": 43}),
    "ifd0-past-eof": (E.container(O, 0xFFFF0000, {}), {"fault": "Truncated", "at": 0xFFFF0000, "len": 2}),
    "ifd0-inside-header": (patched(VALID, 4, b"\2\0\0\0"), {"fault": "Truncated", "len": 12 * 42}),
    "entry-count-past-eof": (patched(VALID, 8, struct.pack("<H", 1000)), {"fault": "Truncated", "at": 10, "len": 12000}),
    "payload-offset-past-eof": (one(own(more=[E.pointer(O, 273, 4, 64, 0xFFFFFF00)])), {"fault": "Truncated", "n_ifds": 1}),
    "count-overflow": (one(own(more=[E.pointer(O, 273, 4, 0xFFFFFFFF, 64)])), {"fault": "TagTooLarge"}),
    "self-referential-subifd": (one([E.pointer(O, 330, 4, 1, 8)]), {"fault": "CyclicIfd", "number": 8}),
    "subifd-cycle-two": (E.container(O, 8, {8: ([E.pointer(O, 330, 4, 1, 200)], 0), 200: ([E.pointer(O, 330, 4, 1, 8)], 0)}), {"fault": "CyclicIfd", "number": 8}),
    "chain-cycle": (one(own(), 8), {"fault": "CyclicIfd", "number": 8}),
    "long-cycle": (E.container(O, 8, {8 + 40 * i: ([E.inline(O, 254, 4, 1)], 8 + 40 * ((i + 1) % 6)) for i in range(6)}), {"fault": "CyclicIfd", "number": 8}),
    "deep-subifd-nest": (E.container(O, 8, {8 + 40 * i: ([E.pointer(O, 330, 4, 1, 48 + 40 * i)], 0) for i in range(12)}), {"fault": "IfdDepthExceeded", "number": 8}),
    "unknown-field-type": (one(own(more=[odd(60000, 250, 4)])), OK | {"malformed_tags": []}),
    "malformed-black-level-repeat-dim": (one(own(more=[E.inline(O, 50713, 3, 1)])), OK | {"black_level_repeat_dim": None, "malformed_tags": [50713]}),
    "rational-default-crop-size": (one(own(more=[E.pointer(O, 50720, 5, 2, 600)]), blobs=ratio(8368, 1, 5584, 1)), OK | {"default_crop_size": [8368, 5584], "malformed_tags": []}),
    "malformed-photometric-on-thumbnail": (E.container(O, 8, {8: (THUMB, 0), 200: (own(), 0)}), OK | {"ifd_index": 1}),
    "malformed-photometric-on-only-candidate": (one(own(more=[odd(262)])), {"fault": "NoSensorIfdCandidatesMalformed", "candidates": "0:262"}),
    "zero-entries": (one([]), {"fault": "NoSensorIfd", "n_ifds": 1}),
    "no-ifd0": (E.container(O, 0, {}), {"fault": "NoSensorIfd", "n_ifds": 0}),
    "sub-ifds as a ratio": (one(own(more=[E.pointer(O, 330, 5, 1, 600)]), blobs=ratio(400, 2)), {"fault": "UnexpectedFieldType", "tag": 330, "field_type": 5}),
    "crop by zero": (one(own(more=[E.pointer(O, 50720, 5, 2, 600)]), blobs=ratio(5, 0, 5, 1)), OK | {"default_crop_size": None, "malformed_tags": [50720]}),
    "crop with a rest": (one(own(more=[E.pointer(O, 50720, 5, 2, 600)]), blobs=ratio(5, 2, 5, 1)), OK | {"default_crop_size": None, "malformed_tags": [50720]}),
    "crop that divides": (one(own(more=[E.pointer(O, 50720, 5, 2, 600)]), blobs=ratio(16736, 2, 5584, 1)), OK | {"default_crop_size": [8368, 5584]}),
    "black level of no type": (one(own(more=[odd(50714)])), OK | {"black_level": None, "malformed_tags": [50714]}),
    **{f"{t} of no type": (one(own(more=[odd(t)])), {"fault": "UnexpectedFieldType"}) for t in (278, 259, 273, 279, 258)},
    "orientation bad on the first": (E.container(O, 8, {8: ([E.inline(O, 254, 4, 1), odd(274), E.pointer(O, 330, 4, 1, 200)], 0), 200: (own(), 0)}), {"fault": None, "orientation": None, "malformed_tags": [274]}),
    "orientation bad on the plane": (one(own(more=[odd(274)])), {"fault": None, "orientation": None, "malformed_tags": [274]}),
    "orientation from the plane": (E.container(O, 8, {8: ([E.inline(O, 254, 4, 1), odd(274), E.pointer(O, 330, 4, 1, 200)], 0), 200: (own(more=[E.inline(O, 274, 3, 6)]), 0)}), {"fault": None, "orientation": 6, "malformed_tags": []}),
    "no width": (one(own(without=(256,))), {"fault": "MissingTag"}),
    "no subfile type": (one(own(without=(254,))), OK),
    "thumbnail of raw samples": (one(own(more=[E.inline(O, 254, 4, 1)])), {"fault": "NoSensorIfd", "candidates": ""}),
    "one candidate of two": (E.container(O, 8, {8: ([E.inline(O, 254, 4, 1), odd(262)], 200), 200: ([E.inline(O, 254, 4, 0), odd(262)], 0)}), {"fault": "NoSensorIfdCandidatesMalformed", "candidates": "1:262"}),
    "a wider preview": (E.container(O, 8, {8: ([E.inline(O, 254, 4, 1), E.inline(O, 256, 4, 9999), E.pointer(O, 330, 4, 1, 200)], 0), 200: (own(), 0)}), OK | {"ifd_index": 1}),
    "too many": (E.container(O, 8, {8 + 6 * i: ([], 14 + 6 * i if i < 513 else 0) for i in range(514)}), {"fault": "TooManyIfds", "number": 512}),
    "not compressed": (VALID, {"refused": None}),
    "jpeg": (one(own(compression=7)), {"fault": None, "refused": "UnsupportedCompression(jpeg)"}),
    "other": (one(own(compression=65535)), {"fault": None, "refused": "UnsupportedCompression(other(65535))"}),
    "active area": (one(own(more=[E.pointer(O, 50829, 4, 4, 600)]), blobs=ratio(0, 0, 2, 4)), OK | {"active_area": [0, 0, 2, 4]}),
    "active area of zeros": (one(own(more=[E.pointer(O, 50829, 4, 4, 600)]), blobs=ratio(0, 0, 0, 0)), OK | {"active_area": [0, 0, 0, 0]}),
    "no active area": (VALID, {"active_area": None}),
    "opcode lists": (one(own(more=[E.inline(O, 51008, 1, 0), E.inline(O, 51022, 1, 0)])), OK | {"opcode_lists": [True, False, True]}),
}


@pytest.fixture(scope="module")
def decoded(spark):
    files = spark.createDataFrame([(n, bytearray(x)) for n, (x, _) in CASES.items()], "path string, content binary")
    found = containers(files)
    s = sensors(found).withColumn("refused", refused())
    return {r.path: r.asDict() for r in s.join(found.select("path", "error.at", "error.len", "error.tag", "error.field_type", "error.number"), "path").collect()}


@pytest.mark.parametrize("name", CASES)
def test_container(decoded, name):
    want = CASES[name][1]
    assert {k: decoded[name][k] for k in want} == want
