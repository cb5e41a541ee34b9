"""Writes small containers, for tests and for queries that decode what they know."""

from __future__ import annotations

import struct

Entry = tuple[int, int, int, bytes]


def inline(order: str, tag: int, field_type: int, value: int) -> Entry:
    code = {1: "B", 3: "H", 4: "I"}[field_type]
    return tag, field_type, 1, struct.pack(order + code, value).ljust(4, b"\0")


def pointer(order: str, tag: int, field_type: int, count: int, at: int) -> Entry:
    return tag, field_type, count, struct.pack(order + "I", at)


def container(order: str, first: int, directories: dict[int, tuple[list[Entry], int]], blobs: dict[int, bytes] = {}, version: int = 42, mark: bytes = b"") -> bytes:  # noqa: B006
    """Header, then directories {offset: (entries, next)} and blobs {offset: bytes}, zeros between."""
    parts = {0: (mark or {"<": b"II", ">": b"MM"}[order]) + struct.pack(order + "HI", version, first), **blobs}
    for at, (entries, after) in directories.items():
        parts[at] = struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", *e[:3]) + e[3] for e in entries) + struct.pack(order + "I", after)
    out = bytearray(max(at + len(x) for at, x in parts.items()))
    for at, x in parts.items():
        out[at : at + len(x)] = x
    return bytes(out)


def plane(order: str, width: int = 4, height: int = 2, bits: int = 14, strip: int = 14, compression: int = 1, more: list[Entry] = []) -> list[Entry]:  # noqa: B006
    """The entries of a sensor directory."""
    own = {254: (4, 0), 256: (4, width), 257: (4, height), 258: (3, bits), 259: (3, compression), 262: (3, 34892), 277: (3, 1), 273: (4, 512), 279: (4, strip)}
    given = {e[0] for e in more}
    return [inline(order, tag, *x) for tag, x in own.items() if tag not in given] + list(more)
