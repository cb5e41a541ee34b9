"""Ledger records: front matter and sections of Markdown files."""

from __future__ import annotations

import json
import re

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = "(-timeline\\.md$)|(/prompts/)"
_ODD = "\\x00-\\x1f\\x7f-\\x9f\\u2028\\u2029\\ud800-\\udfff\\ufeff\\ufffe\\uffff"  # what ends lines in YAML beside the usual end, and what it refuses
_WORD = "[A-Za-z0-9_./][A-Za-z0-9_./-]*+"
USUAL = re.compile(  # indent, dash, key, value, comment; nothing is tried twice, so the time grows with the line's length
    "( *+)(- )?(?:([A-Za-z_][A-Za-z0-9_-]{0,99}+):(?: ++|\\Z))?"
    f"([A-Za-z0-9_./~<(][^#{_ODD}]*+|\"(?:[^\"\\\\{_ODD}]|\\\\[\"\\\\])*+\"|'(?:[^'{_ODD}]|'')*+'|\\[(?:{_WORD}(?:, *+{_WORD})*+)?\\])?"
    f" *+(?:(?<![^ ])#[^{_ODD}]*+)?"
)
WORD = re.compile("[A-Za-z0-9_./~<(][A-Za-z0-9_./-]*+")
SEEN: dict = {}  # lines of at most LONG characters that were read, as many lines of records are alike; MOST of them, then anew
STARTS: dict = {}  # the same of what stands before a value
MOST, LONG, DEEP = 4096, 200, 100


def scan(spark: SparkSession, path: str, glob: str, active: bool = False) -> DataFrame:
    """(path, mtime, text) of the files that match, without timelines and prompts; active: without archives too."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("text"))
    rows = rows.filter(~F.col("path").rlike(SKIPPED))
    return rows.filter(~F.contains("path", F.lit("/done/"))) if active else rows


def plain(node):
    """A node as scalars of text, lists and dicts."""
    if isinstance(node.value, str):
        return node.value
    if node.id == "sequence":
        return [plain(x) for x in node.value]
    if any(not isinstance(k.value, str) for k, _ in node.value):
        raise yaml.YAMLError("a key is no scalar")
    return {k.value: plain(v) for k, v in node.value}


def usual_line(line: str) -> tuple | None:
    """(indent, dash, key, value) of a line that is a key, an entry or both, with the value None where a key has none on its line; () of a blank
    line or a comment; None where the line may be more than that."""
    found = USUAL.fullmatch(line)
    if not found:
        return None
    indent, dash, key, value = found.groups()
    if not value:
        return None if dash and not key else (len(indent), bool(dash), key, None) if key else ()
    if not dash and not key:
        return None
    if value[0] == '"':
        value = re.sub(r"\\(.)", r"\1", value[1:-1])
    elif value[0] == "'":
        value = value[1:-1].replace("''", "'")
    elif value[0] == "[":
        value = [x.strip() for x in value[1:-1].split(",")] if len(value) > 2 else []
    else:
        value = value.rstrip(" ")
        if ": " in value or value[-1] == ":":
            return None
    return len(indent), bool(dash), key, value


def read(line: str) -> tuple | None:
    """usual_line(line), kept for when the line or its key comes again."""
    start, colon, value = line.partition(": ")
    known = STARTS.get(start)
    row = (*known, value) if known and WORD.fullmatch(value) else usual_line(line)
    if row is not None and len(line) <= LONG:
        if len(SEEN) >= MOST:
            SEEN.clear()
            STARTS.clear()
        SEEN[line] = row
        if row and row[2] and colon:
            STARTS[start] = row[:3]
    return row


def usual(head: str) -> dict | None:
    """Front matter in which every value ends on its line, as libyaml reads it but several times as fast; None where it may be anything else."""
    lines = head.split("\n")
    if lines[0]:
        return None
    depth, node, outer, waiting = -1, {}, [], ""  # the open list or mapping and its column, those around it, and the last key if it has no value yet
    top = node
    for line in lines:
        row = SEEN.get(line)
        if row is None:
            row = read(line)
            if row is None:
                return None
        if not row:
            continue
        indent, dash, key, value = row
        if waiting is not None and (indent > depth or dash and indent == depth):
            outer.append((depth, node))
            node[waiting] = new = [] if dash else {}
            depth, node = indent, new
        else:
            while indent < depth or indent == depth and not dash and type(node) is list:
                depth, node = outer.pop()
            if indent != depth or dash and type(node) is dict:
                return None
        if dash:
            if key is None:
                node.append(value)
                waiting = None
                continue
            outer.append((depth, node))
            node.append({})
            depth, node = indent + 2, node[-1]
        if value is None:
            node[key], waiting = "", key
        else:
            node[key], waiting = value, None
        if len(outer) > DEEP:
            return None
    return top.get("") if type(top.get("")) is dict else None


def front_matter(text: str | None) -> str | None:
    """The front matter as JSON with every scalar as its text; null where there is none or it cannot be read."""
    if not text or not text.startswith("---"):
        return None
    parts = text.split("\n---", 1)
    if len(parts) < 2:
        return None
    known = usual(parts[0][3:])
    if known is not None:
        return json.dumps(known)
    loader = None
    try:
        loader = getattr(yaml, "CBaseLoader", yaml.BaseLoader)(parts[0][3:])
        node = loader.get_single_node()
        return json.dumps(plain(node)) if node is not None and node.id == "mapping" else None
    except (yaml.YAMLError, RecursionError):  # the latter of an alias within its own anchor
        return None
    finally:
        if loader:
            loader.dispose()


def with_front_matter(files: DataFrame) -> DataFrame:
    """files with matter, a JSON string of scalars as text; quarry.sources.records has the typed fields."""

    def parse(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([front_matter(x) for x in text], pa.string())], [*batch.schema.names, "matter"])

    from pyspark.sql.types import StringType, StructField, StructType

    return files.mapInArrow(parse, StructType([*files.schema.fields, StructField("matter", StringType())]))
