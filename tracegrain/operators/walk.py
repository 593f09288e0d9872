"""Nested JSON cells as rows: one for each value below a cell's root, with its redacted path and its type."""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracegrain.functions.names import DYNAMIC, SENSITIVE

from .cells import cell_status

# fixed values: how far a profile looks into a cell, and the number of keys of one object from which it takes keys as data
DEPTH, KEYS, ELEMENTS, MANY_KEYS = 8, 200, 50, 20
ROWS = 1 << 14  # rows that a worker hands on at once
WALKED = ["array", "object", "scalar"]
TYPES = {dict: "object", list: "array", str: "string", int: "integer", float: "number", type(None): "null"}
HIDDEN = [re.compile(p) for p in SENSITIVE]
NODE = "path string, type string, leaf string, value string, length long, inspected long, samples long"


def _type(v: object) -> str:
    if isinstance(v, bool):
        return "boolean"
    return TYPES[type(v)]


@functools.lru_cache(maxsize=1 << 16)
def _hidden(key: str) -> bool:
    return any(p.search(key) for p in HIDDEN) or (len(key) >= 24 and not set(key) & set("_-."))


def _nodes(root: object, whole: bool = False) -> Iterator[tuple]:
    """Values in document order. ``seen`` holds the keys met under each path of this cell: from the twentieth on, new
    keys and those met before are hidden. ``whole``: all levels, keys and elements, and keys are hidden by their shape alone."""
    deepest, most_keys, most = (math.inf, None, None) if whole else (DEPTH, KEYS, ELEMENTS)
    seen: dict[str, set[str]] = {}
    todo: list[Iterator[tuple]] = [iter([(root, "", "", 0)])]  # of each level, what is left there
    while todo:
        for v, path, leaf, depth in todo[-1]:
            below: Iterator[tuple] | None = None
            length = inspected = samples = None
            if isinstance(v, dict):
                keys, inner = seen.setdefault(path, set()), []
                for k in itertools.islice(v, most_keys):
                    keys.add(k)
                    shown = DYNAMIC if (not whole and len(keys) >= MANY_KEYS) or _hidden(k) else k
                    inner.append((v[k], f"{path}.{shown}" if path else shown, k, depth + 1))
                below = iter(inner)
            elif isinstance(v, list):
                head = v[:most]
                length, inspected = len(v), len(head)
                samples = 0 if any(isinstance(x, (dict, list)) for x in head) else length
                below = zip(head, itertools.repeat(path + "[]"), itertools.repeat(leaf), itertools.repeat(depth + 1), strict=False)
            scalar = None if v is None or isinstance(v, (dict, list, bool)) else str(v)
            yield path, _type(v), leaf, scalar, length, inspected, samples
            if below is not None and depth < deepest:
                todo.append(below)
                break
        else:
            todo.pop()


def _parsed(text: str) -> list:
    """The value of a cell in a list, or an empty list where there is none."""
    try:
        return [json.loads(text)]
    except ValueError:
        return []


def walk(cells: DataFrame, keys: list[str], cell: str = "cell", whole: bool = False) -> DataFrame:
    """``keys`` and a row (path, type, leaf, value, length, inspected, samples) for each value of each populated cell;
    the root's path is empty. Values are scalars and may be private. Cells that are empty,
    malformed or null give no row; a column ``status`` tells which these are, or else the cells are asked. A profile looks
    8 levels deep, at 200 keys an object and 50 elements an array; ``whole`` looks at everything. A cell is one row of the
    input, so a batch of few rows bounds the memory, and rows are handed on in batches while a cell is walked."""
    schema = StructType([cells.schema[k] for k in keys]).simpleString()[len("struct<") : -1]
    kinds = [pa.string()] * 4 + [pa.int64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ((i, *node) for i, text in enumerate(batch.column(len(keys))) for v in _parsed(text.as_py()) for node in _nodes(v, whole))
            while rows := list(itertools.islice(found, ROWS)):
                of, *made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *kinds], strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(of) for k in range(len(keys))], *made], names=[*keys, "path", "type", "leaf", "value", "length", "inspected", "samples"])

    status = F.col("status") if "status" in cells.columns else cell_status(F.col(cell))
    populated = cells.where(status.isin(WALKED)).select(*keys, F.trim(cell).alias(cell))
    return populated.mapInArrow(run, f"{schema.replace(':', ' ')}, {NODE}")


def key_paths(nodes: DataFrame, by: list[str]) -> DataFrame:
    """How often each path below the root holds each type."""
    return nodes.where(F.col("path") != "").groupBy(*by, "path", "type").agg(F.count("*").alias("n"))


def array_stats(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Numbers, lengths and looked-at elements of arrays, roots included."""
    n = F.col("length")
    return nodes.where(n.isNotNull()).groupBy(*by).agg(F.count("*").alias("arrays"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.avg(n).alias("mean_length"), F.sum(n).alias("total_length"), F.sum("inspected").alias("inspected"), F.sum("samples").alias("samples"))
