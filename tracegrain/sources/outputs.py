"""Stored tables of a reconstruction, under fixed schemas: a table without rows has its columns all the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "session bigint, layout string, hypothesis string, channel bigint, segment bigint, packet_start bigint, packet_end bigint, fs double, values array<double>"
QUALITY = "session bigint, layout string, hypothesis string, channel bigint, segment bigint, start_idx int, end_idx int, flat double, clip double, score double, label string, reasons array<string>"


#: How rows are dealt to files and sorted in them: sessions and what lies within them stay together.
ORDER = ["session", "layout", "hypothesis", "channel", "segment"]


def _write(df: DataFrame, schema: str, path: str, order: list[str]) -> None:
    """Files hold ranges of ``order`` that don't overlap, and are sorted, so a reader that asks for some sessions passes over
    the other files and row groups. A session that holds very many rows is spread over several files."""
    columns = [c.split() for c in schema.split(", ")]
    rows = df.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)


def write_segments(segments: DataFrame, path: str) -> None:
    _write(segments, SEGMENTS, path, ORDER)


def write_quality(windows: DataFrame, path: str) -> None:
    _write(windows, QUALITY, path, [*ORDER, "start_idx"])
