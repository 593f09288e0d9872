"""Readers of session tables and safe reports, and their guards."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracegrain.functions.store import number_rows

FIELD_LIMIT = 10 << 20
REFUSED = (".csv", ".parquet", ".db", ".sqlite")


def read_sessions(spark: SparkSession, path: str, field_limit: int = FIELD_LIMIT) -> DataFrame:
    """A CSV of JSON cells: every column text, missing cells empty, header order kept; longer fields are an error."""
    options = {"header": "true", "escape": '"', "multiLine": "true", "mode": "FAILFAST", "maxCharsPerColumn": str(field_limit), "encoding": "UTF-8"}
    names = spark.read.options(**options).csv(path).columns
    schema = StructType([StructField(n, StringType()) for n in names])
    return spark.read.options(**options).schema(schema).csv(path).fillna("")


def number_sessions(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with session_ordinal from 0 in the given order (for tables whose sessions have a key of their own)."""
    return number_rows(df, order, "session_ordinal")


def sample_columns(df: DataFrame, most: int = 20) -> DataFrame:
    """column and ``values``: the first ``most`` cells of each column, the limit being the feature."""
    head = df.limit(most)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])
    return head.select(F.inline(each)).groupBy("column").agg(F.collect_list(F.coalesce("value", F.lit(""))).alias("values"))


def packet_cells(df: DataFrame, column: str = "raw_packets_json") -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"column {column} is missing")
    return df.select(*[c for c in ("session_ordinal", "session") if c in df.columns], column)


def guard_report_path(path: str) -> str:
    """Only existing JSON files that are not named private may be shown."""
    name = os.path.basename(path).lower()
    if name.endswith(REFUSED) or not name.endswith(".json"):
        raise ValueError("only JSON reports may be read")
    if "private" in path.lower():
        raise ValueError("private reports may not be read")
    if not os.path.isfile(path):
        raise FileNotFoundError(name)
    return path


def guard_outside(path: str, workspace: str) -> str:
    """Benchmark folders must lie outside the workspace."""
    full, root = os.path.realpath(path), os.path.realpath(workspace)
    if full == root or full.startswith(root + os.sep):
        raise ValueError("the folder must be outside the workspace")
    return full


def read_report(spark: SparkSession, path: str, schema: StructType, version: str) -> DataFrame:
    """A safe report under a fixed schema; another root than an object and another schema_version than ``version`` are
    refused, no version means an old one."""
    body = spark.read.text(guard_report_path(path), wholetext=True)
    is_object = F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT<"))
    body = body.where(F.when(is_object, True).otherwise(F.raise_error(F.lit("a report must be a JSON object")).cast("boolean")))
    df = body.select(F.from_json("value", schema).alias("r")).select("r.*")
    known = F.col("schema_version").isNull() | (F.col("schema_version") == version)
    return df.where(F.when(known, True).otherwise(F.raise_error(F.lit("unknown schema_version")).cast("boolean")))
