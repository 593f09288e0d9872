"""Text cells of session tables: status, kind of column, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULLISH = ["", "null", "none", "nan"]


def is_nullish(cell: Column) -> Column:
    return F.lower(F.trim(F.coalesce(cell, F.lit("")))).isin(NULLISH)


def _parsed(text: Column) -> tuple[Column, Column]:
    """Whether ``text`` is one JSON value and nothing more, and that value as a variant. The parser stops at the end of a value,
    so the text is parsed as the first of two values in an array, of which the second is the text's hash."""
    end = F.xxhash64(text)
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), end.cast("string"), F.lit("]")))
    return F.coalesce(F.try_variant_get(both, "$[1]", "long") == end, F.lit(False)), F.try_variant_get(both, "$[0]", "variant")


def is_json(text: Column) -> Column:
    return _parsed(text)[0]


def cell_status(cell: Column) -> Column:
    """empty, malformed, null, empty_array, empty_object, array, object or scalar."""
    t = F.trim(F.coalesce(cell, F.lit("")))
    whole, v = _parsed(t)
    kind = F.schema_of_variant(v)
    is_array, is_object = F.startswith(kind, F.lit("ARRAY<")), F.startswith(kind, F.lit("OBJECT<"))
    bare = F.regexp_replace(t, "\\s", "")
    out = F.when(F.lower(t).isin(NULLISH), "empty").when(~whole, "malformed")
    return out.when(bare == "[]", "empty_array").when(bare == "{}", "empty_object").when(is_array, "array").when(is_object, "object").when(F.is_variant_null(v), "null").otherwise("scalar")


def column_profile(cells: DataFrame) -> DataFrame:
    """Per column (cells: column, cell, and its status if that is known): nullish and other cells, malformed and container cells, and its kind."""
    c = cells.select("column", F.coalesce("cell", F.lit("")).alias("cell"), *(["status"] if "status" in cells.columns else []))
    c = c if "status" in c.columns else c.withColumn("status", cell_status(F.col("cell")))
    json_name = F.endswith(F.lower(F.col("column")), F.lit("_json"))
    empty = F.lower(F.trim("cell")).isin(NULLISH)
    looks = F.regexp_like(F.trim("cell"), F.lit('^[{\\["]'))
    bad = ~empty & (F.col("status") == "malformed") & (looks | json_name)
    good = ~empty & (F.col("status").isin("array", "object", "empty_array", "empty_object") | ((F.col("status") == "scalar") & json_name))
    counts = c.groupBy("column").agg(F.count_if(empty).alias("null_or_empty"), F.count_if(~empty).alias("non_empty"), F.count_if(bad).alias("malformed"), F.count_if(good).alias("json_ok"))
    plain = F.col("non_empty") - F.col("malformed") - F.col("json_ok")
    mixed = (F.col("malformed") > 0) & (F.endswith(F.lower(F.col("column")), F.lit("_json")) | (F.col("json_ok") > 0) | (plain == 0))
    return counts.withColumn("kind", F.when(mixed, "mixed_malformed").when(F.col("json_ok") > 0, "json_like").otherwise("ordinary"))


def status_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("column", cell_status(F.col("cell")).alias("status")).agg(F.count("*").alias("n"))


def top_types(cells: DataFrame) -> DataFrame:
    """Per column, how many parsed cells have each JSON type at their root; empty and malformed cells have none."""
    kind = cell_status(F.col("cell"))
    v = F.schema_of_variant(F.try_parse_json(F.trim("cell")))
    scalar = F.when(v == "BOOLEAN", "boolean").when(v == "STRING", "string").when(v == "BIGINT", "integer").otherwise("number")
    name = F.when(kind.isin("array", "empty_array"), "array").when(kind.isin("object", "empty_object"), "object").when(kind == "scalar", scalar)
    return cells.select("column", name.alias("type")).where(F.col("type").isNotNull()).groupBy("column", "type").agg(F.count("*").alias("n"))
