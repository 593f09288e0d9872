"""Tables that cut lineage, and numbers of rows that no single task gives out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode a temporary folder is set where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tracegrain-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, and read from there by all that follows."""
    path = f"{shared_dir(df.sparkSession)}/tracegrain/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_A_TASK = 1 << 17


def tasks_for(rows: DataFrame, each: int | None = None) -> int:
    """Into how many tasks ``rows`` are to be dealt for ``each`` rows a task (ROWS_A_TASK): it grows with their number, whatever
    the number of files they come in and of partitions that small shuffles are merged to."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (each or ROWS_A_TASK)))


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, its rows' gapless number from 0 in ``order``; rows that tie in all of it come in any order.

    Rows are sorted by range partitions and numbered in each; one count a partition is summed up and brought back. So
    no task sees more than its range, and what is broadcast has as many rows as there are partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_off")))
    return at.withColumn("_part", part).join(offsets, "_part").select(*df.columns, (F.col("_off") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], width: float = 4096.0) -> DataFrame:
    """``keys`` and, for each name of ``shares``, that percentile of ``value`` (nulls don't count) by linear interpolation.

    Exact without a group's values in one task: values are counted by ranges of ``width`` first, so the two values next
    to each rank are known to lie in one range each, and only those ranges are looked at value by value.
    """
    had = rows.where(F.col(value).isNotNull()).withColumn("_b", F.floor(F.col(value) / width))
    counts = had.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("*", F.coalesce(F.sum("_c").over(up), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"))
    ranks = [F.struct(F.lit(k).alias("_name"), (F.lit(q) * (F.col("_n") - 1)).alias("_r")) for k, q in shares.items()]
    wanted = counts.select(*keys, "_b", "_before", "_c", F.inline(F.array(*ranks))).select("*", F.explode(F.array(F.floor("_r"), F.ceil("_r"))).alias("_k")).where((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_c"))).distinct()
    ranges = wanted.select(*keys, "_b", "_before").distinct()
    inside = had.join(ranges, [*keys, "_b"]).groupBy(*keys, "_b", "_before", value).agg(F.count("*").alias("_m"))
    along = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = inside.select(*keys, "_b", F.col(value).alias("_v"), (F.col("_before") + F.coalesce(F.sum("_m").over(along), F.lit(0))).alias("_from"), "_m")
    picked = wanted.select(*keys, "_b", "_name", "_r", "_k").join(placed, [*keys, "_b"]).where((F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_from") + F.col("_m")))
    low, high = F.min("_v").cast("double"), F.max("_v").cast("double")
    each = picked.groupBy(*keys, "_name").agg((low + (high - low) * (F.first("_r") - F.floor(F.first("_r")))).alias("_q"))
    return each.groupBy(*keys).pivot("_name", list(shares)).agg(F.first("_q"))
