"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import save

ROUNDS = 6
PRIME = 2147483647
WALK = 64


def row_numbers(rows: DataFrame, order: list[str], label: str) -> tuple[DataFrame, int]:
    """``doc``, a struct of the columns of ``rows``, with ``row``, their gapless number from 0 in ``order``, and how many
    rows there are.

    Range partitions are numbered locally in one stored pass; only one count per partition is summed, so no
    task ever sees more than its own range. Rows that tie in all of ``order`` are equal in it and so interchangeable.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # range bounds are sampled from the stored rows: the texts are read once only
    rows = save(rows.select(F.struct(*rows.columns).alias("doc")), f"{label}-in")
    keys = [F.col("doc").getField(c) for c in order]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = save(ranged.withColumn("at", F.monotonically_increasing_id()), label)
    placed = placed.select("doc", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("within"))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"), "n")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # at most spark.sql.shuffle.partitions rows, whatever the input: a proven bound
    numbered = placed.join(F.broadcast(offsets.select("part", "off")), "part")
    return numbered.select("doc", (F.col("off") + F.col("within")).alias("row")), total


def _mix(half: Column, i: Column, seed: int) -> Column:
    """A round function in exact 64-bit integer arithmetic: every product stays under 2**62."""
    a = ((half % PRIME) * F.lit(48271) + i * 69621 + F.lit(seed % PRIME)) % PRIME
    return (a * ((a + half + i * 16807) % PRIME)) % PRIME


def _feistel(x: Column, a: int, b: int, seed: int) -> Column:
    def one(s: Column, i: Column) -> Column:
        left, right = s["l"], s["r"]
        even = F.struct(F.pmod(left + _mix(right, i, seed), F.lit(a).cast("long")).alias("l"), right.alias("r"))
        odd = F.struct(left.alias("l"), F.pmod(right + _mix(left, i, seed), F.lit(b).cast("long")).alias("r"))
        return F.when(i % 2 == 1, even).otherwise(odd)

    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b).cast("long")).alias("r"))
    rounds = F.array(*[F.lit(i).cast("long") for i in range(1, ROUNDS + 1)])
    return F.aggregate(rounds, start, one, lambda s: s["l"] * b + s["r"])


def permuted(row: Column, total: int, seed: int = 17) -> Column:
    """Where ``row`` of ``total`` rows stands in the shuffle; a bijection of 0..total-1 that needs no other row.

    The cipher acts on a*b >= total points with a = ceil(sqrt(total)); a point past the end is enciphered again
    (cycle walking). Fewer than a points lie past the end, so for under 4096 rows 64 walks always suffice, and
    beyond that the chance to need more is below (1/64)**64; it would raise an error, never give a wrong place.
    """
    a = max(1, math.isqrt(max(total - 1, 0)) + 1)
    b = max(1, -(-total // a))
    once = _feistel(row, a, b, seed)
    walks = F.sequence(F.lit(1), F.lit(WALK))
    walked = F.aggregate(walks, once, lambda x, _: F.when(x < total, x).otherwise(_feistel(x, a, b, seed)))
    return F.aggregate(F.array(walked), F.lit(0).cast("long"), lambda _, x: F.when(x < total, x).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")))


def shard_rows(rows: DataFrame, order: list[str], shards: int = 24, seed: int = 17, label: str = "shards") -> DataFrame:
    """``rows`` with ``row_number``, ``shard`` and ``slot``; shard sizes differ by at most one, slots are gapless.

    Columns of ``rows`` are kept; one that is called like a new one is an error. Nulls order first; an empty table gives
    an empty table; repeated rows each get a place of their own, and which of them gets which is of no account.
    """
    if taken := {"row_number", "shard", "slot"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"the rows have columns {sorted(taken)} already: rename them first")
    numbered, total = row_numbers(rows, order, label)
    out = numbered.select("doc", "row", permuted(F.col("row"), total, seed).alias("place"))
    return out.select("doc.*", F.col("row").alias("row_number"), F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """Every document's shard and slot under the law ``rows``, without its text. Null text: size 8, crc32 of nothing.

    Other columns are not looked at; repeated rows each get a place, an empty table none."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    small = docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    placed = shard_rows(small, ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
