"""Neighbours and running sums along long series, without a series ever being in one task.

Rows of a series have a whole number of their own, ``order``, that counts up without long gaps. Series are cut into blocks of
BLOCK such numbers; a window runs over a block, and what it needs of the block before is brought to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _block(order: str, size: int) -> Column:
    return F.floor(F.col(order) / size)


def neighbours(df: DataFrame, keys: list[str], order: str, named: dict[str, Callable[[WindowSpec], Column]], size: int = BLOCK) -> DataFrame:
    """``df`` with the columns ``named``: window functions over a series (``keys``, in the order of ``order``) that look at the
    row before or after alone, given as functions of a window: {"delta": lambda w: F.lag("x").over(w)}.

    The last row of a block goes with the next block and the first with the one before, as a guest that is dropped after the
    windows: one shuffle, and a few rows more. A number that is missing just there costs the neighbour; rows that are
    numbered without gaps have every neighbour.
    """
    b = _block(order, size)
    guests = F.when(F.col(order) % size == size - 1, F.array(b, b + 1)).when((F.col(order) % size == 0) & (F.col(order) > 0), F.array(b, b - 1)).otherwise(F.array(b))
    dealt = df.withColumn("_home", b).withColumn("_block", F.explode(guests))
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    seen = dealt.select("*", *[f(w).alias(name) for name, f in named.items()])
    return seen.where(F.col("_block") == F.col("_home")).drop("_home", "_block")


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, inclusive: bool = True, size: int = BLOCK) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the series up to the row (or before it, unless ``inclusive``): a block's
    own running sum, and the sums of the blocks before, of which there is one row a block."""
    with_block = df.withColumn("_block", _block(order, size)).withColumn("_value", value)
    sums = with_block.groupBy(*keys, "_block").agg(F.sum("_value").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    own = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    run = with_block.withColumn("_own", F.coalesce(F.sum("_value").over(own), F.lit(0)))
    return run.join(offsets, [*keys, "_block"]).select(*df.columns, (F.col("_off") + F.col("_own")).alias(name))


def running_sums(df: DataFrame, keys: list[str], order: str, values: list[Column], name: str, size: int = BLOCK) -> DataFrame:
    """``df`` with the array ``name``: for each of ``values`` its sum over the rows of the series before this one."""
    each = [f"_v{i}" for i in range(len(values))]
    with_block = df.select("*", _block(order, size).alias("_block"), *[v.alias(c) for v, c in zip(values, each, strict=True)])
    sums = with_block.groupBy(*keys, "_block").agg(*[F.sum(c).alias(c) for c in each])
    up = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_block", F.array(*[F.coalesce(F.sum(c).over(up), F.lit(0)) for c in each]).alias("_off"))
    own = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = with_block.select(*df.columns, "_block", F.array(*[F.coalesce(F.sum(c).over(own), F.lit(0)) for c in each]).alias("_own"))
    return run.join(offsets, [*keys, "_block"]).select(*df.columns, F.zip_with("_off", "_own", lambda a, b: a + b).alias(name))


def previous(df: DataFrame, keys: list[str], order: str, value: str, name: str, size: int = BLOCK) -> DataFrame:
    """``df`` with ``name``: the last ``value`` that isn't null of the rows of the series before this one, however far back; null
    where there is none. Blocks hand on their last value: a row a block, which a window runs over."""
    with_block = df.withColumn("_block", _block(order, size))
    has = F.col(value).isNotNull()
    lasts = with_block.where(has).groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_last"))
    blocks = with_block.select(*keys, "_block").distinct().join(lasts, [*keys, "_block"], "left")
    up = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_block", F.last("_last", ignorenulls=True).over(up).alias("_carried"))
    own = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = with_block.withColumn("_own", F.last(value, ignorenulls=True).over(own))
    return run.join(carried, [*keys, "_block"]).select(*df.columns, F.coalesce("_own", "_carried").alias(name))
