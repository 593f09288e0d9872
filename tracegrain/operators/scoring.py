"""The grid of decoding hypotheses and its scores. Words carry a phase in closed form, so no packet waits for another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrain.functions.bits import ORDERS, transform_word
from tracegrain.functions.ordering import previous, running_sum

CHANNELS = [1, 2, 3, 4, 5, 6, 8, 11]


def decoder_grid(spark: SparkSession) -> DataFrame:
    """All 192 candidates with ``spec_idx`` in the order signedness, byte order, channels, layout: a fixed small table."""
    axes = [("signedness", ["uint24", "int24"]), ("byte_order", ORDERS), ("channel_count", CHANNELS), ("layout_mode", ["packet_local", "continuous"])]
    grid = spark.range(1).select()
    for name, values in axes:
        grid = grid.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"_{name}", name))
    sizes = [len(v) for _, v in axes]
    idx = F.lit(0)
    for (name, _), n in zip(axes, sizes, strict=True):
        idx = idx * n + F.col(f"_{name}")
    return grid.select(idx.cast("long").alias("spec_idx"), *[n for n, _ in axes])


def phased(payloads: DataFrame) -> DataFrame:
    """Payloads with ``before``, the number of the session's words that came earlier: a continuous layout's phase."""
    return running_sum(payloads, ["session"], "ordinal", F.size("payload"), "before", inclusive=False)


def channel_words(payloads: DataFrame, channels: list[int], signedness: str = "int24", order: str = "CAB") -> DataFrame:
    """Rows (channel_count, layout, session, channel, ordinal, pos, place, x) for both layouts and each number of channels;
    ``place`` counts the session's words."""
    each = phased(payloads).select("session", "ordinal", "before", F.posexplode("payload").alias("pos", "v"))
    x = transform_word(F.col("v"), signedness, order)
    specs = F.explode(F.array(*[F.struct(F.lit(c).alias("channel_count"), F.lit(m).alias("layout")) for c in channels for m in ("packet_local", "continuous")])).alias("spec")
    spec = each.select("session", "ordinal", "before", "pos", x.alias("x"), specs).select("*", "spec.*").drop("spec")
    at = F.when(F.col("layout") == "continuous", F.col("before") + F.col("pos")).otherwise(F.col("pos").cast("long"))
    return spec.select("channel_count", "layout", "session", F.pmod(at, F.col("channel_count").cast("long")).alias("channel"), "ordinal", "pos", (F.col("before") + F.col("pos")).alias("place"), "x")


def channel_stats(channel_rows: DataFrame) -> DataFrame:
    """Per spec, session and channel: samples, energy, saturation, equal neighbours within packets, mean absolute step,
    and the mean jump over packet edges, where each packet's first word meets the channel's last word before it."""
    spec = ["channel_count", "layout", "session", "channel"]
    rows = previous(channel_rows.withColumn("_v", F.struct("x", "ordinal")), spec, "place", "_v", "_p").select(*spec, "ordinal", "x", F.col("_p.x").alias("_x"), F.col("_p.ordinal").alias("_o"))
    d, inner = F.abs(F.col("x") - F.col("_x")), F.col("_o") == F.col("ordinal")
    edge = F.col("_o") < F.col("ordinal")
    full = (F.col("x") == 8388607) | (F.col("x") == -8388608)
    return rows.groupBy(*spec).agg(F.count("*").alias("n"), F.var_pop("x").alias("energy"), F.avg(F.when(full, 1.0).otherwise(0.0)).alias("saturation_rate"), F.coalesce(F.avg(F.when(inner, F.when(d == 0, 1.0).otherwise(0.0))), F.lit(0.0)).alias("flatline_rate"), F.avg(F.when(inner, d)).alias("mean_step"), F.avg(F.when(edge, d)).alias("mean_jump"))


def spec_scores(stats: DataFrame) -> DataFrame:
    """Per spec: medians over sessions and channels, and the coefficient of variation of the channels' energy."""
    ratio = F.col("mean_jump") / F.greatest(F.col("mean_step"), F.lit(1e-9))
    energy = F.col("energy")
    cv = F.when(F.abs(F.avg(energy)) <= 1e-9, F.stddev_pop(energy)).otherwise(F.stddev_pop(energy) / F.abs(F.avg(energy)))
    return stats.groupBy("channel_count", "layout").agg(F.percentile("mean_step", F.lit(0.5)).alias("step"), F.percentile(ratio, F.lit(0.5)).alias("jump_ratio"), F.avg("saturation_rate").alias("saturation_rate"), F.avg("flatline_rate").alias("flatline_rate"), cv.alias("energy_cv"))


def ranked(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Cost of each spec: the weighted sum of its rank in each metric over (n - 1); ties by number of channels, then
    layout. Specs are a fixed grid of under 200 rows, so one window over them is no burden."""
    tie = [F.col("channel_count"), F.col("layout")]
    n = F.count("*").over(Window.partitionBy())
    cost = F.lit(0.0)
    for name, weight in weights.items():
        rank = F.row_number().over(Window.orderBy(F.coalesce(F.col(name), F.lit(float("inf"))), *tie)) - 1
        cost = cost + weight * rank / F.greatest(n - 1, F.lit(1))
    costed = scores.withColumn("cost", cost)
    return costed.withColumn("rank", F.row_number().over(Window.orderBy("cost", *tie)))
