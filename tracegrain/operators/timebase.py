"""Packet times: deltas, gaps, segments and sample times. Arrival order counts; nothing is sorted by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.functions.ordering import neighbours, running_sum

GAP_MS = 1500.0


def deltas(packets: DataFrame) -> DataFrame:
    """``packets`` (session, ordinal, received_ms) with ``delta``, null for a session's first packet."""
    step = lambda w: (F.col("received_ms") - F.lag("received_ms").over(w)).cast("double")
    return neighbours(packets, ["session"], "ordinal", {"delta": step})


def gap_class(delta: Column, gap_ms: float) -> Column:
    steps = [(0.0, "zero"), (500.0, "le_500ms"), (gap_ms, "le_gap_threshold"), (5000.0, "gap_to_5s"), (30000.0, "gap_to_30s")]
    out = F.when(delta < 0, "negative")
    for most, name in steps:
        out = out.when(delta <= most, name)
    return out.otherwise("gap_gt_30s")


def summaries(packets: DataFrame, gap_ms: float = GAP_MS) -> DataFrame:
    """One row a session: counts of packets, gaps, regressions and duplicates; least, median and p95 delta."""
    d = F.col("delta")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False))).alias
    forward, total = F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0.0)), F.coalesce(F.sum(d), F.lit(0.0))
    return deltas(packets).groupBy("session").agg(F.count("*").alias("packet_count"), count(d > gap_ms)("gap_count"), count(d < 0)("regression_count"), count(d == 0)("duplicate_count"), (F.abs(forward - total) > 1.0).alias("duration_inconsistency"), F.min(d).alias("delta_min_ms"), F.percentile(d, F.lit(0.5)).alias("delta_median_ms"), F.percentile(d, F.lit(0.95)).alias("delta_p95_ms"))


def gap_histogram(packets: DataFrame, gap_ms: float = GAP_MS) -> DataFrame:
    d = deltas(packets).where(F.col("delta").isNotNull())
    return d.groupBy(gap_class(F.col("delta"), gap_ms).alias("gap_class")).agg(F.count("*").alias("n"))


def thresholds(packets: DataFrame, floor_ms: float = GAP_MS) -> DataFrame:
    """session, median positive delta (1000 where there is none) and the adaptive gap threshold."""
    d = F.col("delta")
    median = F.coalesce(F.percentile(F.when(d > 0, d), F.lit(0.5)), F.lit(1000.0))
    return deltas(packets).groupBy("session").agg(median.alias("median_ms")).withColumn("threshold_ms", F.greatest(F.col("median_ms") * 1.5, F.lit(floor_ms)))


def segments(packets: DataFrame, floor_ms: float = GAP_MS, fixed_ms: float | None = None) -> DataFrame:
    """Packets with ``segment``: a new one starts where time goes back or a gap passes the session's threshold, or ``fixed_ms``.

    Thresholds have one row a session, so they are joined, not gathered; segments are counted up by blocks of packets.
    """
    known = deltas(packets)
    marked = known.join(thresholds(packets, floor_ms), "session") if fixed_ms is None else known.withColumn("threshold_ms", F.lit(fixed_ms))
    cut = F.when((F.col("delta") < 0) | (F.col("delta") > F.col("threshold_ms")), 1).otherwise(0)
    return running_sum(marked, ["session"], "ordinal", cut, "segment")


def segment_ranges(packets: DataFrame, floor_ms: float = GAP_MS, fixed_ms: float | None = None) -> DataFrame:
    """session, segment, packet_start (inclusive), packet_end (exclusive), span_ms."""
    return segments(packets, floor_ms, fixed_ms).groupBy("session", "segment").agg(F.min("ordinal").alias("packet_start"), (F.max("ordinal") + 1).alias("packet_end"), (F.max_by("received_ms", "ordinal") - F.min_by("received_ms", "ordinal")).alias("span_ms"))


def sample_times(packets: DataFrame, samples: int) -> DataFrame:
    """Estimated times of ``samples`` samples in each packet: even steps to the next packet, or of the median delta."""
    median = deltas(packets).groupBy("session").agg(F.coalesce(F.percentile("delta", F.lit(0.5)), F.lit(1000.0)).alias("_m"))
    step = lambda w: (F.lead("received_ms").over(w) - F.col("received_ms")).cast("double")
    ahead = neighbours(packets, ["session"], "ordinal", {"_d": step}).join(median, "session")
    span = F.when(F.col("_d") > 0, F.col("_d")).otherwise(F.col("_m"))
    each = ahead.select("session", "ordinal", "received_ms", span.alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("j"))
    return each.select("session", "ordinal", "j", (F.col("received_ms") + (F.col("j") + 0.5) * F.col("_s") / samples).alias("t_ms"))


def relative_times(packets: DataFrame, samples: int) -> DataFrame:
    """Times of ``samples`` samples in each packet at even steps of the session's median positive delta; no sample, no row."""
    if samples < 1:
        return packets.select("session", "ordinal", F.lit(0).alias("j"), F.lit(0.0).alias("t_ms")).where("false")
    each = packets.join(thresholds(packets).select("session", "median_ms"), "session").select("session", "ordinal", "received_ms", "median_ms", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("j"))
    return each.select("session", "ordinal", "j", (F.col("received_ms") + F.col("j") * F.col("median_ms") / samples).alias("t_ms"))


def nested_correlation(packets: DataFrame) -> DataFrame:
    """Per session: the correlation of the steps of nested_time with those of received_ms; null for under three packets, for
    a packet without one of the two, and where either doesn't change. Sums are of differences from the mean, so that large
    times cancel nothing."""
    steps = neighbours(packets, ["session"], "ordinal", {"delta": lambda w: (F.col("received_ms") - F.lag("received_ms").over(w)).cast("double"), "step": lambda w: F.col("nested_time") - F.lag("nested_time").over(w)})
    means = steps.groupBy("session").agg(F.avg("step").alias("ms"), F.avg("delta").alias("md"), F.count("*").alias("n"), F.count("nested_time").alias("k"), F.count("received_ms").alias("r"))
    x, y = F.col("step") - F.col("ms"), F.col("delta") - F.col("md")
    sums = steps.join(means, "session").groupBy("session").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.first("r").alias("r"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    whole = (F.col("n") >= 3) & (F.col("k") == F.col("n")) & (F.col("r") == F.col("n")) & (F.col("xx") > 0) & (F.col("yy") > 0)
    return sums.select("session", F.when(whole, F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))).alias("nested_time_delta_corr"))


def corpus(packets: DataFrame, gap_ms: float = GAP_MS, samples: int | None = None) -> DataFrame:
    """One row for all sessions: totals of gaps, regressions and duplicates, sessions whose deltas don't add up, the share of
    sessions with a gap, and the rate that ``samples`` a packet imply (null without them, or without a step forward)."""
    s = summaries(packets, gap_ms)
    total = s.agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum("packet_count"), F.lit(0)).alias("packets"), F.coalesce(F.sum("gap_count"), F.lit(0)).alias("total_gap_count"), F.coalesce(F.sum("regression_count"), F.lit(0)).alias("total_regression_count"),
        F.coalesce(F.sum("duplicate_count"), F.lit(0)).alias("total_duplicate_count"), F.count_if("duration_inconsistency").alias("duration_inconsistency_count"), F.count_if(F.col("gap_count") > 0).alias("gap_sessions"))
    middle = deltas(packets).where(F.col("delta") > 0).groupBy("delta").agg(F.count("*").alias("n"))  # equal steps once
    middle = middle.agg(F.percentile("delta", F.lit(0.5), F.col("n")).alias("m"))
    rate = F.when(F.col("m") > 0, F.lit(samples).cast("double") / (F.col("m") / 1000.0))
    return total.join(middle).select(*total.columns, (F.col("gap_sessions") / F.greatest("sessions", F.lit(1))).alias("gap_rate_sessions"), rate.alias("implied_rate_hz"))
