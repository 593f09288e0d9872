"""Statistics of payload positions and of the bits of their words. Input rows: session, ordinal, pos, v."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.functions.bits import bit_length, byte, leading_zeros, to_uint24, trailing_zeros
from tracegrain.functions.ordering import neighbours
from tracegrain.functions.store import exact_percentiles, number_rows

from .verdicts import named


def position_stats(words: DataFrame) -> DataFrame:
    """Per position: count, range, mean, sample deviation (0 for one value), bit lengths, rates of zero and saturation."""
    v = F.col("v")
    bits = F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v))))
    u = to_uint24(v)
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0)).alias
    return words.groupBy("pos").agg(F.count("*").alias("n"), F.min(v).alias("v_min"), F.max(v).alias("v_max"), (F.max(v) - F.min(v)).alias("v_range"), F.avg(v).alias("v_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("v_std"), F.min(bits).alias("bits_min"), F.max(bits).alias("bits_max"), F.avg(bits).alias("bits_mean"), rate(v == 0)("zero_rate"), rate((u == 0) | (u == 16777215))("saturation_rate"))


def bit_histograms(words: DataFrame) -> DataFrame:
    """kind (bit_length, leading_zeros, trailing_zeros), value, n."""
    u = words.select(to_uint24(F.col("v")).alias("u"))
    each = u.groupBy("u").agg(F.count("*").alias("n"))  # equal words once
    kinds = each.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), f(F.col("u")).cast("long").alias("value")) for k, f in (("bit_length", bit_length), ("leading_zeros", leading_zeros), ("trailing_zeros", trailing_zeros))])).alias("x"))
    return kinds.groupBy(F.col("x.kind").alias("kind"), F.col("x.value").alias("value")).agg(F.sum("n").alias("n"))


def divisibility(words: DataFrame) -> DataFrame:
    """k and the share of words that 2**k divides, for k from 1 to 8, in one pass."""
    u = to_uint24(F.col("v"))
    shares = words.agg(*[F.avg(F.when(u % (1 << k) == 0, 1.0).otherwise(0.0)).alias(str(k)) for k in range(1, 9)])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("share")) for k in range(1, 9)])).alias("x")).select("x.*")


def byte_diversity(words: DataFrame) -> DataFrame:
    """Per position and byte lane: distinct bytes out of 256. Distinct pairs are at most 768 a position."""
    lanes = F.explode(F.array(*[F.struct(F.lit(k).alias("lane"), byte(F.col("v"), k).alias("b")) for k in "ABC"])).alias("x")
    pairs = words.select("pos", lanes).select("pos", "x.*").distinct()
    return pairs.groupBy("pos", "lane").agg((F.count("*") / 256.0).alias("unique_fraction"))


def constant_rate(payloads: DataFrame) -> DataFrame:
    return payloads.agg(F.avg(F.when(F.array_min("payload") == F.array_max("payload"), 1.0).otherwise(0.0)).alias("constant_rate"), F.count("*").alias("n"))


def changes(words: DataFrame) -> DataFrame:
    """Per session and position, along packets: monotonicity, bit stability, mean absolute step."""
    stepped = neighbours(words, ["session", "pos"], "ordinal", {"_p": lambda w: F.lag("v").over(w)}).where(F.col("_p").isNotNull())
    d = F.col("v") - F.col("_p")
    up, down = (F.avg(F.when(c, 1.0).otherwise(0.0)) for c in (d >= 0, d <= 0))
    flips = F.sum(F.bit_count(to_uint24(F.col("v").bitwiseXOR(F.col("_p")))))
    return stepped.groupBy("session", "pos").agg(F.greatest(up, down).alias("monotonicity"), (1 - flips / (24.0 * F.count("*"))).alias("bit_stability"), F.avg(F.abs(d)).alias("mean_abs_step"))


def spread(words: DataFrame) -> DataFrame:
    """Per position: median, MAD, interquartile range, share of distinct values. Exact; no position's values meet in one task."""
    rows = words.select("pos", F.col("v").cast("double").alias("v"))
    first = exact_percentiles(rows, ["pos"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    away = rows.join(F.broadcast(first.select("pos", "median")), "pos").select("pos", F.abs(F.col("v") - F.col("median")).alias("d"))
    mad = exact_percentiles(away, ["pos"], "d", {"mad": 0.5})
    distinct = rows.groupBy("pos", "v").agg(F.count("*").alias("n")).groupBy("pos").agg((F.count("*") / F.sum("n")).alias("unique_ratio"))
    return first.join(mad, "pos").join(distinct, "pos").select("pos", "median", (F.col("q3") - F.col("q1")).alias("iqr"), "unique_ratio", "mad")


def session_consistency(words: DataFrame) -> DataFrame:
    """Per position: population deviation of the sessions' medians, raw and over their MAD."""
    v = F.col("v").cast("double")
    med = words.groupBy("session", "pos").agg(F.percentile(v, F.lit(0.5)).alias("m"))
    mad = words.join(med, ["session", "pos"]).groupBy("session", "pos").agg(F.first("m").alias("m"), F.percentile(F.abs(v - F.col("m")), F.lit(0.5)).alias("mad"))
    return mad.groupBy("pos").agg(F.stddev_pop("m").alias("raw_spread"), F.stddev_pop(F.col("m") / (F.col("mad") + 1e-9)).alias("robust_spread"))


def consistency_overall(words: DataFrame) -> DataFrame:
    """Mean and highest spread over all positions; nothing is spread with under two sessions (0)."""
    one = words.select("session").distinct().count() < 2
    c = session_consistency(words)
    at = lambda f, k: F.when(F.lit(one), 0.0).otherwise(F.coalesce(f(k), F.lit(0.0)))
    return c.agg(*[at(f, f"{k}_spread").alias(f"{k}_{n}") for k in ("raw", "robust") for n, f in (("mean", F.avg), ("max", F.max))])


def dense(stats: DataFrame, length: int) -> DataFrame:
    """``stats`` (pos, n, ...) for every position below ``length``, those without values included (n is 0), and no other."""
    every = stats.sparkSession.range(length).select(F.col("id").cast("int").alias("pos"))
    return every.join(stats, "pos", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _correlation(x: str, y: str) -> Column:
    """Absolute correlation; 0 for under three rows, or where one of the two doesn't change."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    ok = (F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) >= 3) & (sx >= 1e-12) & (sy >= 1e-12)
    return F.coalesce(F.when(ok, F.abs(F.try_divide(F.covar_pop(x, y), sx * sy))), F.lit(0.0))


def features(payloads: DataFrame, length: int) -> DataFrame:
    """The eleven features of each position below ``length`` over all packets (session, ordinal, received_ms, payload), in the
    order of (session, ordinal): their number is the packet's index, and a packet's neighbour is the one after it.

    Packets are numbered by range partitions and joined with the next number, so neither a session nor a position is ever
    gathered in one task.
    """
    usable = payloads.where(F.size("payload") == length).select("session", "ordinal", "received_ms", "payload")
    packets = number_rows(usable, ["session", "ordinal"], "idx")
    p, v = F.posexplode("payload"), F.col("v")
    each = packets.select("idx", "received_ms", "payload", p.alias("pos", "v"))
    each = each.select("pos", v.cast("double").alias("v"), F.col("idx").cast("double").alias("idx"), F.col("received_ms").cast("double").alias("t"), F.get("payload", F.col("pos") - 1).cast("double").alias("left"), F.get("payload", F.col("pos") + 1).cast("double").alias("right"))
    sides = [F.when(F.count(k) > 0, _correlation("v", k)) for k in ("left", "right")]
    near = F.coalesce((F.coalesce(sides[0], F.lit(0.0)) + F.coalesce(sides[1], F.lit(0.0))) / F.nullif(sum(F.when(x.isNotNull(), 1).otherwise(0) for x in sides), F.lit(0)), F.lit(0.0))
    linear = each.groupBy("pos").agg(_correlation("v", "idx").alias("corr_packet_index"), _correlation("v", "t").alias("corr_timestamp"), near.alias("neighbor_corr"), F.min("v").alias("low"), F.max("v").alias("high"))
    after = packets.select((F.col("idx") - 1).alias("idx"), F.col("payload").alias("next"))
    steps = packets.select("idx", "payload").join(after, "idx").select(F.posexplode(F.arrays_zip("payload", "next")).alias("pos", "x")).select("pos", F.col("x.payload").alias("v"), F.col("x.next").alias("w"))
    d = F.col("w") - v
    up, down = (F.avg(F.when(c, 1.0).otherwise(0.0)) for c in (d >= 0, d <= 0))
    flips = F.sum(F.bit_count(to_uint24(v.bitwiseXOR(F.col("w")))))
    along = steps.groupBy("pos").agg(F.greatest(up, down).alias("monotonicity"), (1 - flips / (24.0 * F.count("*"))).alias("bit_pattern_stability"))
    moved = steps.select("pos", d.cast("double").alias("d"))
    middle = exact_percentiles(moved, ["pos"], "d", {"m": 0.5})
    mad = exact_percentiles(moved.join(F.broadcast(middle), "pos").select("pos", F.abs(F.col("d") - F.col("m")).alias("a")), ["pos"], "a", {"cross_packet_deriv_mad": 0.5})
    return (
        spread(each.select("pos", "v")).join(linear, "pos").join(_entropy(each.select("pos", "v"), linear), "pos").join(along, "pos", "left").join(mad, "pos", "left")
        .select("pos", "median", "mad", "iqr", "entropy", "unique_ratio", F.coalesce("monotonicity", F.lit(0.0)).alias("monotonicity"), "corr_packet_index", "corr_timestamp", F.coalesce("cross_packet_deriv_mad", F.lit(0.0)).alias("cross_packet_deriv_mad"), "neighbor_corr", F.coalesce("bit_pattern_stability", F.lit(1.0)).alias("bit_pattern_stability"))
    )


def _entropy(values: DataFrame, bounds: DataFrame, bins: int = 32) -> DataFrame:
    """Bits of each position's values: of themselves if there are at most ``bins`` different ones, else of equal bins."""
    counts = values.groupBy("pos", "v").agg(F.count("*").alias("n"))
    many = counts.groupBy("pos").agg((F.count("*") > bins).alias("many"), F.sum("n").alias("all"))
    known = counts.join(F.broadcast(many), "pos").join(F.broadcast(bounds.select("pos", "low", "high")), "pos")
    place = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)).cast("double")
    share = known.groupBy("pos", F.when(F.col("many"), place).otherwise(F.col("v")).alias("bin")).agg((F.sum("n") / F.first("all")).alias("p"))
    return share.groupBy("pos").agg((-F.sum(F.col("p") * F.log2(F.col("p") + 1e-15))).alias("entropy"))


# fixed values: what speaks for a position that holds no samples, and from which sum on it is left out
EXCLUDE = 0.45


def exclusions(found: DataFrame, threshold: float = EXCLUDE) -> DataFrame:
    """``found`` (features) with metadata_likelihood, decision and reasons."""
    f = F.col
    evidence = [
        (f("monotonicity") >= 0.95, 0.25, "high_monotonicity"), (f("corr_packet_index") >= 0.8, 0.25, "tracks_packet_index"), (f("corr_timestamp") >= 0.8, 0.15, "tracks_timestamp"),
        ((f("neighbor_corr") < 0.15) & (f("unique_ratio") > 0.5), 0.15, "low_neighbor_corr"), ((f("bit_pattern_stability") >= 0.98) & (f("unique_ratio") < 0.1), 0.1, "stable_bit_pattern"),
        ((f("mad") < 1e-6) & (f("unique_ratio") < 0.05), 0.1, "near_constant"), ((f("entropy") < 1.0) & (f("unique_ratio") < 0.2), 0.05, "low_entropy"),
    ]
    total = F.lit(0.0)
    for when, weight, _ in evidence:
        total = total + F.when(when, weight).otherwise(0.0)
    scored = found.withColumn("metadata_likelihood", F.least(F.lit(1.0), total))
    out = f("metadata_likelihood") >= threshold
    return scored.withColumn("decision", F.when(out, "propose_exclude").otherwise("keep")).withColumn("reasons", named(*[(w, k) for w, _, k in evidence], (out, "score_above_threshold")))
