"""Decision tables: window quality, channel compatibility, rate gates. What is missing never improves a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: thresholds of the channel verdict
COMPATIBLE = {"frequency_agreement": 0.70, "median_lagged_correlation": 0.30, "median_coherence": 0.20}
PARTIAL = {"frequency_agreement": 0.50, "median_lagged_correlation": 0.25, "median_coherence": 0.10}
LEAST_PAIRS, LEAST_FRACTION = 10, 0.60


def at_least(x: Column, t: float) -> Column:
    return F.coalesce(x >= t, F.lit(False))


def named(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order; a condition that can't be told doesn't."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for c, k in pairs]), lambda x: x.isNotNull())


def channel_criteria(pairs: Column, fraction: Column, frequency: Column, lagged: Column, coherence: Column) -> Column:
    """verdict, passed and failed: the criteria are looked at in three steps (enough pairs, compatible, partial), each only
    if the one before it doesn't settle the verdict."""
    enough = [(at_least(pairs, LEAST_PAIRS), "min_evaluable_pairs"), (at_least(fraction, LEAST_FRACTION), "min_evaluable_fraction")]
    steps = [[(at_least(x, t[k]), f"{step}_{k}") for x, k in zip((frequency, lagged, coherence), t, strict=True)] for step, t in (("compatible", COMPATIBLE), ("partial", PARTIAL))]
    (f, _), (x, _), (c, _) = steps[1]
    settled = enough[0][0] & enough[1][0]
    full = steps[0][0][0] & steps[0][1][0] & steps[0][2][0]
    verdict = F.when(~settled, "NOT_EVALUABLE").when(full, "COMPATIBLE").when(f & (x | c), "PARTIALLY_COMPATIBLE").otherwise("INSUFFICIENT_CHANNEL_AGREEMENT")
    looked = [F.lit(True)] * 2 + [settled] * 3 + [settled & ~full] * 3
    lists = [named(*[(seen & (ok if want else ~ok), k) for seen, (ok, k) in zip(looked, enough + steps[0] + steps[1], strict=True)]) for want in (True, False)]
    return F.struct(verdict.alias("verdict"), lists[0].alias("passed"), lists[1].alias("failed"))


def channel_verdict(pairs: Column, fraction: Column, frequency: Column, lagged: Column, coherence: Column) -> Column:
    return channel_criteria(pairs, fraction, frequency, lagged, coherence)["verdict"]


def evaluable(reasons: Column) -> Column:
    return ~F.array_contains(reasons, "too_short")


def of_selection(pairs: DataFrame, layout: str | None, hypothesis: str | None) -> DataFrame:
    """The pairs of the chosen layout and hypothesis; none if nothing is chosen."""
    return pairs.where((F.col("layout") == F.lit(layout)) & (F.col("hypothesis") == F.lit(hypothesis)))


def pair_summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Roll-up of channel pairs (zero_lag, max_xcorr, best_lag, coherence, dom_a, dom_b, agree, reasons), with the verdict
    and the criteria that passed and failed. Pairs that are too short count in the total alone."""
    ok = evaluable(F.col("reasons"))
    told = ok & F.col("dom_a").isNotNull() & F.col("dom_b").isNotNull()
    at = lambda x, q: F.percentile(F.when(ok, x), F.lit(q))
    lag = F.col("best_lag").cast("double")
    s = pairs.groupBy(*by).agg(
        F.count("*").alias("total_pairs"), F.count_if(ok).alias("evaluable_pairs"), F.count_if(told).alias("frequency_evaluable"), F.count_if(told & F.col("agree")).alias("frequency_agreeing"),
        at(F.abs("zero_lag"), 0.5).alias("median_abs_zero_lag"), at(F.col("max_xcorr"), 0.5).alias("median_max_xcorr"), at(F.col("coherence"), 0.5).alias("median_coherence"), at(lag, 0.5).alias("median_best_lag"), (at(lag, 0.75) - at(lag, 0.25)).alias("best_lag_iqr"))
    s = s.withColumn("evaluable_fraction", F.col("evaluable_pairs") / F.greatest("total_pairs", F.lit(1))).withColumn("frequency_fraction", F.when(F.col("frequency_evaluable") > 0, F.col("frequency_agreeing") / F.col("frequency_evaluable")))
    return s.select("*", channel_criteria(F.col("evaluable_pairs"), F.col("evaluable_fraction"), F.col("frequency_fraction"), F.col("median_max_xcorr"), F.col("median_coherence")).alias("c")).select(*s.columns, "c.*")


def pair_reasons(pairs: DataFrame, by: list[str]) -> DataFrame:
    """How often each reason stands at pairs that can't be evaluated; ``unspecified`` where none is given."""
    left = pairs.where(~evaluable(F.col("reasons")))
    codes = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("unspecified")))
    return left.select(*by, F.explode(codes).alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("n"))


def flat_and_clip(values: Column) -> Column:
    """(flat, clip): the share of steps of at most 1e-6 (1 for under two values), and of values at the edges of their range."""

    def shares(x: Column) -> Column:
        v, low, span = x["v"], x["low"], x["high"] - x["low"]
        n = F.size(v)
        still = F.size(F.filter(F.zip_with(F.slice(v, 2, F.greatest(n - 1, F.lit(0))), F.slice(v, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: F.abs(a - b)), lambda d: d <= 1e-6))
        edge = F.size(F.filter(v, lambda y: (y <= x["low"] + 0.01 * span) | (y >= x["high"] - 0.01 * span))) / F.greatest(n, F.lit(1))
        exact = F.size(F.filter(v, lambda y: (y == low) | (y == x["high"]))) / F.greatest(n, F.lit(1))
        flat = F.when(n < 2, 1.0).otherwise(still / F.greatest(n - 1, F.lit(1)))
        return F.struct(flat.alias("flat"), F.when(n < 1, 0.0).when(span < 1e-9, 1.0).when(span < 100, 0.0).when(edge > 0.3, edge).otherwise(exact).alias("clip"))

    # the range is worked out once, before any value is held against it
    return F.transform(F.array(F.struct(values.alias("v"), F.array_min(values).alias("low"), F.array_max(values).alias("high"))), shares)[0]


def windows(segments: DataFrame, seconds: float = 10.0, hop_seconds: float = 5.0) -> DataFrame:
    """Sliding windows over ``values`` (fs): the whole segment where it is shorter; a last partial window is left out."""
    win, hop = F.greatest(F.lit(8), F.floor(F.col("fs") * seconds).cast("int")), F.greatest(F.lit(1), F.floor(F.col("fs") * hop_seconds).cast("int"))
    n = F.size("values")
    starts = F.when(n <= win, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - win, F.lit(0)), hop))
    each = segments.withColumn("_w", win).withColumn("start_idx", F.explode(starts))
    return each.withColumn("values", F.slice("values", F.col("start_idx") + 1, F.col("_w"))).withColumn("end_idx", F.col("start_idx") + F.size("values")).drop("_w")


# fixed values: what a quality window gains and loses by, and its labels from the best to the worst
LABELS = ["plausible_candidate_signal", "uncertain", "poor", "unusable"]


def window_quality(rows: DataFrame) -> DataFrame:
    """score, label and reasons of windows with flat, clip, their segment's band_power_ratio, prominence, harmonic, acf_peak
    and usable (all null where it has none), and their pair's agree, rel_diff and inverted (likewise)."""
    has, usable = F.col("usable").isNotNull(), F.coalesce("usable", F.lit(False))
    dead = F.col("flat") >= 0.9
    clipped = ~dead & (F.col("clip") >= 0.5)
    live = ~dead & ~clipped
    agree = F.coalesce("agree", F.lit(False))
    terms = [
        (usable, 0.25, "periodic_ok"), (F.col("band_power_ratio") >= 0.2, 0.1, None), (F.col("prominence") >= 3.0, 0.1, "prominent_peak"), (F.col("harmonic"), 0.05, None), (has & ~usable, -0.15, "weak_periodicity"),
        (agree, 0.1, "channel_agree"), (~agree & (F.col("rel_diff") > 0.25), -0.1, "channel_disagree"), (F.col("inverted"), 0.02, "inverted_channels"),
    ]
    raw = F.lit(0.5)
    for when, gain, _ in terms:
        raw = raw + F.when(F.coalesce(when, F.lit(False)), gain).otherwise(0.0)
    score = F.when(dead, 0.05).when(clipped, 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    fine = (F.col("score") >= 0.7) & usable & at_least(F.col("band_power_ratio"), 0.15) & at_least(F.col("acf_peak"), 0.15)
    label = F.when(~live, "unusable").when(fine, "plausible_candidate_signal").when(F.col("score") >= 0.45, "uncertain").otherwise("poor")
    last = [(F.col("label") == k, v) for k, v in (("plausible_candidate_signal", "plausible_candidate"), ("uncertain", "mixed_evidence"), ("poor", "low_score"))]
    reasons = named((dead, "flatline"), (clipped, "clipping"), *[(live & when, code) for when, _, code in terms if code], *last)
    return rows.withColumn("score", F.round(score, 9)).withColumn("label", label).withColumn("reasons", reasons)


def label_counts(windows: DataFrame) -> DataFrame:
    """Windows of each label, those without any included, and their share of all in percent (0 where there are none)."""
    counts = windows.agg(F.count("*").alias("all"), *[F.count_if(F.col("label") == k).alias(k) for k in LABELS])
    each = counts.select("all", F.inline(F.array(*[F.struct(F.lit(k).alias("label"), F.col(k).alias("n")) for k in LABELS])))
    return each.select("label", "n", (F.col("n") / F.greatest("all", F.lit(1)) * 100.0).alias("percent"))


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Counts, balanced accuracy, precision, recall and F1 of 0/1 columns; ratios without a base are 0."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    c = rows.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(~t & ~g).alias("tn"), F.count_if(t & ~g).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(0.0)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    c = c.withColumn("recall", ratio(tp, tp + fn)).withColumn("precision", ratio(tp, tp + fp)).withColumn("balanced_accuracy", (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2)
    both = F.col("precision") + F.col("recall")
    return c.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / F.greatest(both, F.lit(1e-300))).otherwise(0.0))


def paired_errors(rows: DataFrame, truth: str, guess: str, by: list[str]) -> DataFrame:
    """Coverage of the estimates, and mean and median absolute error and bias where there is one."""
    has = F.col(guess).isNotNull() & ~F.isnan(F.col(guess).cast("double"))
    e = F.when(has, F.col(guess) - F.col(truth))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(has, 1.0).otherwise(0.0)).alias("coverage"), F.avg(F.abs(e)).alias("mae"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_abs_error"), F.avg(e).alias("bias"))


def mean_rates(periodicity: DataFrame, by: list[str]) -> DataFrame:
    """Mean rates a minute by spectrum (dominant_hz) and by time (acf_lag_s), over the values above zero; null without."""
    hz, lag = F.col("dominant_hz"), F.col("acf_lag_s")
    return periodicity.groupBy(*by).agg(F.avg(F.when(hz > 0, hz * 60.0)).alias("spectral"), F.avg(F.when(lag > 0, 60.0 / lag)).alias("time_domain"))


# fixed values: decoder statuses that open the first gate, and what a channel verdict says at the last one
GOOD_DECODERS = ["PROVISIONALLY_ACCEPTED", "ACCEPTED"]
MOST_ERROR, LEAST_COVERAGE, TOLERANCE = 5.0, 0.80, 5.0
CHANNEL_GATES = {"COMPATIBLE": "channel_agreement_compatible", "PARTIALLY_COMPATIBLE": "channel_agreement_partial_only", "INSUFFICIENT_CHANNEL_AGREEMENT": "channel_agreement_insufficient"}


def rate_gates(rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``rows`` (decoder_status, public_error, public_coverage, spectral, time_domain, verdict) with rate_status, rate and
    the gates passed and failed. What is missing fails its gate. Two rates too far apart outrank all other failures if the
    decoder is good; a rate is given only if every gate is passed."""
    good = F.coalesce(F.col("decoder_status").isin(GOOD_DECODERS), F.lit(False))
    error, coverage = F.coalesce(F.col("public_error") <= MOST_ERROR, F.lit(False)), at_least(F.col("public_coverage"), LEAST_COVERAGE)
    both = F.col("spectral").isNotNull() & F.col("time_domain").isNotNull()
    apart = F.coalesce(F.abs(F.col("spectral") - F.col("time_domain")) > tolerance, F.lit(False))
    agree = F.coalesce(F.col("verdict") == "COMPATIBLE", F.lit(False))
    passed = named((good, "decoder_status_ok"), (error, "public_median_abs_hr_error_ok"), (coverage, "public_coverage_ok"), (both & ~apart, "spectral_time_agree"), (agree, CHANNEL_GATES["COMPATIBLE"]))
    gate = F.lit("channel_agreement_not_evaluable")
    for verdict in ("PARTIALLY_COMPATIBLE", "INSUFFICIENT_CHANNEL_AGREEMENT"):
        gate = F.when(F.col("verdict") == verdict, CHANNEL_GATES[verdict]).otherwise(gate)
    failed = named((~good, "decoder_status_insufficient"), (~error, "public_median_abs_hr_error_gate"), (~coverage, "public_coverage_gate"), (~both, "rate_estimates_unavailable"), (apart, "spectral_time_disagreement"))
    failed = F.concat(failed, F.when(agree, F.array().cast("array<string>")).otherwise(F.array(gate)))
    out = rows.withColumn("passed", passed).withColumn("failed", failed)
    status = F.when(apart & good, "METHOD_DISAGREEMENT").when(F.size("failed") > 0, "NOT_COMPUTED").otherwise("COMPUTED")
    return out.withColumn("rate_status", status).withColumn("rate", F.when(F.col("rate_status") == "COMPUTED", (F.col("spectral") + F.col("time_domain")) / 2))
