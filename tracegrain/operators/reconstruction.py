"""Hypotheses on what a payload holds, and the channels that each gives under four layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrain.functions.bits import transform_word
from tracegrain.functions.ordering import running_sum

from . import spectral, timebase, verdicts

LAYOUTS = ["INTERLEAVED_PACKET_LOCAL", "INTERLEAVED_CONTINUOUS", "BLOCKED_PACKET_LOCAL", "BLOCKED_CONTINUOUS"]


def hypotheses(spark: SparkSession, length: int = 66, primary: bool = False) -> DataFrame:
    """The seven hypotheses (hypothesis, variant, channel_count, metadata, signal), or the first choice of each of the
    four families: a fixed small table. ``metadata`` and ``signal`` are positions and part the payload between them."""
    half = length // 2
    rows = [
        ("H_2x33", "default", 2, [], True),
        ("H_2x32_plus_2global", "endpoints", 2, [0, length - 1], True),
        ("H_2x32_plus_2global", "leading", 2, [0, 1], False),
        ("H_2x32_plus_2global", "trailing", 2, [length - 2, length - 1], False),
        ("H_2block_meta_per_ch", "last_of_block", 2, [half - 1, length - 1], True),
        ("H_2block_meta_per_ch", "first_of_block", 2, [0, half], False),
        ("H_3x22", "default", 3, [], True),
    ]
    kept = [F.struct(F.lit(h).alias("hypothesis"), F.lit(v).alias("variant"), F.lit(c).alias("channel_count"), F.array(*map(F.lit, m)).cast("array<int>").alias("metadata")) for h, v, c, m, first in rows if first or not primary]
    df = spark.range(0, 1, 1, 1).select(F.inline(F.array(*kept)))  # one partition: what is made of it shuffles nothing
    return df.withColumn("signal", F.array_except(F.sequence(F.lit(0), F.lit(length - 1)), "metadata"))


def layouts_identical(length: Column, channel_count: Column) -> Column:
    """Whether local and continuous layouts of payloads of ``length`` coincide."""
    return (channel_count > 0) & (F.try_mod(length, channel_count) == 0)


def channels(payloads: DataFrame, grid: DataFrame, length: int) -> DataFrame:
    """Words (x) by session, hypothesis, variant, layout and channel, in the order of (ordinal, i).

    ``payloads``: session, ordinal, payload; those that are null or of another length are left out, and sessions left
    without any vanish. A continuous layout's phase is the number of earlier words (interleaved) or of earlier left-over
    words (blocked) of the session, in closed form from the packet's place. ``grid`` is a fixed small table.
    """
    usable = payloads.where(F.size("payload") == length)
    numbered = running_sum(usable.select("session", "ordinal", "payload"), ["session"], "ordinal", F.lit(1), "place", inclusive=False)
    words = numbered.join(F.broadcast(grid), F.lit(True)).select("session", "ordinal", "place", "hypothesis", "variant", "channel_count", F.size("signal").alias("n"), F.posexplode(F.transform("signal", lambda i: F.get("payload", i))).alias("i", "x"))
    return words.select("session", "hypothesis", "variant", F.explode(_layouts()).alias("l"), "ordinal", "i", "x").select("session", "hypothesis", "variant", "l.*", "ordinal", "i", "x")


def _layouts() -> Column:
    """Layout and channel of a word, four of them: word ``i`` of ``n`` of the packet at ``place``, dealt to ``channel_count``."""
    c, n, i, k = F.col("channel_count"), F.col("n"), F.col("i"), F.col("place")
    block = F.floor(n / c)
    left = n - block * c
    over = i - block * c
    dealt = lambda phase: F.pmod(phase + i, c)
    blocked = lambda phase: F.when(over < 0, F.floor(i / F.greatest(block, F.lit(1)))).otherwise(F.pmod(phase + over, c))
    zero = F.lit(0).cast("long")
    each = zip(LAYOUTS, (dealt(zero), dealt(k * n), blocked(zero), blocked(k * left)), strict=True)
    return F.array(*[F.struct(F.lit(name).alias("layout"), ch.cast("long").alias("channel")) for name, ch in each])


def deals(grid: DataFrame) -> DataFrame:
    """hypothesis (with its variant), layout, channel, channel_count, turns: the positions of a channel's words in the packet at a
    place are ``turns[place mod channel_count]``, as phases come round after so many packets. A fixed small table."""
    cell = ["hypothesis", "variant", "channel_count", "layout", "channel"]
    places = grid.select("hypothesis", "variant", "channel_count", "signal", F.explode(F.sequence(F.lit(0), F.col("channel_count") - 1)).alias("place"))
    words = places.select("hypothesis", "variant", "channel_count", "place", F.size("signal").alias("n"), F.posexplode("signal").alias("i", "pos"))
    each = words.select("hypothesis", "variant", "channel_count", "place", "i", "pos", F.explode(_layouts()).alias("l")).select("*", "l.*")
    at = each.groupBy(*cell, "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "pos"))), lambda s: s["pos"]).alias("at"))
    known = at.groupBy(*cell).agg(F.map_from_entries(F.collect_list(F.struct("place", "at"))).alias("m"))
    turns = F.transform(F.sequence(F.lit(0), F.col("channel_count") - 1), lambda p: F.coalesce(F.element_at("m", p), F.array().cast("array<int>")))
    return known.select(hypothesis_key(F.col("hypothesis"), F.col("variant")).alias("hypothesis"), "layout", "channel", "channel_count", turns.alias("turns"))


def alike(grid: DataFrame) -> DataFrame:
    """layout, hypothesis, of_layout, of_hypothesis: each cell of the grid, and the first of those that deal as it does. Where a
    payload's words part evenly, packet-local and continuous layouts are one dealing. A fixed small table."""
    whole = deals(grid).groupBy("layout", "hypothesis").agg(F.to_json(F.array_sort(F.collect_list(F.struct("channel", "channel_count", "turns")))).alias("dealt"))
    first = whole.groupBy("dealt").agg(F.min(F.struct("hypothesis", "layout")).alias("f")).select("dealt", F.col("f.layout").alias("of_layout"), F.col("f.hypothesis").alias("of_hypothesis"))
    return whole.join(F.broadcast(first), "dealt").select("layout", "hypothesis", "of_layout", "of_hypothesis")


def in_all_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``rows`` (layout, hypothesis and more) of the cells that ``gap_segments`` gave ``once``, again for each cell of ``cells`` (alike())."""
    named = cells.select("of_layout", "of_hypothesis", F.col("layout").alias("_layout"), F.col("hypothesis").alias("_hypothesis"))
    each = rows.join(F.broadcast(named), (F.col("layout") == F.col("of_layout")) & (F.col("hypothesis") == F.col("of_hypothesis")))
    return each.withColumn("layout", F.col("_layout")).withColumn("hypothesis", F.col("_hypothesis")).select(*rows.columns)


PHASE_NAMES = {"packet_local": LAYOUTS[0], "continuous": LAYOUTS[1]}


def layout_name(short: Column) -> Column:
    """The layout's full name for the short one of the decoder grid; null for another."""
    out = F.lit(None).cast("string")
    for k, v in PHASE_NAMES.items():
        out = F.when(short == k, v).otherwise(out)
    return out


def hypothesis_key(hypothesis: Column, variant: Column) -> Column:
    return F.concat_ws(":", hypothesis, variant)


def is_partition(signal: Column, metadata: Column, length: Column) -> Column:
    """Whether the two lists of positions part 0 to length - 1 between them."""
    whole = F.array_sort(F.concat(signal, metadata)) == F.sequence(F.lit(0), length - 1)
    return F.coalesce(whole & (F.size(F.array_intersect(signal, metadata)) == 0), F.lit(False))


def interleave(samples: DataFrame, keys: list[str]) -> DataFrame:
    """``samples`` (keys, channel, idx, x) in one row of turns: ``at`` from 0 in the order of (idx, channel), which passes
    over channels that have run out. A group of ``keys`` is one packet."""
    w = Window.partitionBy(*keys).orderBy("idx", "channel")
    return samples.withColumn("at", F.row_number().over(w) - 1)


def _place(hypothesis: Column, layout: Column) -> Column:
    """A grid cell's place: hypotheses outside, layouts inside."""
    at = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), c)
    return at(hypothesis, ["H_2x33:default", "H_2x32_plus_2global:endpoints", "H_2block_meta_per_ch:last_of_block", "H_3x22:default"]) * len(LAYOUTS) + at(layout, LAYOUTS)


GRID = ["session", "layout", "hypothesis", "channel"]


def gap_segments(payloads: DataFrame, grid: DataFrame, length: int, floor_ms: float = timebase.GAP_MS, once: DataFrame | None = None) -> DataFrame:
    """The grid's channels cut at the gaps between packets (session, ordinal, received_ms, payload): one row for each session,
    layout, hypothesis (with its variant), channel and segment, with packet_start, packet_end (exclusive), the values in
    order, and fs. No value crosses a gap; a segment without values has no row.

    ``fs`` is the number of words of a whole packet over the session's median step, for every channel alike.
    With ``once`` (alike() of the grid) cells that deal alike come once, for ``in_all_cells`` to give what is told of them to all.
    """
    rows = _dealt_packets(payloads, grid, length, floor_ms, once=once)
    return rows.select(*GRID, "segment", F.col("held")[0]["ordinal"].alias("packet_start"), (F.element_at("held", -1)["ordinal"] + 1).alias("packet_end"), "fs", _values().alias("values"))


RUN = 64


def _dealt_packets(payloads: DataFrame, grid: DataFrame, length: int, floor_ms: float, run: int | None = None, once: DataFrame | None = None) -> DataFrame:
    """GRID, segment, fs, channel_count, turns, held: the packets (ordinal, place, payload) of a segment, or of each of its runs of
    at most ``run`` ordinals, that have words for the channel. Packets are gathered before they are dealt, so that they are shuffled once
    and not once a cell, and their words never are rows."""
    usable = payloads.where(F.size("payload") == length)
    cut = timebase.segments(usable.select("session", "ordinal", "received_ms"), floor_ms)
    placed = running_sum(cut.select("session", "ordinal", "segment", (F.lit(float(length)) / (F.col("median_ms") / 1000.0)).alias("fs")), ["session"], "ordinal", F.lit(1), "place", inclusive=False)
    packets = usable.select("session", "ordinal", "payload").join(placed, ["session", "ordinal"])
    packets = packets.withColumn("_run", F.floor(F.col("ordinal") / run) if run else F.lit(0).cast("long"))
    parts = int(payloads.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # what packets grow to counts, not their bytes
    whole = packets.repartition(parts, "session", "segment", "_run").groupBy("session", "segment", "_run").agg(F.first("fs").alias("fs"), F.array_sort(F.collect_list(F.struct("ordinal", "place", "payload"))).alias("packets"))
    ways = deals(grid)
    if once is not None:
        ways = ways.join(F.broadcast(once.select(F.col("of_layout").alias("layout"), F.col("of_hypothesis").alias("hypothesis")).distinct()), ["layout", "hypothesis"])
    each = whole.join(F.broadcast(ways))
    held = F.filter("packets", lambda p: F.size(_turn(p)) > 0)
    return each.select(*GRID, "segment", "fs", "channel_count", "turns", held.alias("held")).where(F.size("held") > 0)


def _turn(packet: Column) -> Column:
    return F.get("turns", F.pmod(packet["place"], F.col("channel_count")).cast("int"))


def _values() -> Column:
    return F.flatten(F.transform("held", lambda p: F.transform(_turn(p), lambda i: F.get(p["payload"], i).cast("double"))))


def segment_pieces(payloads: DataFrame, grid: DataFrame, length: int, floor_ms: float = timebase.GAP_MS) -> DataFrame:
    """What ``gap_segments`` cuts, by runs of at most RUN packets: GRID, segment, ordinal (the run's first), the runs' values of that
    channel in order, fs. For ``spectral_blocks``, which measure segments of any length."""
    rows = _dealt_packets(payloads, grid, length, floor_ms, RUN)
    return rows.select(*GRID, "segment", F.col("held")[0]["ordinal"].alias("ordinal"), "fs", _values().alias("values"))


def spectral_rollup(periodicity: DataFrame) -> DataFrame:
    """Per layout and hypothesis: segments, mean band ratio and ACF peak, share of usable ones, and how steady the dominant
    frequency of the usable ones is (cv is 0 for under two of them)."""
    hz = F.when(F.col("usable"), F.col("dominant_hz"))
    n = F.count(hz)
    cv = F.when(n < 2, 0.0).otherwise(F.stddev_pop(hz) / (F.avg(hz) + 1e-15))
    return periodicity.groupBy("layout", "hypothesis").agg(F.count("*").alias("n_segments"), F.avg("band_power_ratio").alias("mean_band_power_ratio"), F.avg("acf_peak").alias("mean_acf_peak"), F.avg(F.when(F.col("usable"), 1.0).otherwise(0.0)).alias("usable_fraction"), cv.alias("cv"), n.alias("n"), F.coalesce(F.avg(hz), F.lit(0.0)).alias("mean_hz"))


def selected(rollup: DataFrame) -> DataFrame:
    """The layout and hypothesis of the highest mean band ratio; of equal ones (to 12 digits, as the order of sums isn't
    fixed) the first of the grid. One row, nulls if there is nothing to choose from."""
    order = F.struct(F.round("mean_band_power_ratio", 12), -_place(F.col("hypothesis"), F.col("layout")))
    return rollup.agg(F.max_by(F.struct("layout", "hypothesis"), order).alias("s")).select("s.*")


def judged_windows(segments: DataFrame, periodicity: DataFrame, pairs: DataFrame, shared_ids: bool = True) -> DataFrame:
    """Quality windows of ``segments``, each with its segment's periodicity and its session's first channel pair of the same
    layout and hypothesis.

    A segment's id names session, channel and number only, so the grid's cells share it; with ``shared_ids`` all of them
    get the periodicity of the last cell that has the segment, without, each its own.
    """
    facts = ["band_power_ratio", "prominence", "harmonic", "acf_peak", "usable"]
    if shared_ids:
        ids = ["session", "channel", "segment"]
        known = periodicity.groupBy(*ids).agg(F.max_by(F.struct(*facts), _place(F.col("hypothesis"), F.col("layout"))).alias("f")).select(*ids, "f.*")
    else:
        ids = [*GRID, "segment"]
        known = periodicity.select(*ids, *facts)
    first = pairs.groupBy("session", "layout", "hypothesis").agg(F.min_by(F.struct("agree", "rel_diff", F.array_contains("reasons", "inverted_channels").alias("inverted")), F.struct("packet_start", "channel_a", "channel_b")).alias("p")).select("session", "layout", "hypothesis", "p.*")
    wins = verdicts.windows(segments).select(*GRID, "segment", "start_idx", "end_idx", verdicts.flat_and_clip(F.col("values")).alias("e")).select(*GRID, "segment", "start_idx", "end_idx", "e.*")
    return verdicts.window_quality(wins.join(known, ids, "left").join(first, ["session", "layout", "hypothesis"], "left"))


def segment_pairs(segments: DataFrame) -> DataFrame:
    """Agreement of each two channels of a session's segment."""
    return spectral.channel_pairs(segments, ["session", "layout", "hypothesis", "packet_start", "packet_end"])


def load(payloads: DataFrame, length: int, signedness: str = "int24", order: str = "CAB", most_sessions: int | None = None) -> DataFrame:
    """Packets with a time and a payload of ``length``, each word read as ``signedness`` and byte ``order`` say; with
    ``most_sessions``, of the first so many sessions alone, the limit being the feature. Sessions left without a packet vanish."""
    usable = payloads.where(F.col("received_ms").isNotNull() & (F.size("payload") == length))
    read = usable.withColumn("payload", F.transform("payload", lambda v: transform_word(v, signedness, order)))
    if most_sessions is None:
        return read
    first = usable.select("session").distinct().orderBy("session").limit(most_sessions)
    return read.join(F.broadcast(first) if most_sessions <= 10_000 else first, "session", "left_semi")
