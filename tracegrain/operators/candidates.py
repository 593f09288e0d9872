"""Scores of the 192 decoding candidates over all packets, their ranks and their statuses.

A candidate reads every word in one of 12 ways and deals it to channels in one of 16. Neighbours are found once a dealing,
on the raw words; the 12 readings are laid over them afterwards, so the windows run 16 and not 192 times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions.bits import ORDERS, byte
from tracegrain.functions.ordering import previous, running_sums
from tracegrain.functions.store import stored

from .scoring import CHANNELS, phased
from .steps import LAYOUTS, READINGS, channel_moments, edge_runs, jump_medians, packet_edges, pair_moments, step_medians

EPS = 1e-9
# fixed values: weights of the costs and thresholds of the statuses
WEIGHTS = {"deriv_mad": 1.0, "boundary_jump": 1.5, "session_consistency": 1.0, "position_dependence": 0.8, "saturation_rate": 1.2, "flatline_rate": 1.2, "channel_duplication": 1.0, "energy_balance": 0.6}
REJECT_SATURATION, REJECT_FLATLINE, REJECT_JUMP = 0.85, 0.90, 50.0
PROVISIONAL_JUMP, PROVISIONAL_CONSISTENCY, NEAR_TIE, TWIN, EXCEPTIONAL_GAP = 8.0, 0.75, 0.05, 0.02, 0.25
READING, DEALING = ["signedness", "byte_order"], ["channel_count", "layout"]
SPEC = [*READING, *DEALING]


def _read(rows: DataFrame, words: list[str]) -> DataFrame:
    """The rows once for each reading, with ``words`` replaced by what they mean in it."""
    kept = [c for c in rows.columns if c not in words]
    parts = rows.select(*kept, *[byte(F.col(w), k).cast("double").alias(f"{w}{k}") for w in words for k in "ABC"])

    def meaning(w: str, signedness: str, order: str) -> Column:
        x = F.col(w + order[0]) * 65536 + F.col(w + order[1]) * 256 + F.col(w + order[2])
        return F.when(F.col(w + order[0]) >= 128, x - 16777216).otherwise(x) if signedness == "int24" else x

    each = F.array(*[F.struct(F.lit(s).alias("signedness"), F.lit(o).alias("byte_order"), *[meaning(w, s, o).alias(w) for w in words]) for s, o in READINGS])
    return parts.select(*kept, F.explode(each).alias("r")).select(*kept, "r.*")


def _reading_place() -> Column:
    """A reading's place among READINGS, from 0."""
    return F.array_position(F.array(*[F.lit(f"{s} {o}") for s, o in READINGS]), F.concat_ws(" ", *READING)).cast("int") - 1


def _of_readings(rows: DataFrame) -> DataFrame:
    """``rows`` with a reading's two names instead of its place."""
    named = F.array(*[F.struct(F.lit(s).alias("signedness"), F.lit(o).alias("byte_order")) for s, o in READINGS])
    return rows.withColumn("_r", F.get(named, F.col("reading"))).select("_r.*", *[c for c in rows.columns if c != "reading"])


def _weighted(rows: DataFrame, moments: dict[str, Column]) -> DataFrame:
    """Rows once for each reading, with each of the 36 products' ``moments`` weighted into one number."""
    ways = []
    for s, o in READINGS:
        w = [float(256 ** (2 - o.index(k))) for k in "ABC"] + [-16777216.0 if s == "int24" and o[0] == k else 0.0 for k in "ABC"]
        ways.append(F.struct(F.lit(s).alias("signedness"), F.lit(o).alias("byte_order"), F.array(*[F.lit(a * b) for a in w for b in w]).alias("w")))
    each = rows.select("*", F.explode(F.array(*ways)).alias("r"))
    total = lambda m: F.aggregate(F.zip_with(m, "r.w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return each.select("*", "r.signedness", "r.byte_order", *[total(m).alias(k) for k, m in moments.items()])


def _placed(payloads: DataFrame, channels: list[int]) -> DataFrame:
    """Payloads with what came before them: words of the session, and of each channel of each local dealing; stored, and
    dealt by blocks of packets, so that no session is in one task."""
    n = F.size("payload")
    held = [F.greatest(F.floor((n - k + c - 1) / c), F.lit(0)) for c in channels for k in range(c)]
    rows = running_sums(phased(payloads.where(n > 0)), ["session"], "ordinal", held, "held")
    parts = int(payloads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.select("session", "payload", "before", "held", "ordinal").repartition(parts, "session", F.floor(F.col("ordinal") / 1024)), "placed")


def _mid(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def _duplication(packets: DataFrame, own: DataFrame, channels: list[int]) -> DataFrame:
    """Per candidate the median over sessions of the largest absolute correlation of two channels, sample by sample as
    far as the shortest of those goes that vary and have three words or more; sessions without such pairs count as 0."""
    keys = [*DEALING, "session"]
    able = own.where((F.col("n") >= 3) & (F.col("least") < F.col("most")))
    shortest = able.select(*keys, "channel", F.min("n").over(Window.partitionBy(*keys)).alias("shortest"))
    sums = stored(pair_moments(packets, channels, shortest), "pair-moments")
    n = F.col("n")
    alone = sums.where("a = b").select(*keys, "a", F.transform("s", lambda x: x / n).alias("m"), F.transform("q", lambda x: x / n).alias("q"))
    cross = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))
    alone = alone.select(*keys, "a", "m", F.zip_with("q", cross("m", "m"), lambda x, y: x - y).alias("c"))
    side = lambda k: alone.select(*keys, F.col("a").alias(k), F.col("m").alias(f"m{k}"), F.col("c").alias(f"c{k}"))
    known = sums.where("a < b").join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])
    both = F.zip_with(F.transform("q", lambda x: x / n), cross("ma", "mb"), lambda x, y: x - y)
    read = _weighted(known, {"xy_": both, "xx": F.col("ca"), "yy": F.col("cb")})
    norm = F.sqrt(F.greatest(F.lit(0.0), F.col("xx"))) * F.sqrt(F.greatest(F.lit(0.0), F.col("yy")))
    best = read.groupBy(*SPEC, "session").agg(F.max(F.when(norm > EPS, F.abs(F.try_divide("xy_", norm)))).alias("corr"))
    every = _read(own.select(*keys).distinct().withColumn("v", F.lit(0).cast("long")), ["v"]).drop("v")
    by_session = every.join(best, [*SPEC, "session"], "left").withColumn("corr", F.coalesce("corr", F.lit(0.0)))
    return by_session.groupBy(*SPEC).agg(_mid(F.col("corr")).alias("channel_duplication"))


def _position_dependence(payloads: DataFrame) -> DataFrame:
    words = payloads.select("session", F.posexplode("payload").alias("pos", "v"))
    means = _read(words, ["v"]).groupBy(*READING, "session", "pos").agg(F.avg("v").alias("m"))
    by_session = means.groupBy(*READING, "session").agg((F.var_pop("m")).alias("var"), _mid(F.abs("m")).alias("mid"))
    return by_session.groupBy(*READING).agg((_mid(F.col("var")) / F.greatest(F.lit(EPS), F.pow(_mid(F.col("mid")), F.lit(2)))).alias("position_dependence"))


def metrics(payloads: DataFrame, channels: list[int] = CHANNELS) -> DataFrame:
    """One row a candidate with its eight costs (lower is better). ``payloads``: session, ordinal, payload.

    Sessions without words count for nothing; no payloads at all give no rows. Steps within packets depend on the number
    of channels and saturation on the reading alone, so these are measured 96 and 12 times, not 192. Only the words at a
    packet's edges become rows of a dealing. Sessions times candidates, which some sides of joins here are as large as, are
    few next to the words.
    """
    packets = _placed(payloads, channels)
    own = stored(channel_moments(packets, channels), "channel-moments")
    steps = stored(step_medians(packets.select("session", "payload"), channels), "step-medians")
    unsigned = F.col("signedness") == "uint24"
    full = F.when(unsigned, (F.col("v") <= 0) | (F.col("v") >= 16777215)).otherwise((F.col("v") <= -8388608) | (F.col("v") >= 8388607))
    words = _read(packets.select("session", F.explode("payload").alias("v")), ["v"])
    filled = words.groupBy(*READING, "session").agg(F.count_if(full).alias("full"), F.count(F.lit(1)).alias("n"))
    stepped = [*READING, "channel_count"]
    still = steps.where("NOT overall").select(*stepped, "session", "mad", F.col("zeros").alias("flat"), F.col("n").alias("steps"))
    series = [*DEALING, "session", "channel"]
    edges = previous(stored(packet_edges(packets, channels), "edges"), series, "ordinal", "last", "p").where(F.col("p").isNotNull())
    runs = edge_runs(edges.select(*DEALING, "session", "ordinal", "first", "p"))
    jumped = _of_readings(jump_medians(runs)).withColumnRenamed("median", "jump")
    by_session = [*SPEC, "session"]
    ways = F.explode(F.array(*[F.struct(F.lit(c).alias("channel_count"), F.lit(m).alias("layout")) for c in channels for m in ("packet_local", "continuous")])).alias("d")
    every = filled.select("*", ways).select(*READING, "d.*", "session", "full", "n")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    sums = every.join(still, [*stepped, "session"], "left").join(jumped, by_session, "left").select(*by_session, "full", "n", zero("flat"), zero("steps"), F.coalesce("mad", F.lit(0.0)).alias("mad"), F.coalesce("jump", F.lit(0.0)).alias("jump"))
    sums = stored(sums, "session-sums")
    scale = F.greatest(F.lit(EPS), F.col("mad"))
    each = sums.select(*by_session, "full", "n", "flat", "steps", "mad", (F.col("jump") / scale).alias("ratio"), (F.col("full") / F.col("n")).alias("sat"), F.coalesce(F.try_divide("flat", "steps"), F.lit(0.0)).alias("still"))
    iqr = lambda c: F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))
    spread = F.when(F.count(F.lit(1)) < 2, 0.0).otherwise((iqr("mad") + iqr("ratio") + iqr("sat") + iqr("still")) / 4)
    rolled = each.groupBy(*SPEC).agg(spread.alias("session_consistency"), (F.sum("full") / F.sum("n")).alias("saturation_rate"), F.coalesce(F.try_divide(F.sum("flat"), F.sum("steps")), F.lit(0.0)).alias("flatline_rate"))
    scales = sums.where(F.col("layout") == LAYOUTS[0]).select("channel_count", "session", F.struct(_reading_place().alias("reading"), scale.alias("scale")).alias("s"))  # alike in both layouts
    scales = scales.groupBy("channel_count", "session").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["scale"]).alias("scale"))
    boundary = _of_readings(jump_medians(runs, scales)).withColumnRenamed("median", "boundary_jump")
    energy = _weighted(own, {"e": F.col("c")}).groupBy(*by_session)
    cv = F.when(F.abs(F.avg("e")) <= EPS, F.stddev_pop("e")).otherwise(F.try_divide(F.stddev_pop("e"), F.abs(F.avg("e"))))
    balance = energy.agg(cv.alias("cv")).groupBy(*SPEC).agg(_mid(F.col("cv")).alias("energy_balance"))
    overall = steps.where("overall").select(*stepped, F.col("mad").alias("deriv_mad"))
    out = rolled.join(overall, stepped, "left").join(boundary, SPEC, "left").join(balance, SPEC, "left").join(_duplication(packets, own, channels), SPEC, "left").join(_position_dependence(packets), READING, "left")
    return out.select(_index(channels).alias("spec_idx"), *SPEC, *[F.coalesce(m, F.lit(0.0)).alias(m) for m in WEIGHTS])


def _index(channels: list[int]) -> Column:
    """A candidate's place in the grid: signedness, byte order, channels, layout."""
    at = lambda c, values: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)) - 1
    idx = at("signedness", ["uint24", "int24"]) * len(ORDERS) + at("byte_order", ORDERS)
    return (idx * len(channels) + at("channel_count", channels)) * 2 + at("layout", ["packet_local", "continuous"])


def ranked(scores: DataFrame) -> DataFrame:
    """``cost``, the weighted sum of rank / (n - 1) over the metrics, and ``rank`` from 1; ties by place in the grid. The
    grid is fixed and small, so windows over all its rows are no burden."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    cost = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        cost = cost + weight * (F.row_number().over(Window.orderBy(name, "spec_idx")) - 1) / F.greatest(n - 1, F.lit(1))
    costed = scores.withColumn("cost", cost)
    return costed.withColumn("rank", F.row_number().over(Window.orderBy("cost", "spec_idx")))


def statuses(scored: DataFrame, documented: bool = False, anomalies: int = 0, samples_per_packet: int | None = None, time_aligned: bool = False) -> DataFrame:
    """``status`` and its reason ``codes``. Only the first candidate can be more than unverified: it must clear its
    thresholds, and no candidate with another dealing, nor its twin of the other sign, may cost about the same."""
    everyone = Window.partitionBy()
    best = lambda c: F.first(c).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gap = F.col("cost") - best("cost")
    other = (F.col("rank") > 1) & ((F.col("channel_count") != best("channel_count")) | (F.col("layout") != best("layout")))
    twin = (F.col("signedness") != best("signedness")) & (F.col("byte_order") == best("byte_order")) & (F.col("channel_count") == best("channel_count")) & (F.col("layout") == best("layout"))
    seen = scored.select("*", (other & (gap <= NEAR_TIE)).alias("_tie"), (twin & (gap <= TWIN)).alias("_twin"), F.when(F.col("rank") == 2, gap).alias("_gap"))
    seen = seen.select(*scored.columns, F.bool_or("_tie").over(everyone).alias("tie"), F.bool_or("_twin").over(everyone).alias("twin"), F.coalesce(F.max("_gap").over(everyone), F.lit(1.0)).alias("gap"))
    copied = (F.col("channel_count") > 1) & (F.col("channel_duplication") >= 0.999) & (F.col("energy_balance") < 1e-6) & (F.col("flatline_rate") > 0.5)
    reject = F.when(F.col("saturation_rate") >= REJECT_SATURATION, "reject_saturation").when(F.col("flatline_rate") >= REJECT_FLATLINE, "reject_flatline").when(F.col("boundary_jump") >= REJECT_JUMP, "reject_boundary_jump").when(copied, "reject_duplicate_channels")
    high, loose = F.col("boundary_jump") > PROVISIONAL_JUMP, F.col("session_consistency") > PROVISIONAL_CONSISTENCY
    fine = (F.col("rank") == 1) & ~high & ~loose & ~F.col("tie") & ~F.col("twin")
    locked = (F.col("gap") >= EXCEPTIONAL_GAP) & F.lit(anomalies == 0 and samples_per_packet is not None and time_aligned)
    accepted = F.lit(documented) | locked
    lits = lambda *xs: F.array(*[F.lit(x) for x in xs])
    some = lambda *cs: F.filter(F.array(*[F.when(c, F.lit(x)) for c, x in cs]), lambda x: x.isNotNull())
    good = F.concat(lits("top_ranked", "boundary_ok", "cross_session_ok", "no_layout_near_tie", "no_signedness_twin", "not_physiological_proof"), some((accepted, "vendor_documented" if documented else "exceptional_evidence_lock")))
    first = F.col("rank") == 1
    doubts = some((F.lit(True), "unverified_default"), (first & F.col("tie"), "layout_near_tie"), (first & F.col("twin"), "signedness_twin"), (first & high, "boundary_above_provisional"), (first & loose, "cross_session_above_provisional"))
    status = F.when(reject.isNotNull(), "REJECTED").when(fine & accepted, "ACCEPTED").when(fine, "PROVISIONALLY_ACCEPTED").otherwise("UNVERIFIED")
    codes = F.when(reject.isNotNull(), F.array(reject)).when(fine, good).otherwise(doubts)
    return seen.select(*scored.columns, status.alias("status"), codes.alias("codes"))
