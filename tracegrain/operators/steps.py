"""What the decoding candidates make of packets' words, in arrays: a packet is a row, its words never are.

Medians are found digit by digit. A pass counts the next eight bits of the values that agree with what is known of a rank, and
the count that holds the rank tells the digit; so a median is exact, and no task holds more than counts. The moments that
variances and correlations need are sums over blocks of samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions.bits import ORDERS
from tracegrain.functions.store import stored

READINGS = [(s, o) for s in ("uint24", "int24") for o in ORDERS]
LAYOUTS = ("packet_local", "continuous")
SHIFTS = (16, 8, 0)
SAMPLES = 4096
FEATURES = 6
PACKETS = 4096
AT_ONCE = 1 << 14  # words whose steps lie in a core's cache
FEW_SESSIONS = 1000
BITS = (48, 34, 0)


def readings(words: np.ndarray) -> np.ndarray:
    """One row for each of READINGS: what the words' low 24 bits mean in it."""
    at = {"A": words >> 16 & 255, "B": words >> 8 & 255, "C": words & 255}
    unsigned = np.stack([at[o[0]] << 16 | at[o[1]] << 8 | at[o[2]] for o in ORDERS])
    return np.concatenate([unsigned, np.where(unsigned >= 1 << 23, unsigned - (1 << 24), unsigned)])


def features(words: np.ndarray) -> np.ndarray:
    """Bytes A, B, C of the words and their top bits: every reading is a weighted sum of these."""
    parts = np.stack([words >> 16 & 255, words >> 8 & 255, words & 255])
    return np.concatenate([parts, parts >> 7]).astype(np.float64)


def _sessions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(session, its rows of a batch, their words end to end, the words' places in their packets); session and payload come first."""
    for batch in batches:
        keys = batch.column(0).dictionary_encode()
        for k, session in enumerate(keys.dictionary.to_pylist()):
            rows = batch.filter(pc.equal(keys.indices, k))
            words = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = pc.fill_null(pc.list_value_length(rows.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield session, rows, words, np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)


def _count(sums: np.ndarray, step: np.ndarray, g: int, known: tuple[tuple[np.ndarray, ...], ...], shift: int) -> None:
    """Add to ``sums`` (session's own or all sessions', rank, digit) the digits of ``step``. What the two ask alike is counted once."""
    told = {}
    for every, (low, high, middle) in enumerate(known):
        centre = None if middle is None else int(middle[g])
        for rank, begins in ((0, int(low[g])), (1, int(high[g]))):
            if rank and low[g] == high[g]:
                continue
            if (centre, begins) not in told:
                if centre not in told:
                    told[centre] = step if centre is None else np.abs(2 * step - centre)
                v = told[centre]
                digits = v >> shift if shift == SHIFTS[0] else (v[v >> shift + 8 == begins] >> shift) & 255
                told[centre, begins] = np.bincount(digits, minlength=512)
            sums[every, rank] += told[centre, begins]
        if shift == SHIFTS[0] and centre is None:
            if "zeros" not in told:
                told["zeros"] = len(step) - np.count_nonzero(step)
            sums[every, 2, 0] += told["zeros"]


def _digits(packets: DataFrame, channels: list[int], shift: int, overall: tuple[np.ndarray, ...]) -> DataFrame:
    """(session, overall, g, rank, digit, n): how often each digit occurs among a group's values that begin as the lower or
    upper middle one does. Group g is a number of channels and a reading. ``packets``: session, payload, low, high, middle
    of the session; ``overall`` has the same three for all sessions. Rank 2 counts values of 0."""
    count_of, first = len(READINGS), shift == SHIFTS[0]
    groups, reach = len(channels) * count_of, max(channels, default=0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for session, rows, words, place in _sessions(batches):
            own = tuple(None if x is None else np.array(x) for x in (rows.column(i)[0].as_py() for i in (2, 3, 4)))
            sums = np.zeros((2, groups, 3, 512), np.int64)
            for a in range(0, len(words), AT_ONCE):
                back = min(a, reach)
                read = readings(words[a - back : a + AT_ONCE].astype(np.int32))  # wraps, which leaves the low bits
                for i, c in enumerate(channels):
                    begin = max(back, c)
                    step = np.abs(read[:, begin:] - read[:, begin - c : read.shape[1] - c]) if begin < read.shape[1] else read[:, :0]
                    step = np.compress(place[a - back + begin : a + AT_ONCE] >= c, step, axis=1)
                    for r in range(count_of):
                        _count(sums[:, i * count_of + r], step[r], i * count_of + r, (own, overall), shift)
            seen = sums > 0
            if first and own[2] is None:
                seen[:, :, 2, 0] = True
            every, g, rank, digit = np.nonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([session] * len(g), rows.schema.field(0).type), pa.array(every > 0), pa.array(g.astype(np.int32)), pa.array(rank.astype(np.int32)), pa.array(digit), pa.array(sums[seen])],
                names=["session", "overall", "g", "rank", "digit", "n"])

    kind = packets.schema["session"].dataType.simpleString()
    each = packets.select("session", "payload", "low", "high", "middle").mapInArrow(count, f"session {kind}, overall boolean, g int, rank int, digit long, n long")
    every = each.withColumn("session", F.when(~F.col("overall"), F.col("session")))
    return every.groupBy("session", "overall", "g", "rank", "digit").agg(F.sum("n").alias("n"))


STATE = "low array<long>, high array<long>, low_rank array<long>, high_rank array<long>, n array<long>, zeros array<long>"


def _advance(state: DataFrame, counts: DataFrame, first: bool) -> DataFrame:
    """The state with one more digit of each rank's value."""

    def step(known: pa.Table, found: pa.Table) -> pa.Table:
        low, high, low_rank, high_rank, n, zeros = (np.array(known.column(c)[0].as_py(), np.int64) for c in ("low", "high", "low_rank", "high_rank", "n", "zeros"))
        g, rank, digit, many = (found.column(c).to_numpy() for c in ("g", "rank", "digit", "n"))
        sums = np.zeros((3, len(low), 512), np.int64)
        np.add.at(sums, (rank, g, digit), many)
        if first:
            n[:] = sums[0].sum(axis=1)
            low_rank, high_rank = np.maximum(n - 1, 0) // 2, n // 2
            zeros += sums[2, :, 0]
        upper = np.where((low == high)[:, None], sums[0], sums[1])
        for value, at, own in ((low, low_rank, sums[0]), (high, high_rank, upper)):
            up = np.cumsum(own, axis=1)
            d = np.minimum((up <= at[:, None]).sum(axis=1), 511)
            at -= np.where(d > 0, np.take_along_axis(up, np.maximum(d - 1, 0)[:, None], axis=1)[:, 0], 0)
            value[:] = (value << 8) + d
        out = [known.column(c) for c in ("session", "overall")] + [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (low, high, low_rank, high_rank, n, zeros)]
        return pa.table(out, names=[f.split()[0] for f in ("session", "overall", *STATE.split(", "))])

    kind = state.schema["session"].dataType.simpleString()
    return state.groupBy("overall", "session").cogroup(counts.groupBy("overall", "session")).applyInArrow(step, f"session {kind}, overall boolean, {STATE}")


def step_medians(packets: DataFrame, channels: list[int]) -> DataFrame:
    """(session, overall, channel_count, signedness, byte_order, n, zeros, mid, mad): steps between words that lie a number of
    channels apart in a packet, their median and median absolute deviation, in each session and (``overall``) in all.

    ``packets``: session (not null), payload. Groups without steps have n = 0 and nulls.
    """
    groups = len(channels) * len(READINGS)
    zeros = F.array_repeat(F.lit(0).cast("long"), groups)
    blank = [zeros.alias(c.split()[0]) for c in STATE.split(", ")]
    sessions = packets.select("session").distinct().select("session", F.lit(False).alias("overall"))
    every = packets.sparkSession.range(1).select(F.lit(None).cast(packets.schema["session"].dataType).alias("session"), F.lit(True).alias("overall"))
    keys = sessions.unionByName(every)
    state, middles = stored(keys.select("*", *blank), "ranks"), None
    few = state.count() <= FEW_SESSIONS  # a long session's packets stay dealt as they are, and only its ranks travel
    medians = None
    for doubled in (False, True):
        if doubled:
            medians = state
            middles = state.select("session", "overall", F.zip_with("low", "high", lambda a, b: a + b).alias("middle"))
            state = stored(keys.select("*", *blank), "ranks")
        for shift in SHIFTS:
            known = state.select("session", "overall", "low", "high")
            known = known.join(middles.withColumnRenamed("session", "_s").withColumnRenamed("overall", "_o"), F.col("session").eqNullSafe(F.col("_s")) & (F.col("overall") == F.col("_o"))).drop("_s", "_o") if doubled else known.withColumn("middle", F.lit(None).cast("array<long>"))
            whole = known.where("overall").first()
            overall = tuple(None if whole[c] is None else np.array(whole[c]) for c in ("low", "high", "middle"))
            own = known.where("NOT overall").drop("overall")
            counts = _digits(packets.join(F.broadcast(own) if few else own, "session"), channels, shift, overall)
            state = stored(_advance(state, counts, shift == SHIFTS[0]), "ranks")
    grid = F.array(*[F.struct(F.lit(c).alias("channel_count"), F.lit(s).alias("signedness"), F.lit(o).alias("byte_order")) for c in channels for s, o in READINGS])
    lay = lambda df, half: df.select("session", "overall", F.posexplode(F.arrays_zip("low", "high", "n", "zeros")).alias("g", "x")).select("session", "overall", "g", "x.n", "x.zeros", F.when(F.col("x.n") > 0, (F.col("x.low") + F.col("x.high")) / (2 * half)).alias("v"))
    mid = lay(medians, 1).select("session", "overall", "g", "n", "zeros", F.col("v").alias("mid"))
    mad = lay(state, 2).select(F.col("session").alias("_s"), F.col("overall").alias("_o"), F.col("g").alias("_g"), F.col("v").alias("mad"))
    both = mid.join(mad, F.col("session").eqNullSafe(F.col("_s")) & (F.col("overall") == F.col("_o")) & (F.col("g") == F.col("_g"))).withColumn("spec", F.element_at(grid, F.col("g") + 1))
    return both.select("session", "overall", "spec.*", "n", "zeros", "mid", "mad")


def _dealings(channels: list[int], place: np.ndarray, before: np.ndarray, held: np.ndarray) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """(number of channels, layout, channel, sample) of each word. ``before`` and ``held`` are, for a word's packet, the words
    of earlier packets, and how many of these each channel of each local dealing has."""
    at = 0
    for c in channels:
        local = place % c
        yield c, LAYOUTS[0], local, held[np.arange(len(place)), at + local] + place // c
        yield c, LAYOUTS[1], (before + place) % c, (before + place) // c
        at += c


def _placed(batches: Iterator[pa.RecordBatch]):
    for session, rows, words, place in _sessions(batches):
        n = pc.fill_null(pc.list_value_length(rows.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.repeat(rows.column(2).to_numpy(zero_copy_only=False), n)
        held = np.array(rows.column(3).to_pylist(), np.int64).reshape(len(n), -1)
        yield session, rows, words, place, before, np.repeat(held, n, axis=0), n


def _moment_columns() -> list[str]:
    return [f"s{i}" for i in range(FEATURES)] + [f"q{i}{j}" for i in range(FEATURES) for j in range(FEATURES)]


def channel_moments(packets: DataFrame, channels: list[int]) -> DataFrame:
    """(channel_count, layout, session, channel, n, least, most, m, c): words of each channel, the least and most of them unsigned,
    their features' means and covariances. ``packets``: session, payload, before, held."""
    kind = packets.schema["session"].dataType.simpleString()
    names = ["session", "channel_count", "layout", "channel", "n", "least", "most", *_moment_columns()]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for session, rows, words, place, before, held, _ in _placed(batches):
            f, u, out = features(words), words & 0xFFFFFF, []
            for c, layout, channel, _ in _dealings(channels, place, before, held):
                for k in range(c):
                    mine = channel == k
                    if mine.any():
                        x = f[:, mine]
                        out.append((session, c, layout, k, int(mine.sum()), int(u[mine].min()), int(u[mine].max()), *x.sum(axis=1).tolist(), *(x @ x.T).ravel().tolist()))
            types = [rows.schema.field(0).type, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.float64()] * (FEATURES + FEATURES**2)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=names)

    schema = f"session {kind}, channel_count int, layout string, channel long, n long, least long, most long, {', '.join(f'{c} double' for c in _moment_columns())}"
    each = packets.select("session", "payload", "before", "held").mapInArrow(measure, schema)
    sums = each.groupBy("channel_count", "layout", "session", "channel").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), *[F.sum(c).alias(c) for c in _moment_columns()])
    n = F.col("n")
    mean = [F.col(f"s{i}") / n for i in range(FEATURES)]
    cov = [F.col(f"q{i}{j}") / n - mean[i] * mean[j] for i in range(FEATURES) for j in range(FEATURES)]
    return sums.select("channel_count", "layout", "session", "channel", "n", "least", "most", F.array(*mean).alias("m"), F.array(*cov).alias("c"))


def pair_moments(packets: DataFrame, channels: list[int], shortest: DataFrame) -> DataFrame:
    """(channel_count, layout, session, a, b, n, s, q), a <= b: over the samples that lie before ``shortest`` (channel_count, layout,
    session, channel, shortest), of channels named there, the sum of a's features and of the products of a's and b's.

    A channel's samples are dealt to blocks of SAMPLES; channels meet block by block, in one product of matrices.
    """
    kind = packets.schema["session"].dataType.simpleString()
    keys = ["channel_count", "layout", "session"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for session, rows, words, place, before, held, _ in _placed(batches):
            out = []
            for c, layout, channel, sample in _dealings(channels, place, before, held):
                if c > 1:
                    block = sample // SAMPLES
                    key = block * c + channel
                    order = np.argsort(key, kind="stable")
                    bounds = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]])) if len(key) else []
                    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                        o = order[i:j]
                        out.append((c, layout, session, int(block[o[0]]), int(channel[o[0]]), (sample[o] % SAMPLES).astype("<i4").tobytes(), (words[o] & 0xFFFFFF).astype("<i4").tobytes()))
            types = [pa.int32(), pa.string(), rows.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=[*keys, "block", "channel", "at", "v"])

    def multiply(group: pa.Table) -> pa.Table:
        first = {c: group.column(c)[0] for c in (*keys, "block")}
        ends = dict(zip(group.column("channel").to_pylist(), group.column("shortest").to_pylist(), strict=True))
        own = {k: np.full(SAMPLES, -1, np.int64) for k in ends}
        for k, at, v in zip(group.column("channel").to_pylist(), group.column("at").to_pylist(), group.column("v").to_pylist(), strict=True):
            own[k][np.frombuffer(at, "<i4")] = np.frombuffer(v, "<i4")
        named = sorted(own)
        until = min(SAMPLES, max(0, min(ends.values()) - first["block"].as_py() * SAMPLES))
        x = np.concatenate([features(own[k][:until]) for k in named])  # all of these channels have every sample up to there
        q, s = x @ x.T, x.sum(axis=1)
        out = []
        for i, a in enumerate(named):
            for j, b in enumerate(named[i:], i):
                out.append((a, b, until, s[i * FEATURES : (i + 1) * FEATURES].tolist(), q[i * FEATURES : (i + 1) * FEATURES, j * FEATURES : (j + 1) * FEATURES].ravel().tolist()))
        a, b, n, s, q = zip(*out, strict=True)
        flat = np.concatenate([np.array(s), np.array(q)], axis=1)
        return pa.table([*[pa.repeat(first[c], len(out)) for c in keys], pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), *[pa.array(flat[:, i]) for i in range(flat.shape[1])]], names=[*keys, "a", "b", "n", *_moment_columns()])

    dealt = packets.select("session", "payload", "before", "held").mapInArrow(deal, f"channel_count int, layout string, session {kind}, block long, channel long, at binary, v binary")
    some = dealt.join(shortest, [*keys, "channel"]).where(F.col("block") * SAMPLES < F.col("shortest"))
    each = some.groupBy(*keys, "block").applyInArrow(multiply, f"channel_count int, layout string, session {kind}, a long, b long, n long, {', '.join(f'{c} double' for c in _moment_columns())}")
    sums = each.groupBy(*keys, "a", "b").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _moment_columns()])
    return sums.select(*keys, "a", "b", "n", F.array(*[F.col(f"s{i}") for i in range(FEATURES)]).alias("s"), F.array(*[F.col(f"q{i}{j}") for i in range(FEATURES) for j in range(FEATURES)]).alias("q"))


def packet_edges(packets: DataFrame, channels: list[int]) -> DataFrame:
    """(channel_count, layout, session, channel, ordinal, first, last): each channel's first and last word of each packet that
    has any. ``packets``: session, payload, before, held, ordinal."""
    kind = packets.schema["session"].dataType.simpleString()

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for session, rows, words, place, before, held, n in _placed(batches):
            ordinal = np.repeat(rows.column(4).to_numpy(zero_copy_only=False), n)
            packet = np.repeat(np.arange(len(n)), n)
            parts = []
            for c, layout, channel, _ in _dealings(channels, place, before, held):
                key = packet * c + channel
                order = np.argsort(key, kind="stable")
                change = np.diff(key[order]) != 0
                first, last = order[np.concatenate([[True], change])] if len(key) else order, order[np.concatenate([change, [True]])] if len(key) else order
                k = len(first)
                parts.append(pa.table([pa.array([c] * k, pa.int32()), pa.array([layout] * k, pa.string()), pa.array([session] * k, rows.schema.field(0).type), pa.array(channel[first]), pa.array(ordinal[first], pa.int64()), pa.array(words[first]), pa.array(words[last])], names=["channel_count", "layout", "session", "channel", "ordinal", "first", "last"]))
            yield from pa.concat_tables(parts).combine_chunks().to_batches()

    return packets.select("session", "payload", "before", "held", "ordinal").mapInArrow(edges, f"channel_count int, layout string, session {kind}, channel long, ordinal long, first long, last long")


def edge_runs(edges: DataFrame) -> DataFrame:
    """(channel_count, layout, session, v, p): a row for all jumps, from word p to word v, at the edges of a run of PACKETS packets.
    ``edges``: channel_count, layout, session, ordinal, first, p (the last word before it, not null)."""
    keys = ["channel_count", "layout", "session"]
    runs = edges.groupBy(*keys, F.floor(F.col("ordinal") / PACKETS).alias("run")).agg(F.collect_list(F.struct("first", "p")).alias("e"))
    return stored(runs.select(*keys, F.col("e.first").alias("v"), F.col("e.p").alias("p")), "edge-runs")


def jump_medians(runs: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """(channel_count, layout, reading, [session,] median): of the sizes of jumps in each session, for each of READINGS by its place; or
    with ``scales`` (channel_count, session, scale: an array by reading, none of them 0) of jumps over scales, of all sessions.

    Exact, and no task holds more than counts: numbers of at least 0 are ordered as their bits are, so that the two middle ones are
    found by three passes over ever lower bits. A pass counts the next bits of the numbers that begin as a middle one does.
    """
    group = ["channel_count", "layout"] + ([] if scales is not None else ["session"])
    kind = runs.schema["session"].dataType.simpleString()
    if scales is None:
        runs = runs.withColumn("scale", F.array_repeat(F.lit(1.0), len(READINGS)))
    else:
        runs = runs.join(scales, ["channel_count", "session"])

    def count_at(shift: int, above: int):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    v, p = (row.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("v", "p"))
                    scale = row.column("scale").flatten().to_numpy(zero_copy_only=False)
                    sizes = np.abs(readings(v) - readings(p))
                    begins = row.column("begins")[0].as_py()
                    found = []
                    for r in range(len(READINGS)):
                        bits = (sizes[r] / scale[r]).view(np.int64)
                        for begin in [0] if above > 63 else sorted(set(begins[r])):
                            part = bits if above > 63 else bits[bits >> above == begin]
                            digits, n = np.unique((part >> shift) & ((1 << (above - shift)) - 1 if above < 64 else -1), return_counts=True)
                            found.append((r, begin, digits, n))
                    many = [len(x[2]) for x in found]
                    of = pa.array(np.zeros(sum(many), np.int32))
                    each = [np.repeat([x[k] for x in found], many) for k in (0, 1)] + [np.concatenate([x[k] for x in found]) for k in (2, 3)]
                    yield pa.RecordBatch.from_arrays([*[row.column(c).take(of) for c in ("channel_count", "layout", "session")], pa.array(each[0].astype(np.int32)), *[pa.array(a.astype(np.int64)) for a in each[1:]]], names=["channel_count", "layout", "session", "reading", "begin", "digit", "n"])

        return count

    state, above = None, 64
    for shift in BITS:
        if state is None:
            asked = runs.withColumn("begins", F.lit(None).cast("array<array<long>>"))
        else:
            at = state.groupBy(*group, "reading").agg(F.collect_list("begin").alias("b")).groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("reading", "b"))), lambda x: x["b"]).alias("begins"))
            asked = runs.join(at, group)
        each = asked.select("channel_count", "layout", "session", "v", "p", "scale", "begins").mapInArrow(count_at(shift, above), f"channel_count int, layout string, session {kind}, reading int, begin long, digit long, n long")
        counts = each.groupBy(*group, "reading", "begin", "digit").agg(F.sum("n").alias("n"))
        along = Window.partitionBy(*group, "reading", "begin")
        counts = counts.select("*", F.sum("n").over(along.orderBy("digit")).alias("upto"), F.sum("n").over(along).alias("all"))
        if state is None:
            ranks = F.array(F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2))
            known = counts.select("*", F.posexplode(ranks).alias("rank", "at"))
        else:
            known = counts.join(state, [*group, "reading", "begin"])
        here = (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))
        state = stored(known.where(here).select(*group, "reading", "rank", (F.shiftleft("begin", above - shift if above < 64 else 0) + F.col("digit")).alias("begin"), (F.col("at") - F.col("upto") + F.col("n")).alias("at")), "jump-ranks")
        above = shift

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(batch.column("begin").to_numpy().view(np.float64))], names=[*batch.schema.names[:-1], "x"])

    kinds = ", ".join(f"{c} {runs.schema[c].dataType.simpleString()}" for c in group)
    middle = state.select(*group, "reading", "begin").mapInArrow(numbers, f"{kinds}, reading int, x double")
    return middle.groupBy(*group, "reading").agg((0.5 * F.min("x") + 0.5 * F.max("x")).alias("median"))
