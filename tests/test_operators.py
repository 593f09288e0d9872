"""Core operators on hand-computed cases."""

import json
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from tracegrain.functions import bits, names, ordering, privacy, store
from tracegrain.operators import audit, benchmark, candidates, cells, packets, reconstruction, reports, scoring, spectral, spectral_blocks, steps, timebase, verdicts, walk
from tracegrain.plans import evidence
from tracegrain.sources import outputs, sessions
from tracegrain.streaming.segments import stateful_segments, streaming_segments


def one(spark, col):
    return spark.range(1).select(col).first()[0]


def test_words_of_24_bits(spark):
    v = lambda x: F.lit(x).cast("long")
    assert one(spark, bits.to_int24(v(1 << 23))) == -(1 << 23)
    assert one(spark, bits.to_int24(v((1 << 24) - 1))) == -1
    assert one(spark, bits.to_uint24(v((1 << 24) + 5))) == 5
    assert len({one(spark, bits.permute(v(0x123456), o)) for o in bits.ORDERS}) == 6
    assert one(spark, bits.permute(v(0x123456), "CAB")) == 0x561234
    assert one(spark, F.array(bits.bit_length(v(0)), bits.trailing_zeros(v(0)), bits.trailing_zeros(v(8)))) == [0, 24, 3]


def test_names(spark):
    assert one(spark, names.tokens(F.lit("heartRate_PPG.time-ms2"))) == ["heart", "rate", "ppg", "time", "ms", "2"]
    assert one(spark, names.modalities(F.lit("avg_heartRate"))) == ["heart_rate"]
    assert one(spark, names.modalities(F.lit("x"))) == []
    for key, hidden in (("12.5", True), ("patient_id", True), ("a" * 24, True), ("samples", False), ("AA:BB:CC:DD:EE:FF", True)):
        assert (one(spark, names.redact(F.lit(key))) == names.DYNAMIC) is hidden


def test_scrub(spark):
    got = one(spark, privacy.scrub(F.lit("/in/Ada.csv Ada AA:BB:CC:DD:EE:FF 2024-06-15T14:30:00Z"), {"/in/Ada.csv": "<input_path>", "Ada": "<redacted>"}))
    assert got == "<input_path> <redacted> <redacted_mac> <redacted_timestamp>" or got == "<input_path> <redacted> <redacted_mac> <redacted_timestamp>Z"
    assert one(spark, privacy.forbidden(F.lit("A Medical Alert"))) == ["medical alert"]


def _packet(values, ms):
    return {"dataEnd": True, "dataType": "119", "dicData": {"PPG": values, "Time": ms}, "receivedAtMs": ms}


def test_packets(spark):
    cell = json.dumps([_packet([1, 2.0, 3], 1000), _packet("[4, 5, 6]", 2000), _packet("{not", 3000), _packet(["x"], 4000), {"a": 1}, 7, _packet("{}", "soon")])
    rows = spark.createDataFrame([(0, cell), (1, ""), (2, "{bad"), (3, "[]")], "session_ordinal long, raw_packets_json string")
    out = packets.validated(packets.packet_rows(rows)).orderBy("packet_ordinal").collect()
    assert [r.payload for r in out[:2]] == [[1, 2, 3], [4, 5, 6]] and all(r.schema_ok for r in out[:2])
    assert [r.codes for r in out[2:4]] == [["ppg_json_malformed"], ["ppg_non_integer"]]
    assert out[4].codes == ["missing_top_keys", "extra_top_keys", "dicdata_missing"] and out[5].codes == ["packet_not_object"]
    assert out[6].codes == ["received_at_invalid", "ppg_not_array"]
    assert packets.usable(packets.validated(packets.packet_rows(rows)), 3).count() == 2


def test_odd_cells_and_packets(spark):
    texts = [None, " NaN ", "\n [1]", "[1", "null", '"x"', "{}", "[ ]", "[]x", "[1]]", "[1]}", "[1], [2]", '[1], "a": 2']
    found = packets.cell_states(spark.createDataFrame(list(enumerate(texts)), "session_ordinal long, raw_packets_json string")).orderBy("session_ordinal")
    assert [r.state for r in found.collect()] == ["empty", "empty", "packets", "malformed", "empty", "malformed", "malformed", "packets", *["malformed"] * 5]
    kinds = spark.createDataFrame([(x,) for x in ("{}x", "{}", "1 2", "1", "[1]]", "[1]", "null", '"a" ')], "cell string").select(cells.cell_status(F.col("cell")).alias("s"))
    assert [r.s for r in kinds.collect()] == ["malformed", "empty_object", "malformed", "scalar", "malformed", "array", "empty", "scalar"]
    odd = [None, "text", [1], {**_packet([1], 5), "dicData": None}, {**_packet([1], 5), "dicData": [1]}, {**_packet([1], -5.0), "dataType": 119}, {**_packet([1, None], 5)}, {**_packet([], 5), "receivedAtMs": None}]
    out = packets.validated(packets.packet_rows(spark.createDataFrame([(0, json.dumps(odd))], "session_ordinal long, raw_packets_json string"))).orderBy("packet_ordinal").collect()
    assert [r.codes for r in out] == [["packet_not_object"]] * 3 + [["dicdata_missing"]] * 2 + [[], ["ppg_non_integer"], []]
    assert [(r.data_type, r.received_at_ms, r.payload) for r in out[5:]] == [("119", -5, [1]), ("119", 5, None), ("119", None, [])]


def _packets(spark, times):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(times)], "session long, ordinal long, received_ms long")


def test_timebase(spark):
    s = timebase.summaries(_packets(spark, [0, 1000, 1000, 500, 3500])).first()
    assert (s.gap_count, s.duplicate_count, s.regression_count, s.delta_min_ms, s.delta_median_ms, round(s.delta_p95_ms, 6), s.duration_inconsistency) == (1, 1, 1, -500, 500, 2700, True)
    r = timebase.segment_ranges(_packets(spark, [0, 1000, 2000, 7000, 8000])).orderBy("segment").collect()
    assert [(x.packet_start, x.packet_end) for x in r] == [(0, 3), (3, 5)]
    assert timebase.thresholds(_packets(spark, [0, 2000, 4000])).first().threshold_ms == 3000
    assert timebase.thresholds(_packets(spark, [5])).first().median_ms == 1000


def test_decoder_grid(spark):
    g = scoring.decoder_grid(spark).orderBy("spec_idx").collect()
    assert [r.spec_idx for r in g] == list(range(192)) and g[1].layout_mode == "continuous" and g[2].channel_count == 2


def test_channels_follow_the_phase(spark):
    p = spark.createDataFrame([(0, 0, list(range(5))), (0, 1, list(range(5, 10)))], "session long, ordinal long, payload array<long>")
    rows = scoring.channel_words(p, [3], "uint24", "ABC").collect()
    assert all(r.channel == r.x % 3 for r in rows if r.layout == "continuous")
    assert all(r.channel == r.pos % 3 for r in rows if r.layout == "packet_local")


def _periodicity(spark, *series, fs=33.0):
    rows = [(i, [float(x) for x in v], fs) for i, v in enumerate(series)]
    out = spectral.segment_periodicity(spark.createDataFrame(rows, "k int, values array<double>, fs double")).orderBy("k").collect()
    assert [r.k for r in out] == list(range(len(series)))
    return out


def test_periodicity(spark):
    t = np.arange(660) / 33
    r = np.random.default_rng(0)
    sine, flat, short, noise, again, brief, two = _periodicity(
        spark, 10000 * np.sin(2 * np.pi * 1.2 * t), np.full(330, 42.0), t[:10], r.normal(0, 1000, 660), 10000 * np.sin(2 * np.pi * 1.2 * t), np.sin(t[:100]), np.sin(2 * np.pi * 1.2 * t) + 0.5 * np.sin(2 * np.pi * 2.4 * t))
    assert sine.usable and abs(sine.dominant_hz - 1.2) < 0.15 and sine.acf_peak > 0.2 and abs(sine.acf_lag_s - 1 / 1.2) < 0.05
    assert sine.asDict() | {"k": 4} == again.asDict() and sine.reasons == ["acf_peak", "periodic_candidate"]
    assert flat.reasons == ["flatline_segment"] and short.reasons == ["segment_too_short"] and brief.reasons == ["segment_duration_short"]
    assert not flat.usable and flat.band_power_ratio == 0 and flat.dominant_hz is None
    assert noise.band_power_ratio < 0.5 < sine.band_power_ratio and noise.prominence < sine.prominence
    assert two.harmonic and "harmonic_structure" in two.reasons
    assert spectral.segment_periodicity(spark.createDataFrame([], "k int, values array<double>, fs double")).count() == 0


def test_spectra_by_definition():
    """Power, autocorrelation and lagged correlation against sums written out."""
    r = np.random.default_rng(5)
    x, y, fs, n = r.normal(0, 1, 300), r.normal(0, 1, 300), 20.0, 64
    w = np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / n) for i in range(n)])
    want = np.zeros(n // 2 + 1)
    frames = [x[a : a + n] for a in range(0, len(x) - n + 1, n // 2)]
    for f in frames:
        for k in range(n // 2 + 1):
            z = sum((f[i] - f.mean()) * w[i] * np.exp(-2j * np.pi * k * i / n) for i in range(n))
            want[k] += abs(z) ** 2 / (fs * (w**2).sum()) / len(frames) * (1 if k in (0, n // 2) else 2)
    f, p = spectral.welch(x[None], np.array([fs]), n)
    assert np.allclose(p[0], want) and np.allclose(f[0], np.arange(n // 2 + 1) * fs / n)
    got = spectral.measure_pairs(x[None], y[None], np.array([fs]))
    a, b = x - x.mean(), y - y.mean()
    lags = {k: sum(a[i + k] * b[i] for i in range(300) if 0 <= i + k < 300) / (x.std() * y.std() * 300) for k in range(-40, 41)}
    best = max(lags, key=lambda k: abs(lags[k]))
    assert got["best_lag"][0] == best and np.isclose(got["max_xcorr"][0], abs(lags[best])) and np.isclose(got["zero_lag"][0], np.corrcoef(x, y)[0, 1])
    own = spectral.measure_segments(x[None], np.array([fs]))
    c = x - np.median(x)
    acf = [sum(c[i] * c[i + k] for i in range(300 - k)) / (c**2).sum() for k in range(41)]
    assert own["acf_lag"][0] == 4 + int(np.argmax(acf[4:41])) and np.isclose(own["acf_height"][0], max(acf[4:41]))


def _pieces(spark, rows, step):
    parts = [(k, i, [float(v) for v in x[a : a + step]], fs) for k, x, fs in rows for i, a in enumerate(range(0, len(x), step))]
    return spark.createDataFrame(parts, "k int, ordinal long, values array<double>, fs double")


def test_spectra_by_blocks_are_those_of_whole_segments(spark):
    r = np.random.default_rng(8)
    t = np.arange(3000) / 33
    rows = [(0, 9000 * np.sin(2 * np.pi * 1.2 * t) + r.normal(0, 50, 3000), 33.0), (1, r.normal(0, 1, 1024), 64.0), (2, np.full(900, 7.0), 33.0), (3, t[:40], 33.0), (4, r.normal(0, 1, 513).cumsum(), 20.0), (5, np.sin(t[:100]), 33.0), (6, r.integers(-9, 9, 2047).astype(float), 250.0)]
    whole = spark.createDataFrame([(k, [float(v) for v in x], fs) for k, x, fs in rows], "k int, values array<double>, fs double")
    want = {x.k: x for x in spectral.segment_periodicity(whole).collect()}
    for size in (300, 512, spectral_blocks.SAMPLES):
        got = {x.k: x for x in spectral_blocks.periodicity(_pieces(spark, rows, 23), ["k"], size).collect()}
        assert sorted(got) == sorted(want)
        for k, w in want.items():
            for name, v in w.asDict().items():
                assert got[k][name] == (pytest.approx(v, rel=1e-9, abs=1e-12) if isinstance(v, float) else v), (size, k, name)
    assert spectral_blocks.periodicity(_pieces(spark, [], 23), ["k"]).count() == 0


def test_spectra_of_a_long_recording(spark):
    """A million and a half samples without a gap, made by Spark: no row is longer than a block and what it reaches over."""
    n, fs = 1_500_000, 64.0
    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.floor(10000 * F.sin((F.col("id") * 64 + i) * (2 * math.pi * 1.25 / fs)) + (F.col("id") * 64 + i) * 7919 % 211).cast("double"))
    pieces = spark.range(-(-n // 64)).select(F.lit(1).alias("k"), F.col("id").alias("ordinal"), values.alias("values"), F.lit(fs).alias("fs"))
    assert spectral_blocks.sample_blocks(pieces, ["k"]).select(F.max(F.size("x"))).first()[0] <= spectral_blocks.SAMPLES + 256 + 128
    got = spectral_blocks.periodicity(pieces, ["k"]).first()
    assert got.usable and abs(got.dominant_hz - 1.25) < 0.13 and got.acf_peak > 0.9 and abs(got.acf_lag_s - 0.8) < 0.02


def test_channel_pairs(spark):
    a = np.random.default_rng(1).normal(0, 1, 400)
    rows = [(0, 0, a, 33.0), (0, 1, -np.roll(a, 5), 33.0), (1, 0, a, 33.0), (1, 1, a, 33.0), (2, 0, a[:5], 33.0), (2, 1, a, 33.0), (3, 0, np.zeros(90), 33.0), (3, 1, a[:90], 33.0)]
    df = spark.createDataFrame([(k, c, [float(v) for v in x], fs) for k, c, x, fs in rows], "k int, channel int, values array<double>, fs double")
    got = {r.k: r for r in spectral.channel_pairs(df, ["k"]).collect()}
    assert got[0].best_lag == -5 and got[0].max_xcorr > 0.9 and "delayed_channels" in got[0].reasons
    assert got[1].coherence > 0.99 and got[1].agree and got[1].reasons == ["dom_freq_agree"]
    assert got[2].reasons == ["too_short"] and got[2].zero_lag == 0
    assert "zero_variance" in got[3].reasons


@pytest.mark.parametrize(
    ("args", "want"),
    [((37, 1.0, 18 / 37, 0.205, 0.075), "INSUFFICIENT_CHANNEL_AGREEMENT"), ((20, 1.0, 0.75, 0.4, 0.3), "COMPATIBLE"), ((20, 1.0, 0.55, 0.28, 0.08), "PARTIALLY_COMPATIBLE"), ((8, 1.0, 0.9, 0.9, 0.9), "NOT_EVALUABLE"), ((20, 0.5, 0.9, 0.9, 0.9), "NOT_EVALUABLE"), ((20, 1.0, 0.75, 0.4, None), "PARTIALLY_COMPATIBLE")],
)
def test_channel_verdict(spark, args, want):
    assert one(spark, verdicts.channel_verdict(*[F.lit(a).cast("double") for a in args])) == want


def test_rates(spark):
    cases = [
        (("ACCEPTED", 3.0, 0.9, 60.0, 80.0, "COMPATIBLE"), "METHOD_DISAGREEMENT", ["spectral_time_disagreement"]), (("ACCEPTED", 3.0, 0.9, 60.0, 62.0, "COMPATIBLE"), "COMPUTED", []),
        (("ACCEPTED", None, 0.9, 60.0, 62.0, "COMPATIBLE"), "NOT_COMPUTED", ["public_median_abs_hr_error_gate"]), (("UNVERIFIED", 3.0, 0.9, 60.0, 80.0, "PARTIALLY_COMPATIBLE"), "NOT_COMPUTED", ["decoder_status_insufficient", "spectral_time_disagreement", "channel_agreement_partial_only"]),
        ((None, None, None, None, 1.0, None), "NOT_COMPUTED", ["decoder_status_insufficient", "public_median_abs_hr_error_gate", "public_coverage_gate", "rate_estimates_unavailable", "channel_agreement_not_evaluable"]),
    ]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, decoder_status string, public_error double, public_coverage double, spectral double, time_domain double, verdict string")
    got = verdicts.rate_gates(df).orderBy("i").collect()
    assert [(r.rate_status, r.failed) for r in got] == [c[1:] for c in cases] and got[1].rate == 61.0 and got[0].rate is None
    assert got[1].passed == ["decoder_status_ok", "public_median_abs_hr_error_ok", "public_coverage_ok", "spectral_time_agree", "channel_agreement_compatible"]


def test_exact_percentiles(spark):
    r = np.random.default_rng(3)
    data = {k: np.concatenate([r.integers(-1 << 23, 1 << 23, n), [7] * n]).astype(float) / 2 for k, n in ((0, 1), (1, 5), (2, 400))}
    rows = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [(2, None), (3, None)], "k int, v double")
    got = {x.k: x for x in store.exact_percentiles(rows, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.95}).collect()}
    assert set(got) == set(data)
    assert all(np.allclose([got[k].a, got[k].b, got[k].c], np.percentile(x, [25, 50, 95])) for k, x in data.items())


def test_neighbours_and_sums_across_blocks(spark):
    rows = [(k, i, (i * 37 + k) % 11) for k in (1, 2) for i in range(50 if k == 1 else 3)]
    df = spark.createDataFrame(rows, "k int, o long, v int").repartition(5)
    named = {"before": lambda w: F.lag("v").over(w), "after": lambda w: F.lead("v").over(w)}
    got = ordering.running_sum(ordering.neighbours(df, ["k"], "o", named, 8), ["k"], "o", F.col("v"), "upto", size=8)
    got = ordering.running_sum(got, ["k"], "o", F.col("v"), "until", inclusive=False, size=8)
    have = {(r.k, r.o): r for r in got.collect()}
    assert len(have) == len(rows)
    for k, i, v in rows:
        of = {j: x for q, j, x in rows if q == k}
        r = have[k, i]
        assert (r.before, r.after, r.until, r.upto) == (of.get(i - 1), of.get(i + 1), sum(of[j] for j in range(i)), sum(of[j] for j in range(i)) + v)


def test_number_rows(spark):
    df = spark.createDataFrame([(i * 37 % 100, str(i)) for i in range(100)], "a int, b string").repartition(7)
    assert [(r.a, r.n) for r in store.number_rows(df, ["a"], "n").orderBy("n").collect()] == [(i, i) for i in range(100)]
    assert store.number_rows(df.where("false"), ["a"], "n").count() == 0


def test_quality_shares(spark):
    v = lambda x: one(spark, verdicts.flat_and_clip(F.array(*[F.lit(float(y)) for y in x]).cast("array<double>")))
    assert tuple(v([])) == (1.0, 0.0) and tuple(v([5])) == (1.0, 1.0) and tuple(v([5, 5, 5])) == (1.0, 1.0)
    assert tuple(v([0, 0, 1000, 500])) == (1 / 3, 0.75) and tuple(v([0, 50, 50])) == (0.5, 0.0)


def test_reports(spark, tmp_path):
    doc = F.lit('{"a":{"Patient":"x","path":"C:\\\\data"},"k":1}')
    assert one(spark, reports.export_findings(doc)) == ["path", "identifying_key"]
    assert one(spark, reports.allowed(F.lit('{"a":{"b":1,"c":2},"d":3}'), "a struct<b:int>")) == '{"a":{"b":1}}'
    assert one(spark, reports.missing_warning(reports.missing_fields(a=F.lit(" "), b=F.lit(0), c=F.lit(None)))) == "Missing source fields; exported NOT_AVAILABLE: a, c"
    empty = spark.createDataFrame([], "rank int, signedness string, byte_order string, channel_count int, layout string, status string, codes array<string>")
    assert reports.selection_notes(empty).first().notes == ["no_candidates"]
    row = spark.createDataFrame([(1, "int24", "CAB", 2, "continuous", "UNVERIFIED", ["unverified_default"])], empty.schema)
    assert reports.selection_notes(row).first().notes[0] == "selected_rank1=int24|CAB|C2|continuous"
    (tmp_path / "r.json").write_text("[1]")
    with pytest.raises(Exception, match="object"):
        sessions.read_report(spark, str(tmp_path / "r.json"), StructType.fromDDL("schema_version string"), "1.0").collect()


def test_outputs(spark, tmp_path):
    path = str(tmp_path / "q")
    outputs.write_quality(spark.createDataFrame([], outputs.QUALITY), path)
    assert spark.read.parquet(path).columns == [f.name for f in StructType.fromDDL(outputs.QUALITY).fields]
    samples = sessions.sample_columns(spark.createDataFrame([("1", ""), ("2", "x"), ("3", "y")], "a string, b string"), 2)
    assert {r["column"]: len(r["values"]) for r in samples.collect()} == {"a": 2, "b": 2}


def test_benchmark(spark, tmp_path):
    (tmp_path / "signals").mkdir()
    t = np.arange(400) / 20
    wave = np.sin(2 * np.pi * 1.25 * t)
    (tmp_path / "signals" / "a.txt").write_text("\n".join(map(str, wave)))
    np.save(tmp_path / "signals" / "b.npy", wave)
    np.save(tmp_path / "signals" / "c.npy", (wave * 1000).astype(np.int16).reshape(20, 20))
    rec = {"record_id": "r1", "subject_id": "s", "fs_hz": 20.0, "quality_label": 1, "reference_hr_bpm": 75.0, "signal_file": "signals/a.txt"}
    records = [rec, rec | {"record_id": "r2", "signal_file": "signals/none.txt"}, rec | {"record_id": "r3", "signal_file": "signals/b.npy"}, rec | {"record_id": "r4", "signal_file": "signals/c.npy"}, rec | {"record_id": "r5", "signal_file": "signals/none.npy"}]
    (tmp_path / "manifest.json").write_text(json.dumps({"version": "2.0.0", "records": records}))
    read = {r.record_id: r["values"] for r in benchmark.read_manifest(spark, str(tmp_path)).collect()}
    assert sorted(read) == ["r1", "r3", "r4"] and read["r1"] == read["r3"] == wave.tolist() and read["r4"] == (wave * 1000).astype(np.int16).tolist()
    got = {r.record_id: r for r in benchmark.estimates(benchmark.read_manifest(spark, str(tmp_path))).collect()}
    assert all(r.guess == 1 and abs(r.bpm - 75) < 8 for r in got.values())
    (tmp_path / "signals" / "b.npy").write_bytes(b"no array")
    with pytest.raises(Exception, match="signals/b.npy is no array"):
        benchmark.read_manifest(spark, str(tmp_path)).collect()


def test_split_by_subjects(spark):
    rows = [(f"r{i:03}", f"s{i * 7 % 23:02}") for i in range(120)] + [("x", None)]
    got = [r.record_id for r in benchmark.by_subject(spark.createDataFrame(rows, "record_id string, subject_id string"), 5).orderBy("place").collect()]
    subjects = [None, *sorted({s for _, s in rows if s})]
    np.random.default_rng(5).shuffle(subjects)
    assert got == [r for s in subjects for r in sorted(r for r, t in rows if t == s)]


def test_top_k(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).alias("v"), "id")
    top = reports.top_k(rows, ["g"], [F.desc("v"), F.col("id")], 4)
    want = {(g, *x) for g in range(3) for x in sorted(((i * 37 % 101, i) for i in range(g, 1000, 3)), key=lambda x: (-x[0], x[1]))[:4]}
    assert {(r.g, r.v, r.id) for r in top.collect()} == want
    plan = top._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle


def test_sorted_files(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.range(4000).select((F.col("id") * 7 % 40).alias("session"), F.lit("L").alias("layout"), F.lit("H").alias("hypothesis"), (F.col("id") % 3).alias("channel"), F.col("id").alias("segment"), F.lit(0).alias("packet_start"), F.lit(1).alias("packet_end"), F.lit(1.0).alias("fs"), F.array(F.lit(1.0)).alias("values"))
    outputs.write_segments(rows, path)
    ranges = []
    for f in (tmp_path / "s").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        stats = [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
        ranges.append((min(x.min for x in stats), max(x.max for x in stats)))
    ranges.sort()
    assert len(ranges) > 1 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert sum(lo <= 7 <= hi for lo, hi in ranges) <= 2 and spark.read.parquet(path).where("session = 7").count() == 100


def test_frames_and_older_reports(spark):
    per = spark.createDataFrame([(True, ["periodic_candidate"]), (False, ["weak_periodicity"]), (False, ["flatline_segment"]), (False, ["flatline_segment"])], "usable boolean, reasons array<string>")
    assert {r.kind: r.n for r in reports.periodicity_frame(per).collect()} == {"plausible": "1", "weak": "1", "non_evaluable": "2"}
    assert {r.n for r in reports.periodicity_frame(per.limit(0)).collect()} == {"NOT_AVAILABLE"}
    old = spark.createDataFrame([((3, 40, 192, 1500.0), 66, "119", "UNVERIFIED", ["x"])], "meta struct<session_count:long,packet_count:long,candidate_count:long,gap_threshold_ms:double>, nominal_payload_length long, datatype_mode string, selected_status string, privacy_posture array<string>")
    row = reports.from_legacy(old, 2).first()
    assert (row.schema_version, row.session_count, row.decoder_status, row.malformed_packet_count, row.total_gap_count, row.max_gap_ms) == ("dashboard.safe.v1", 3, "UNVERIFIED", None, None, None)
    one_ = spark.createDataFrame([((5, 2), [], {"pending_upload": 0}, [])], "meta struct<row_count:long,column_count:long>, modality_coverage array<string>, inconsistency_counts map<string,long>, privacy_posture array<string>")
    first = reports.from_legacy(one_, 1).first()
    assert (first.row_count, first.upload_completion_count, first.upload_pending_count) == (5, None, None)


def test_confusion(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1)], "t int, g int")
    r = verdicts.confusion(rows, "t", "g").first()
    assert (r.tp, r.fp, r.tn, r.fn, r.balanced_accuracy) == (1, 1, 1, 1, 0.5)
    e = verdicts.paired_errors(spark.createDataFrame([("a", 70.0, 72.0), ("a", 80.0, None), ("a", 90.0, 85.0)], "k string, t double, g double"), "t", "g", ["k"]).first()
    assert (round(e.coverage, 3), e.mae, e.bias) == (0.667, 3.5, -1.5)


def test_sessions(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('id,raw_packets_json\n1,"[{""a"": 1}]"\n2,\n')
    df = sessions.read_sessions(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [("1", '[{"a": 1}]'), ("2", "")]
    with pytest.raises(ValueError):
        sessions.packet_cells(df.drop("raw_packets_json"))
    for bad in ("x.csv", "private.json"):
        with pytest.raises(ValueError):
            sessions.guard_report_path(bad)


def test_streaming_segments(spark, tmp_path):
    spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' + make_interval(0,0,0,0,h) AS ts, 1L AS session FROM VALUES (0),(1),(50),(51),(400) AS t(h)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, session long").parquet(str(tmp_path / "in"))
    q = streaming_segments(stream).writeStream.format("memory").queryName("segs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("segs").collect()) == [2, 2]


@pytest.mark.parametrize("split", [[0, 7, 19, 60], [0, 30, 31, 60]])
def test_stateful_segments(spark, tmp_path, split):
    """Three micro-batches with a restart before the last, replayed packets and shuffled rows: the batch job's segments."""
    r = np.random.default_rng(split[1])
    rows, now = [], {"a": 0, "b": 500}
    for k in range(60):
        for s in ("a", "b") if k % 3 else ("a",):
            now[s] += int(r.choice([1000, 1000, 1400, 0, -300, 5000]))
            rows.append((s, k, now[s], r.integers(0, 9, r.integers(0, 4)).tolist() if k % 5 else None))
    schema = "session string, arrival long, received_ms long, payload array<long>"
    ts = F.timestamp_millis(F.greatest("received_ms", F.lit(0)) + 10**12)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(query):
        stream = spark.readStream.schema(schema + ", ts timestamp").parquet(str(tmp_path / "in"))
        q = stateful_segments(stream, 1500.0, "1 hour", "10 minutes", channels=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).queryName(query).start()
        q.processAllAvailable()
        q.stop()

    (tmp_path / "in").mkdir()
    for i, (a, b) in enumerate(zip(split, split[1:], strict=False)):
        part = [x for x in rows if a <= x[1] < b] + ([x for x in rows if x[1] == a - 1] if i else [])  # and a replay
        r.shuffle(part)
        spark.createDataFrame([tuple(x) for x in part], schema).withColumn("ts", ts).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(f"part{i}")
    late = [("c", 0, 10**8, None)]  # the watermark passes all open segments
    spark.createDataFrame(late, schema).withColumn("ts", ts).write.mode("append").parquet(str(tmp_path / "in"))
    run("end")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    numbered = spark.createDataFrame([(s, i, ms) for s in ("a", "b") for i, (_, _, ms, _) in enumerate(x for x in rows if x[0] == s)], "session string, ordinal long, received_ms long")
    want = timebase.segment_ranges(numbered, fixed_ms=1500.0).collect()
    key = lambda x: (x.session, x.segment, x.packet_start, x.packet_end, x.span_ms)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert {x.closed for x in got} == {"gap", "regression", "idle"}
    for s in ("a", "b"):
        last = max((x for x in got if x.session == s), key=lambda x: x.segment)
        assert last.closed == "idle" and last.phase == sum(len(x[3] or []) for x in rows if x[0] == s) == sum(x.words for x in got if x.session == s)


def test_previous_and_running_sums(spark):
    """Values are carried over blocks of two and over nulls."""
    rows = [("a", k, None if k in (0, 3, 4, 5, 6) else k * 10) for k in (0, 1, 2, 3, 4, 5, 6, 9, 11)] + [("b", 4, 7), ("b", 5, None)]
    df = spark.createDataFrame(rows, "s string, k long, v long")
    got = {(r.s, r.k): (r.p, r.h) for r in ordering.running_sums(ordering.previous(df, ["s"], "k", "v", "p", 2), ["s"], "k", [F.col("k"), F.coalesce("v", F.lit(0))], "h", 2).collect()}
    before, total, want = {}, {}, {}
    for s, k, v in rows:
        want[s, k] = (before.get(s), list(total.setdefault(s, [0, 0])))
        before[s] = before.get(s) if v is None else v
        total[s] = [total[s][0] + k, total[s][1] + (v or 0)]
    assert got == want


def test_walk(spark):
    deep = "1"
    for _ in range(12):
        deep = '{"d":' + deep + "}"
    many = json.dumps({f"k{i}": i for i in range(300)})
    cells = spark.createDataFrame([(1, '{"a":[1,{"b":null}],"12":true}'), (2, deep), (3, many), (4, "[" + "1," * 70 + "2]"), (5, "{bad"), (6, ""), (7, None)], "id int, cell string")
    rows = walk.walk(cells, ["id"]).where(F.col("path") != "").groupBy("id", "path", "type").count().collect()
    got = {(r["id"], r["path"], r["type"]): r["count"] for r in rows}
    assert {k[1:] for k in got if k[0] == 1} == {("a", "array"), ("a[]", "integer"), ("a[]", "object"), ("a[].b", "null"), ("<dynamic_key>", "boolean")}
    assert max(k[1].count("d") for k in got if k[0] == 2) == 8
    assert got[(3, "<dynamic_key>", "integer")] == 200 - 19 and (3, "k18", "integer") in got
    assert got[(4, "[]", "integer")] == 50
    assert not [k for k in got if k[0] > 4]
    total = walk.array_stats(walk.walk(cells, ["id"]), ["id"]).where("id = 4").first()
    assert (total["total_length"], total["inspected"], total["samples"]) == (71, 50, 71)


def test_audit_of_empty_and_null(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "[1,2]", "x")], "session long, ppg_json string, note string")
    cells = audit.with_status(audit.unpivot(rows))
    got = {(r["session"], r["modality"]): r["status"] for r in audit.modality_statuses(cells).collect()}
    assert (got[(1, "ppg")], got[(2, "ppg")], got[(2, "ecg")]) == ("payload_empty", "samples_present", "column_absent")
    assert {(r["session"], r["code"]) for r in audit.findings(cells).collect()} == {(1, "empty_physiology")}
    none = audit.with_status(audit.unpivot(rows.limit(0)))
    assert audit.modality_statuses(none).count() == 0 and audit.findings(none).count() == 0


def _inside(levels, value):
    """``value`` under so many keys."""
    for _ in range(levels):
        value = {"d": value}
    return value


def test_modalities_are_found_however_deep_long_or_wide_a_cell_is(spark):
    ecg = {"ecg": [1, 2]}
    found = [[0] * 60 + [ecg], [0] * 40000 + [[ecg]], _inside(12, ecg), _inside(300, ecg), {f"k{i}": i for i in range(300)} | ecg, {f"k{i}": i for i in range(24)} | ecg, {"ecg": _inside(12, [1])}, [[0] * 60, ecg] * 60]
    none = [{"ecg": [0] * 60 + [{}]}, {"ecg": [0] * 60 + [[]]}, {"ecg": _inside(12, {})}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(found + none)] + [(99, json.dumps([0] * 60 + [{"x": 1}]))]
    cells = audit.with_status(audit.unpivot(spark.createDataFrame(rows, "session long, data_json string")))
    got = {r["session"]: r["status"] for r in audit.modality_statuses(cells).where("modality = 'ecg'").collect()}
    assert got == dict.fromkeys(range(len(found)), "samples_present") | dict.fromkeys(range(len(found), len(rows) - 1), "structure_present_no_samples") | {99: "column_absent"}


def test_findings_see_times_however_deep_long_or_wide_a_cell_is(spark):
    times = {"time_s": [0, 100]}
    agree = [{"time_s": list(range(101))}, {"time_s": [5] * 40000 + [105]}, [0] * 60 + [times], _inside(12, times), {f"k{i}": i for i in range(300)} | times, [{"time_s": i} for i in range(101)]]
    differ = [{"time_s": [0, 100] + [50] * 60 + [300]}, _inside(12, {"time_s": [0, 10]})]
    rows = [(i, "100", json.dumps(v)) for i, v in enumerate(agree + differ)] + [(99, "100", json.dumps(_inside(12, {"time_s": [7]})))]
    cells = audit.with_status(audit.unpivot(spark.createDataFrame(rows, "session long, duration_s string, data_json string")))
    got = {(r["session"], r["code"]) for r in audit.findings(cells).collect()}
    assert got == {(len(agree) + i, "duration_mismatch") for i in range(len(differ))} | {(99, "duration_not_evaluable")}


def test_time_units(spark):
    for name, unit in (("time_ms", "ms"), ("sample_us", "us"), ("startSeconds", "s"), ("epoch_s", "s"), ("value", None)):
        assert one(spark, names.time_unit(F.lit(name))) == unit
    assert one(spark, names.is_time_field(F.lit("recorded_at"))) and not one(spark, names.is_time_field(F.lit("ratio")))


def _candidate_by_hand(sessions, signed, order, c, layout):
    """Costs of one candidate, word by word."""
    eps, mid = 1e-9, lambda x: float(np.median(x)) if len(x) else 0.0

    def word(v):
        u = v & 0xFFFFFF
        b = {"A": u >> 16, "B": (u >> 8) & 255, "C": u & 255}
        x = (b[order[0]] << 16) | (b[order[1]] << 8) | b[order[2]]
        return x - (1 << 24) if signed and x >= 1 << 23 else x

    mad = lambda x: mid(np.abs(np.array(x) - mid(x))) if len(x) else 0.0
    vectors, steps_all, ratios_all, corrs, cvs, var, mids, totals = [], [], [], [], [], [], [], np.zeros(4)
    low, high = (-(1 << 23), (1 << 23) - 1) if signed else (0, 0xFFFFFF)
    for packets_ in sessions:
        streams, steps, jumps, seen = [[] for _ in range(c)], [], [], 0
        for p in packets_:
            parts = [[] for _ in range(c)]
            for i, v in enumerate(p):
                parts[(i + (seen if layout == "continuous" else 0)) % c].append(float(word(v)))
            seen += len(p)
            for s, part in zip(streams, parts, strict=True):
                if part and s:
                    jumps.append(abs(part[0] - s[-1]))
                steps += list(np.abs(np.diff(part)))
                s += part
        words = np.concatenate(streams)
        m = mad(steps)
        ratios = [j / max(eps, m) for j in jumps]
        counts = np.array([np.sum((words <= low) | (words >= high)), len(words), np.sum(np.array(steps) == 0), len(steps)])
        totals += counts
        vectors.append([m, mid(ratios), counts[0] / counts[1], counts[2] / max(1, counts[3])])
        steps_all, ratios_all = steps_all + steps, ratios_all + ratios
        best = 0.0
        able = [s for s in streams if len(s) >= 3 and np.std(s) > 0]
        n = min(map(len, able), default=0)
        for a in range(len(able)):
            for b in range(a):
                x, y = np.array(able[a][:n]), np.array(able[b][:n])
                if x.std() > 0 and y.std() > 0:
                    best = max(best, abs(np.corrcoef(x, y)[0, 1]))
        corrs.append(best)
        e = np.array([np.var(s) for s in streams if s])
        cvs.append(e.std() / abs(e.mean()) if abs(e.mean()) > eps else e.std())
        width = max(len(p) for p in packets_)
        means = [np.mean([word(p[i]) for p in packets_ if i < len(p)]) for i in range(width)]
        var.append(np.var(means))
        mids.append(mid(np.abs(means)))
    q = np.percentile(np.array(vectors), [75, 25], axis=0)
    return [mad(steps_all), mid(ratios_all), float(np.mean(q[0] - q[1])), mid(var) / max(eps, mid(mids) ** 2), totals[0] / totals[1], totals[2] / totals[3], mid(corrs), mid(cvs)]


def test_candidate_costs_by_brute_force(spark):
    rng = np.random.default_rng(5)
    sessions_ = [[[int(v) for v in rng.integers(-(1 << 23), 1 << 24, rng.integers(5, 9))] for _ in range(4)] for _ in range(3)]
    sessions_[0][1][3] = sessions_[0][1][1] = 0xFFFFFF
    rows = [(s, o, p) for s, ps in enumerate(sessions_) for o, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "session long, ordinal long, payload array<long>")
    got = candidates.metrics(df, [1, 3]).collect()
    assert sorted(r["spec_idx"] for r in got) == list(range(48))
    for r in got:
        want = _candidate_by_hand(sessions_, r["signedness"] == "int24", r["byte_order"], r["channel_count"], r["layout"])
        assert [r[k] for k in candidates.WEIGHTS] == pytest.approx(want, rel=1e-6, abs=1e-9), r


def test_candidate_statuses(spark):
    def row(i, cost, rank, **over):
        base = {"spec_idx": i, "signedness": "int24", "byte_order": "ABC", "channel_count": 2, "layout": "continuous", **dict.fromkeys(candidates.WEIGHTS, 0.1), "cost": cost, "rank": rank}
        return base | over

    def top(*rows, **options):
        df = candidates.statuses(spark.createDataFrame(list(rows)), **options)
        return df.where("rank = 1").select("status", "codes").first()

    far = row(1, 0.9, 2, channel_count=3)
    assert top(row(0, 0.1, 1), far)["status"] == "PROVISIONALLY_ACCEPTED"
    assert top(row(0, 0.1, 1), far, documented=True)["status"] == "ACCEPTED"
    assert top(row(0, 0.1, 1), far, samples_per_packet=33, time_aligned=True)["codes"][-1] == "exceptional_evidence_lock"
    assert top(row(0, 0.1, 1), row(1, 0.12, 2, channel_count=3), documented=True)["codes"] == ["unverified_default", "layout_near_tie"]
    assert top(row(0, 0.1, 1), row(1, 0.11, 2, signedness="uint24"))["codes"] == ["unverified_default", "signedness_twin"]
    assert top(row(0, 0.1, 1, saturation_rate=0.9), far)["codes"] == ["reject_saturation"]
    assert top(row(0, 0.1, 1, boundary_jump=9.0), far)["status"] == "UNVERIFIED"


def test_hypotheses_part_the_payload(spark):
    rows = reconstruction.hypotheses(spark).collect()
    assert len(rows) == 7 and all(sorted(r["metadata"] + r["signal"]) == list(range(66)) for r in rows)
    assert reconstruction.hypotheses(spark, primary=True).count() == 4


def test_blocked_layout_carries_its_phase(spark):
    df = spark.createDataFrame([(1, 0, [1, 2, 3, 4]), (1, 1, [5, 6, 7, 8]), (1, 2, [9]), (2, 0, None)], "session long, ordinal long, payload array<long>")
    rows = reconstruction.channels(df, reconstruction.hypotheses(spark, 4, primary=True), 4).where("hypothesis = 'H_3x22' AND layout LIKE 'BLOCKED%'").orderBy("ordinal", "i").collect()
    got = {lay: [r["channel"] for r in rows if r["layout"] == lay] for lay in reconstruction.LAYOUTS[2:]}
    assert got == {"BLOCKED_PACKET_LOCAL": [0, 1, 2, 0, 0, 1, 2, 0], "BLOCKED_CONTINUOUS": [0, 1, 2, 0, 0, 1, 2, 1]}


def test_audit_deals_sessions_to_tasks_by_their_number(spark, monkeypatch):
    """No task of the modality statuses takes a share that grows with the table, whatever the session's shuffle partitions."""
    monkeypatch.setattr(store, "ROWS_A_TASK", 40)
    wide = spark.range(100).select(F.col("id").alias("session"), F.lit('{"ppg":[1,2]}').alias("ppg_json"), F.lit("").alias("note")).coalesce(1)
    cells = store.stored(audit.with_status(audit.unpivot(wide)), "cells")
    assert audit.json_nodes(cells).rdd.getNumPartitions() == 5
    statuses = audit.modality_statuses(cells)
    assert statuses.rdd.getNumPartitions() == 5
    assert statuses.where("modality = 'ppg' AND status = 'samples_present'").count() == 100 and statuses.count() == 1100


def test_kernel_gets_bounded_groups_of_segments(spark):
    """However many segments of one length a batch has, the kernel that needs many times their memory gets few of them at once."""
    segments = spark.range(0, 3000, 1, 1).select("id", F.array_repeat(F.lit(1.0), 640).alias("values"), F.lit(64.0).alias("fs"))
    got = spectral.measured(segments, ["values"], lambda x, fs: {"held": np.full(len(x), float(x.size))}, ["held"], 64)
    assert got.count() == 3000 and got.agg(F.max("held")).first()[0] <= 1 << 18


def _shuffled(spark, df):
    """Rows that all stages of a run of ``df`` wrote to shuffles."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group := f"g{id(df)}", "rows shuffled")
    df.write.format("noop").mode("overwrite").save()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_grid_deals_packets_and_not_words(spark):
    rows = [(0, i, i * 1000 + i // 50 * 9000, [i * 64 + j for j in range(64)]) for i in range(300)]
    timed = spark.createDataFrame(rows, "session long, ordinal long, received_ms long, payload array<long>").repartition(2).localCheckpoint()
    segs = reconstruction.gap_segments(timed, reconstruction.hypotheses(spark, 64, primary=True), 64)
    assert segs.count() == 6 * 4 * (2 + 2 + 2 + 3)
    plan = segs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Generate" in line and "payload" in line]


def test_pairs_gather_a_segment_once(spark):
    rows = [(s, c, [float(v) for v in range(70)], 33.0) for s in range(50) for c in range(3)]
    df = spark.createDataFrame(rows, "s int, channel int, values array<double>, fs double").repartition(2).localCheckpoint()
    pairs = spectral.channel_pairs(df, ["s"])
    assert pairs.count() == 50 * 3
    with_each_side = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _shuffled(spark, spectral.channel_pairs(df, ["s"])) <= len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_each_side)


def test_jump_medians_by_bits(spark):
    """Exact for runs of several thousand packets, ties, no change at all and scales that part numbers of equal size."""
    rng = np.random.default_rng(11)
    jumps = [(c, "continuous", s, int(o), int(a), int(b)) for c, s, n in ((1, 0, 9001), (1, 1, 40), (2, 0, 1), (2, 1, 6)) for o, (a, b) in enumerate(rng.integers(0, 1 << 24, (n, 2)) if s == 0 else rng.integers(0, 3, (n, 2)))]
    runs = steps.edge_runs(spark.createDataFrame(jumps, "channel_count int, layout string, session long, ordinal long, first long, p long"))
    assert runs.count() == 3 + 1 + 1 + 1
    sizes = {(c, s): np.abs(steps.readings(np.array([j[4] for j in jumps if (j[0], j[2]) == (c, s)])) - steps.readings(np.array([j[5] for j in jumps if (j[0], j[2]) == (c, s)]))) for c in (1, 2) for s in (0, 1)}
    got = {(r.channel_count, r.session, r.reading): r["median"] for r in steps.jump_medians(runs).collect()}
    assert got == {(*k, r): float(np.median(v[r])) for k, v in sizes.items() for r in range(12)}
    scale = {(c, s): [1e-9 if s and r % 2 else 3.0 + c + 7 * s + r for r in range(12)] for c in (1, 2) for s in (0, 1)}
    scales = spark.createDataFrame([(*k, v) for k, v in scale.items()], "channel_count int, session long, scale array<double>")
    got = {(r.channel_count, r.reading): r["median"] for r in steps.jump_medians(runs, scales).collect()}
    assert got == {(c, r): pytest.approx(np.median(np.concatenate([sizes[c, s][r] / scale[c, s][r] for s in (0, 1)])), rel=1e-15) for c in (1, 2) for r in range(12)}


def test_long_sessions_packets_stay_where_they_are(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(0, [int(x) for x in rng.integers(0, 1 << 24, 3)]) for _ in range(20_000)] + [(1, [int(x) for x in rng.integers(-(1 << 30), 1 << 30, 40_000)])]
    packets = spark.createDataFrame(rows, "session long, payload array<long>").repartition(4).localCheckpoint()
    limit, plans, count = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), [], steps._digits
    monkeypatch.setattr(steps, "_digits", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or count(df, *a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.session, r.signedness): r for r in steps.step_medians(packets, [2]).where("NOT overall AND byte_order = 'ABC'").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    for s in (0, 1):
        u = [np.array(p) & 0xFFFFFF for k, p in rows if k == s]
        step = np.concatenate([np.abs(x[2:] - x[:-2]) for x in u])
        r = got[s, "uint24"]
        assert (r.n, r.mid, r.mad) == (len(step), np.median(step), np.median(np.abs(step - np.median(step))))
    assert len(plans) == 6 and not any("SortMergeJoin [session" in p or "ShuffledHashJoin [session" in p for p in plans)


def test_cells_that_deal_alike_are_measured_once(spark):
    rows = [(s, i, i * 1000 + i // 50 * 9000, [(s + i * 64 + j) * 7919 % 10007 for j in range(64)]) for s in range(2) for i in range(120)]
    timed = spark.createDataFrame(rows, "session long, ordinal long, received_ms long, payload array<long>").localCheckpoint()
    grid = reconstruction.hypotheses(spark, 64, primary=True)
    cells = reconstruction.alike(grid).localCheckpoint()
    assert cells.count() == 16 and cells.select("of_layout", "of_hypothesis").distinct().count() == 10
    every, once = reconstruction.gap_segments(timed, grid, 64), reconstruction.gap_segments(timed, grid, 64, once=cells)
    assert (every.count(), once.count()) == (2 * 3 * 4 * 9, 2 * 3 * (3 * 2 * 2 + 4 * 3))
    again = reconstruction.in_all_cells(once, cells).select(*every.columns)
    assert every.exceptAll(again).count() == again.exceptAll(every).count() == 0


def test_pairs_of_cells_that_deal_alike_are_measured_once(spark, monkeypatch):
    seen = []
    whole = reconstruction.segment_pairs
    monkeypatch.setattr(reconstruction, "segment_pairs", lambda segs: seen.append(segs.select("layout", "hypothesis").distinct().count()) or whole(segs))
    got = evidence.grid_pairs(spark, "/root/testdata/sf0.001").select("layout", "hypothesis").distinct().count()
    assert (seen, got) == ([10], 16)


def test_grid_pairs_measures_no_spectra(spark, monkeypatch):
    """It tells correlations at lag 0 alone; lags and spectra of each pair were most of its time."""
    kernels, measured = [], spectral.measured
    monkeypatch.setattr(spectral, "measured", lambda df, series, kernel, *more: kernels.append(kernel) or measured(df, series, kernel, *more))
    assert evidence.grid_pairs(spark, "/root/testdata/sf0.001").count()
    assert kernels == [spectral.zero_lags]
    r = np.random.default_rng(3)
    rows = [(k, c, r.normal(size=n).tolist() if k < 3 else [1.0] * n, 8.0) for k in range(5) for c, n in ((0, 70), (1, 66 if k != 4 else 5))]
    df = spark.createDataFrame(rows, "k int, channel int, values array<double>, fs double")
    of = lambda x: {(p.k, p.channel_a, p.channel_b): p.zero_lag for p in x.collect()}
    assert of(spectral.channel_pairs(df.drop("fs"), ["k"])) == of(spectral.channel_pairs(df, ["k"])) and len(rows) == 10
