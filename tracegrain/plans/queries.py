"""The core queries over the given tables, each with its SQL twin beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrain.functions import bits, names, privacy
from tracegrain.functions.store import stored
from tracegrain.operators import audit, candidates, cells, positions, reconstruction, scoring, spectral, timebase, verdicts, walk
from tracegrain.sources import views

from . import evidence as _evidence  # noqa: F401  (registers its queries)
from .registry import query

DAY = 86400000.0
DELTAS_SQL = """deltas AS (
  SELECT *, CAST(received_ms - lag(received_ms) OVER (PARTITION BY session ORDER BY ordinal) AS DOUBLE) AS delta FROM packets)"""
THRESHOLD_SQL = f"""med AS (
  SELECT session, coalesce(quantile_cont(delta, 0.5) FILTER (WHERE delta > 0), 1000.0) AS median_ms FROM deltas GROUP BY session),
seg AS (
  SELECT d.*, sum(CASE WHEN d.delta < 0 OR d.delta > greatest(m.median_ms * 1.5, {DAY}) THEN 1 ELSE 0 END)
    OVER (PARTITION BY d.session ORDER BY d.ordinal ROWS UNBOUNDED PRECEDING) AS segment
  FROM deltas d JOIN med m ON d.session = m.session)"""
U24 = "(v & 16777215)"
SIGNED = "CASE WHEN ((v & 255) * 65536 + ((v >> 16) & 255) * 256 + ((v >> 8) & 255)) >= 8388608 THEN ((v & 255) * 65536 + ((v >> 16) & 255) * 256 + ((v >> 8) & 255)) - 16777216 ELSE (v & 255) * 65536 + ((v >> 16) & 255) * 256 + ((v >> 8) & 255) END"


@query(f"""WITH {views.PACKETS_SQL}, {DELTAS_SQL}
SELECT session, count(*) AS packet_count, count(*) FILTER (WHERE delta > {DAY}) AS gap_count, count(*) FILTER (WHERE delta < 0) AS regression_count,
  count(*) FILTER (WHERE delta = 0) AS duplicate_count,
  abs(coalesce(sum(delta) FILTER (WHERE delta > 0), 0.0) - coalesce(sum(delta), 0.0)) > 1.0 AS duration_inconsistency,
  min(delta) AS delta_min_ms, quantile_cont(delta, 0.5) AS delta_median_ms, round(quantile_cont(delta, 0.95), 6) AS delta_p95_ms
FROM deltas GROUP BY session""")
def packet_timebase(spark: SparkSession, sf: str) -> DataFrame:
    return timebase.summaries(views.packets(spark, sf), DAY).withColumn("delta_p95_ms", F.round("delta_p95_ms", 6))


@query(f"""WITH {views.PACKETS_SQL}, {DELTAS_SQL}
SELECT CASE WHEN delta < 0 THEN 'negative' WHEN delta = 0 THEN 'zero' WHEN delta <= 500 THEN 'le_500ms' WHEN delta <= 1500 THEN 'le_gap_threshold'
  WHEN delta <= 5000 THEN 'gap_to_5s' WHEN delta <= 30000 THEN 'gap_to_30s' ELSE 'gap_gt_30s' END AS gap_class, count(*) AS n
FROM deltas WHERE delta IS NOT NULL GROUP BY 1""")
def gap_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return timebase.gap_histogram(views.packets(spark, sf))


@query(f"""WITH {views.PACKETS_SQL}, {DELTAS_SQL}, {THRESHOLD_SQL}
SELECT session, CAST(segment AS BIGINT) AS segment, min(ordinal) AS packet_start, max(ordinal) + 1 AS packet_end,
  arg_max(received_ms, ordinal) - arg_min(received_ms, ordinal) AS span_ms FROM seg GROUP BY session, segment""")
def gap_segments(spark: SparkSession, sf: str) -> DataFrame:
    return timebase.segment_ranges(views.packets(spark, sf), DAY)


@query(f"""WITH {views.PACKETS_SQL}, {DELTAS_SQL}
SELECT session, coalesce(quantile_cont(delta, 0.5) FILTER (WHERE delta > 0), 1000.0) AS median_ms,
  greatest(coalesce(quantile_cont(delta, 0.5) FILTER (WHERE delta > 0), 1000.0) * 1.5, 1500.0) AS threshold_ms FROM deltas GROUP BY session""")
def gap_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return timebase.thresholds(views.packets(spark, sf))


@query(f"""WITH {views.PACKETS_SQL}, {DELTAS_SQL}, m AS (SELECT session, coalesce(quantile_cont(delta, 0.5), 1000.0) AS md FROM deltas GROUP BY session),
a AS (SELECT p.*, CAST(lead(received_ms) OVER (PARTITION BY p.session ORDER BY ordinal) - received_ms AS DOUBLE) AS d, md FROM packets p JOIN m ON p.session = m.session)
SELECT session, ordinal, CAST(j AS INTEGER) AS j, received_ms + (j + 0.5::DOUBLE) * (CASE WHEN d > 0 THEN d ELSE md END) / 4 AS t_ms FROM a, unnest([0, 1, 2, 3]) AS u(j)""")
def sample_times(spark: SparkSession, sf: str) -> DataFrame:
    return timebase.sample_times(views.packets(spark, sf), 4)


@query(f"""WITH {views.PAYLOADS_SQL}
SELECT CAST(pos AS INTEGER) AS pos, count(*) AS n, min(v) AS v_min, max(v) AS v_max, max(v) - min(v) AS v_range, avg(v) AS v_mean, round(coalesce(stddev_samp(v), 0.0), 6) AS v_std,
  min(CASE WHEN v = 0 THEN 0 ELSE length(bin(abs(v))) END)::INTEGER AS bits_min, max(CASE WHEN v = 0 THEN 0 ELSE length(bin(abs(v))) END)::INTEGER AS bits_max,
  avg(CASE WHEN v = 0 THEN 0 ELSE length(bin(abs(v))) END) AS bits_mean, avg(CASE WHEN v = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS zero_rate,
  avg(CASE WHEN {U24} IN (0, 16777215) THEN 1.0::DOUBLE ELSE 0.0 END) AS saturation_rate FROM words GROUP BY pos""")
def position_stats(spark: SparkSession, sf: str) -> DataFrame:
    return positions.position_stats(views.words(spark, sf)).withColumn("v_std", F.round("v_std", 6))


@query(f"""WITH {views.PAYLOADS_SQL}, u AS (SELECT {U24} AS u FROM words),
k AS (SELECT 'bit_length' AS kind, CASE WHEN u = 0 THEN 0 ELSE length(bin(u)) END AS value FROM u
  UNION ALL SELECT 'leading_zeros', 24 - CASE WHEN u = 0 THEN 0 ELSE length(bin(u)) END FROM u
  UNION ALL SELECT 'trailing_zeros', CASE WHEN u = 0 THEN 24 ELSE length(bin(u)) - length(rtrim(bin(u), '0')) END FROM u)
SELECT kind, CAST(value AS BIGINT) AS value, count(*) AS n FROM k GROUP BY 1, 2""")
def bit_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return positions.bit_histograms(views.words(spark, sf))


@query(f"""WITH {views.PAYLOADS_SQL}
SELECT CAST(k AS INTEGER) AS k, avg(CASE WHEN {U24} % (1 << k) = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS share FROM words, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS t(k) GROUP BY 1""")
def divisibility(spark: SparkSession, sf: str) -> DataFrame:
    return positions.divisibility(views.words(spark, sf))


@query(f"""WITH {views.PAYLOADS_SQL}, l AS (SELECT pos, 'A' AS lane, (v >> 16) & 255 AS b FROM words UNION ALL SELECT pos, 'B', (v >> 8) & 255 FROM words UNION ALL SELECT pos, 'C', v & 255 FROM words)
SELECT CAST(pos AS INTEGER) AS pos, lane, CAST(count(DISTINCT b) AS DOUBLE) / 256.0 AS unique_fraction FROM l GROUP BY 1, 2""")
def byte_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return positions.byte_diversity(views.words(spark, sf)).withColumn("unique_fraction", F.col("unique_fraction").cast("double"))


@query(f"""WITH {views.PAYLOADS_SQL} SELECT avg(CASE WHEN list_min(payload) = list_max(payload) THEN 1.0::DOUBLE ELSE 0.0 END) AS constant_rate, count(*) AS n FROM payloads""")
def constant_payloads(spark: SparkSession, sf: str) -> DataFrame:
    return positions.constant_rate(views.payloads(spark, sf))


@query(f"""WITH {views.PAYLOADS_SQL}, s AS (SELECT *, lag(v) OVER (PARTITION BY session, pos ORDER BY ordinal) AS p FROM words)
SELECT session, CAST(pos AS INTEGER) AS pos, greatest(avg(CASE WHEN v >= p THEN 1.0::DOUBLE ELSE 0.0 END), avg(CASE WHEN v <= p THEN 1.0::DOUBLE ELSE 0.0 END)) AS monotonicity,
  1 - CAST(sum(bit_count(xor(v, p) & 16777215)) AS DOUBLE) / (24.0::DOUBLE * count(*)) AS bit_stability, avg(abs(v - p)) AS mean_abs_step FROM s WHERE p IS NOT NULL GROUP BY session, pos""")
def position_changes(spark: SparkSession, sf: str) -> DataFrame:
    return positions.changes(views.words(spark, sf))


@query(f"""WITH {views.PAYLOADS_SQL}, m AS (SELECT pos, quantile_cont(CAST(v AS DOUBLE), 0.5) AS median, quantile_cont(CAST(v AS DOUBLE), 0.75) - quantile_cont(CAST(v AS DOUBLE), 0.25) AS iqr,
  CAST(count(DISTINCT v) AS DOUBLE) / count(*) AS unique_ratio FROM words GROUP BY pos)
SELECT CAST(m.pos AS INTEGER) AS pos, any_value(median) AS median, any_value(iqr) AS iqr, any_value(unique_ratio) AS unique_ratio, quantile_cont(abs(CAST(v AS DOUBLE) - median), 0.5) AS mad
FROM words w JOIN m ON w.pos = m.pos GROUP BY m.pos""")
def position_spread(spark: SparkSession, sf: str) -> DataFrame:
    return positions.spread(views.words(spark, sf))


@query(f"""WITH {views.PAYLOADS_SQL}, m AS (SELECT session, pos, quantile_cont(CAST(v AS DOUBLE), 0.5) AS m FROM words GROUP BY 1, 2),
d AS (SELECT w.session, w.pos, any_value(m) AS m, quantile_cont(abs(CAST(v AS DOUBLE) - m), 0.5) AS mad FROM words w JOIN m ON w.session = m.session AND w.pos = m.pos GROUP BY 1, 2)
SELECT CAST(pos AS INTEGER) AS pos, round(stddev_pop(m), 3) AS raw_spread, round(stddev_pop(m / (mad + 1e-9)), 6) AS robust_spread FROM d GROUP BY pos""")
def session_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return positions.session_consistency(views.words(spark, sf)).select("pos", F.round("raw_spread", 3).alias("raw_spread"), F.round("robust_spread", 6).alias("robust_spread"))


@query(f"""WITH {views.PAYLOADS_SQL}
SELECT o.byte_order, CAST(sum(x) AS BIGINT) AS total, min(x) AS lowest, max(x) AS highest FROM (
  SELECT byte_order, CASE WHEN p >= 8388608 THEN p - 16777216 ELSE p END AS x FROM (
    SELECT byte_order, CASE byte_order WHEN 'ABC' THEN a * 65536 + b * 256 + c WHEN 'ACB' THEN a * 65536 + c * 256 + b WHEN 'BAC' THEN b * 65536 + a * 256 + c
      WHEN 'BCA' THEN b * 65536 + c * 256 + a WHEN 'CAB' THEN c * 65536 + a * 256 + b ELSE c * 65536 + b * 256 + a END AS p
    FROM (SELECT (v >> 16) & 255 AS a, (v >> 8) & 255 AS b, v & 255 AS c FROM words), unnest(['ABC', 'ACB', 'BAC', 'BCA', 'CAB', 'CBA']) AS t(byte_order))) o GROUP BY 1""")
def byte_orders(spark: SparkSession, sf: str) -> DataFrame:
    w = views.words(spark, sf)
    each = w.select(F.explode(F.array(*[F.struct(F.lit(o).alias("byte_order"), bits.transform_word(F.col("v"), "int24", o).alias("x")) for o in bits.ORDERS])).alias("t")).select("t.*")
    return each.groupBy("byte_order").agg(F.sum("x").alias("total"), F.min("x").alias("lowest"), F.max("x").alias("highest"))


CHANNELS_SQL = f"""{views.PAYLOADS_SQL}, ph AS (
  SELECT *, coalesce(sum(len(payload)) OVER (PARTITION BY session ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM payloads),
pw AS (SELECT session, ordinal, before, unnest(range(len(payload))) AS pos, unnest(payload) AS v FROM ph),
ch AS (SELECT CAST(c AS INTEGER) AS channel_count, layout, session, CAST(CASE WHEN layout = 'continuous' THEN (before + pos) % c ELSE pos % c END AS BIGINT) AS channel, ordinal, pos, {SIGNED} AS x
  FROM pw, unnest([1, 2, 3, 4, 5, 6, 8, 11]) AS a(c), unnest(['packet_local', 'continuous']) AS b(layout)),
st AS (SELECT *, lag(x) OVER w AS px, lag(ordinal) OVER w AS po FROM ch WINDOW w AS (PARTITION BY channel_count, layout, session, channel ORDER BY ordinal, pos))"""


@query(f"""WITH {CHANNELS_SQL}
SELECT channel_count, layout, session, channel, count(*) AS n, round(var_pop(x) / 1e9, 3) AS energy, avg(CASE WHEN x IN (8388607, -8388608) THEN 1.0::DOUBLE ELSE 0.0 END) AS saturation_rate,
  coalesce(avg(CASE WHEN x = px THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE po = ordinal), 0.0) AS flatline_rate, avg(abs(x - px)) FILTER (WHERE po = ordinal) AS mean_step, avg(abs(x - px)) FILTER (WHERE po < ordinal) AS mean_jump
FROM st GROUP BY 1, 2, 3, 4""")
def decoder_channels(spark: SparkSession, sf: str) -> DataFrame:
    stats = scoring.channel_stats(scoring.channel_words(views.payloads(spark, sf), scoring.CHANNELS))
    return stats.withColumn("energy", F.round(F.col("energy") / 1e9, 3))


@query()
def decoder_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Cost and rank of channel counts and layouts; ties of near-equal doubles keep this from an exact SQL twin."""
    scores = scoring.spec_scores(scoring.channel_stats(scoring.channel_words(views.payloads(spark, sf), scoring.CHANNELS)))
    return scoring.ranked(scores, {"step": 1.0, "jump_ratio": 1.5, "saturation_rate": 1.2, "flatline_rate": 1.2, "energy_cv": 0.6})


STATUS_SQL = """st AS (SELECT *, trim(coalesce(cell, '')) AS t, CASE WHEN lower(trim(coalesce(cell, ''))) IN ('', 'null', 'none', 'nan') THEN 'empty'
  WHEN NOT json_valid(trim(coalesce(cell, ''))) THEN 'malformed' WHEN trim(cell) = '[]' THEN 'empty_array' WHEN trim(cell) = '{}' THEN 'empty_object'
  WHEN trim(cell) LIKE '[%' THEN 'array' WHEN trim(cell) LIKE '{%' THEN 'object' ELSE 'scalar' END AS status FROM cells)"""


@query(f"""WITH {views.CELLS_SQL}, {STATUS_SQL} SELECT "column", status, count(*) AS n FROM st GROUP BY 1, 2""")
def cell_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return cells.status_counts(views.cells(spark, sf))


@query(f"""WITH {views.CELLS_SQL}, {STATUS_SQL}, c AS (SELECT "column", count(*) FILTER (WHERE status = 'empty') AS null_or_empty, count(*) FILTER (WHERE status <> 'empty') AS non_empty,
  count(*) FILTER (WHERE status = 'malformed' AND (regexp_matches(t, '^[{{\\["]') OR "column" LIKE '%\\_json' ESCAPE '\\')) AS malformed,
  count(*) FILTER (WHERE status IN ('array', 'object', 'empty_array', 'empty_object') OR (status = 'scalar' AND "column" LIKE '%\\_json' ESCAPE '\\')) AS json_ok FROM st GROUP BY 1)
SELECT *, CASE WHEN malformed > 0 AND ("column" LIKE '%\\_json' ESCAPE '\\' OR json_ok > 0 OR non_empty - malformed - json_ok = 0) THEN 'mixed_malformed' WHEN json_ok > 0 THEN 'json_like' ELSE 'ordinary' END AS kind FROM c""")
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return cells.column_profile(views.cells(spark, sf))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\\b', '<redacted_mac>', 'g'), '\\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\\b', '<redacted_uuid>', 'g'),
  '\\b\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?(?:Z|[+-]\\d{2}:?\\d{2})?\\b', '<redacted_timestamp>', 'g') AS clean
FROM (SELECT doc_id, replace(concat(text, ' AA:BB:CC:DD:EE:0', CAST(doc_id % 10 AS VARCHAR), ' 0b5e51a', CAST(doc_id % 10 AS VARCHAR), '-12ab-4cde-8f01-23456789abcd 2024-06-15T14:30:0', CAST(doc_id % 10 AS VARCHAR), 'Z ', source), source, '<input_path>') AS t FROM documents)""")
def scrubbed_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = views.table(spark, sf, "documents")
    digit = (F.col("doc_id") % 10).cast("string")
    t = F.concat(F.col("text"), F.lit(" AA:BB:CC:DD:EE:0"), digit, F.lit(" 0b5e51a"), digit, F.lit("-12ab-4cde-8f01-23456789abcd 2024-06-15T14:30:0"), digit, F.lit("Z "), F.col("source"))
    return d.select("doc_id", privacy.scrub(F.replace(t, F.col("source"), F.lit("<input_path>"))).alias("clean"))


@query("""SELECT name, CASE u % 3 WHEN 0 THEN 'heart_rate' WHEN 1 THEN 'blood_pressure,hrv' ELSE '' END AS modalities, CASE WHEN u % 4 = 3 THEN '<dynamic_key>' ELSE name END AS shown
FROM (SELECT DISTINCT user_id AS u, CASE WHEN user_id % 4 = 3 THEN 'device_' ELSE '' END || event_type || CASE user_id % 3 WHEN 0 THEN '_heartRate_' WHEN 1 THEN '.HRV-systolic' ELSE '_chr_' END || user_id AS name FROM events)""")
def name_modalities(spark: SparkSession, sf: str) -> DataFrame:
    """Modalities and redaction of key names made from the events' types."""
    u = F.col("user_id")
    middle = F.when(u % 3 == 0, "_heartRate_").when(u % 3 == 1, ".HRV-systolic").otherwise("_chr_")
    kinds = views.table(spark, sf, "events").select(F.concat(F.when(u % 4 == 3, "device_").otherwise(""), F.col("event_type"), middle, u.cast("string")).alias("name")).distinct()
    return kinds.select("name", F.array_join(names.modalities(F.col("name")), ",").alias("modalities"), names.redact(F.col("name")).alias("shown"))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    """Gap segments of the first hypothesis in the first layout."""
    grid = reconstruction.hypotheses(spark, 64, primary=True).where("hypothesis = 'H_2x33'")
    return reconstruction.gap_segments(views.timed_payloads(spark, sf), grid, 64).where(F.col("layout") == reconstruction.LAYOUTS[0])


@query()
def segment_periodicity(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.segment_periodicity(_segments(spark, sf))


@query()
def channel_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.pair_summary(reconstruction.segment_pairs(_segments(spark, sf)), ["session"])


@query()
def window_quality(spark: SparkSession, sf: str) -> DataFrame:
    segs = _segments(spark, sf)
    return reconstruction.judged_windows(segs, spectral.segment_periodicity(segs), reconstruction.segment_pairs(segs))


@query("""WITH r AS (SELECT quality AS truth, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS guess FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE truth = 1 AND guess = 1) AS tp, count(*) FILTER (WHERE truth <> 1 AND guess = 1) AS fp, count(*) FILTER (WHERE truth <> 1 AND guess <> 1) AS tn, count(*) FILTER (WHERE truth = 1 AND guess <> 1) AS fn FROM r),
m AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
  (CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END + CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0.0 END) / 2 AS balanced_accuracy FROM c)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m""")
def label_confusion(spark: SparkSession, sf: str) -> DataFrame:
    d = views.table(spark, sf, "documents").select("doc_id", "n_chars").join(views.table(spark, sf, "labels"), "doc_id")
    return verdicts.confusion(d.select(F.col("quality").alias("truth"), F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("guess")), "truth", "guess")


@query("""WITH r AS (SELECT event_type, value AS truth, CASE WHEN event_id % 7 = 0 THEN NULL ELSE lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS guess FROM events)
SELECT event_type, count(*) AS n, avg(CASE WHEN guess IS NULL THEN 0.0::DOUBLE ELSE 1.0 END) AS coverage, round(avg(abs(guess - truth)), 9) AS mae, quantile_cont(abs(guess - truth), 0.5) AS median_abs_error, round(avg(guess - truth), 9) AS bias FROM r GROUP BY 1""")
def paired_errors(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events")
    guess = F.when(F.col("event_id") % 7 != 0, F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    out = verdicts.paired_errors(e.select("event_type", F.col("value").alias("truth"), guess.alias("guess")), "truth", "guess", ["event_type"])
    return out.withColumn("mae", F.round("mae", 9)).withColumn("bias", F.round("bias", 9))


TYPES_SQL = "CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' ELSE lower(t) END"


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    return stored(audit.with_status(audit.unpivot(views.sessions(spark, sf))), "cells")  # read several times


@query(f"""WITH {views.SESSIONS_SQL} SELECT col AS "column", path, {TYPES_SQL} AS type, count(*) AS n FROM nodes WHERE path <> '' GROUP BY 1, 2, 3""")
def key_paths(spark: SparkSession, sf: str) -> DataFrame:
    return walk.key_paths(audit.json_nodes(_audited(spark, sf)), ["column"])


@query(f"""WITH {views.SESSIONS_SQL} SELECT col AS "column", count(*) AS arrays, CAST(min(len) AS BIGINT) AS shortest, CAST(max(len) AS BIGINT) AS longest, avg(len) AS mean_length, CAST(sum(len) AS BIGINT) AS total_length,
  CAST(sum(least(len, 50)) AS BIGINT) AS inspected, CAST(sum(samples) AS BIGINT) AS samples FROM nodes WHERE len IS NOT NULL GROUP BY 1""")
def array_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return walk.array_stats(audit.json_nodes(_audited(spark, sf)), ["column"])


MODALITY_SQL = f"""WITH {views.SESSIONS_SQL},
m AS (SELECT unnest(['ppg', 'accelerometer', 'heart_rate', 'hrv', 'spo2', 'ecg', 'temperature', 'sleep', 'activity', 'blood_pressure', 'glucose']) AS modality),
total AS (SELECT session, col, sum(samples) AS s FROM nodes GROUP BY 1, 2),
hits AS (SELECT DISTINCT session, col, CASE WHEN path LIKE 'ppg%' THEN 'ppg' WHEN path LIKE 'heart_rate%' THEN 'heart_rate' ELSE 'accelerometer' END AS modality FROM nodes WHERE path LIKE 'ppg%' OR path LIKE 'heart_rate%' OR path LIKE '%acc%'),
h AS (SELECT session, modality, sum(s) AS s FROM hits JOIN total USING (session, col) GROUP BY 1, 2),
st AS (SELECT s.session, m.modality, CASE
    WHEN m.modality = 'ppg' AND h.session IS NULL THEN CASE WHEN ppg_json = '{{bad' THEN 'payload_malformed' ELSE 'payload_empty' END
    WHEN h.session IS NULL THEN 'column_absent' WHEN h.s > 0 THEN 'samples_present' ELSE 'structure_present_no_samples' END AS status
  FROM sessions s CROSS JOIN m LEFT JOIN h ON h.session = s.session AND h.modality = m.modality)"""


@query(MODALITY_SQL + " SELECT session, modality, status FROM st")
def modality_status(spark: SparkSession, sf: str) -> DataFrame:
    return audit.modality_statuses(_audited(spark, sf))


@query(MODALITY_SQL + """, k AS (SELECT unnest(['column_absent', 'payload_empty', 'payload_malformed', 'samples_present', 'structure_present_no_samples', 'not_evaluable']) AS status)
SELECT m.modality, k.status, count(st.session) AS n FROM m CROSS JOIN k LEFT JOIN st ON st.modality = m.modality AND st.status = k.status GROUP BY 1, 2""")
def modality_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return audit.modality_coverage(audit.modality_statuses(_audited(spark, sf)))


FINDINGS_SQL = f"""WITH {views.SESSIONS_SQL},
n AS (SELECT *, CAST(chunks_sent AS DOUBLE) AS sent, CASE WHEN chunks_total <> '' THEN 9.0::DOUBLE END AS total, TRY_CAST(upload_pending AS DOUBLE) AS pending, CAST(duration_s AS DOUBLE) AS dur,
  CASE WHEN chunks_total = '' AND motion_json LIKE '{{%' THEN CAST(json_extract_string(motion_json, '$.failed') AS DOUBLE) END AS failed,
  CASE WHEN ppg_json LIKE '{{"t%' THEN abs(CAST(json_extract(ppg_json, '$.time_ms[1]') AS DOUBLE)) / 1000 END AS span FROM sessions)
SELECT session, 'invalid_json' AS code, 'ppg_json' AS "column", 'invalid_json' AS detail FROM n WHERE ppg_json = '{{bad'
UNION ALL SELECT session, 'empty_physiology', 'ppg_json', 'empty_physiology' FROM n WHERE ppg_json IN ('', '[]')
UNION ALL SELECT session, 'pending_upload', 'upload_pending', 'pending_upload' FROM n WHERE upload_pending = 'yes'
UNION ALL SELECT session, 'pending_upload', 'upload_pending', 'pending_upload' FROM n WHERE pending > 0
UNION ALL SELECT session, 'chunk_mismatch', 'chunks_sent', 'sent_gt_total' FROM n WHERE sent > total
UNION ALL SELECT session, 'chunk_mismatch', 'failed', 'failed_gt_total' FROM n WHERE failed > total
UNION ALL SELECT session, 'chunk_mismatch', 'chunks_total', 'sent_plus_failed_gt_total' FROM n WHERE sent + failed > total + 1e-9
UNION ALL SELECT session, 'duration_not_evaluable', CASE WHEN dur IS NOT NULL THEN 'duration_s' END, 'duration_not_evaluable' FROM n WHERE (dur IS NULL OR span IS NULL) AND (dur IS NOT NULL OR span IS NOT NULL)
UNION ALL SELECT session, 'duration_mismatch', 'duration_s', 'duration_mismatch' FROM n WHERE dur > 0 AND abs(span - dur) > 0.25 * dur"""


@query(FINDINGS_SQL)
def session_findings(spark: SparkSession, sf: str) -> DataFrame:
    return audit.findings(_audited(spark, sf))


@query()
def decoder_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """All 192 candidates with eight costs, rank and status; tested against brute force, as ties of doubles decide ranks."""
    return candidates.statuses(candidates.ranked(candidates.metrics(views.payloads(spark, sf))))


@query(f"""WITH {views.PAYLOADS_SQL},
h(hypothesis, variant, c, meta) AS (VALUES ('H_2x33', 'default', 2, []::INT[]), ('H_2x32_plus_2global', 'endpoints', 2, [0, 63]), ('H_2block_meta_per_ch', 'last_of_block', 2, [31, 63]), ('H_3x22', 'default', 3, []::INT[])),
k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ordinal) - 1 AS place FROM payloads WHERE len(payload) = 64),
w AS (SELECT session, ordinal, place, hypothesis, variant, c, 64 - len(meta) AS n, p, payload[p + 1] AS x, p - len(list_filter(meta, lambda m: m < p)) AS i
  FROM k CROSS JOIN h CROSS JOIN range(64) AS r(p) WHERE NOT list_contains(meta, p)),
ch AS (SELECT *, CASE layout WHEN 'INTERLEAVED_PACKET_LOCAL' THEN i % c WHEN 'INTERLEAVED_CONTINUOUS' THEN (place * n + i) % c
    ELSE CASE WHEN i < n // c * c THEN i // (n // c) WHEN layout = 'BLOCKED_PACKET_LOCAL' THEN (i - n // c * c) % c ELSE (place * (n % c) + i - n // c * c) % c END END AS channel
  FROM w CROSS JOIN (SELECT unnest(['INTERLEAVED_PACKET_LOCAL', 'INTERLEAVED_CONTINUOUS', 'BLOCKED_PACKET_LOCAL', 'BLOCKED_CONTINUOUS']) AS layout))
SELECT session, hypothesis, variant, layout, CAST(channel AS BIGINT) AS channel, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, CAST(sum(x * (ordinal * 64 + i)) AS BIGINT) AS placed FROM ch GROUP BY ALL""")
def reconstructed_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Words, their sum, and their sum weighted by place, for each channel of the grid of four hypotheses and four layouts."""
    rows = reconstruction.channels(views.payloads(spark, sf), reconstruction.hypotheses(spark, 64, primary=True), 64)
    return rows.groupBy("session", "hypothesis", "variant", "layout", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * (F.col("ordinal") * 64 + F.col("i"))).alias("placed"))


@query(f"SELECT code, count(*) AS n FROM ({FINDINGS_SQL}) GROUP BY code")
def finding_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.counts_by_code(audit.findings(_audited(spark, sf)))
