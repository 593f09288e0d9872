"""What a report shows: scans for what it may not hold, values that are missing, and counts, shares and labels as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions import privacy

from .verdicts import named

NOT_AVAILABLE = "NOT_AVAILABLE"
# fixed values: what looks like a path or names a person, statuses that say there is no sample, and the kind of sources
PATH = "(?i)(?:[A-Za-z]:\\\\|/home/|/Users/|\\\\\\\\|reports[/\\\\]private|/tmp/)"
IDENTIFYING = "(?i)session[_-]?id|device[_-]?id|patient"
NO_SAMPLES = ["column_absent", "payload_empty", "structure_present_no_samples"]
REVIEWED, DEMO = "reviewed_project", "synthetic_demo"


def export_findings(document: Column) -> Column:
    """What is wrong with a JSON document that is to be shown: shapes that tell times or addresses, paths, keys that identify
    (at any depth), forbidden phrases. Empty if nothing is."""
    keys = F.regexp_extract_all(document, F.lit('"((?:[^"\\\\]|\\\\.)*)"\\s*:'), F.lit(1))
    bad_keys = F.exists(keys, lambda k: F.regexp_like(k, F.lit(IDENTIFYING)))
    leaks = F.transform(privacy.leaks(document), lambda x: F.concat(F.lit("leak:"), x))
    phrases = F.transform(privacy.forbidden(document), lambda x: F.concat(F.lit("phrase:"), x))
    return F.concat(leaks, named((F.regexp_like(document, F.lit(PATH)), "path"), (bad_keys, "identifying_key")), phrases)


def allowed(document: Column, schema: str) -> Column:
    """``document`` (JSON) with the fields of ``schema`` alone, at every depth; null if it isn't an object."""
    return F.to_json(F.from_json(document, schema), {"ignoreNullFields": "true"})


def is_available(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.coalesce((text != "") & (text != NOT_AVAILABLE), F.lit(False))


def present_or_na(value: Column) -> Column:
    return F.when(is_available(value), value.cast("string")).otherwise(NOT_AVAILABLE)


def missing_fields(**fields: Column) -> Column:
    """The names of the fields that are null or blank, in the order given."""
    return named(*[(~is_available(c), name) for name, c in fields.items()])


def missing_warning(missing: Column) -> Column:
    return F.when(F.size(missing) > 0, F.concat(F.lit("Missing source fields; exported NOT_AVAILABLE: "), F.array_join(missing, ", ")))


def fmt_int(value: Column) -> Column:
    return F.when(is_available(value), F.format_number(value.cast("bigint"), 0)).otherwise(NOT_AVAILABLE)


def fmt_number(value: Column, decimals: int = 4, unit: str = "") -> Column:
    return F.when(is_available(value), F.format_string(f"%.{decimals}f{unit.replace('%', '%%')}", value.cast("double"))).otherwise(NOT_AVAILABLE)


def fmt_duration(ms: Column) -> Column:
    """Seconds from one second on, else milliseconds."""
    v = ms.cast("double")
    return F.when(~is_available(ms), NOT_AVAILABLE).when(F.abs(v) >= 1000.0, F.format_string("%.1f s", v / 1000.0)).otherwise(F.format_string("%.0f ms", v))


def fmt_share(count: Column, total: Column, decimals: int = 1) -> Column:
    share = 100.0 * count / F.greatest(total, F.lit(1))
    return F.when(total <= 0, F.format_string("%d (NOT_AVAILABLE)", count)).otherwise(F.format_string(f"%d/%d = %.{decimals}f%%", count, total, share))


def session_label(ordinal: Column) -> Column:
    return F.format_string("Session %03d", ordinal)


def label_of(code: Column, labels: dict[str, str], plain: bool = True) -> Column:
    """The label of a code; an unknown one is shown as it is, or with spaces for underscores."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(known, code), code if plain else F.replace(code, F.lit("_"), F.lit(" ")))


def margin(scores: DataFrame, by: list[str], name: str, score: str) -> DataFrame:
    """Per group the two highest scores' names and their distance, to 4 digits; null with under two. Of equal scores the
    lesser name is first. Only two rows a group are kept while it is aggregated."""
    best = F.max_by(F.struct(F.col(name).alias("n"), F.col(score).alias("s")), F.struct(F.col(score), F.col("_tie")))
    ranked = scores.where(F.col(score).isNotNull()).withColumn("_tie", -F.col("_place")) if "_place" in scores.columns else scores.where(F.col(score).isNotNull()).withColumn("_tie", F.lit(0))
    first = ranked.groupBy(*by).agg(best.alias("a"), F.count("*").alias("_n"))
    rest = ranked.join(first, by).where(F.col(name) != F.col("a.n")).groupBy(*by).agg(best.alias("b"))
    two = F.col("b").isNotNull()
    return first.join(rest, by, "left").select(*by, F.when(two, F.col("a.n")).alias("top"), F.when(two, F.col("b.n")).alias("second"), F.when(two, F.round(F.col("a.s") - F.col("b.s"), 4)).alias("margin"))


def modality_table(coverage: DataFrame) -> DataFrame:
    """From counts (modality, status, n): sessions with samples and without, and how many samples-present sessions are told:
    their count if there is one; else 0 if statuses that mean no sample cover all sessions; else unknown (null)."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    status = F.col("status")
    with_samples = F.sum(F.when(status == "samples_present", F.col("n")))
    other = n(~status.isin(NO_SAMPLES) & (status != "samples_present"))
    told = F.coalesce(with_samples, F.when((other == 0) & (n(status.isin(NO_SAMPLES)) == F.max("sessions")), F.lit(0)))
    return coverage.groupBy("modality").agg(F.coalesce(with_samples, F.lit(0)).alias("with_samples"), n(status != "samples_present").alias("without"), told.alias("samples_told"))


def sources_agree(kinds: DataFrame, by: list[str]) -> DataFrame:
    """Per group whether its parts (kind, null where none is said) may go into one report, and why not."""
    seen = kinds.groupBy(*by).agg(F.sort_array(F.collect_set("kind")).alias("kinds"))  # kinds are a handful of names
    k = F.col("kinds")
    why = F.when(F.array_contains(k, DEMO), "demo_aggregates").when(F.size(k) > 1, "mixed_kinds").when((F.size(k) == 1) & ~F.array_contains(k, REVIEWED), "unsupported_kind")
    return seen.withColumn("refused", why)


def selection_notes(statuses: DataFrame) -> DataFrame:
    """One row from decoder statuses: the first candidate, its status and the notes on it; ``no_candidates`` for none."""
    best = statuses.where(F.col("rank") == 1).agg(F.first(F.struct(F.concat_ws("|", "signedness", "byte_order", F.concat(F.lit("C"), "channel_count"), "layout").alias("id"), "status", "codes")).alias("b"))
    some = F.col("b").isNotNull()
    notes = F.when(some, F.concat(F.array(F.concat(F.lit("selected_rank1="), "b.id"), F.concat(F.lit("status="), "b.status"), F.lit("phase2_does_not_validate_physiological_ppg")), F.col("b.codes"))).otherwise(F.array(F.lit("no_candidates")))
    return best.select(F.col("b.id").alias("selected"), F.coalesce("b.status", F.lit("UNVERIFIED")).alias("status"), notes.alias("notes"))


def overview(totals: DataFrame) -> DataFrame:
    """One row of totals as rows (metric, shown): a total that is null is NOT_AVAILABLE, never 0."""
    each = F.array(*[F.struct(F.lit(c).alias("metric"), present_or_na(F.col(c)).alias("shown")) for c in totals.columns])
    return totals.select(F.inline(each))


def status_cards(row: DataFrame, **fields: str) -> DataFrame:
    """The statuses of a research summary as cards (title, status); what is missing is NOT_AVAILABLE, no status is made up."""
    each = F.array(*[F.struct(F.lit(title.replace("_", " ")).alias("title"), present_or_na(F.col(c)).alias("status")) for title, c in fields.items()])
    return row.select(*[c for c in row.columns if c not in fields.values()], F.inline(each))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank`` from 1. Spark limits each partition's groups to k rows before it
    shuffles them and once more after, so a group brings at most k rows a partition to its task; ties go as ``order`` says."""
    place = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def session_frame(summaries: DataFrame) -> DataFrame:
    """Packets and gaps of each session under its label (session: its number)."""
    return summaries.select(session_label(F.col("session")).alias("session"), "packet_count", "gap_count")


def hypothesis_frame(rollup: DataFrame) -> DataFrame:
    """A spectral roll-up's scores under the names that a report has for them."""
    return rollup.select("layout", "hypothesis", F.col("mean_band_power_ratio").alias("band_ratio"), "usable_fraction", F.col("cv").alias("frequency_cv"))


def periodicity_frame(periodicity: DataFrame) -> DataFrame:
    """Segments that are plausibly periodic, weakly so, and those that can't be evaluated (kind, n); NOT_AVAILABLE where there
    are no segments at all."""
    barred = F.exists("reasons", lambda r: r.isin("segment_too_short", "segment_duration_short", "flatline_segment"))
    kinds = {"plausible": F.col("usable") & ~barred, "weak": ~F.col("usable") & ~barred, "non_evaluable": barred}
    counts = periodicity.agg(F.count("*").alias("_all"), *[F.count_if(c).alias(k) for k, c in kinds.items()])
    shown = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(F.col("_all") > 0, F.col(k).cast("string")).otherwise(NOT_AVAILABLE).alias("n")) for k in kinds])
    return counts.select(F.inline(shown))


# fixed values: the version of safe rows, and where an older report of each phase has their columns, if it has them
SAFE_VERSION = "dashboard.safe.v1"
LEGACY = {
    1: {"row_count": "meta.row_count", "column_count": "meta.column_count", "modality_coverage": "modality_coverage", "inconsistency_counts": "inconsistency_counts", "upload_completion_count": None, "privacy_posture": "privacy_posture"},
    2: {"session_count": "meta.session_count", "packet_count": "meta.packet_count", "malformed_packet_count": None, "candidate_count": "meta.candidate_count", "nominal_payload_length": "nominal_payload_length", "datatype_mode": "datatype_mode", "decoder_status": "selected_status", "top_decoder_family": None, "total_gap_count": None, "max_gap_ms": None, "gap_threshold_ms": "meta.gap_threshold_ms", "privacy_posture": "privacy_posture"},
    3: {"verdict": "channel_compatibility.verdict", "frequency_agreeing": "channel_compatibility.frequency_agreeing_pairs", "frequency_evaluable": "channel_compatibility.frequency_evaluable_pairs", "frequency_agreement_fraction": "channel_compatibility.frequency_agreement_fraction", "median_zero_lag_correlation": "channel_compatibility.median_abs_zero_lag_correlation", "median_max_lagged_correlation": "channel_compatibility.median_max_abs_lagged_correlation", "median_coherence": "channel_compatibility.median_coherence", "median_best_lag_samples": "channel_compatibility.median_best_lag_samples", "rate_status": "rate_status"},
}


def from_legacy(rows: DataFrame, phase: int) -> DataFrame:
    """Rows of an older report of ``phase`` 1, 2 or 3 as safe rows. What the older form doesn't have is null, never 0; pending
    uploads of phase 1 are null unless some are counted."""
    columns = [(F.lit(None).cast("long") if src is None else F.col(src)).alias(name) for name, src in LEGACY[phase].items()]
    if phase == 1:
        pending = F.col("inconsistency_counts")["pending_upload"]
        columns.append(F.when(pending > 0, pending).alias("upload_pending_count"))
    return rows.select(F.lit(SAFE_VERSION).alias("schema_version"), *columns)
