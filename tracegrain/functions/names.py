"""Column and key names: tokens, modalities, time units, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: modalities with their needles, time fields, unit hints
MODALITIES = {
    "ppg": ("ppg", "photoplethysmography", "photoplethysmogram"),
    "accelerometer": ("accelerometer", "accel", "acc", "imu"),
    "heart_rate": ("heart_rate", "heartRate", "hr", "bpm"),
    "hrv": ("hrv", "heart_rate_variability", "rmssd", "sdnn"),
    "spo2": ("spo2", "sp_o2", "oxygen_saturation", "o2sat"),
    "ecg": ("ecg", "ekg", "electrocardiogram"),
    "temperature": ("temperature", "temp", "skin_temp"),
    "sleep": ("sleep", "sleep_stage", "sleepStage"),
    "activity": ("activity", "steps", "calories"),
    "blood_pressure": ("blood_pressure", "bloodPressure", "bp", "systolic", "diastolic"),
    "glucose": ("glucose", "cgm", "blood_glucose", "ibg"),
}
# fixed values: shapes of keys that may not be shown
SENSITIVE = [
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$",
    "^[0-9]+([.][0-9]+)?$",
    "(?i)^(patient|protocol|device|mac|consent|user|email|phone|ssn|mrn)(_|$)|(patient_name|protocol_number|device_mac|consent_image)",
    "^[0-9A-Fa-f]{16,}$",
]
DYNAMIC = "<dynamic_key>"


def tokens(name: Column) -> Column:
    """Lower-case tokens: parts between separators; short capital parts stay whole, others split at case and digits."""
    parts = F.filter(F.split(name, "[_\\-.\\s/]+"), lambda p: p != "")

    def one(p: Column) -> Column:
        short = (F.length(p) <= 5) & (F.upper(p) == p) & F.regexp_like(p, F.lit("[A-Z]"))
        pieces = F.transform(F.regexp_extract_all(p, F.lit("[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"), F.lit(0)), F.lower)
        return F.when(short | (F.size(pieces) == 0), F.array(F.lower(p))).otherwise(pieces)

    return F.flatten(F.transform(parts, one))


def tokens_match(have: Column, needle: Column) -> Column:
    """Whether ``needle`` is a run of ``have``."""
    starts = F.sequence(F.lit(1), F.size(have) - F.size(needle) + 1)
    return (F.size(needle) > 0) & (F.size(have) >= F.size(needle)) & F.exists(F.when(F.size(have) >= F.size(needle), starts).otherwise(F.array(F.lit(1))), lambda i: F.slice(have, i, F.size(needle)) == needle)


def _any_of(have: Column, needles: tuple[str, ...]) -> Column:
    return F.exists(F.transform(F.array(*[F.lit(n) for n in needles]), tokens), lambda n: tokens_match(have, n))


def matches_any(name: Column, needles: tuple[str, ...]) -> Column:
    return F.exists(F.array(tokens(name)), lambda have: _any_of(have, needles))


def modalities(name: Column) -> Column:
    """The sorted modalities whose needles the name holds."""
    found = lambda have: F.filter(F.array(*[F.when(_any_of(have, MODALITIES[k]), F.lit(k)) for k in sorted(MODALITIES)]), lambda x: x.isNotNull())
    return F.transform(F.array(tokens(name)), found)[0]


def is_sensitive(key: Column) -> Column:
    hit = (F.length(key) >= 24) & ~F.regexp_like(key, F.lit("[_.-]"))
    for pattern in SENSITIVE:
        hit = hit | F.regexp_like(key, F.lit(pattern))
    return hit


def redact(key: Column) -> Column:
    return F.when(is_sensitive(key), F.lit(DYNAMIC)).otherwise(key)


# fixed values: names of times, and the units that such names tell
TIME_FIELDS = ("timestamp", "timestamps", "time", "datetime", "date_time", "ts", "recorded_at", "sampled_at", "created_at", "updated_at", "start_time", "end_time", "time_ms", "time_s", "time_us", "epoch_ms", "epoch_s")
UNIT_HINTS = {"time_ms": "ms", "epoch_ms": "ms", "time_us": "us", "time_s": "s", "epoch_s": "s", "timestamp_ms": "ms", "timestamp_s": "s"}
UNIT_WORDS = {"ms": ("ms", "milliseconds"), "us": ("us", "microseconds"), "s": ("s", "sec", "seconds")}
UNIT_SECONDS = {"s": 1.0, "ms": 1e-3, "us": 1e-6}


def is_time_field(name: Column) -> Column:
    return matches_any(name, TIME_FIELDS)


def time_unit(name: Column) -> Column:
    """ms, us or s where the name tells it: by a known run of tokens, else by the last token; else null."""
    last = F.try_element_at(tokens(name), F.lit(-1))
    out = F.when(F.lit(False), F.lit("s"))
    for needle, unit in UNIT_HINTS.items():
        out = out.when(matches_any(name, (needle,)), unit)
    for unit, words in UNIT_WORDS.items():
        out = out.when(last.isin(*words), unit)
    return out
