"""Scrubbing of texts, and scans for what may not be shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: shapes that are scrubbed, in this order, and phrases that no report may hold
SCRUBBED = [
    ("<redacted_mac>", "\\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\\b"),
    ("<redacted_uuid>", "\\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\\b"),
    ("<redacted_timestamp>", "\\b\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?(?:Z|[+-]\\d{2}:?\\d{2})?\\b"),
]
PHRASES = [
    "diagnosed", "patient risk", "detected disease", "confirmed PPG", "confirmed ppg", "accurate heart rate", "clinical-grade", "clinical grade", "medical alert", "normal patient", "abnormal patient",
    "validated PPG", "validated ppg", "this is heart rate", "HRV computed", "SpO2 computed", "blood pressure estimate", "disease-risk",
]
LEAKS = [("exact_timestamp", SCRUBBED[2][1]), ("mac_address", SCRUBBED[0][1])]


def scrub(text: Column, literals: dict[str, str] | None = None) -> Column:
    """``text`` without the literals (the longest first), then without addresses, ids and times."""
    out = text
    for literal in sorted(literals or {}, key=lambda x: (-len(x), x)):
        out = F.replace(out, F.lit(literal), F.lit((literals or {})[literal]))
    for name, pattern in SCRUBBED:
        out = F.regexp_replace(out, pattern, name)
    return out


def leaks(text: Column) -> Column:
    """exact_timestamp and mac_address, as far as ``text`` holds one."""
    return F.filter(F.array(*[F.when(F.regexp_like(text, F.lit(p)), F.lit(n)) for n, p in LEAKS]), lambda x: x.isNotNull())


def forbidden(text: Column) -> Column:
    """The phrases that ``text`` holds in any case, as they are listed."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(p.lower())), F.lit(p)) for p in PHRASES]), lambda x: x.isNotNull())
