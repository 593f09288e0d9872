"""Small helpers over arrays, all of Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
STEP = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def match_spans(text: Column, pattern: str, group: int = 0, least: int = 0, keep: bool = False) -> Column:
    """(s, e) of the leftmost non-overlapping matches in code points, end exclusive, whose ``group`` has ``least``
    characters; with ``keep``, the matched text t too. Pieces between matches and matches are laid end to end, in blocks,
    so that long lists stay cheap."""
    kind = "array<struct<s:int,e:int,t:string>>" if keep else "array<struct<s:int,e:int>>"
    none = F.array().cast(kind)

    def laid(parts: Column) -> Column:
        def block(s: Column, b: Column) -> Column:
            start = F.struct(s["at"].alias("at"), none.alias("out"))

            def one(t: Column, x: Column) -> Column:
                found = F.struct((t["at"] + x["g"]).cast("int").alias("s"), (t["at"] + x["g"] + x["m"]).cast("int").alias("e"), *([x["t"].alias("t")] if keep else []))
                return F.struct((t["at"] + x["g"] + x["m"]).alias("at"), F.when(x["k"] >= least, F.concat(t["out"], F.array(found))).otherwise(t["out"]).alias("out"))

            inner = F.aggregate(F.slice(parts, b * STEP + 1, STEP), start, one)
            return let(inner, lambda v: F.struct(v["at"].alias("at"), F.concat(s["out"], v["out"]).alias("out")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / STEP).cast("int"))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda s: s["out"])

    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    texts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    whole = F.transform(texts, lambda m: F.length(m))
    key = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m)) if group else whole
    columns = {"g": F.slice(gaps, 1, F.size(whole)), "m": whole, "k": key} | ({"t": texts} if keep else {})
    zipped = F.arrays_zip(*[c.alias(k) for k, c in columns.items()])
    parts = F.transform(zipped, lambda z: F.struct(*[z[k].alias(k) for k in columns]))
    return F.when(F.regexp_like(text, F.lit(pattern)), let(parts, laid)).otherwise(none)
