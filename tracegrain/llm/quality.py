"""Quality rules: a short-circuit cascade ordered by what each rule rejects for its cost on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hof import WORD, let, words
from .state import save

SAMPLE, REPEATS, LONGEST = 400, 8, 1 << 18
WINDOW = 3


def _covered(places: Column) -> Column:
    """Words in 3-word windows that start at the sorted ``places``."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(places, start, lambda s, x: F.struct((s["n"] + F.least(F.lit(WINDOW), x - s["last"])).alias("n"), x.alias("last")), lambda s: s["n"])


def _repeated(hashes: Column) -> Column:
    """Of a text's window hashes: the words in windows that occur at least twice. Sorting brings equal windows together."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def dups(s: Column) -> Column:
        twice = F.filter(s, lambda p, k: (F.get(s, k - 1)["h"] == p["h"]) | (F.get(s, k + 1)["h"] == p["h"]))
        return _covered(F.sort_array(F.transform(twice, lambda p: p["i"])))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, dups))


def repeat_words(ws: Column) -> Column:
    n = F.size(ws)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(n < WINDOW, F.lit(0)).otherwise(let(hashes, _repeated))


def base_measures(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; a null text has no words."""
    t = F.coalesce(text, F.lit(""))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words"))
    dups = let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    symbols = F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long")
    return let(let(words(t), of_words), lambda m: F.struct(m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), symbols.alias("n_symbols"), dups.alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words")))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD)))


@dataclass
class Rule:
    """``fails`` takes the text and the base measures (a struct column) and tells whether a document is rejected."""

    name: str
    fails: Callable[[Column, Column], Column]
    cost: float = 0.0
    share: float = 0.0


def base_rules() -> list[Rule]:
    return [Rule("short", lambda t, m: m["n_words"] < 50), Rule("repeats", lambda t, m: 100 * m["n_repeat_words"] > 50 * m["n_words"])]


def default_rules() -> list[Rule]:
    """The method's own rules. Those that look at the text itself cost a pass over it; the others compare measures."""
    return [
        Rule("symbols", lambda t, m: 2 * m["n_symbols"] > m["n_words"]),
        Rule("word length", lambda t, m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
        Rule("lines", lambda t, m: let(F.size(_lines(t)), lambda n: (n >= 4) & (2 * m["n_dup_lines"] > n))),
        Rule("capitals", lambda t, m: 2 * F.regexp_count(t, F.lit("[A-Z]")) > m["word_chars"]),
    ]


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` rows of ``docs`` (text), drawn at random over all partitions, with their base measures; stored.
    Texts of over LONGEST bytes are left out, so it has some megabytes at most. It sets the order of rules alone."""
    n = docs.count()
    some = docs.select(F.coalesce("text", F.lit("")).alias("text")).sample(False, min(1.0, sample / max(1, n)), 11)
    return save(some.where(F.octet_length("text") <= LONGEST).select("text", base_measures(F.col("text")).alias("m")), "quality-sample")


def ordered(docs: DataFrame, rules: list[Rule], sample: int = SAMPLE) -> list[Rule]:
    """The rules by rejection per second on a sample, the best first; the order never changes what is kept.

    A rule's cost is the time of a job that evaluates it REPEATS times on each sampled row, less that of a job which
    reads and repeats the rows only; each is run twice and the quicker run counts, as the first one compiles.
    """
    few = sampled(docs, sample).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    t, m = F.col("text"), F.col("m")

    def timed(failed: Column) -> tuple[float, float]:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            share = few.agg(F.avg(F.coalesce(failed, F.lit(False)).cast("int"))).first()[0]
            took.append(time.perf_counter() - began)
        return min(took), float(share or 0)

    idle, _ = timed(F.length(t) < F.col("_k") - REPEATS)
    for rule in rules:
        took, rule.share = timed(rule.fails(t, m))
        rule.cost = max(took - idle, 1e-3)
    return sorted(rules, key=lambda r: (-r.share / r.cost, r.cost))


def cascade(rules: list[Rule], text: Column, measures: Column, first: Column | None = None) -> Column:
    """Whether a document passes: a rule is evaluated only if those before it (and ``first``) let the document through,
    as CASE looks at its branches in turn. A rule that gives null lets it through."""
    out = F.when(F.lit(False) if first is None else first, False)
    for rule in rules:
        out = out.when(rule.fails(text, measures), False)
    return out.otherwise(True)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias("_doc"), F.coalesce("text", F.lit("")).alias("_t"), base_measures(F.col("text")).alias("_m"))


def _base_failed(m: Column) -> Column:
    short, repeats = (r.fails(None, m) for r in base_rules())
    return short | repeats


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and every one of ``rules``, with all their columns.

    Null and empty texts are short and go. Repeated rows are judged alike, each by itself; rules that tie in rejection
    per cost come the cheaper first, which changes nothing that is kept. An empty table gives an empty one.
    """
    rules = ordered(docs, rules or default_rules(), sample)
    return _measured(docs).where(cascade(rules, F.col("_t"), F.col("_m"), _base_failed(F.col("_m")))).select("_doc.*")


def judge(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Each document's base measures, whether it fails the base rules, and whether the cascade keeps it.

    The base measures are asked for of every row; the cascade's own rules are evaluated only on rows that pass the base
    rules, and each only on rows that the rules before it let through. Null text: no words. Repeated rows each get a
    row; an empty table gives an empty one; other columns of ``docs`` are not looked at.
    """
    rules = ordered(docs, default_rules(), sample)
    m, failed = F.col("_m"), _base_failed(F.col("_m"))
    rows = _measured(docs.select("doc_id", "text"))
    return rows.select("_doc.doc_id", "_m.*", failed.alias("base_failed"), cascade(rules, F.col("_t"), m, failed).alias("kept")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
