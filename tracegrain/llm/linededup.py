"""Line dedup: winnowed line hashes, joined positions, matches extended both ways, later repeated runs deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hof import WORD, let
from .state import save

MIN_WORDS = 50


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line that has a word: _uid, _order, pos (among such lines), at (among all), h, w."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w"))), lambda x: x["w"] > 0)
    return docs.select("_uid", F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("_order"), lines.alias("lines"))


def postings(lines: DataFrame, min_words: int) -> DataFrame:
    """The selected positions of each text, winnowed: a window is the least run of lines with ``min_words`` words from a
    line on, and its fingerprint the least line hash in it, of equal ones the rightmost. Neighbouring windows mostly
    select the same line, so a text has far fewer postings than lines.

    A repeated run of ``min_words`` words holds a whole window wherever it stands, so both copies select its line: no
    such run is lost. ``wins`` are the windows that chose the line: their first line, number of lines, and a hash of all.
    A line's place is the number of words before it, so a range of ``min_words`` places holds just the lines needed.
    """
    rows = lines.select("_uid", "_order", F.posexplode("lines").alias("pos", "x")).select("_uid", "_order", "pos", "x.*")
    before = Window.partitionBy("_uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_p", F.coalesce(F.sum("w").over(before), F.lit(0)).cast("long"))
    ahead = Window.partitionBy("_uid").orderBy("_p").rangeBetween(0, min_words - 1)
    least = F.min(F.struct(F.col("h"), (-F.col("pos")).alias("at"))).over(ahead)
    seen = placed.select("_uid", "_order", "pos", least.alias("_least"), F.xxhash64(F.collect_list("h").over(ahead)).alias("key"), F.count("*").over(ahead).cast("int").alias("n"), F.sum("w").over(ahead).alias("_w"))
    whole = seen.where(F.col("_w") >= min_words)
    return whole.groupBy("_uid", "_order", "_least").agg(F.collect_list(F.struct("pos", "n", "key")).alias("wins")).select("_uid", "_order", F.col("_least.h").alias("fingerprint"), "wins")


def _met(posted: DataFrame) -> DataFrame:
    """Windows that stood before: _uid, pos, n, and ``_first``, the place where the same window stands first.

    Postings are joined on the fingerprint; most fingerprints have one posting and go at once. A line that very many
    texts share is a hot fingerprint: its postings meet the first window of the same lines, not each other.
    """
    shared = posted.groupBy("fingerprint").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("fingerprint")
    wins = posted.join(shared, "fingerprint", "left_semi").select("fingerprint", "_uid", "_order", F.inline("wins"))
    wins = save(wins, "windows")
    place = F.struct(F.col("_order"), F.col("_uid"), F.col("pos"))
    first = wins.groupBy("fingerprint", "key").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    return wins.join(first, ["fingerprint", "key"]).where(place > F.col("_first"))


def _runs(found: DataFrame) -> DataFrame:
    """Windows matched along one diagonal, merged to runs: _uid, _uid2, shift, s, e (positions, end inclusive)."""
    diagonal = Window.partitionBy("_uid", "_uid2", "shift").orderBy("s")
    reach = F.max("e").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("_new", F.when(F.col("s") <= reach + 1, 0).otherwise(1))
    numbered = marked.withColumn("_run", F.sum("_new").over(diagonal))
    return numbered.groupBy("_uid", "_uid2", "shift", "_run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_run")


def _equal_steps(a: Column, b: Column, a_at: Column, b_at: Column, step: int, most: Column) -> Column:
    """How many lines beyond (a_at, b_at) are equal in both, in one direction."""
    ks = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ks, F.lit(0), lambda n, k: F.when((n == k - 1) & (F.get(a, a_at + k * step) == F.get(b, b_at + k * step)), k).otherwise(n))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """For rows of ``docs`` (_uid, doc_id, text): _uid and ``runs``, the disjoint ascending runs of lines (s, e inclusive)
    that came before.

    Earlier means a smaller doc_id (null last), then a smaller _uid, then an earlier line of the same text.
    """
    lines = save(_lines(docs), "lines")
    met = _met(save(postings(lines, min_words), "postings"))
    found = met.select("_uid", F.col("_first._uid").alias("_uid2"), (F.col("pos") - F.col("_first.pos")).alias("shift"), F.col("pos").alias("s"), (F.col("pos") + F.col("n") - 1).cast("int").alias("e"))
    runs = _runs(found)
    own = lines.select("_uid", F.transform("lines", lambda x: x["h"]).alias("_a"), F.transform("lines", lambda x: x["at"]).alias("_at"))
    other = lines.select(F.col("_uid").alias("_uid2"), F.transform("lines", lambda x: x["h"]).alias("_b"))
    sides = runs.join(own, "_uid").join(other, "_uid2")
    # a side with min_words equal words would hold a window of its own, so no side has more lines than that
    s2, e2 = F.col("s") - F.col("shift"), F.col("e") - F.col("shift")
    left = _equal_steps(F.col("_a"), F.col("_b"), F.col("s"), s2, -1, F.least(F.col("s"), s2, F.lit(min_words)))
    right = _equal_steps(F.col("_a"), F.col("_b"), F.col("e"), e2, 1, F.least(F.size("_a") - 1 - F.col("e"), F.size("_b") - 1 - e2, F.lit(min_words)))
    grown = sides.select("_uid", F.get("_at", F.col("s") - left).alias("s"), F.get("_at", F.col("e") + right).alias("e"))
    whole = Window.partitionBy("_uid").orderBy("s", "e")
    reach = F.max("e").over(whole.rowsBetween(Window.unboundedPreceding, -1))
    numbered = grown.withColumn("_new", F.when(F.col("s") <= reach + 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(whole))
    apart = numbered.groupBy("_uid", "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return apart.groupBy("_uid").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs"))


def _without(lines: Column, runs: Column) -> Column:
    """``lines`` without the disjoint ascending ``runs``: the stretches between them, each copied once."""

    def stretch(i: Column) -> Column:
        begin = F.coalesce(F.get(runs, i - 1)["e"] + 1, F.lit(0))
        return F.slice(lines, begin + 1, F.coalesce(F.get(runs, i)["s"], F.size(lines)) - begin)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), stretch))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, removed: str | None = "_removed") -> DataFrame:
    """``docs`` with every later run of lines, of at least ``min_words`` words, taken out of ``text``, and the number of
    lines taken as ``removed`` (None: no such column; a column of ``docs`` with that name is an error).

    All rows and columns stay; a text that is wholly a repeat becomes empty. Null text stays null. Lines without a word
    are skipped in matching and go with the run around them. Shorter repeats stay. Repeated rows: the later ones count
    as repeats. Ties: of rows with one doc_id, the one read first stays. An empty table gives an empty one. Results are
    whole: hot lines are neither capped nor dropped.
    """
    if removed in docs.columns:
        raise ValueError(f"the documents have a column {removed} already: name another")
    marked = save(docs.select(F.monotonically_increasing_id().alias("_uid"), F.struct(*docs.columns).alias("_doc")), "linededup-in")
    runs = repeated_runs(marked.select("_uid", F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_doc.text").alias("text")), min_words)
    joined = marked.join(runs, "_uid", "left")
    left = let(F.split("_doc.text", "\n", -1), lambda lines: _without(lines, F.col("runs")))
    text = F.when(F.col("runs").isNull(), F.col("_doc.text")).otherwise(F.array_join(left, "\n"))
    columns = [text.alias("text") if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns]
    n = F.when(F.col("runs").isNull(), 0).otherwise(F.aggregate("runs", F.lit(0), lambda t, v: t + v["e"] - v["s"] + 1))
    return joined.select(*columns, *([n.cast("long").alias(removed)] if removed else []))


def deduped_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the text left, and how many lines went, for every document; null text stays null with no line taken, and
    an empty table gives an empty one."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_removed").alias("n_removed"), (F.col("_removed") > 0).alias("changed"))
