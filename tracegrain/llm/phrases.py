"""Collocations by multikey three-way quicksort of suffix pointers, after suffixes were routed by their leading words.

A suffix is a word and up to DEPTH - 1 words after it in its piece. Its words are 64-bit hashes; two words of one hash are
an error, so counts are exact. What can't be frequent is left out early: leading pairs are counted by 32 bits of a hash
beside their route (which can only keep too many), and a suffix ends before the first pair that isn't frequent.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import map_array, new_path, save, store_array
from .tokens import slices
from .wordhash import mix, texts_at, word_places

DEPTH, LEAST, TOP, COVERED, SCALE = 4, 30, 2000, 80, 2_000_000
#: Words that a route of pairs stands for, about; a leading pair that holds an eighth of that is hot: dealt by all its words.
ROUTED = 1 << 22
SLICE = 8 << 20
PARTS = np.zeros(256, dtype=bool)
PARTS[[9, 32, *range(10, 14), *b".,;:!?"]] = True
ENDS = PARTS.copy()
ENDS[[9, 32]] = False
WORDS = [f"w{i}" for i in range(1, DEPTH + 1)]
_mapped = functools.lru_cache(maxsize=4096)(map_array)


def _scanned(batches: Iterator[pa.RecordBatch]):
    """(lang, bytes, hashes, starts, ends, whether the next word follows in the same piece) of runs of one language's texts."""
    for batch in batches:
        for some in slices(batch, 1, SLICE):
            langs = some.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = some.column(1).filter(pa.compute.equal(langs.indices, k)).to_pylist()
                data, hashes, starts, ends, _ = word_places(texts, PARTS)
                if len(hashes):
                    cut = np.concatenate([[0], np.cumsum(ENDS[data], dtype=np.int32)])
                    yield lang, data, hashes, starts, ends, np.append(cut[starts[1:]] == cut[ends[:-1]], False)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    differs = np.zeros(len(columns[0]), bool)
    differs[:1] = True
    for c in columns:
        differs[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(differs)


def _pair_hash(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    salt = mix(np.array([zlib.crc32(lang.encode())], np.uint64))
    return mix(first * np.uint64(0xD6E8FEB86659FD93) + mix(second ^ salt))


def _routed(hashes: np.ndarray, routes: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(routes)).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, hash, word, n) over all texts; a run's words are summed up before they are shuffled."""
    schema = pa.schema([("lang", pa.string()), ("hash", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, hashes, starts, ends, _ in _scanned(batches):
            own, first, n = np.unique(hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64)), texts_at(data, starts[first], ends[first]), pa.array(n.astype(np.int64))], schema=schema)

    each = texts.mapInArrow(count, "lang string, hash long, word string, n long").groupBy("lang", "hash").agg(F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("_other"))
    same = F.when(F.col("word") == F.col("_other"), F.col("word")).otherwise(F.raise_error(F.lit("two words have one hash")).cast("string"))
    return each.select("lang", "hash", same.alias("word"), "n")


def _frequent_pairs(texts: DataFrame, routes: int, least: int, hot: int, folder: str) -> None:
    """Store for each route the sorted pair hashes (32 bits) that occur ``least`` times or more, times two, plus one if
    ``hot`` times or more. A run's pairs are summed up before they are shuffled; a route's runs meet in one task."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, hashes, _, _, joined in _scanned(batches):
            at = np.flatnonzero(joined)
            pairs = np.sort(_pair_hash(lang, hashes[at], hashes[at + 1]))
            begin = _runs(pairs)
            n = np.diff(np.append(begin, len(pairs)))
            pairs = pairs[begin]
            route = _routed(pairs, routes)
            order = np.argsort(route, kind="stable")
            bounds = np.searchsorted(route[order], np.arange(routes + 1))
            low = (pairs[order] & np.uint64(0xFFFFFFFF)).astype("<u4")
            n = np.minimum(n[order], 0xFFFFFFFF).astype("<u4")
            used = np.flatnonzero(np.diff(bounds))
            blobs = []
            for r in used.tolist():
                h, m = low[bounds[r] : bounds[r + 1]], n[bounds[r] : bounds[r + 1]]
                once = m == 1
                blobs.append(np.array([once.sum()], "<u4").tobytes() + h[once].tobytes() + h[~once].tobytes() + m[~once].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(blobs, pa.binary())], names=["route", "pairs"])

    def keep(group: pa.Table) -> pa.Table:
        ones, many, n = [], [], []
        for blob in group.column("pairs").to_pylist():
            k = int(np.frombuffer(blob, "<u4", 1)[0])
            ones.append(np.frombuffer(blob, "<u4", k, 4))
            rest = np.frombuffer(blob, "<u4", offset=4 + 4 * k)
            many.append(rest[: len(rest) // 2])
            n.append(rest[len(rest) // 2 :])
        single = np.sort(np.concatenate(ones))
        begin = _runs(single)
        h = np.concatenate([single[begin], *many]).astype(np.int64)
        n = np.concatenate([np.diff(np.append(begin, len(single))), *n]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        begin = _runs(h)
        n = np.add.reduceat(n, begin)
        often = n >= least
        store_array(f"{folder}/{group.column('route')[0].as_py()}.npy", 2 * h[begin][often] + (n[often] >= hot))
        return pa.table({"route": group.column("route")[:1], "pairs": pa.array([often.sum()], pa.int64())})

    every = texts.sparkSession.range(routes).select(F.col("id").cast("int").alias("route"), F.lit(b"\0\0\0\0").alias("pairs"))
    texts.mapInArrow(emit, "route int, pairs binary").unionByName(every).groupBy("route").applyInArrow(keep, "route int, pairs long").write.format("noop").mode("overwrite").save()


def _looked_up(pairs: np.ndarray, routes: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(whether it may be frequent, whether it is hot) of each pair hash."""
    route = _routed(pairs, routes)
    order = np.argsort(route.astype(np.int16 if routes < 1 << 15 else np.int64), kind="stable")
    bounds = np.searchsorted(route[order], np.arange(routes + 1))
    want = 2 * (pairs[order] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    kept, hot = np.zeros(len(pairs), bool), np.zeros(len(pairs), bool)
    for r in np.flatnonzero(np.diff(bounds)).tolist():
        have = _mapped(f"{folder}/{r}.npy")
        if len(have):
            own = slice(bounds[r], bounds[r + 1])
            found = have[np.minimum(np.searchsorted(have, want[own]), len(have) - 1)]
            kept[order[own]] = found >> 1 == want[own] >> 1
            hot[order[own]] = (found >> 1 == want[own] >> 1) & (found & 1 == 1)
    return kept, hot


def _suffixes(texts: DataFrame, routes: int, folder: str) -> DataFrame:
    """(lang, route, suffixes): suffixes whose leading pair may be frequent, each different one of a run once with its count."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, hashes, _, _, joined in _scanned(batches):
            at = np.flatnonzero(joined)
            pairs = _pair_hash(lang, hashes[at], hashes[at + 1])
            kept, hot = _looked_up(pairs, routes, folder)
            at, route, hot = at[kept], _routed(pairs[kept], routes), hot[kept]
            goes = np.zeros(len(hashes) + DEPTH, bool)
            goes[at] = True
            padded = np.append(hashes, np.zeros(DEPTH, np.uint64))
            words, on = np.zeros((DEPTH, len(at)), np.uint64), np.ones(len(at), bool)
            for d in range(DEPTH):
                if d:
                    on = on & goes[at + d - 1]
                words[d] = np.where(on, padded[at + d], np.uint64(0))
            deep = mix(words[2] + mix(words[3])) >> np.uint64(32)
            route = np.where(hot, (route + deep.astype(np.int64)) % routes, route)
            order = np.lexsort((*words[::-1], route))
            words, route, hot = words[:, order], route[order], hot[order]
            begin = _runs(route, *words)
            n = np.diff(np.append(begin, len(order))) * 2 + hot[begin]
            table = np.concatenate([words[:, begin], n.astype(np.uint64)[None, :]]).astype("<u8")
            bounds = np.searchsorted(route[begin], np.arange(routes + 1))
            used = np.flatnonzero(np.diff(bounds))
            blobs = [table[:, bounds[r] : bounds[r + 1]].tobytes() for r in used.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(blobs, pa.binary())], names=["lang", "route", "suffixes"])

    return texts.mapInArrow(emit, "lang string, route int, suffixes binary")


def quicksort(keys: np.ndarray, n: np.ndarray, least: int, free: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers to suffixes (``keys``: depth x suffixes, 0 past a suffix's end), all
    partitions of a round at once. A partition is split by one of its words at its depth into less, equal and greater;
    the equal part goes on at the next depth, and its size, weighted by ``n``, is the count of its words so far.
    Partitions under ``least`` are abandoned, unless they hold a suffix that is ``free`` of this.

    Gives for each number of words (a pointer of each equal part, its count, whether it is free), for 1 and more words.
    """
    depths, size = keys.shape
    free = np.zeros(size, bool) if free is None else free
    out: list[list] = [[] for _ in range(depths)]
    pointers = np.arange(size)
    begins, level = np.zeros(1, np.int64), np.zeros(1, np.int64)
    sizes = np.array([size])
    while len(pointers):
        part = np.repeat(np.arange(len(sizes)), sizes)
        depth = level[part]
        word = keys[depth, pointers]
        pivot = word[begins + sizes // 2][part]
        side = (word > pivot).astype(np.int64) * 2 + (word == pivot)  # 0 less, 1 equal, 2 greater
        counts = np.zeros((len(sizes), 3), np.int64)
        for k in range(3):
            counts[:, k] = np.add.reduceat((side == k).astype(np.int64), begins)
        starts = begins[:, None] + np.cumsum(counts, axis=1) - counts
        to = np.empty(len(pointers), np.int64)
        for k in range(3):
            here = np.flatnonzero(side == k)
            rank = np.arange(len(here)) - np.repeat(np.cumsum(counts[:, k]) - counts[:, k], counts[:, k])
            to[here] = starts[part[here], k] + rank
        moved = np.empty_like(pointers)
        moved[to] = pointers
        sizes, kind, level = counts.ravel(), np.tile([0, 1, 2], len(sizes)), np.repeat(level, 3)
        has = sizes > 0
        sizes, kind, level = sizes[has], kind[has], level[has]
        begins = np.cumsum(sizes) - sizes
        weight, any_free = np.add.reduceat(n[moved], begins), np.logical_or.reduceat(free[moved], begins)
        go = (weight >= least) | any_free
        equal = kind == 1
        ended = equal & (keys[level, moved[begins]] == 0)
        for d in range(depths):
            mine = np.flatnonzero(equal & go & ~ended & (level == d))
            if len(mine):
                out[d].append((moved[begins[mine]], weight[mine], any_free[mine]))
        level = level + equal
        go &= ~ended & (level < depths)
        pointers = moved[np.repeat(go, sizes)]
        sizes, level = sizes[go], level[go]
        begins = np.cumsum(sizes) - sizes
    none = np.zeros(0, np.int64)
    return [tuple(np.concatenate([x[i] for x in o]) if o else none.astype(bool if i == 2 else np.int64) for i in range(3)) for o in out]


def _counted(suffixes: DataFrame, least: int) -> DataFrame:
    """(lang, w1 to w4, n) of phrases of two words and more; those of hot leading pairs come in parts."""

    def sort(group: pa.Table) -> pa.Table:
        table = np.concatenate([np.frombuffer(b, "<u8").reshape(DEPTH + 1, -1) for b in group.column("suffixes").to_pylist()], axis=1)
        keys, n, hot = table[:DEPTH], (table[DEPTH] >> np.uint64(1)).astype(np.int64), (table[DEPTH] & np.uint64(1)).astype(bool)
        lang, parts = group.column("lang")[0], []
        for length, (at, count, _) in enumerate(quicksort(keys, n, least, hot), 1):
            if length > 1:
                words = [pa.array((keys[d, at] if d < length else np.zeros(len(at), np.uint64)).view(np.int64)) for d in range(DEPTH)]
                parts.append(pa.table([pa.repeat(lang, len(at)), *words, pa.array(count)], names=["lang", *WORDS, "n"]))
        return pa.concat_tables(parts)

    schema = f"lang string, {', '.join(f'{w} long' for w in WORDS)}, n long"
    return suffixes.groupBy("lang", "route").applyInArrow(sort, schema).groupBy("lang", *WORDS).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent_phrases(docs: DataFrame, least: int = LEAST, routed: int = ROUTED) -> tuple[DataFrame, DataFrame]:
    """(words, phrases), both stored: (lang, hash, word, n) of all words and (lang, w1 to w4, n) of the phrases that occur
    ``least`` times or more in their language; 0 stands after a phrase's last word."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = save(word_counts(texts), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    routes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // routed))
    folder = new_path(spark, "pairs")
    _frequent_pairs(texts, routes, least, max(1, routed // 8), folder)
    return words, save(_counted(_suffixes(texts, routes, folder), least), "phrases")


def _key(values: list) -> list[Column]:
    return [v.alias(f"k{i}") for i, v in enumerate([*values, *[F.lit(0).cast("long")] * (DEPTH - len(values))])]


def _scored(words: DataFrame, phrases: DataFrame, least: int) -> DataFrame:
    """Phrases with a, l, r and score of their lowest cut."""
    w = [F.col(x) for x in WORDS]
    length = sum(((x != 0).cast("int") for x in w), F.lit(0))
    known = phrases.select("lang", *_key(w), F.col("n")).unionByName(words.where(F.col("n") >= least).select("lang", *_key([F.col("hash")]), "n"))
    keys = [f"k{i}" for i in range(DEPTH)]

    def cut(n: int, k: int) -> Column:
        left, right = F.struct(*_key(w[:k])), F.struct(*_key(w[k:n]))
        return F.when(length == n, F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right")))

    cuts = F.filter(F.array(*[cut(n, k) for n in range(2, DEPTH + 1) for k in range(1, n)]), lambda x: x.isNotNull())
    each = phrases.select("lang", *WORDS, F.col("n").alias("a"), F.explode(cuts).alias("c")).select("lang", *WORDS, "a", "c.k", "c.left", "c.right")
    for side in ("left", "right"):
        of = known.select("lang", F.struct(*keys).alias(side), F.col("n").alias(side[0]))
        each = each.join(of, ["lang", side])
    score = F.expr(f"CAST((CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS LONG)")
    best = each.withColumn("score", score).groupBy("lang", *WORDS, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", *WORDS, "a", "b.l", "b.r", "b.score")


def _uncovered(scored: DataFrame, phrases: DataFrame, covered: int) -> DataFrame:
    """Phrases that no longer one around them has most occurrences of."""
    w = [F.col(x) for x in WORDS]
    inner = [(n, b, m) for n in range(3, DEPTH + 1) for m in range(2, n) for b in range(n - m + 1)]
    whole = lambda n: (w[n - 1] != 0) & ((w[n] == 0) if n < DEPTH else F.lit(True))
    spans = F.filter(F.array(*[F.when(whole(n), F.struct(*[c.alias(x) for c, x in zip([*w[b : b + m], *[F.lit(0).cast("long")] * (DEPTH - m)], WORDS, strict=True)])) for n, b, m in inner]), lambda x: x.isNotNull())
    around = phrases.where(F.col(WORDS[2]) != 0).select("lang", "n", F.explode(spans).alias("s")).select("lang", "n", "s.*").groupBy("lang", *WORDS).agg(F.max("n").alias("_around"))
    wide = lambda c, k: F.col(c).cast("decimal(20,0)") * k
    return scored.join(around, ["lang", *WORDS], "left").where(F.col("_around").isNull() | (wide("_around", 100) < wide("a", covered))).drop("_around")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, routed: int = ROUTED) -> DataFrame:
    """Each language's first ``top`` phrases of two to four words: lang, rank, phrase, a, l, r, n, score.

    Null text is empty, null lang is 'und'. Equal rows count each by itself, long texts are read whole. Equal scores are
    ranked by a, then by the phrase's bytes. A table without frequent phrases, or without rows, gives no rows. Other
    columns don't matter, whatever they are called.
    """
    words, phrases = frequent_phrases(docs, least, routed)
    best = _uncovered(_scored(words, phrases, least), phrases, covered)
    often = words.where(F.col("n") >= least)
    for x in WORDS:
        best = best.join(often.select("lang", F.col("hash").alias(x), F.col("word").alias(f"_{x}")), ["lang", x], "left")
    phrase = F.concat_ws(" ", *[f"_{x}" for x in WORDS])
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = best.select("lang", phrase.alias("phrase"), "a", "l", "r", "score").withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
