"""How the sources of a language differ in their terms, exactly, with a frequent-pattern tree over the rows of terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import map_array, new_path, save, store_array
from .tokens import slices
from .wordhash import texts_at, word_places

#: What parts terms: all ASCII but letters.
PARTS = np.ones(256, dtype=bool)
PARTS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
UNIT, LEAST, TOP = 1_000_000_000, 3, 200
CELLS = 1 << 20


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and the group's documents that have it.

    Null text, lang and source are ''. Each run of documents is summed up before anything is shuffled. Terms are told
    apart by 64-bit hashes within a run and by themselves from there on.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2):
                data, hashes, starts, ends, owners = word_places(some.column(2).to_pylist(), PARTS)
                if not len(hashes):
                    continue
                _, first, term = np.unique(hashes, return_index=True, return_inverse=True)
                n_docs = some.num_rows
                both, n = np.unique(term * n_docs + owners, return_counts=True)  # a term in a document
                group = pa.StructArray.from_arrays([some.column(0), some.column(1)], ["l", "s"])
                named = list(map(tuple, {(x["l"], x["s"]): 0 for x in group.to_pylist()}))
                code = {x: i for i, x in enumerate(named)}
                of_doc = np.array([code[x["l"], x["s"]] for x in group.to_pylist()])
                key = both // n_docs * len(named) + of_doc[both % n_docs]
                begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if (key[1:] >= key[:-1]).all() else None
                if begin is None:
                    order = np.argsort(key, kind="stable")
                    key, n = key[order], n[order]
                    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                key, sums, have = key[begin], np.add.reduceat(n, begin), np.diff(np.append(begin, len(key)))
                terms = texts_at(data, starts[first], ends[first]).take(pa.array(key // len(named)))
                langs, sources = (pa.array([x[i] for x in named], pa.string()).take(pa.array(key % len(named))) for i in range(2))
                yield pa.RecordBatch.from_arrays([langs, sources, terms, pa.array(sums.astype(np.int64)), pa.array(have.astype(np.int64))], schema=schema)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = docs.select(blank("lang"), blank("source"), blank("text")).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + V)), exact beyond 64 bits."""
    return F.expr(f"CAST(1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(20,0))) DIV CAST({total} + v AS DECIMAL(21,0)) AS LONG)")


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + 1) / whole) in steps of a thousand, so that nothing passes 64 bits."""
    rest, out = n + 1, np.zeros(np.broadcast(n, whole).shape, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return 1 + out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Tree:
    """A frequent-pattern tree of one language's terms: a term is a path of (source, count), sources ascending, counts over
    0. Paths come sorted, with how many terms have each; a node stands for all of them that begin alike.

    ``gained[g, o]`` is what pair (g, o) has more than if no term occurred in either source, in 64 bits that wrap: sums
    of differences may pass them where the sum of all doesn't.
    """

    def __init__(self, sizes: np.ndarray, terms: int):
        self.whole = sizes + terms
        self.zero = shares(np.zeros(len(sizes), np.int64), self.whole)
        self.gained = np.zeros((len(sizes), len(sizes)), np.int64)

    def insert(self, sources: np.ndarray, counts: np.ndarray, lengths: np.ndarray, many: np.ndarray) -> None:
        """Sorted paths end to end."""
        rows, depth = len(lengths), int(lengths.max(initial=0))
        at, place = np.repeat(np.arange(rows), lengths), np.arange(len(sources)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        s, c = np.full((rows, depth), -1), np.zeros((rows, depth), np.int64)
        s[at, place], c[at, place] = sources, counts
        p = shares(c, self.whole[np.maximum(s, 0)])
        differs = np.ones(rows, bool), np.zeros(rows, bool)
        begins = differs[1]
        begins[0] = True
        for d in range(depth):
            begins[1:] |= (s[1:, d] != s[:-1, d]) | (c[1:, d] != c[:-1, d])
            own = np.flatnonzero(s[:, d] >= 0)
            heads = np.flatnonzero(begins[own])
            node, n = own[heads], np.add.reduceat(many[own], heads)  # the nodes at this depth, and their terms
            self._alone(s[node, d], p[node, d], n)
            for e in range(d):
                self._both(s[node, e], p[node, e], s[node, d], p[node, d], n)

    def _alone(self, s: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
        """Against each other source as if the term weren't there; equal nodes are taken together."""
        key = np.lexsort((p, s))
        s, p, n = s[key], p[key], n[key]
        begin = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (p[1:] != p[:-1])]))
        s, p, n = s[begin], p[begin], np.add.reduceat(n, begin)
        step = max(1, CELLS // len(self.zero))
        for a in range(0, len(s), step):
            i, x, m = s[a : a + step], p[a : a + step, None], n[a : a + step, None]
            zero, own = self.zero[None, :], self.zero[i][:, None]
            np.add.at(self.gained, i, m * (distance(x, zero) - distance(own, zero)))
            np.add.at(self.gained.T, i, m * (distance(zero, x) - distance(zero, own)))

    def _both(self, a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, n: np.ndarray) -> None:
        """A node with one of its ancestors: what both being there changes beyond each of them alone."""
        p0, q0 = self.zero[a], self.zero[b]
        for i, x, x0, j, y, y0 in ((a, p, p0, b, q, q0), (b, q, q0, a, p, p0)):
            np.add.at(self.gained, (i, j), n * (distance(x, y) - distance(x, y0) - distance(x0, y) + distance(x0, y0)))


def _gains(paths: DataFrame, sizes_at: str) -> DataFrame:
    """(lang, i, j, gained) of each task's trees, one tree a language that the task has rows of."""
    schema = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("gained", pa.int64())])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, trees = map_array(sizes_at), {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                some = batch.filter(pa.compute.equal(langs.indices, k))
                base, groups, terms = (some.column(i)[0].as_py() for i in (1, 2, 3))
                tree = trees.setdefault(lang, None) or Tree(np.array(sizes[base : base + groups]), terms)
                trees[lang] = tree
                step = max(1, CELLS // groups)
                for a in range(0, some.num_rows, step):
                    part = some.slice(a, step)
                    lengths = pa.compute.list_value_length(part.column(4)).to_numpy(zero_copy_only=False).astype(np.int64)
                    flat = [part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (4, 5)]
                    tree.insert(flat[0].astype(np.int64), flat[1], lengths, part.column(6).to_numpy())
        for lang, tree in trees.items():
            i, j = np.nonzero(tree.gained)
            for a in range(0, len(i), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i[part]), pa.string()), pa.array(i[part].astype(np.int32)), pa.array(j[part].astype(np.int32)), pa.array(tree.gained[i[part], j[part]])], schema=schema)

    return paths.mapInArrow(grow, "lang string, i int, j int, gained long")


def _store_sizes(groups: DataFrame, at: str) -> None:
    """The groups' sizes in their order as one array that tasks map: as many numbers as the result has groups."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_array(at, np.concatenate([np.zeros(0, np.int64), *[b.column(0).to_numpy() for b in batches]]))
        return iter(())

    groups.orderBy("base", "i").coalesce(1).select("total").mapInArrow(write, "x int").collect()


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its distance to each other source of its language (``pair``),
    and the ``top`` terms that it has more of than the language (``term``).

    Null text, lang and source are read as ''. Equal rows count each by itself. A group without terms is compared like any
    other; a language whose terms are all in fewer than ``least`` documents has distances of 0. Values that tie are ranked
    by item. An empty table gives no rows. Other columns don't matter, whatever they are called.
    """
    spark = docs.sparkSession
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = save(term_counts(docs), "terms")
    per_term = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least).drop("docs")
    kept = save(counted.drop("docs").join(per_term, ["lang", "term"]), "kept-terms")
    in_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"))
    terms = per_term.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    in_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(blank("lang"), blank("source")).distinct().join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "lang_total", "v")])
    own = Window.partitionBy("lang")
    numbered = groups.select("*", (F.row_number().over(own.orderBy("source")) - 1).alias("i"), F.count(F.lit(1)).over(own).cast("int").alias("groups"))
    langs = numbered.where("i = 0").select("lang", (F.sum("groups").over(Window.orderBy("lang")) - F.col("groups")).cast("int").alias("base"))
    groups = save(numbered.join(langs, "lang"), "groups")
    sizes_at = new_path(spark, "sizes") + ".npy"
    _store_sizes(groups, sizes_at)

    rows = kept.join(groups.select("lang", "source", "i", "base", "groups", "v"), ["lang", "source"])
    of_term = rows.groupBy("lang", "term", "base", "groups", "v").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("path"))
    paths = of_term.groupBy("lang", "base", "groups", "v", "path").agg(F.count(F.lit(1)).alias("many"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = paths.repartitionByRange(parts, "lang", "path").sortWithinPartitions("lang", "path").select("lang", "base", "groups", "v", "path.i", "path.n", "many")
    wide = "DECIMAL(38,0)"
    gained = _gains(paths, sizes_at).groupBy("lang", "i", "j").agg(F.expr(f"SUM(CAST(gained AS {wide}))").alias("gained"))

    left = groups.where("v > 0").select("lang", "source", "i", "v", _share("0", "total").alias("p0"))
    right = groups.where("v > 0").select("lang", F.col("source").alias("item"), F.col("i").alias("j"), _share("0", "total").alias("q0"))
    zero = "(p0 - q0) * (p0 - q0) DIV q0"
    summed = f"PMOD(COALESCE(gained, 0) + CAST(v AS DECIMAL(20,0)) * CAST({zero} AS DECIMAL(18,0)), CAST('18446744073709551616' AS {wide}))"
    pairs = left.join(right, "lang").where(F.col("i") != F.col("j")).join(gained, ["lang", "i", "j"], "left").select("lang", "source", "item", F.expr(f"CAST({summed} AS LONG)").alias("value"))
    bare = groups.where("v = 0")
    none = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item")).select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    apart = _ranked(pairs.unionByName(none), "pair")

    judged = kept.join(groups.select("lang", "source", "total", "lang_total", "v"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q"))
    more = judged.where(F.col("p") > F.col("q")).select("lang", "source", "item", F.expr("(p - q) * (p - q) DIV q").alias("value"))
    return apart.unionByName(_ranked(more, "term").where(F.col("rank") <= top))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
