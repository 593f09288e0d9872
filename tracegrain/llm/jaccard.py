"""Pairs of texts that share at least a given part of their word shingles: SimHash links, then a grid over the popcounts of
segments that loses no pair, a bound from bit sketches, and exact checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .components import components
from .state import discard, save
from .wordhash import SPACES, hash_words, mix

CHUNK = 1 << 20
BLOCK, FEW, FEW_CELLS = 4096, 1_000_000, 10_000
SEGMENTS, AT_ONCE = 1024, 1 << 16  # segments of a group, and rows of a batch
TEXTS = 256
WORDS = 8
SKETCH = [f"k{j}" for j in range(WORDS)]
CELLS = "cell long, p long, q long, side long, node long, n long, at long"


def shingle_sets(texts: list[str | None], shingle: int) -> Iterator[np.ndarray]:
    """Of each text, the hashes of its different shingles in ascending order; a text of fewer words is one shingle, one
    without words has none. Words are hashed for a chunk of texts at once."""
    at = 0
    while at < len(texts):
        end, total = at + 1, len(texts[at] or "")
        while end < len(texts) and total + len(texts[end] or "") <= CHUNK:
            total += len(texts[end] or "")
            end += 1
        ids, counts = hash_words(texts[at:end], SPACES)
        h = np.zeros(max(0, len(ids) - shingle + 1), dtype=np.uint64)
        for k in range(shingle):
            h = _next(h, ids[k : k + len(h)])
        for begin, n in zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), strict=True):
            if n >= shingle:
                yield np.unique(h[begin : begin + n - shingle + 1])
                continue
            one = np.zeros(min(n, 1), dtype=np.uint64)
            for k in range(n):
                one = _next(one, ids[begin + k : begin + k + 1])
            yield one
        at = end


def _next(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def needed(a, b, tenths: int):
    """The least number of common shingles that sets of ``a`` and ``b`` must have: tenths/10 of the union, in whole numbers."""
    return -((a + b) * -tenths // (10 + tenths))


def similar(x: np.ndarray, y: np.ndarray, tenths: int) -> bool:
    return len(np.intersect1d(x, y, assume_unique=True)) >= needed(len(x), len(y), tenths)


def sketch(s: np.ndarray) -> np.ndarray:
    """64 * WORDS bits, each the parity of the shingles that hash to it. What two sets don't share changes a bit at most
    each, so their sketches differ in no more bits than the sets in shingles: a lower bound that loses no pair."""
    odd = np.bincount((s >> np.uint64(7)) % np.uint64(64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def node_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 7)).view(np.int64))


def majority(s: np.ndarray) -> int:
    """The SimHash of 64 bits of a set of hashes: a bit is 1 if it is in over half of them; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(s), 1 << 14):
        ones += np.unpackbits(s[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view(np.int64)[0])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of TEXTS rows: what Python holds of texts beside a batch doesn't grow with it."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _nodes(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, node, fp (the SimHash) and the sketch's words k0, k1, ... of every document."""

    def make(batches):
        tokens.unload()
        for batch in _parts(batches):
            nodes, fps, words = [], [], [np.zeros((0, WORDS), dtype=np.int64)]
            for s in shingle_sets(batch.column(1).to_pylist(), shingle):
                nodes.append(node_of(s))
                fps.append(majority(s))
                words.append(sketch(s)[None])
            k = np.concatenate(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), *(pa.array(k[:, j]) for j in range(WORDS))], names=["doc_id", "node", "fp", *SKETCH])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, f"doc_id long, node long, fp long, {', '.join(f'{k} long' for k in SKETCH)}")


def _edges() -> np.ndarray:
    """Where the classes of sizes begin: each is half as wide again as the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out)


EDGES = _edges()


def grid(s: np.ndarray, tenths: int) -> np.ndarray:
    """The cells of a set: two similar sets have one in common.

    A set is read as the ones of a fingerprint as long as the space of hashes. That is parted into groups of SEGMENTS segments,
    and embedded as the popcounts of these; the Manhattan distance of two embeddings never exceeds the number of differing
    ones. Similar sets, the smaller one of size n, differ in n * (10 - tenths) / tenths ones at most, so in no more of the groups,
    and agree in the popcounts of all the others. Groups are as many as that, two, and a quarter more; the emptiest quarter
    gives no cell, as all sets with few shingles would meet there: of two lists of cells in one order that share that many and one, the first ones without as many must
    share one too. The number of groups goes by the size class of the smaller set, which a set takes to be any it can be.
    """
    n, out = len(s), [np.zeros(0, dtype=np.uint64)]
    least, most = np.searchsorted(EDGES, [-(-n * tenths // 10), n], side="right") - 1
    for c in range(max(0, least), most + 1):
        apart = int(EDGES[c + 1] - 1) * (10 - tenths) // tenths
        if not apart:
            continue  # only equal sets are similar
        groups = apart + 2 + apart // 4
        salt = mix(np.array([c + 1], dtype=np.uint64))
        segment = ((s >> np.uint64(32)) * np.uint64(groups * SEGMENTS)) >> np.uint64(32)  # ascends, as ``s`` does
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(segment + salt), dtype=np.uint64)])
        edges = np.searchsorted(segment, np.arange(groups + 1, dtype=np.uint64) * np.uint64(SEGMENTS))
        cells = mix(sums[edges[1:]] - sums[edges[:-1]] + mix(np.arange(1, groups + 1, dtype=np.uint64) ^ (salt << np.uint64(1))))  # of popcounts: a sum over ones
        out.append(cells[np.lexsort((cells, -np.diff(edges)))[: apart + 1]])
    return np.concatenate(out)


def _placed(docs: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """(cell, node, n): each set, of ``n`` shingles, in each of its cells."""

    def place(batches):
        told: set[int] = set()  # copies are placed once a task
        for batch in _parts(batches):
            cells, nodes, sizes, held = [], [], [], 0
            for s in shingle_sets(batch.column(0).to_pylist(), shingle):
                node = node_of(s)
                if not len(s) or node in told:
                    continue
                told.add(node)
                cells.append(grid(s, tenths))
                nodes.append(node)
                sizes.append(len(s))
                held += len(cells[-1])
                if held >= AT_ONCE:
                    yield pack(cells, nodes, sizes)
                    cells, nodes, sizes, held = [], [], [], 0
            if held:
                yield pack(cells, nodes, sizes)

    def pack(cells, nodes, sizes):
        k = [len(c) for c in cells]
        cols = [np.concatenate(cells).view(np.int64), np.repeat(np.array(nodes, dtype=np.int64), k), np.repeat(np.array(sizes, dtype=np.int64), k)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["cell", "node", "n"])

    return docs.select("text").mapInArrow(place, "cell long, node long, n long")


def _shared(placed: DataFrame) -> DataFrame:
    """Rows, without copies, of the cells in which different sets meet. A row is looked at beside its neighbours, so that no
    task holds a cell."""

    def meet(batches):
        last, was_met = None, False
        for batch in batches:
            x = np.stack([batch.column(j).to_numpy() for j in range(3)])
            x = x if last is None else np.concatenate([last, x], axis=1)
            if not x.shape[1]:
                continue
            x = x[:, np.concatenate([[True], (x[:2, 1:] != x[:2, :-1]).any(axis=0)])]
            same = x[0, 1:] == x[0, :-1]
            before = np.concatenate([[was_met], same])
            kept = x[:, :-1][:, before[:-1] | same]
            last, was_met = x[:, -1:], bool(before[-1])
            if kept.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], names=["cell", "node", "n"])
        if was_met:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names=["cell", "node", "n"])

    return placed.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(meet, "cell long, node long, n long")


def dealt(placed: DataFrame, cell_rows: int, *kept: str) -> DataFrame:
    """Rows by task: a cell of over ``cell_rows`` rows is dealt to blocks by the first of ``kept``, and every two of its blocks
    meet by themselves."""
    hot = save(placed.groupBy("cell").agg(F.count("*").alias("_n")).where(F.col("_n") > cell_rows), "hot-cells")
    n_hot = hot.count()
    if not n_hot:
        return placed.select("cell", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(-1).alias("side"), *kept)
    blocks = hot.select("cell", F.ceil(F.col("_n") / cell_rows).cast("int").alias("_k"))
    marked = placed.join(F.broadcast(blocks) if n_hot <= FEW_CELLS else blocks, "cell", "left")
    own = F.when(F.col("_k") > 1, F.pmod(F.xxhash64(kept[0]), F.col("_k")).cast("int"))
    others = F.when(F.col("_k") > 1, F.sequence(F.lit(0), F.col("_k") - 1)).otherwise(F.array(F.lit(0)))
    each = marked.withColumn("_own", F.coalesce(own, F.lit(0))).withColumn("_other", F.explode(others))
    alone = F.col("_own") == F.col("_other")
    return each.select("cell", F.least("_own", "_other").alias("p"), F.greatest("_own", "_other").alias("q"), F.when(alone, -1).otherwise(F.col("_own")).alias("side"), *kept)


def _by_cell(rows: DataFrame, schema: str, work) -> DataFrame:
    """``work`` on the columns of each run of whole cells, sorted by cell, blocks, size and node."""
    names = schema.replace(" long", "").split(", ")

    def runs(batches):
        held = None
        for batch in batches:
            x = np.stack([batch.column(j).to_numpy() for j in range(batch.num_columns)])
            x = x if held is None else np.concatenate([held, x], axis=1)
            if not x.shape[1]:
                continue
            same = (x[:3] == x[:3, -1:]).all(axis=0)
            last = 0 if same.all() else x.shape[1] - int(same[::-1].argmin())
            held = x[:, last:]  # the last cell may go on in the next batch
            if last:
                yield work(x[:, :last])
        if held is not None:
            yield work(held)

    def make(batches):
        for cols in runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return rows.repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q", "n", "node").mapInArrow(make, schema)


def _run(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([[True], (x[:3, 1:] != x[:3, :-1]).any(axis=0)]))


def _may(x: np.ndarray, i: np.ndarray, j: np.ndarray, tenths: int) -> np.ndarray:
    """Which of the rows ``i`` and ``j``, two by two, may be similar: they aren't joined yet, and neither their sizes, nor
    what is left of both sets after the common shingle, nor their sketches forbid it."""
    side, n, at, root = x[3], x[5], x[6], x[7]
    least = needed(n[i], n[j], tenths)
    left = np.minimum(n[i] - at[i], n[j] - at[j])
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    ok = (root[i] != root[j]) & ((side[i] < 0) | (side[i] != side[j])) & (10 * small >= tenths * large) & (left >= least)
    apart = np.bitwise_count((x[8:, i[ok]] ^ x[8:, j[ok]]).view(np.uint64)).sum(axis=0, dtype=np.int64)
    ok[ok] = apart <= n[i[ok]] + n[j[ok]] - 2 * least[ok]
    return ok


def _ahead(x: np.ndarray, run: np.ndarray, tenths: int, lags: int | None):
    """(i, j) that may be similar, a row and one up to ``lags`` further on in its run; sizes ascend in a run."""
    n = x[5]
    i, lag = np.arange(x.shape[1]), 1
    while lags is None or lag <= lags:
        i = i[i + lag < x.shape[1]]
        i = i[(run[i] == run[i + lag]) & (10 * n[i] >= tenths * n[i + lag])]
        if not len(i):
            return
        ok = _may(x, i, i + lag, tenths)
        yield i[ok], i[ok] + lag
        lag += 1


def _pairs_in(tenths: int, lags: int | None):
    """Pairs (a < b) of a run that may be similar: neighbours up to ``lags`` apart, or all, if it is None.

    Of all pairs, those within the most frequent root of a run are joined already. So a run that one root fills is
    passed over, and where one root has nearly all rows, only the others are held against the run.
    """

    def pairs(x: np.ndarray) -> list[np.ndarray]:
        run, found = _run(x), []
        if lags is not None:
            found = list(_ahead(x, run, tenths, lags))
        elif x.shape[1]:
            run -= 1
            order = np.lexsort((x[7], run))
            new = np.concatenate([[True], (np.diff(run[order]) != 0) | (np.diff(x[7][order]) != 0)])
            start = np.flatnonzero(new)
            count, of = np.diff(np.append(start, len(order))), run[order][start]
            most = np.lexsort((-count, of))
            most = most[np.concatenate([[True], np.diff(of[most]) != 0])]
            rows = np.bincount(run)
            rest = rows - count[most]
            few = (rest > 0) & (rows >= 64) & (8 * rest < rows)
            many = (rest > 0) & ~few
            back = np.flatnonzero(many[run])
            found = [(back[i], back[j]) for i, j in _ahead(np.ascontiguousarray(x[:, back]), run[back], tenths, None)]
            major = x[7][order][start][most]
            ends = np.cumsum(rows)
            for k in np.flatnonzero(few).tolist():
                all_ = np.arange(ends[k] - rows[k], ends[k])
                for i in all_[x[7][all_] != major[k]].tolist():
                    j = all_[all_ != i]
                    j = j[_may(x, np.full(len(j), i), j, tenths)]
                    found.append((np.full(len(j), i), j))
        node = x[4]
        both = [np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]) for i, j in found]
        return list(np.unique(np.concatenate([np.zeros((2, 0), dtype=np.int64), *both], axis=1), axis=1))

    return pairs


def embedding(s: np.ndarray) -> bytes:
    """The popcounts (255 at most) of a set's segments, of which there are a power of two, between half the set's size and all
    of it."""
    bits = max(6, len(s).bit_length() - 1)
    found = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(found, 255).astype(np.uint8).tobytes()


def manhattan(x: bytes, y: bytes) -> int:
    """The distance of two embeddings, the finer one folded to the coarser: no more than the sets differ in."""
    a, b = (np.frombuffer(e, np.uint8).astype(np.int64) for e in (x, y))
    least = min(len(a), len(b))
    return int(np.abs(a.reshape(least, -1).sum(axis=1) - b.reshape(least, -1).sum(axis=1)).sum())


def _near(pairs: DataFrame, texts: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """Those of the ``pairs`` whose embeddings lie within the Manhattan bound: what is left is a small part, so few texts travel."""

    def embed(batches):
        for batch in _parts(batches):
            sets = list(shingle_sets(batch.column(1).to_pylist(), shingle))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([embedding(s) for s in sets], pa.binary())], names=["node", "n", "e"])

    def bound(batches):
        for batch in batches:
            rows = zip(*(batch.column(j).to_pylist() for j in range(2, 6)), strict=True)
            ok = [manhattan(x, y) <= n + m - 2 * needed(n, m, tenths) for n, x, m, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    told = save(texts.select("node", "text").mapInArrow(embed, "node long, n long, e binary"), "embedded")
    both = pairs.join(told.toDF("a", "na", "ea"), "a").join(told.toDF("b", "nb", "eb"), "b").select("a", "b", "na", "ea", "nb", "eb")
    out = save(both.mapInArrow(bound, "a long, b long"), "bounded")
    discard(told)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose texts are similar."""
    ids = save(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(firsts, "node"), "met-ids")
    few = ids.count() <= FEW
    texts = save(docs.select(F.col("doc_id").cast("long").alias("_first"), "text").join(F.broadcast(ids) if few else ids, "_first").select("node", "text"), "met-texts")
    near = _near(pairs, texts, shingle, tenths)
    both = near.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def check(batches):
        for batch in _parts(batches):
            sides = (shingle_sets(batch.column(j).to_pylist(), shingle) for j in (2, 3))
            ok = [similar(x, y, tenths) for x, y in zip(*sides, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = save(both.mapInArrow(check, "a long, b long"), "similar")
    discard(ids, texts, near)
    return out


def _alike(rows: DataFrame, simhash_links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a < b) of nodes whose SimHashes are equal or linked: a class of equal ones is a star around its least node."""
    known = save(rows.select("node", "fp").distinct(), "fingerprints")
    classes = save(known.groupBy("fp").agg(F.min("node").alias("least")), "classes")
    of = lambda k: classes.select(F.col("fp").alias(k), F.col("least").alias(f"n{k}"))
    across = simhash_links(classes.select("fp")).join(of("a"), "a").join(of("b"), "b").select("na", "nb")
    within = known.join(classes, "fp").where(F.col("node") != F.col("least")).select("node", "least")
    both = across.union(within).toDF("x", "y")
    out = save(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "alike")
    discard(known, classes)
    return out


def linked(docs: DataFrame, shingle: int, tenths: int, simhash_links: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``node`` (one for each different set) of all ``docs``, and the links ``a``, ``b`` between nodes that
    join all sets with a Jaccard similarity of ``tenths``/10 or more; none is lost and none is wrong (by 64-bit hashes).

    ``docs`` is read several times, so its doc_id must be fixed, unique and not null. Pairs that the SimHash operator links
    (``simhash_links``, of distinct ``fp``), and neighbours in each cell of grid(), are checked first; then all other pairs that
    meet in a cell and that these links don't join already.
    """
    names = CELLS.replace(" long", "").split(", ")
    rows = save(_nodes(docs, shingle), "nodes")
    alike = _alike(rows, simhash_links)
    shared = save(_shared(_placed(docs, shingle, tenths)), "shared")
    firsts = rows.groupBy("node").agg(F.min("doc_id").alias("_first"))
    sketches = rows.groupBy("node").agg(*[F.first(k).alias(k) for k in SKETCH])  # a node's rows all have the same
    pairs = lambda table, lags: _by_cell(table, "a long, b long", _pairs_in(tenths, lags)).distinct()
    met = dealt(shared, BLOCK, "node", "n").select(*[F.col(c).cast("long") for c in names[:-1]], F.lit(0).cast("long").alias("at"))
    met = save(met.join(sketches, "node").select(*names, *SKETCH), "sketched")
    discard(shared)
    near = save(alike.union(pairs(met.select(*names, F.col("node").alias("root"), *SKETCH), 1)).distinct(), "pairs")
    links = _verified(near, docs, firsts, shingle, tenths)
    rooted = met.join(components(links), "node", "left").select(*names, F.coalesce("root", "node").alias("root"), *SKETCH)
    more = save(pairs(rooted, None), "pairs")
    rest = save(more.join(near, ["a", "b"], "left_anti"), "rest")
    discard(alike, met, near, more)
    return rows.select("doc_id", "node"), links.union(_verified(rest, docs, firsts, shingle, tenths))
