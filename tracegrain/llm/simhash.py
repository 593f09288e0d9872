"""SimHash near-dedup: fingerprints, a segment-popcount embedding, a grid range-join under its Manhattan bound, exact checks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .components import components
from .state import save, small_batches

SHINGLE, BITS = 4, 4
SEGMENTS, SEGMENT_ENTROPY = 32, 1.5  # two-bit segments of a fingerprint, and the bits that a segment's popcount tells
IN_A_CELL = 64
STAGE_SHINGLE, STAGE_TENTHS = 5, 8
CELL = 4096
AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The text's SimHash of 64 bits; zero if it has no word. Shingles are hashed in blocks of fixed size."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space parts
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, AT_ONCE):
        end = min(n, at + AT_ONCE)
        h = np.fromiter((digest(join(words[i : i + shingle]), 42) for i in range(at, end)), dtype=np.uint64, count=end - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every document."""

    def make(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "doc_id long, fp long")


LOW_BITS = np.uint64(0x5555555555555555)


def embed(fp: np.ndarray) -> np.ndarray:
    """The popcounts of a fingerprint's 32 two-bit segments, each written as that many ones in its two bits: 00, 01, 11.

    So written, the Manhattan distance between two embeddings is the number of their differing bits. It never exceeds
    the Hamming distance between the fingerprints, as sorting two bits brings no two segments further apart.
    """
    u = fp.view(np.uint64)
    high = (u >> np.uint64(1)) & LOW_BITS
    low = u & LOW_BITS
    return (low | high) | ((low & high) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance between embeddings: the lower bound of what their fingerprints differ by."""
    return np.bitwise_count(a ^ b).astype(np.int64)


def groups_for(n: int, bits: int = BITS) -> int:
    """Into how many groups the segments of ``n`` fingerprints are parted, so that a cell holds about IN_A_CELL of
    unrelated ones. Every number of groups over ``bits`` finds all links; more of them mean smaller but more cells."""
    groups = bits + 2
    while groups < 3 * bits and n / 2 ** (SEGMENT_ENTROPY * SEGMENTS * (groups - bits) / groups) > IN_A_CELL:
        groups += 1
    return groups


def _grid(fp: np.ndarray, bits: int, groups: int):
    """Every cell of the fingerprints in the grid over the embedding.

    Within Manhattan distance ``bits`` at most that many of the groups of segments differ, so two linked fingerprints
    agree in the popcounts of at least groups - bits of them: a cell fixes one choice of such groups and their popcounts,
    and the range over the other groups is joined within the cell.
    """
    codes = embed(fp)
    edges = np.linspace(0, SEGMENTS, groups + 1).round().astype(int)
    keys = [(codes >> np.uint64(2 * a)) & np.uint64((1 << 2 * (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    for k, pick in enumerate(combinations(range(groups), groups - bits)):
        cell = np.full(len(fp), k, dtype=np.uint64)
        for g in pick:
            cell = (cell ^ keys[g]) * np.uint64(0x9E3779B97F4A7C15)  # a collision only makes a cell larger
            cell ^= cell >> np.uint64(29)
        yield cell


def _placed(classes: DataFrame, bits: int, groups: int) -> DataFrame:
    """Each fingerprint in each of its cells."""

    def place(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for cell in _grid(fp, bits, groups) if len(fp) else ():
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), batch.column(0)], names=["cell", "fp"])

    return classes.select("fp").mapInArrow(place, "cell long, fp long")


def _links_in(ids: np.ndarray, side: np.ndarray, run: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within each run of one cell; between two blocks only pairs across count.

    A range join: rows of a run come in the order of the sum of all their popcounts, which two linked rows have within
    ``bits`` of each other, so a row meets only those that far ahead. Pairs within Manhattan distance ``bits`` are then
    verified on the fingerprints. Pairs that are joined already are not compared again.
    """
    sums = np.bitwise_count(ids.view(np.uint64)).astype(np.int64)
    order = np.lexsort((ids, sums, run))
    ids, side, run, sums = ids[order], side[order], run[order], sums[order]
    fp = ids.view(np.uint64)
    codes = embed(fp)
    out, n, lag = [], len(ids), 1
    part = np.arange(n)
    at = np.arange(n)
    while True:
        at = at[at + lag < n]
        at = at[(run[at] == run[at + lag]) & (sums[at + lag] - sums[at] <= bits)]
        if not len(at):
            return out
        a = at[(part[at] != part[at + lag]) & ((side[at] < 0) | (side[at] != side[at + lag]))]
        a = a[manhattan(codes[a], codes[a + lag]) <= bits]
        a = a[np.bitwise_count(fp[a] ^ fp[a + lag]) <= bits]
        if len(a):
            top = np.arange(n)
            for x in a.tolist():
                p, q = _top(top, part[x]), _top(top, part[x + lag])
                if p != q:
                    top[max(p, q)] = min(p, q)
                    out.append((int(ids[x]), int(ids[x + lag])))
            while (up := top[top] != top).any():
                top[up] = top[top[up]]
            part = top[part]
        lag += 1


def _top(top: np.ndarray, x: int) -> int:
    while top[x] != x:
        x = top[x]
    return x


def links(classes: DataFrame, bits: int = BITS, groups: int | None = None, cell_rows: int = CELL) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (fp) that join all parts within ``bits`` differing bits; none is
    lost. Those that meet in a cell give spanning forests, never all pairs. No task holds more than two blocks of a cell."""
    parts = groups or groups_for(classes.count(), bits)
    met = jaccard.dealt(_placed(classes, bits, parts), cell_rows, "fp").repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q", "fp")

    def runs(rows: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])
        found = _links_in(rows[4], rows[3], np.cumsum(new), bits)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def compare(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(j).to_numpy().astype(np.int64) for j in range(batch.num_columns)])
            if held:
                rows = np.concatenate([*held, rows], axis=1)
            n = rows.shape[1]
            if not n:
                continue
            same = (rows[:3] == rows[:3, -1:]).all(axis=0)
            last = 0 if same.all() else n - int(same[::-1].argmin())
            held = [rows[:, last:]]  # the last cell may go on in the next batch
            if last:
                yield runs(rows[:, :last])
        if held:
            yield runs(held[0])

    return met.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, groups: int | None = None) -> DataFrame:
    """doc_id, ``fp`` and ``component_id`` (the least doc_id reachable over links) for every row of ``docs``.

    Other columns are not looked at; an empty table gives an empty one; repeated rows each get a row. Equal fingerprints are one class, so copies are never compared with each other. Null and empty texts have
    fingerprint zero and link like any other; a null doc_id is never a component's name unless all its rows have none.
    """
    rows = save(fingerprints(docs, shingle), "fingerprints")
    classes = save(rows.groupBy("fp").agg(F.min("doc_id").alias("_first")), "classes")
    return _named(rows, classes, "fp", components(links(classes, bits, groups))).select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, shingle: int = STAGE_SHINGLE, tenths: int = STAGE_TENTHS) -> DataFrame:
    """doc_id (unique, not null) and ``component_id``: the least doc_id reachable over pairs of documents whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more. Every such pair is a link, and no other is: the links of
    links() are verified first, and jaccard.grid() brings those that 64 bits cannot tell."""
    with small_batches(docs.sparkSession):  # all that sends texts to Python is stored here
        rows, joined = jaccard.linked(docs, shingle, tenths, links)
    classes = save(rows.groupBy("node").agg(F.min("doc_id").alias("_first")), "classes")
    return _named(rows, classes, "node", components(joined)).select("doc_id", "component_id")


def _named(rows: DataFrame, classes: DataFrame, key: str, parts: DataFrame) -> DataFrame:
    """``rows`` with component_id. Only classes with links are gathered by root; others are named at once."""
    parts = parts.select(F.col("node").alias("_node"), "root")
    named = classes.join(parts, classes[key] == parts["_node"], "left").select(key, F.coalesce("root", key).alias("_root"), "_first")
    least = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    names = save(named.join(least, "_root").select(key, "component_id"), "names")
    return rows.join(names, key, "left")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of similar_documents(): that of its least doc_id; equal ids keep one row.

    A component whose ids are all null keeps one of its rows. All columns of ``docs`` stay.
    """
    marked = save(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("_doc")), "dedup-in")
    rows = marked.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text"))
    ids = marked.select("_row", F.col("_doc.doc_id").alias("_id"))
    found = similar_documents(rows).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_part"))
    best = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row")))
    kept = found.join(ids, "_row").groupBy("_part").agg(best.alias("_best")).select(F.col("_best._row").alias("_row"))
    return marked.join(kept, "_row", "left_semi").select("_doc.*")


def near_duplicate_documents(docs: DataFrame) -> DataFrame:
    """near_duplicates() with the fingerprint as 16 lower-case hex digits. Other columns don't matter, whatever they are called."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
