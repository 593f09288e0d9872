"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .state import save

LENGTH, GROUP = 1024, 8192


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, cut: type = tokens.SpaceCut) -> DataFrame:
    """Each document's ids and one id 0, cut every ``length`` ids: doc_id, start, length, ids_crc32, doc_tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def cut_up(batches):
        coder = tokens.encoder(tokenizer, cut)
        for batch in batches:
            for some in tokens.slices(batch, 1):
                ids, counts = coder.encode(some.column(1))
                ids, counts = np.insert(ids, np.cumsum(counts), 0).astype("<u4"), counts + 1
                parts = -(-counts // length)
                doc = np.repeat(np.arange(len(counts)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * length
                sizes = np.minimum(length, counts[doc] - start)
                begin, view = (np.cumsum(counts) - counts)[doc] + start, memoryview(ids)
                sums = [zlib.crc32(view[a:b]) for a, b in zip(begin.tolist(), (begin + sizes).tolist(), strict=True)]
                columns = [some.column(0).take(pa.array(doc)), pa.array(start), pa.array(sizes), pa.array(sums, pa.int64()), pa.array(counts[doc])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        coder.rest()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut_up, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size; sizes go in decreasing order, ties as given, each to the first bin with room.

    The tree's leaves are the bins' free places and each inner node the most free below it, so the first bin
    that fits is found, and its path mended, in log2(bins) steps.
    """
    n = len(sizes)
    leaves = 1 << max(0, int(n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        need, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        node >>= 1
        while node:
            best = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == best:
                break
            tree[node] = best
            node >>= 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """All pieces with ``sequence_id`` and ``offset``; sequences hold at most ``length`` ids.

    Pieces are stored, then dealt at random, by a hash of their stored row, to groups of about ``group``: a group's
    size depends on no key or source, and every group is packed by itself. Null or empty text: only id 0. Rows with
    equal or null doc_id are packed like any others; an empty table gives no piece.
    """
    stored = save(pieces(docs, tokenizer, length).withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-stored.count() // group))
    dealt = stored.withColumn("_group", F.pmod(F.xxhash64("_uid"), F.lit(groups)))

    def fit(part: pa.Table) -> pa.Table:
        part = part.sort_by("_uid")
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), length)
        ids = pa.array((part["_group"].to_numpy() << 32) + bins)
        return part.drop_columns(["_uid", "_group"]).append_column("sequence_id", ids).append_column("offset", pa.array(offsets))

    return dealt.groupBy("_group").applyInArrow(fit, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
