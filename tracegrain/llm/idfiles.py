"""Token ids of documents in files of independently coded, checksummed blocks, and their way back.

A file is groups of blocks, then an index of its documents, then a trailer. All numbers are little-endian.

* group: ``IDSG``, ids, ids a block, vocabulary (u32 each), for each block its coded bytes and the CRC-32 of its ids as
  u32, a CRC-32 of all this, then the blocks' bytes (see ``idcoder``);
* index: zlib of doc_id (i64), whether that is null (u8) and count of ids (i64) of all documents;
* trailer: bytes of the index, its CRC-32, documents, groups (u64 each), and ``IDSF``.
"""

from __future__ import annotations

import contextlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import idcoder, tokens
from .state import new_path, save

GROUP, FILE, HEAD, TAIL = b"IDSG", b"IDSF", struct.Struct("<4sIII"), struct.Struct("<QQQQ4s")
HELD = idcoder.BLOCK * idcoder.LANES


class Damaged(ValueError):
    """A file's bytes are not what was written."""


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


class Writer:
    """Ids go in document by document; memory is bounded by one group of blocks and the index."""

    def __init__(self, out, vocabulary: int):
        self.out, self.vocabulary, self.groups, self.n = out, vocabulary, 0, 0
        self.held: list[np.ndarray] = []
        self.waiting = 0
        self.docs: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray) -> None:
        """The ``ids`` of some documents end to end, and how many each has."""
        self.docs.append((doc_ids.astype("<i8"), nulls.astype("u1"), counts.astype("<i8")))
        self.held.append(ids.astype(np.int32))
        self.waiting += len(ids)
        if self.waiting >= HELD:
            every = np.concatenate(self.held)
            whole = len(every) - len(every) % HELD
            for a in range(0, whole, HELD):
                self._group(every[a : a + HELD])
            self.held, self.waiting = [every[whole:]], len(every) - whole

    def _group(self, ids: np.ndarray) -> None:
        block = idcoder.block_length(len(ids))
        coded = idcoder.encode(ids, self.vocabulary, block)
        sums = [idcoder.checksum(ids[a : a + block]) for a in range(0, len(ids), block)]
        head = HEAD.pack(GROUP, len(ids), block, self.vocabulary) + np.array([[len(c) for c in coded], sums], "<u4").tobytes()
        self.out.write(head + struct.pack("<I", zlib.crc32(head)) + b"".join(coded))
        self.groups += 1
        self.n += len(ids)

    def close(self) -> int:
        if self.waiting:
            self._group(np.concatenate(self.held))
        columns = [np.concatenate(c) for c in zip(*self.docs, strict=True)] or [np.zeros(0)] * 3
        index = zlib.compress(b"".join(c.tobytes() for c in columns))
        self.out.write(index + TAIL.pack(len(index), zlib.crc32(index), len(columns[0]), self.groups, FILE))
        return self.n


def _index(file) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    end = file.size()
    if end < TAIL.size:
        raise Damaged("the file is too short")
    file.seek(end - TAIL.size)
    size, crc, n, groups, mark = TAIL.unpack(file.read(TAIL.size))
    if mark != FILE or size > end - TAIL.size:
        raise Damaged("the trailer is missing")
    file.seek(end - TAIL.size - size)
    raw = file.read(size)
    if zlib.crc32(raw) != crc:
        raise Damaged("the index has changed")
    raw = zlib.decompress(raw)
    file.seek(0)
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n).astype(bool), np.frombuffer(raw, "<i8", n, 9 * n), groups


def _groups(file, groups: int, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first id, ids) of the blocks that hold places ``begin`` to ``end``; others are passed over."""
    at = 0
    for _ in range(groups):
        head = file.read(HEAD.size)
        mark, n, block, vocabulary = HEAD.unpack(head)
        if mark != GROUP or not block:
            raise Damaged("no group begins here")
        blocks = -(-n // block)
        head += file.read(8 * blocks)
        if struct.unpack("<I", file.read(4))[0] != zlib.crc32(head):
            raise Damaged("a group's head has changed")
        sizes, sums = np.frombuffer(head, "<u4", 2 * blocks, HEAD.size).reshape(2, blocks).astype(np.int64)
        a = max(0, (begin - at) // block)
        b = blocks if end is None else min(blocks, max(0, -(-(end - at) // block)))
        if a < b:
            file.seek(file.tell() + int(sizes[:a].sum()))
            coded = [file.read(int(k)) for k in sizes[a:b]]
            file.seek(file.tell() + int(sizes[b:].sum()))
            ids = idcoder.decode(coded, min(n, b * block) - a * block, vocabulary, block)
            for k in range(a, b):
                if idcoder.checksum(ids[(k - a) * block : (k - a + 1) * block]) != sums[k]:
                    raise Damaged(f"block {k} has changed")
            yield at + a * block, ids
        else:
            file.seek(file.tell() + int(sizes.sum()))
        at += n


def read_ids(uri: str, begin: int, end: int) -> np.ndarray:
    """The ids at places ``begin`` to ``end`` (exclusive) of a file; only blocks that hold them are decoded."""
    fs, path = _store(uri)
    with fs.open_input_file(path) as file:
        *_, groups = _index(file)
        parts = [ids[max(0, begin - at) : max(0, end - at)] for at, ids in _groups(file, groups, begin, end)]
    return np.concatenate([np.zeros(0, np.int32), *parts])


def read_documents(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a file's documents in order; memory is bounded by one group and the longest document."""
    fs, path = _store(uri)
    with fs.open_input_file(path) as file:
        doc_ids, nulls, counts, groups = _index(file)
        source, held = _groups(file, groups), np.zeros(0, np.int32)
        at = 0
        for doc_id, null, n in zip(doc_ids.tolist(), nulls.tolist(), counts.tolist(), strict=True):
            if len(held) - at < n:
                parts, have = [held[at:]], len(held) - at
                while have < n:
                    _, ids = next(source, (0, None))
                    if ids is None:
                        raise Damaged("the index has more ids than the blocks")
                    parts.append(ids)
                    have += len(ids)
                held, at = np.concatenate(parts), 0
            yield None if null else doc_id, held[at : at + n]
            at += n


def write_ids(docs: DataFrame, tokenizer: str, cut: type = tokens.WordCut, end_id: int = 2, files: int | None = None, folder: str | None = None) -> DataFrame:
    """Encode ``text``, add ``end_id`` and write all ids in ascending doc_id order to ``files`` files; one row a file:
    part, path, documents, ids.

    Null text is empty and gives the end alone; null ids come first; rows with equal doc_id go by a hash of their text.
    Other columns don't matter, whatever they are called. An empty table gives files without documents, or none. A task
    writes under a name of its own and renames it at its end, so one that is lost and runs again leaves one whole file.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "ids")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, writer, documents = tokens.encoder(tokenizer, cut), None, None, 0
        with contextlib.ExitStack() as held:
            for batch in batches:
                for some in tokens.slices(batch, 1):
                    if writer is None:
                        part = some.column(3)[0].as_py()
                        path = f"{folder}/part-{part:06d}.ids"
                        fs, local = _store(path)
                        fs.create_dir(os.path.dirname(local), recursive=True)
                        own = f"{local}.{uuid.uuid4().hex}"
                        writer = Writer(held.enter_context(fs.open_output_stream(own)), max(coder.vocabulary, end_id + 1))
                    ids, counts = coder.encode(some.column(1))
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    doc_ids = some.column(0)
                    writer.add(ids, doc_ids.fill_null(0).to_numpy(zero_copy_only=False), doc_ids.is_null().to_numpy(zero_copy_only=False), counts + 1)
                    documents += some.num_rows
            n = writer.close() if writer else 0
        coder.rest()
        if writer:
            fs.move(own, local)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "documents": [documents], "ids": [n]}, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    return save(dealt.mapInArrow(write, "part int, path string, documents long, ids long"), "id-files")


def read_files(written: DataFrame) -> DataFrame:
    """Each document of ``write_ids``'s files, read back from them: doc_id, start (ids of all documents before it),
    n_tokens and ids_crc32. A file is a task; the sums before it run over one row a file."""
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = written.select("part", "path", F.coalesce(before, F.lit(0)).alias("start"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = []
                for doc_id, ids in read_documents(path):
                    rows.append((doc_id, start, len(ids), idcoder.checksum(ids)))
                    start += len(ids)
                    if len(rows) == 8192:
                        yield _rows(rows, schema)
                        rows = []
                if rows:
                    yield _rows(rows, schema)

    files = max(1, written.count())
    return placed.repartitionByRange(files, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def round_trip(docs: DataFrame, tokenizer: str, cut: type = tokens.WordCut, end_id: int = 2, files: int | None = None) -> DataFrame:
    """``write_ids`` and ``read_files``: what is stored for each document."""
    return read_files(write_ids(docs, tokenizer, cut, end_id, files))
