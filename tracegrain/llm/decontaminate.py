"""Benchmark decontamination: Wu-Manber search of documents for windows of benchmark words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import map_array, new_path, save, store_array
from .wordhash import hash_words, mix

WINDOW = 10
BLOCK_BYTES, CHUNK_BYTES, LANE = 16 << 20, 1 << 20, 256
ARRAYS = ["words", "block", "shift", "window", "place", "first", "item", "name", "name_end"]
#: Letters A-Z become small, digits, a-z and bytes of other alphabets stay, all else parts words.
PARTS = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])
HIGH = np.uint64(0xFFFFFFFF00000000)


def _block_hash(ids: np.ndarray, end: np.ndarray, m: int) -> np.ndarray:
    """The hash of the two words up to ``end`` (one, if patterns have one word)."""
    return mix(ids[end - 1] * np.uint64(0x9E3779B97F4A7C15) + ids[end]) if m > 1 else ids[end]


def _window_key(ids: np.ndarray, end: np.ndarray, m: int) -> np.ndarray:
    """A test string's place among all: the hash of its last block, then a hash of all its words, 32 bits each."""
    whole = np.zeros(len(end), dtype=np.uint64)
    for k in range(m):
        whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + ids[end - k])
    return (_block_hash(ids, end, m) & HIGH) | (whole >> np.uint64(32))


def _tables(names: list[str], texts: list[str], window: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(pattern length, arrays) for the windows of the items; texts without words give none.

    ``block``, ``shift``: each block of words and how far the search may go on from it; a block that isn't there is in
    no pattern. ``window``: keys of the different windows, by their last block; ``place``: where in ``words`` one ends;
    ``first``, ``item``: the items that have it.
    """
    ids, counts = hash_words(texts, PARTS)
    begin = np.cumsum(counts) - counts
    raw = [n.encode() for n in names]
    known = {"words": ids, "name": np.frombuffer(b"".join(raw), dtype=np.uint8), "name_end": np.cumsum([len(r) for r in raw])}
    for m in range(1, window + 1):
        mine = np.flatnonzero(counts >= window if m == window else counts == m)
        if not len(mine):
            continue
        step = min(m, 2)
        owner = np.repeat(mine, counts[mine])
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts[mine]) - counts[mine], counts[mine])
        at = begin[owner] + within
        block = _block_hash(ids, at[within >= step - 1], m)
        shift = np.maximum(0, m - 1 - within[within >= step - 1])
        order = np.lexsort((shift, block))
        least = order[np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0]))]
        end, own = at[within >= m - 1], owner[within >= m - 1]
        key = _window_key(ids, end, m)
        order = np.lexsort((own, key))
        key, end, own = key[order], end[order], own[order]
        once = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(own) != 0)])
        key, end, own = key[once], end[once], own[once]
        first = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
        yield m, known | {"block": block[least], "shift": shift[least].astype(np.uint8), "window": key[first], "place": end[first], "first": np.append(first, len(key)), "item": own.astype(np.int32)}


class Tables:
    """The arrays for one pattern length, as a worker maps them."""

    def __init__(self, length: int, arrays: dict[str, np.ndarray]):
        self.m, self.a = length, arrays
        self.far = max(1, length - 1)

    def names(self, windows: np.ndarray) -> set[str]:
        """The items that have one of ``windows``."""
        found: set[int] = set()
        for w in np.unique(windows).tolist():
            found.update(self.a["item"][self.a["first"][w] : self.a["first"][w + 1]].tolist())
        ends = self.a["name_end"]
        return {self.a["name"][(ends[i - 1] if i else 0) : ends[i]].tobytes().decode() for i in found}

    def find(self, ids: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, window) of each occurrence in the texts that start at ``begin`` in ``ids``, in order.

        All texts are searched at once, in lanes of LANE places where an occurrence may end. A lane looks at one block of
        words and goes on as far as its shift allows: without a pattern near, at most places nothing is looked up.
        """
        m, block, shift = self.m, self.a["block"], self.a["shift"]
        spots = np.maximum(0, counts - m + 1)
        lanes = -(-spots // LANE)
        text = np.repeat(np.arange(len(counts)), lanes)
        at = begin[text] + m - 1 + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(at + LANE, begin[text] + counts[text])
        ends = [np.zeros(0, dtype=np.int64)]
        while len(at):
            h = _block_hash(ids, at, m)
            k = np.minimum(np.searchsorted(block, h), len(block) - 1)
            go = np.where(block[k] == h, shift[k], self.far).astype(np.int64)
            ends.append(at[go == 0])
            at = at + np.maximum(go, 1)
            at, stop = at[at < stop], stop[at < stop]
        end = np.sort(np.concatenate(ends))
        key = _window_key(ids, end, m)
        w = np.minimum(np.searchsorted(self.a["window"], key), len(self.a["window"]) - 1)
        same = self.a["window"][w] == key
        end, w = end[same], w[same]
        for k in range(m):  # word by word
            same = ids[end - k] == self.a["words"][self.a["place"][w] - k]
            end, w = end[same], w[same]
        return end, w


def build(bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[tuple[str, int]]:
    """Store the tables of ``bench`` (item_id, text) and return (path, pattern length) of each.

    Different items are dealt by hash to blocks of about ``block_bytes`` of text. A task builds a block's tables in some 20
    times the memory of its text; workers map them (6 times the text), so what they hold is shared and can be dropped. A null item_id is
    called ``null``. The driver gets at most ``window`` rows a block.
    """
    spark = bench.sparkSession
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = save(items, "benchmark")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    path = new_path(spark, "wu-manber")

    def make(rows: pa.Table) -> pa.Table:
        made = []
        for m, arrays in _tables(rows["item_id"].to_pylist(), rows["text"].to_pylist(), window):
            made.append((f"{path}/{rows['_block'][0].as_py()}-{m}", m))
            for name in ARRAYS:
                store_array(f"{made[-1][0]}/{name}.npy", arrays[name])
        return pa.table({"path": pa.array([p for p, _ in made], pa.string()), "m": pa.array([m for _, m in made], pa.int32())})

    dealt = items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    return sorted((r.path, r.m) for r in dealt.groupBy("_block").applyInArrow(make, "path string, m int").collect())


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Texts a few at a time: of CHUNK_BYTES characters or one text at most."""
    at = 0
    while at < len(texts):
        end, total = at + 1, len(texts[at] or "")
        while end < len(texts) and total + len(texts[end] or "") <= CHUNK_BYTES:
            total += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def scan(texts: list[str | None], tables: list[Tables]) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """Of each text: its words, the places of hit words as disjoint runs [start, end, ...], the items found."""
    ids, counts = hash_words(texts, PARTS)
    begin = np.cumsum(counts) - counts
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    items: dict[int, set[str]] = {}
    for t in tables:
        end, w = t.find(ids, begin, counts)
        np.add.at(edge, end - t.m + 1, 1)
        np.add.at(edge, end + 1, -1)
        owner = np.searchsorted(begin + counts, end, side="right")
        for d in np.unique(owner).tolist():
            items.setdefault(d, set()).update(t.names(w[owner == d]))
    hit = np.cumsum(edge[:-1]) > 0
    runs: list[list[int]] = [[] for _ in texts]
    for d in items:
        own = np.concatenate([[False], hit[begin[d] : begin[d] + counts[d]], [False]])
        runs[d] = np.flatnonzero(own[1:] != own[:-1]).tolist()
    return counts, runs, [sorted(items.get(d, ())) for d in range(len(texts))]


def mark(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """For every row of ``docs``: ``doc``, a struct of its columns (those of ``carry``), ``n_words``, ``runs`` (hit word
    places) and ``items``.

    Null or empty text: no words. Equal items all count; an empty benchmark finds nothing, an empty table gives an empty
    one, and repeated rows are each marked. A map over the documents in one pass, whatever the benchmark's size: nothing
    of them is shuffled. Matching is by 64-bit hashes of words.
    """
    carry = docs.columns if carry is None else carry
    built = build(bench, window, block_bytes)
    spec = pa.schema([("n_words", pa.int64()), ("runs", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    def search(batches):
        tables = [Tables(m, {name: map_array(f"{path}/{name}.npy") for name in ARRAYS}) for path, m in built]
        for batch in batches:
            texts = batch.column(1).to_pylist() if batch.num_columns > 1 else batch.column(0).field("text").to_pylist()
            out: list[list] = [[], [], []]
            for a, b in _chunks(texts):
                for have, new in zip(out, scan(texts[a:b], tables), strict=True):
                    have.extend(new)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(out, spec, strict=True))], names=["doc", *spec.names])

    rows = docs.select(F.struct(*carry).alias("doc"), *([] if "text" in carry else [F.col("text").alias("t")]))
    kept = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(search, f"doc {kept}, n_words long, runs array<int>, items array<string>")


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns, whatever these are called. Null and
    empty texts stay, repeated rows go or stay together, and an empty benchmark or table takes nothing out."""
    return mark(docs, bench, window).where(F.size("runs") == 0).select("doc.*")


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: its words, hit words, items found and their digest; a null text has no words."""
    marked = mark(docs, bench, window, block_bytes, ["doc_id"])
    hit = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("s")), lambda s, x: F.struct((s["n"] + s["s"] * x).alias("n"), (-s["s"]).alias("s")), lambda s: s["n"])
    return marked.select("doc.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))
