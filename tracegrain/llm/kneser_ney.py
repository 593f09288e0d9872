"""LM scoring: an interpolated modified Kneser-Ney bigram model, kept as sorted hash arrays that workers map to memory."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import map_array, new_path, save, store_array
from .wordhash import SPACES, hash_words, mix

START, END = np.uint64(0x5BF03635DE1F8A27), np.uint64(0x9D8A7C1B33A4E5F1)
CHUNK_TOKENS, CHUNK_BYTES, BUCKET_BYTES = 2_000_000, 2 << 20, 48 << 20


def token_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tokens of each text): a 64-bit hash for each word, then END for each text."""
    words, counts = hash_words(texts, SPACES)
    counts = counts + 1
    out = np.full(int(counts.sum()), END, dtype=np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(texts)), counts - 1)] = words
    return out, counts


def contexts(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each token; START before a text's first."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(counts) - counts] = START
    return before


def pair_key(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + ids)


def _text_chunks(texts: list, size: int = CHUNK_BYTES):
    """Texts a few at a time; a chunk is never larger than ``size`` characters or one text."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end] or "") <= size):
            total += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _squeezed(column: np.ndarray) -> bytes:
    """Bytes of one significance together, so that the zeros of small numbers vanish."""
    planes = np.ascontiguousarray(column.view(np.uint8).reshape(len(column), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _widened(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack(rows: list[np.ndarray]) -> list[bytes]:
    """Sorted 64-bit keys as differences, the other columns as they are."""
    return [_squeezed(np.diff(rows[0], prepend=np.uint64(0))), *map(_squeezed, rows[1:])]


def _dealt(key: np.ndarray, columns: list[np.ndarray], buckets: int, schema: pa.Schema) -> pa.RecordBatch:
    """One row for each bucket: the packed columns of the rows whose ``key`` falls into it."""
    order = np.argsort(key, kind="stable")
    edges = np.searchsorted(_bucket(key, buckets)[order], np.arange(buckets + 1))
    out = [[] for _ in schema]
    for b in np.flatnonzero(np.diff(edges)).tolist():
        at = order[edges[b] : edges[b + 1]]
        at = at[np.argsort(columns[0][at], kind="stable")]
        for list_, value in zip(out, (b, *_pack([c[at] for c in columns])), strict=True):
            list_.append(value)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)


def _summed(key: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Rows of equal ``key`` together, in order of it: the key, a place of each, sums of ``columns``."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    sums = [np.add.reduceat(c[order], first, dtype=c.dtype) if len(first) else c[:0] for c in columns]
    return [key[first], order[first], *sums]


@dataclass
class Model:
    """Where the arrays lie, how many there are of each kind, totals and discounts. Its size doesn't grow with the corpus."""

    path: str
    pairs: int
    words: int
    tokens: int
    vocabulary: int
    pair_types: int
    discount: list[float]
    discount1: list[float]
    spare: float


def _discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams that occur 1 to 4 times; plain values where some are missing."""
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.1), k + 0.9) for k, x in enumerate(d)]  # none of all or nothing: every text keeps some probability


def _ones(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].tolist()


def train(docs: DataFrame) -> Model:
    """Count all texts of ``docs`` (text; null: empty) and store the model.

    Tasks count the pairs of their texts and send packed columns by range of the pair's hash; a range's task adds them up,
    stores its sorted array, and sends on what it knows of each word; ranges of word hashes do the same. Hashes spread
    even the most frequent words' pairs over all ranges. The driver gets a few numbers for each range. Repeated rows
    count each time; other columns are not looked at; an empty table gives a model that knows no word.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    word_buckets = max(1, buckets // 4)
    path = new_path(spark, "kneser-ney")
    pair_schema = pa.schema([("bucket", pa.int32()), ("v", pa.binary()), ("w", pa.binary()), ("n", pa.binary())])
    word_names = ["word", "count", "left", "total", "n1", "n2", "n3"]
    word_schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in word_names)])

    def flush(held: list) -> pa.RecordBatch:
        v, w = (np.concatenate(x) for x in zip(*held, strict=True))
        key, at, n = _summed(pair_key(v, w), np.ones(len(v), dtype=np.uint32))
        return _dealt(key, [v[at], w[at], n], buckets, pair_schema)

    def count(batches):
        held, tokens = [], 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _text_chunks(texts):
                ids, counts = token_ids(texts[a:b])
                held.append((contexts(ids, counts), ids))
                tokens += len(ids)
                if tokens >= CHUNK_TOKENS:
                    yield flush(held)
                    held, tokens = [], 0
        if held:
            yield flush(held)

    def add_pairs(group: pa.Table) -> pa.Table:
        v, w, n = ([np.zeros(0, dtype=kind)] for kind in (np.uint64, np.uint64, np.uint32))
        for row in zip(*(group[c].drop_null().to_pylist() for c in "vwn"), strict=True):
            v.append(np.cumsum(_widened(row[0], np.uint64)))
            w.append(_widened(row[1], np.uint64))
            n.append(_widened(row[2], np.uint32))
        v, w = np.concatenate(v), np.concatenate(w)
        key, at, n = _summed(pair_key(v, w), np.concatenate(n).astype(np.uint64))
        v, w, bucket = v[at], w[at], group["bucket"][0].as_py()
        store_array(f"{path}/pair-{bucket}.npy", key)
        store_array(f"{path}/count-{bucket}.npy", n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64))
        one, zero = np.ones(len(v), dtype=np.uint64), np.zeros(len(v), dtype=np.uint64)
        roles = [np.concatenate(c) for c in zip((w, n, one, zero, zero, zero, zero), (v, zero, zero, n, (n == 1), (n == 2), (n > 2)), strict=True)]
        word, _, *sums = _summed(roles[0], *(c.astype(np.uint64) for c in roles[1:]))
        out = _dealt(word, [word, *sums], word_buckets, word_schema)
        coc = ",".join(map(str, _ones(n)))
        return pa.table([*out.columns, pa.array([coc if i == 0 else None for i in range(out.num_rows)], pa.string())], names=[*word_schema.names, "coc"])  # an empty range counts nothing

    def add_words(group: pa.Table) -> pa.Table:
        parts = [[np.zeros(0, dtype=np.uint64)] * len(word_names)]
        parts += [[np.cumsum(_widened(row[0], np.uint64)), *(_widened(x, np.uint64) for x in row[1:])] for row in zip(*(group[c].drop_null().to_pylist() for c in word_names), strict=True)]
        joined = [np.concatenate(c) for c in zip(*parts, strict=True)]
        word, _, *sums = _summed(joined[0], *(c.astype(np.uint64) for c in joined[1:]))
        bucket = group["bucket"][0].as_py()
        store_array(f"{path}/word-{bucket}.npy", word)
        store_array(f"{path}/stats-{bucket}.npy", np.stack(sums, axis=1).astype(np.int64))
        seen = sums[0] > 0
        facts = [int(sums[0].sum()), int(seen.sum()), int(sums[1].sum()), *_ones(sums[1]), int((sums[1] > 2).sum())]
        return pa.table({"facts": pa.array([facts], pa.list_(pa.int64()))})

    def by_bucket(rows: DataFrame, n: int, work, schema: str) -> DataFrame:
        """``work`` on each of the ``n`` buckets. Bucket k is partition k: no task has two. Every bucket has an empty row
        of its own, so that its arrays are stored even if no key falls into it, and a file that isn't there is lost."""
        empty = spark.range(0, n, 1, 1).select(F.col("id").cast("int").alias("bucket"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "bucket"])

        def whole(batches):
            held = [b for b in batches if b.num_rows]
            if held:
                yield from work(pa.Table.from_batches(held)).to_batches()

        return rows.unionByName(empty).repartitionById(n, "bucket").mapInArrow(whole, schema)

    blobs = docs.select("text").mapInArrow(count, "bucket int, v binary, w binary, n binary")
    ranges = by_bucket(blobs, buckets, add_pairs, "bucket int, " + ", ".join(f"{c} binary" for c in word_names) + ", coc string")
    ranges = save(ranges, "kneser-ney-words")
    coc = ranges.where("coc is not null").select(*[F.sum(F.split("coc", ",")[k].cast("long")) for k in range(4)]).first()
    facts = by_bucket(ranges.where("word is not null").drop("coc"), word_buckets, add_words, "facts array<long>")
    total = facts.select(*[F.sum(F.col("facts")[k]) for k in range(8)]).first()
    total, coc = [x or 0 for x in total], [x or 0 for x in coc]
    d1 = _discounts(total[3:7])
    spare = (d1[0] * total[3] + d1[1] * total[4] + d1[2] * total[7]) / max(1, total[2])  # what discounting frees
    return Model(path, buckets, word_buckets, total[0], total[1], total[2], _discounts(coc), d1, spare)


class Arrays:
    """The model's arrays as one worker sees them; looked up by many keys at once."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def _get(self, kind: str, bucket: int):
        name = f"{self.model.path}/{kind}-{bucket}.npy"
        if name not in self.open:
            self.open[name] = map_array(name)  # every range has its file: one that is lost is an error
        return self.open[name]

    def find(self, keys: np.ndarray, kind: str, values: str, buckets: int, width: int = 1) -> np.ndarray:
        """Values of each key, zeros where it is unknown. Sorted keys walk each array once, in order."""
        unique, back = np.unique(keys, return_inverse=True)
        out = np.zeros((len(unique), width), dtype=np.int64)
        edges = np.searchsorted(_bucket(unique, buckets), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            have = self._get(kind, b)
            if not len(have):
                continue
            q = unique[edges[b] : edges[b + 1]]
            at = np.minimum(np.searchsorted(have, q), len(have) - 1)
            hit = np.flatnonzero(have[at] == q)
            out[edges[b] + hit] = np.asarray(self._get(values, b)[at[hit]]).reshape(len(hit), width)
        return out[back]

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and log10 probability of each text."""
        m = self.model
        ids, counts = token_ids(texts)
        before = contexts(ids, counts)
        word = self.find(ids, "word", "stats", m.words, 6)
        # a text's first token follows START, each other one the token before it
        first = np.cumsum(counts) - counts
        prior = np.empty_like(word)
        prior[1:] = word[:-1]
        prior[first] = self.find(np.array([START]), "word", "stats", m.words, 6)[0]
        c = self.find(pair_key(before, ids), "pair", "count", m.pairs)[:, 0]
        d0, d1 = np.array([0.0, *m.discount]), np.array([0.0, *m.discount1])
        left, total = word[:, 1], prior[:, 2]
        flat = 1.0 / (m.vocabulary + 1)
        if m.pair_types:
            lower = np.maximum(left - d1[np.minimum(left, 3)], 0) / m.pair_types + m.spare * flat
        else:
            lower = np.full(len(ids), flat)
        some = np.maximum(total, 1)
        spare = np.where(total > 0, (prior[:, 3:] @ np.array(m.discount)) / some, 1.0)
        p = np.maximum(c - d0[np.minimum(c, 3)], 0) / some + spare * lower
        base = np.log10((word[:, 0] + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1)))
        add = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
        return counts, add((word[:, 0] > 0).astype(np.int64)), add(base), add(np.log10(p))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for every row; null text: only the end token."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        arrays = Arrays(model)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _text_chunks(texts, CHUNK_BYTES):
                n, known, base, full = arrays.scores(texts[a:b])
                cols = [ids.slice(a, b - a), n, known, np.full(b - a, model.tokens), base, full]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from four fifths of ``docs`` by doc_id, score every row. A null doc_id is learned from."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    model = train(docs.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
