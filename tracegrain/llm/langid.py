"""Language ID: TF-IDF n-gram vectors against several centroids per language, by cosine, with rejection by distance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .state import save

BINS = 1 << 13
CENTROIDS, PER_LANGUAGE = 4, 400
MARGIN, CLASSES = 0.8, 24
LOW, CUTS = 0.01, 100
SPACE = bytes(32 if c < 65 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))
PIECE = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of the text's byte 2- and 3-grams, hashed to BINS; case, ASCII digits, marks and space are levelled."""
    counts = np.zeros(BINS, dtype=np.float64)
    body = b" ".join((text or "").lower().encode().translate(SPACE).split())
    raw = np.frombuffer(b" " + body + b" ", dtype=np.uint8)
    for at in range(0, max(0, len(raw) - 2), PIECE):
        b = raw[at : at + PIECE + 2].astype(np.uint32)
        two = b[:-2] * np.uint32(256) + b[1:-1]
        three = two * np.uint32(256) + b[2:]
        for k, codes in ((1, two), (2, three)):
            h = (codes * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(32 - 13)
            counts += np.bincount(h, minlength=BINS)
    return counts


def vector(text: str | None, idf: np.ndarray) -> np.ndarray:
    """The unit TF-IDF vector, with tf damped to 1 + ln(tf); zero for a text without n-grams."""
    c = gram_counts(text)
    v = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * idf
    return v / (np.linalg.norm(v) or 1)


@dataclass
class Model:
    """Languages, the centroids' owners and unit vectors, idf, and the least cosine by language and log2 of the text's length."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language or ``und``, cosine to the nearest centroid, rejected)."""
        if not has_letter(text) or not len(self.owner):
            return "und", 0.0, True
        near = self.centroids @ vector(text, self.idf)
        k = int(near.argmax())
        score = float(min(1.0, max(0.0, near[k])))
        return self.languages[self.owner[k]], score, score < self.least[self.owner[k], size_class(text)]


def size_class(text: str) -> int:
    return min(CLASSES - 1, len(text).bit_length())


def _clusters(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Spherical k-means: unit centroids of the rows of ``x``."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(12):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of ``docs`` each bin occurs: added up within partitions, then over at most BINS bins."""

    def count(batches):
        total, n = np.zeros(BINS, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                total += gram_counts(t.as_py()) > 0
                n += 1
        yield pa.RecordBatch.from_pydict({"bin": pa.array(range(-1, BINS), pa.int32()), "n": pa.array([n, *total.tolist()], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    found = {r.bin: r.n for r in rows}  # BINS + 1 rows, whatever the input
    return np.array([found.get(b, 0) for b in range(BINS)], dtype=np.float64), found.get(-1, 0)


def _sample(good: DataFrame, per_language: int) -> DataFrame:
    """The ``per_language`` different texts of least hash of each language, or all its texts if it has fewer.

    Hashes are counted by their first 16 bits, which tells up to where the least ones lie; only those are ranked. So a
    language that most rows have gathers no more in one task than another.
    """
    keyed = good.withColumn("_key", F.xxhash64("text")).withColumn("_high", F.shiftright("_key", 48))
    seen = save(keyed.select("lang", "_high", "_key").distinct(), "hashes")
    upto = Window.partitionBy("lang").orderBy("_high")
    counts = seen.groupBy("lang", "_high").agg(F.count("*").alias("_n")).select("lang", "_high", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    low = seen.join(counts.where(F.col("_before") < per_language), ["lang", "_high"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_key"))
    few = save(low.withColumn("_rank", rank).where(F.col("_rank") <= per_language).select("lang", "_key"), "least-hashes")
    return keyed.join(F.broadcast(few), ["lang", "_key"]).dropDuplicates(["lang", "_key"]).select("lang", "text")


def _low_cosines(texts: list[str], vectors: np.ndarray, idf: np.ndarray, centroids: int) -> np.ndarray:
    """The LOW quantile, by size class, of the cosines of the texts and of cuts of them of every size.

    Each half of the texts is held against centroids of the other half, so what is measured are unseen texts. A class
    of fewer than CUTS cuts is pooled with its nearest classes, shorter ones first, until it has them.
    """
    found: list[list[float]] = [[] for _ in range(CLASSES)]
    half = np.arange(len(texts)) % 2
    sides = [_clusters(vectors[half != s] if len(texts) > 1 else vectors, centroids) for s in (0, 1)]
    for i, t in enumerate(texts):
        for size in (None, *(1 << k for k in range(14))):
            if size is not None and size >= len(t):
                break
            start = (i * 7919) % (len(t) - size) if size else 0
            cut = t if size is None else t[start : start + size]
            if has_letter(cut):
                found[size_class(cut)].append(float((sides[half[i]] @ vector(cut, idf)).max()))
    least = np.ones(CLASSES)
    for k in range(CLASSES):
        pool: list[float] = []
        for j in sorted(range(CLASSES), key=lambda j: (abs(j - k), j)):
            pool += found[j]
            if len(pool) >= CUTS:
                break
        least[k] = np.quantile(pool, LOW)
    return least


def _fit_language(idf: np.ndarray, centroids: int):
    schema = pa.schema([("lang", pa.string()), ("centroid", pa.binary()), ("least", pa.list_(pa.float64()))])

    def one(rows: pa.Table) -> pa.Table:
        texts = [t for t in rows["text"].to_pylist() if has_letter(t)]
        if not texts:
            return schema.empty_table()
        vectors = np.stack([vector(t, idf) for t in texts])
        c = _clusters(vectors, centroids)
        least = _low_cosines(texts, vectors, idf, centroids)
        return pa.table({"lang": [rows["lang"][0].as_py()] * len(c), "centroid": [x.tobytes() for x in c.astype(np.float32)], "least": [least.tolist()] * len(c)}, schema=schema)

    return one


def fit(docs: DataFrame, lang_col: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, margin: float = MARGIN) -> Model:
    """Learn from ``docs`` (text, lang). Document frequencies count every row with a language; each language's
    centroids are fitted, in a task of its own, on at most ``per_language`` of its different texts; every language
    is learned.

    A text is rejected if its cosine is under ``margin`` times what all but LOW of the sampled texts, and cuts of them,
    of its size class and nearest language have. Rows with null text or language, or without letters, teach nothing; if no row
    teaches, every text is ``und``.
    """
    good = docs.select("text", F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = _frequencies(good)
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = _sample(good, per_language).groupBy("lang").applyInArrow(_fit_language(idf, centroids), "lang string, centroid binary, least array<double>").collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.centroid))
    languages = sorted({r.lang for r in rows})  # at most ``centroids`` rows of BINS floats a language
    owner = np.array([languages.index(r.lang) for r in rows], dtype=np.int64)
    vectors = np.frombuffer(b"".join(r.centroid for r in rows), dtype=np.float32).reshape(-1, BINS)
    own = {r.lang: r.least for r in rows}
    least = np.array([own[lang] for lang in languages]).reshape(-1, CLASSES)
    return Model(languages, owner, vectors, idf, margin * least)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def _judged(docs: DataFrame, model: Model, keep_only: bool) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # CENTROIDS * BINS floats a language at most
    extra = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("rejected", pa.bool_())]

    def judge(batches):
        for batch in batches:
            found = [shared.value.judge(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
            if keep_only:
                yield batch.filter(pa.array([not x[2] for x in found], pa.bool_()))
                continue
            cols = [pa.array([x[j] for x in found], f.type) for j, f in enumerate(extra)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema=pa.schema([*batch.schema, *extra]))

    schema = StructType(docs.schema.fields if keep_only else [*docs.schema.fields, *(StructField(n, t()) for n, t in (("lang_pred", StringType), ("score", DoubleType), ("rejected", BooleanType)))])
    return docs.mapInArrow(judge, schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (without columns of these names) with lang_pred, score, rejected; only ``text`` is looked at."""
    return _judged(docs.drop("lang_pred", "score", "rejected"), model, False)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text the model doesn't reject."""
    return _judged(docs, model, True)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from three quarters of ``docs`` by doc_id and predict every row. A null doc_id isn't held out, nor learned from.

    A text without a letter is ``und`` with score 0; of equally near centroids the first by language's name counts;
    repeated rows each get a row; an empty table gives an empty one."""
    out = F.coalesce(held_out(), F.lit(False))
    model = fit(docs.where(~held_out()))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
