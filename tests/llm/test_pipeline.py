"""The stages on the smallest tables, with planted rows."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_corpus_operators import _contamination, _line_dedup, words
from tokenizers import Tokenizer

from tracegrain.llm import jaccard, simhash, state
from tracegrain.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.save(stage(spark, docs, SF), name)
        assert docs.columns == names
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_planted_rows(spark):
    """What each stage must do to rows planted for it; nulls, repeated rows and columns of any name do no harm."""
    r = np.random.default_rng(12)
    own = spark.read.parquet(f"{SF}/documents.parquet")
    clean = own.where("lang IS NOT NULL AND n_chars BETWEEN 900 AND 3000").orderBy("n_chars", "doc_id").select("text", "lang").distinct().limit(8).collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first().text
    fresh = [" ".join(f"{a}{b}" for a, b in zip(x.text.split(), x.text.split()[1:], strict=False)) for x in clean[:3]]
    near = fresh[0].split()
    near[len(near) // 2] = "andere"
    passage = " ".join(fresh[2].split()[:60])
    planted = {
        90001: "".join(map(chr, r.integers(0x4E00, 0x9000, 400))), 90002: None, 90003: "", 90004: fresh[0], 90005: " ".join(near), 90006: fresh[0], 90007: f"{fresh[1]} {bench}",
        90008: f"{passage}\n{fresh[1]}", 90009: f"{' '.join(fresh[2].split()[70:])}\n{passage}",
    }
    rows = [(k, t, "en", "x", len(t or ""), 7, "a", "b", 3) for k, t in planted.items()] + [(90004, fresh[0], "en", "x", 1, 7, "a", "b", 3), (None, None, None, None, None, None, None, None, None)]
    extra = ["_removed int", "_row string", "_part string", "doc int"]
    docs = own.select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in extra])
    docs = docs.union(spark.createDataFrame(rows, docs.schema)).repartition(5)
    seen, kept = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.save(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns
        seen.append({x.doc_id: x for x in kept.where("doc_id > 90000 OR doc_id IS NULL").collect()})
    language, lines, near_, clean_ = seen
    assert not {90001, 90002, 90003, None} & set(language) and {90004, 90005, 90007} <= set(language)
    assert set(lines) == set(language) and passage in lines[90008].text and passage not in lines[90009].text and lines[90004]["_removed"] == 7
    assert 90004 in near_ and not {90005, 90006} & set(near_) and {90007, 90008, 90009} <= set(near_)
    assert 90007 not in clean_ and {90004, 90008, 90009} <= set(clean_)
    assert kept.where("doc_id = 90004").count() == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_pipeline_by_brute_force(spark):
    """What the language stage keeps goes through the other four written out: all windows of lines, all pairs of shingle sets,
    all benchmark windows, and each text's ids from the tokenizer."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = corpus_pipeline.save(corpus_pipeline.STAGES[0][1](spark, docs, SF), "known")
    lines = list(_line_dedup(known))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for _, t in lines)]
    top = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    least = {}
    for i, t in enumerate(top):
        least[t] = min(least.get(t, lines[i]), lines[i], key=lambda x: x[0])
    apart = [(d, t or "") for d, t in least.values()]
    bench = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {x[0] for x in _contamination(apart, bench) if x[5]}
    tok, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for d, t in apart:
        if d not in dirty:
            ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
            want.update((d, a, min(1024, len(ids) - a), zlib.crc32(ids[a : a + 1024].tobytes()), len(ids)) for a in range(0, len(ids), 1024))
    got = corpus_pipeline.run(spark, SF)
    assert Counter(tuple(r) for r in got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()) == want
    assert dirty and len(apart) < len(lines)


def test_texts_are_taken_out_of_batches_in_pieces():
    batch = pa.RecordBatch.from_pydict({"a": list(range(1000))})
    parts = list(jaccard._parts(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= jaccard.TEXTS < 1000
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(1000))


def test_near_dedup_sends_texts_in_small_batches(spark, monkeypatch):
    """By default 10,000 rows of text are one batch, up to 64 MB outside the heap of an executor for each task."""
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, store = spark.conf.get(key), jaccard.save
    monkeypatch.setattr(jaccard, "save", lambda df, label: seen.append(spark.conf.get(key)) or store(df, label))
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word"), F.col("id") % 4, F.lit(" ")), 30_000).alias("text"))
    assert simhash.deduplicate(docs).count() == 4
    assert set(seen) == {str(state.BATCH)} and spark.conf.get(key) == before

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    with state.small_batches(spark):
        found = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in found) == 40 and max(r["bytes"] for r in found) <= 2 * state.BATCH
