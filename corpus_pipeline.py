"""A training corpus from raw documents: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.llm import decontaminate, langid, linededup, packing, simhash
from tracegrain.llm.queries import tokenizer_path
from tracegrain.llm.state import save


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language the classifier rejects; it learns from three quarters of ``docs``.

    Null and empty texts, and texts without a letter, are in no language and go. Long texts are judged whole; repeated
    rows go or stay together; an empty table gives an empty one; all columns stay, whatever they are called.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.keep_known(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages of 50 words or more out of all but their first document; all rows stay.

    Null text stays null, a text that is wholly a repeat becomes empty. Of rows with one doc_id the one read first keeps
    the passage. An empty table gives an empty one; all columns stay.
    """
    out = linededup.dedup_lines(docs, removed=None)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five words a shingle, a Jaccard similarity of 0.8 or more.

    The least doc_id stays, null ids last; of rows with one doc_id, one stays. Null, empty and blank texts are alike: each
    is a set without shingles. An empty table gives an empty one; all columns stay.
    """
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a benchmark window occurs.

    Null and empty texts stay. An empty benchmark drops nothing, an empty table gives an empty one; all columns stay.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents that are left into pieces and pack these into sequences.

    Null and empty texts are the one id 0. Rows with equal or null doc_id are packed each by itself; sizes that tie go in
    the order of the stored pieces; an empty table gives no piece.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, name)
    return docs
