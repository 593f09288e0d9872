"""A public benchmark of recordings: its manifest, a split by subjects, and two simple heuristics to be measured."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.functions.store import number_rows

from . import spectral

MANIFEST = "version string, records array<struct<record_id:string,subject_id:string,fs_hz:double,quality_label:int,reference_hr_bpm:double,signal_file:string>>"


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Records of ``root``/manifest.json with their ``values``, from text files of numbers or ``.npy`` arrays of any shape and
    number type under ``root``/signals. A record whose file is missing is left out; an array file that is none is an error."""
    records = spark.read.schema(MANIFEST).option("multiLine", True).json(f"{root}/manifest.json").select(F.inline("records"))
    files = spark.read.format("binaryFile").load(f"{root}/signals").select(F.concat(F.lit("signals/"), F.element_at(F.split("path", "/"), -1)).alias("signal_file"), "content")
    is_array = F.endswith("signal_file", F.lit(".npy"))
    numbers = F.transform(F.filter(F.split(F.col("content").cast("string"), "\\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    texts = files.where(~is_array).select("signal_file", numbers.alias("values"))
    signals = texts.unionByName(files.where(is_array).mapInArrow(_arrays, "signal_file string, values array<double>"))
    return records.join(signals, "signal_file").select("record_id", "subject_id", "fs_hz", "quality_label", "reference_hr_bpm", "values")


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Array files, one at a time."""
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                values = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                values = np.asarray(values, np.float64).ravel()
            except (ValueError, TypeError, EOFError, OSError) as e:
                raise ValueError(f"{name} is no array of numbers") from e
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))], names=["signal_file", "values"])


def record_hash(record_id: Column) -> Column:
    return F.substring(F.sha2(record_id, 256), 1, 16)


def by_subject(records: DataFrame, seed: int = 0) -> DataFrame:
    """``records`` with ``place``: subjects in the order that NumPy's generator of ``seed`` shuffles them to from the order of their
    ids, each one's records in the order of theirs. No subject is parted.

    One task draws the permutation, eight bytes a subject; subjects and records are numbered by ranges.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.arange(batch.column(0)[0].as_py())
            np.random.default_rng(seed).shuffle(order)
            for a in range(0, len(order), 1 << 16):
                drawn = order[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(drawn), pa.array(np.arange(a, a + len(drawn)))], names=["_rank", "_drawn"])

    subjects = number_rows(records.select("subject_id").distinct(), ["subject_id"], "_rank")
    order = subjects.agg(F.count("*").alias("n")).mapInArrow(draw, "_rank long, _drawn long")
    drawn = subjects.join(order, "_rank").select(F.col("subject_id").alias("_subject"), "_drawn")
    placed = records.join(drawn, F.col("subject_id").eqNullSafe(F.col("_subject"))).drop("_subject")
    return number_rows(placed, ["_drawn", "record_id"], "place").drop("_drawn")


def estimates(records: DataFrame) -> DataFrame:
    """Per record (record_id, subject_id, values, fs_hz, quality_label, reference_hr_bpm): the guessed label, 1 for a band
    ratio of 0.15 or more, and the rate a minute of the band's peak; 0 and null for under 64 samples."""
    renamed = records.withColumnRenamed("fs_hz", "fs")
    facts = spectral.measured(renamed, ["values"], spectral.measure_segments, ["spread", "in_band", "power", "dominant_hz"], spectral.LEAST_SAMPLES)
    ratio = F.col("in_band") / (F.col("power") + spectral.TINY)
    guess = F.when((F.col("spread") >= spectral.FLAT) & (ratio >= spectral.USABLE_RATIO), 1).otherwise(0)
    return facts.select("record_id", "subject_id", F.col("quality_label").alias("truth"), "reference_hr_bpm", guess.alias("guess"), (F.col("dominant_hz") * 60.0).alias("bpm"))
