"""Tables that cut lineage, and arrays that workers map: files under the folder that all executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode a temporary folder is set where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="tracegrain-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tracegrain/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored table: later reads neither recompute it
    nor depend on the executors that made it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what save() stored for ``tables``: only once no frame that is still to be read was made from them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BATCH = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = BATCH) -> Iterator[None]:
    """What runs within gives Python workers Arrow batches of about ``most`` bytes: an executor holds a batch outside its
    heap while it writes it, and 10,000 long texts a task are more than what is left there."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def store_array(uri: str, array: np.ndarray) -> None:
    """Write one array under its final name at once; a task that runs again writes the same bytes."""
    path = _local(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as f:
            np.save(f, array)
        os.replace(part, path)
        return
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
        np.save(f, array)
    fs.move(part, path)


def map_array(uri: str) -> np.ndarray:
    """The array in shared memory of all workers on a machine; from a store that can't be mapped, by way of a file
    that has no name once it is open. A file that isn't there is an error."""
    if path := _local(uri):
        return np.load(path, mmap_mode="r")
    fs, path = pafs.FileSystem.from_uri(uri)
    with tempfile.NamedTemporaryFile(suffix=".npy") as f:
        with fs.open_input_stream(path) as src:
            while block := src.read(1 << 24):
                f.write(block)
        f.flush()
        return np.load(f.name, mmap_mode="r")
