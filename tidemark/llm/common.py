"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the space and the five controls from tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder; a cluster without it is an error, as a
    machine-local folder there would not be seen by the other machines.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_collectors: list[list[DataFrame]] = []


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


#: Rows that go to a Python worker at once: whole texts are large, and JVM and worker each hold a batch.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_BATCH)
    try:
        if not 0 < int(before) <= BATCH_ROWS:
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        yield
    finally:
        spark.conf.set(_BATCH, before)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and every later read sees the same rows.

    The files go with ``discard``, or else when the driver's JVM ends.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    files, at = _place(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(schema).parquet(path)
    _paths[out] = path
    if _collectors:
        _collectors[-1].append(out)
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete what ``stash`` wrote; nothing that is still to be computed may read it."""
    for df in stashed:
        if path := _paths.pop(df, None):
            files, at = _place(df.sparkSession, path)
            files.delete(at, True)
            files.cancelDeleteOnExit(at)


@contextlib.contextmanager
def collected(into: list[DataFrame]) -> Iterator[None]:
    """Notes in ``into`` what is stashed meanwhile."""
    _collectors.append(into)
    try:
        yield
    finally:
        _collectors.pop()


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished work: it does so when the driver's JVM collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """A dict that this Python worker keeps between tasks, until another operator asks for one: workers are reused, and what all
    operators remember would add up."""
    if owner not in _caches:
        if _caches:
            _caches.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _caches[owner] = {}
    return _caches[owner]


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """``np.unique`` by one sort: on whole numbers that is many times faster than its hash table."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """crc32 of the id written as text (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes: the least bit of each byte comes first."""
    bits = f"list_transform(range(8 * strlen({text})), lambda i: (('0x' || substr(hex({text}), 2 * (i // 8) + 1, 2))::BIGINT >> (i % 8)) & 1)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))"


def sql_lower(text: str) -> str:
    """DuckDB SQL for a text with A-Z in lower case."""
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
