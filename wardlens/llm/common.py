"""Shared pieces of the training-data operators: the shared folder, fold tests, word splitting."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Blocks of 4 MB and more are mapped by themselves and go back to the system when freed; Arrow takes them from there too. Left to
# their own thresholds, allocators keep what a large batch once needed for as long as the worker lives.
pa.set_memory_pool(pa.system_memory_pool())
try:
    ctypes.CDLL("libc.so.6").mallopt(-3, 4 << 20)
except (OSError, AttributeError):  # another C library
    pass

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this session below the one that all executors share, ``spark.checkpoint.dir``. Only a local master, as in
    tests, may go without; elsewhere executors would write to folders that the others can't see. Hadoop removes it at the end."""
    made = getattr(spark, "_wardlens_shared", None)
    if made is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="wardlens-")
            atexit.register(shutil.rmtree, found[7:], True)
        made = f"{found.rstrip('/')}/wardlens-{uuid.uuid4().hex[:12]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        spark._wardlens_shared = made
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def has_rows(spark: SparkSession, url: str) -> bool:
    """Whether a partition's folder was written at all."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(url)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def drop(spark: SparkSession, *urls: str) -> None:
    """Remove paths of the shared folder that nothing reads any more."""
    for url in urls:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(url)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that have ended: Spark removes them once the driver's garbage is collected."""
    for _ in range(2):  # the first round finds the plans, the second what only they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def local_path(url: str) -> str:
    """The POSIX path of a shared folder. Memory-mapped files need one; a mounted volume serves on a cluster."""
    if url.startswith("file:"):
        return "/" + url[5:].lstrip("/")
    if "://" in url:
        raise ValueError(f"memory-mapped files need a mounted folder, not {url}")
    return url


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of doc_id's decimal text, modulo m. A null id counts as the empty text (crc32 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def byte_slices(column: pa.Array, limit: int):
    """(start, stop) runs of a string array of about ``limit`` bytes each; a longer text has a run of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = total = 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words of each text and the offsets of the texts among them. Null is an empty text.

    Splits on runs of the six ASCII white-space characters only, in Arrow's C++ kernels.
    """
    # A copy of its own buffers: kernels that map bytes in place misread a slice that has been cast.
    texts = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        flat, off = flat.filter(pa.array(full)), before[off]
    return flat, off


def hash64(values: pa.Array) -> np.ndarray:
    """The 64-bit xxHash of each string of an array."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))


def mix64(x: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finalizer: a bijection of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_RESIDENT: dict = {}


def resident(key, make):
    """What a Python worker keeps between tasks: one thing at a time, so that a worker that serves several operators holds
    no more than the largest of them."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        tidy()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def tidy() -> None:
    """Give freed memory back to the system: workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run):
    """``run`` for mapInArrow, tidying up when the task ends."""

    def wrapped(batches):
        yield from run(batches)
        tidy()

    return wrapped
