"""Helpers that several corpus operators share."""

import contextlib
import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is
    unset, a temporary one if all runs on one machine, else an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def stored(df: DataFrame, name: str, kept: list[str] | None = None) -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage
    ends there, so lost executors cost no recomputation of what came before. Its
    path is added to kept, for discard()."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if kept is not None:
        kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int | None = None) -> None:
    """Arrow batches of at most so many rows, and of about so many bytes where size is
    given, from now on: texts and token sets are wide, and a Python worker holds a whole
    batch, the JVM up to three times its bytes."""
    if size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Returns freed memory to the system: Spark uses Python workers again, and what
    one task has taken would weigh on the next ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run):
    """run, a function of a task's batches, with give_back() at its end."""

    def stream(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return stream


def released_group(run):
    """The same for a function of one group's table."""

    def group(t):
        try:
            return run(t)
        finally:
            give_back()

    return group


def released_pair(run):
    """The same for a function of two groups' tables."""

    def pair(t, u):
        try:
            return run(t, u)
        finally:
            give_back()

    return pair


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ... by place, and the new name of each (of the
    first, where names repeat): operators add columns of their own beside them."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(reversed(list(zip(df.columns, names, strict=True))))


def plus(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df with more fields."""
    return T.StructType(df.schema.fields + T.StructType.fromDDL(ddl).fields)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod5(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5 (null ids: that of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def byte_words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of text as UTF-8; lower: A-Z lower-cased.
    bytes.split() and bytes.lower() know ASCII only, which is the rule asked for."""
    if not text:
        return []
    b = text.encode("utf-8", "surrogatepass")
    return (b.lower() if lower else b).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each run of k words; order counts."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + mix(word_hashes[j : j + n] + np.uint64(j))
            h ^= h >> np.uint64(29)
    return mix(h)
