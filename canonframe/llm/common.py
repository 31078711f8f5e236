"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_FOLDS = 5


#: Bytes of an Arrow batch on its way to a worker: long texts make small batches, and a worker holds few of them.
BATCH_BYTES = 4 << 20
#: How workers allocate: blocks of 1 MB or more are mapped, so that they go back to the machine when they are freed, and the
#: C library does not raise that limit by itself; Arrow shares its allocator. Otherwise an idle worker keeps what its largest
#: task took, beside the tasks of the others.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(2 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.sparkContext.environment.update(WORKER_MEMORY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir (or that the session was given for checkpoints).

    Only a local session may do without: it gets a temporary folder. Elsewhere a machine's own folder would be lost with
    the machine and unknown to the others, so an unset one is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="canonframe-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Lets the executors delete the shuffle files of an action as it ends, not when the driver happens to collect garbage.

    Only around actions whose result is then read from the shared folder, never around what a caller may run a second time.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's shared folder."""
    spark = df.sparkSession
    small_batches(spark)
    folder = shared_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    with shuffles_freed(spark):
        return df.select("*").checkpoint()  # a plan of its own, which takes the setting


def given_back(spark: SparkSession) -> None:
    """Lets the driver's JVM collect its garbage and give heap back to the machine, between the actions of a long chain: plans
    and broadcasts of the ended ones otherwise keep its heap, beside its hundreds of threads, at its largest."""
    spark._jvm.System.gc()


def free(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a filter of keys: 16 for each key, between these powers of two (8 KB to 32 MB). Beyond 2**24 keys it lets more
#: and more pass that is not wanted; whatever passes is joined exactly, so this costs shuffle, never rows.
LEAST_BITS, MOST_BITS = 16, 28


def bitmap(keys: DataFrame, n: int):
    """A broadcast bit map (int64 words) of the `key` column of n rows, and its number of bits as a power of two."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(key & 63 AS int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()  # at most 2**(MOST_BITS - 6) words
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out), bits


def in_bitmap(words: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    at = keys & ((1 << bits) - 1)
    return (words[at >> 6] >> (at & 63)) & 1 == 1


#: The same as a table of words for joins: at most 2**MOST_JOIN_BITS bits in rows of 64, about 40 MB.
MOST_JOIN_BITS = 26


def flagged(df: DataFrame, key: str, keys: DataFrame, n: int, flag: str) -> DataFrame:
    """df with `flag`: false where the long column `key` is surely none of the n values of the column of that name in `keys`.

    Rows that are not flagged need not cross a shuffle to find that out. Columns alone; the broadcast table has a fixed bound.
    """
    bits = min(MOST_JOIN_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    word, bit = free(df, "__cf_word"), free(df, "__cf_bits")
    at = lambda c: F.shiftright(c.bitwiseAND(F.lit((1 << bits) - 1)), 6)
    one = lambda c: F.expr(f"shiftleft(1L, cast(`{c}` & 63 AS int))")
    words = keys.select(at(F.col(key)).alias(word), one(key).alias(bit)).groupBy(word).agg(F.bit_or(bit).alias(bit))
    out = df.withColumn(word, at(F.col(key))).join(F.broadcast(words), word, "left")
    return out.withColumn(flag, F.coalesce(F.col(bit).bitwiseAND(one(key)) != 0, F.lit(False))).drop(word, bit)


def body(col: str | Column = "text") -> Column:
    """The text, null read as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key that equal rows share, so that results can be joined back even where doc_id is null or repeated."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\u0000")), body(text))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that no model may learn from: crc32 of doc_id as text divides by 5."""
    return F.coalesce((F.crc32(F.col(doc_id).cast("string").cast("binary")) % N_FOLDS) == 0, F.lit(False))


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the session's shared folder and read again, and where it lies."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what staged() wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
