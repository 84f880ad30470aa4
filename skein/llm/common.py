"""Helpers shared by the training-data operators: tables, shared storage, and word splitting."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the words most contracts use: anything but ASCII white space.
WS_WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session (as in tests) may lack it; then a folder of our own is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skein-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"


#: Options of Parquet writers. The lowest level of zstd takes half the time of the usual one, for little more disk.
CODECS = {"snappy": {"compression": "snappy"}, "zstd": {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}}


def materialise(df: DataFrame, name: str, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it again; `path` of the result says where.

    Cuts the lineage: a lost executor loses nothing that was written.
    """
    path = path or shared_path(df.sparkSession, name)
    df.write.options(**CODECS[codec]).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession, rounds: int = 1) -> None:
    """Let go of the shuffle files of finished jobs. Spark deletes them once the driver has collected the garbage that
    refers to them, which may not happen for half an hour by itself. What Python held is garbage to the JVM only a moment
    later, so that a second round finds more."""
    for i in range(rounds):
        if i:
            time.sleep(0.4)
        gc.collect()
        spark._jvm.java.lang.System.gc()


class Scratch:
    """Tables of one run of an operator, in a folder of their own. drop() deletes those that nothing reads any more,
    the end of the with block all; only what result() wrote stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.root, self.made = spark, name, shared_path(spark, name), 0

    def __enter__(self):
        return self

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        self.made += 1
        return materialise(df, name, f"{self.root}/{self.made:03d}-{name}", codec)

    def drop(self, *tables: DataFrame, rounds: int = 1) -> None:
        """rounds: of sweep(), more than one after large shuffles."""
        for t in tables:
            delete(self.spark, t.scratch_path)
        sweep(self.spark, rounds)

    def result(self, df: DataFrame) -> DataFrame:
        return materialise(df, f"{self.name}-result")

    def __exit__(self, *_):
        delete(self.spark, self.root)
        sweep(self.spark)


def slices(batches, rows: int = 500):
    """Arrow batches cut into short ones, so that a worker holds few texts at once as Python strings. At the end the
    worker, which Spark keeps for the next task, gives back the memory it has not in use."""
    import ctypes

    import pyarrow as pa

    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of plain ASCII take Spark's fast path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Longs of the bitmap that thinned() broadcasts: 1 MB of bits.
BITMAP_WORDS = 1 << 17


def _word(h: Column) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(BITMAP_WORDS - 1).cast("long"))


def _bit(h: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({h} & 63 as int))")


def marked(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """df with `maybe`: false only if the hash `key` (a long) is not among the column h of wanted.

    What is broadcast is a bitmap of BITMAP_WORDS longs at most, whatever the size of either side.
    """
    bitmap = wanted.groupBy(_word(F.col("h")).alias("_word")).agg(F.bit_or(_bit("h")).alias("_bits"))
    at = df.withColumn("_h", key).withColumn("_at", _word(F.col("_h")))
    hit = F.coalesce(F.col("_bits").bitwiseAND(_bit("_h")) != 0, F.lit(False))
    return at.join(F.broadcast(bitmap), F.col("_at") == F.col("_word"), "left").withColumn("maybe", hit).drop("_h", "_at", "_word", "_bits")


def thinned(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """The rows of df whose hash may be in wanted: a bounded filter ahead of an exact join."""
    return marked(df, key, wanted).filter("maybe").drop("maybe")


def few(df: DataFrame, rows: int = 200_000) -> bool:
    """Whether df, which must be cheap to read twice (a written table), has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df marked for broadcast if it has few rows; else as it is, to be joined by shuffle. Rows are narrow: a few
    numbers and short strings."""
    return F.broadcast(df) if few(df, rows) else df


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of docs whose key is not in gone (column key). Rows that a bitmap of gone lets go are not shuffled."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    flagged = marked(docs.select(whole, key.alias("mine")), F.xxhash64("mine"), gone.select(F.xxhash64("key").alias("h")))
    stay = flagged.filter("not maybe").select("whole.*")
    rest = flagged.filter("maybe").join(small(gone), F.col("mine").eqNullSafe(F.col("key")), "left_anti")
    return stay.unionByName(rest.select("whole.*"))
