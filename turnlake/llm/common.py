"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spaces as the word rule has them: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
#: Most bytes of one Arrow batch that goes to a Python worker, so that long texts don't add up.
BATCH_BYTES = 32 << 20
#: A key is hot if more than one in so many rows have it; so there are fewer hot keys than this.
HOT_PARTS, HOT_LEAST = 1000, 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where that is unset, local sessions get a temporary one, others an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/turnlake-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again: cuts lineage, and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that nothing reads any more."""
    for t in tables:
        drop_folder(t.sparkSession, t._folder)


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def join_hot(rows: DataFrame, of: DataFrame, key: str | list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with `of`, which has each key once and, in the column `count`, the rows that have it; `total` is their sum.

    Hot keys (fewer than HOT_PARTS, whatever the size) are broadcast, so that their rows stay where they are; the others
    are joined by a shuffle. With how = "left", rows whose key `of` lacks stay, with nulls.
    """
    hot = (F.col(count) > total / HOT_PARTS) & (F.col(count) > HOT_LEAST)
    few, rest = F.broadcast(of.filter(hot).drop(count)), of.filter(~hot).drop(count)
    return rows.join(few, key).unionByName(rows.join(F.broadcast(of.filter(hot).select(key)), key, "left_anti").join(rest, key, how))


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds the bytes of the session's Arrow batches, unless it has set a bound itself (Spark has no bound for one query only)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(key, str(2**31 - 1)).rstrip("bB")
    if found.isdigit() and int(found) > 1 << 30:
        spark.conf.set(key, str(most))


def release_memory() -> None:
    """Gives memory that this process holds but doesn't use back to the system, where the system knows how."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with release_memory at the end of each task: workers are used again, and would keep what they have."""

    def whole(batches):
        yield from run(batches)
        release_memory()

    return whole


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of df (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n = "_" + n
        out.append(n)
    return out


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; none for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod
