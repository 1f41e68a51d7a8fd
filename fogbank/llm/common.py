"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the text contracts: runs of bytes that are not ASCII white space.
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A temporary folder for sessions without a shared one, as in tests.
_OWN: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="fogbank-")
    return found.rstrip("/")


def durable(df: DataFrame, scratch: list | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    The frame is added to ``scratch``, if given, for release() once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fogbank-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if scratch is not None:
        scratch.append((spark, path))
    return out


def release(scratch: list) -> None:
    """Delete the files of durable frames that are read no more."""
    while scratch:
        spark, path = scratch.pop()
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def lots(batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[int, list]]:
    """A batch's texts in lots of at most ``most`` bytes (or one longer text): the first one's row, and the texts.

    The batch stays as Arrow gave it; only a lot of it becomes Python objects.
    """
    texts = batch.column(column)
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield at, texts.slice(at, end - at).to_pylist()
        at = end


def within_bytes(ids: list, sizes: dict, most: int) -> list:
    """Of ids in order, those whose rows fit into ``most`` bytes together."""
    out, total = [], 0
    for i in ids:
        if i in sizes and total + sizes[i] <= most:
            total += sizes[i]
            out.append(i)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus (the fold rule of the learned operators)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def least_by_hash(df: DataFrame, id_col: str, most: int) -> list:
    """At most ``most`` distinct ids of df, the least by hash: a repeatable random sample.

    A first count sets a hash threshold with room to spare, so that about as many rows as wanted are compared,
    not ``most`` rows from every task.
    """
    ids = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.pmod(F.xxhash64(id_col), F.lit(1 << 40)).alias("h"))
    n = ids.count()
    if n > 2 * most:
        bar = int((1 << 40) * min(1.0, (most + 8 * most**0.5 + 20) / n))
        near = [r.i for r in ids.where(F.col("h") < bar).distinct().orderBy("h", "i").limit(most).collect()]
        if len(near) == most:
            return near
    return [r.i for r in ids.distinct().orderBy("h", "i").limit(most).collect()]
