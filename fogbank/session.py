"""Session factory and scan helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build(app: str = "fogbank", cpus: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings every plan here relies on (UTC, AQE, Arrow, fair pools)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FOGBANK_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; time stamps without zone are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


#: A temporary folder for local sessions without a shared one, as in tests.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="fogbank-core-")
    return found.rstrip("/")


def durable(df: DataFrame, scratch: list | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: computed once for its many readers, without its lineage.

    The table is added to ``scratch``, if given, for release() once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/made-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch is not None:
        scratch.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(scratch: list) -> None:
    """Deletes tables that are read no more."""
    while scratch:
        spark, path = scratch.pop()
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
