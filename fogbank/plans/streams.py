"""The stateful streams as queries: the tables come in slices of time, each a micro-batch, and run till the end.

Each query's files, checkpoint and output are in the session's shared folder. A last row far ahead ends the stream's time, so that
what waits for the watermark comes out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fogbank.plans import views
from fogbank.plans.registry import COAST, _PUSH, _base, query, r
from fogbank.session import release, shared_dir
from fogbank.streaming import live, stateful

#: Slices at least; a slice has about so many rows at most, as all of its rows are state for a while, and is so many files.
SLICES, ROWS, FILES = 3, 2_000_000, 8
PARTITIONS = "spark.sql.shuffle.partitions"


def in_slices(df: DataFrame, ts: str, cuts: list, end: DataFrame, path: str) -> None:
    """df's rows by slices of time, and the rows of end after them: a folder each, path/slice=0, 1, ..."""
    number = sum(((F.col(ts) >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    parts = df.where(F.col(ts).isNotNull()).withColumn("slice", number).repartitionByRange((len(cuts) + 1) * FILES, ts, df.columns[0])
    parts.write.partitionBy("slice").parquet(path)
    end.coalesce(1).write.parquet(f"{path}/slice={len(cuts) + 1}")


def cuts_of(df: DataFrame, ts: str) -> tuple[list, object]:
    """The times that cut df into slices, and its last one."""
    span = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b"), F.count(ts).alias("n")).first()
    n = max(SLICES, -(-span.n // ROWS))
    return ([span.a + (span.b - span.a) * i / n for i in range(1, n)], span.b) if span.a is not None else ([], None)


def arrived(spark: SparkSession, path: str, number: int) -> str:
    """Moves a slice to where the stream looks for files, which is returned."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    here, there = p(f"{path}/slice={number}"), p(f"{path}-in/{number}")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(there.getParent())
    if fs.exists(here) and not fs.rename(here, there):  # a slice may have no rows
        raise OSError(f"{here} can't be moved")
    return f"{path}-in/*"


@contextmanager
def few_partitions(spark: SparkSession) -> Iterator[None]:
    """State for one slice at a time: a partition for each core, as each costs files in every batch."""
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(min(int(before), max(2, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, before)


def finished(spark: SparkSession, sources: dict[str, StructType], stream_of: Callable[..., DataFrame], slices: int, root: str, store=nullcontext) -> DataFrame:
    """The whole output of the stream that stream_of makes of its sources, of which only the output files are kept.

    A slice is one batch, whatever files it is in: of a batch that had a part of them, the newest row would make the others late.
    So each slice comes after the run of the one before, and the stream goes on from its checkpoint. store: where it keeps its
    state, if not as the session says.
    """
    with store(spark), few_partitions(spark):
        for i in range(slices):
            paths = {name: arrived(spark, f"{root}/{name}", i) for name in sources}
            stream = stream_of(*[spark.readStream.schema(schema).parquet(paths[name]) for name, schema in sources.items()])
            live.run_available(spark, stream, f"{root}/out", f"{root}/checkpoint")
    release([(spark, f"{root}/{p}") for name in sources for p in (name, f"{name}-in")] + [(spark, f"{root}/checkpoint")])
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("stream_push_onsets", f"SELECT strftime(day, '%Y-%m-%d') AS day, onset FROM ({_PUSH})")
def stream_push_onsets(spark, d):
    """push_onsets as a stream: windowed means, changes and a day's first, each with state."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = views.coast(spark, d).select("station_id", "variable", F.col("t").alias("obs_time"), F.col("v").alias("value"))
    cuts, last = cuts_of(rows, "obs_time")
    end = spark.createDataFrame([(COAST[0], "t2m", last, 0.0)] if last else [], rows.schema).withColumn("obs_time", F.col("obs_time") + F.expr("INTERVAL 3 DAYS"))
    in_slices(rows, "obs_time", cuts, end.select(*rows.columns), f"{root}/seen")
    out = finished(spark, {"seen": rows.schema}, lambda seen: stateful.push_onsets(seen, COAST), len(cuts) + 2, root, stateful.rocks_db)
    return out.withColumn("day", F.col("day").cast("string"))


@query("stream_truth", f"SELECT point_id, init_time, lead_min, valid_time, {r('obs_t2m', 'obs_gust')} FROM base")
def stream_truth(spark, d):
    """Forecasts and reports as two streams: each forecast comes out once, with its truth or, after the watermark, without."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    base = _base(spark, d)
    made = base.select("point_id", "init_time", "lead_min", "valid_time")
    truth = base.where("obs_t2m IS NOT NULL OR obs_gust IS NOT NULL").select("point_id", F.col("valid_time").alias("hour"), F.col("obs_t2m").alias("t2m"), F.col("obs_gust").alias("gust"))
    hours = truth.dropDuplicates(["point_id", "hour"])
    cuts, last = cuts_of(made, "init_time")
    later = F.expr("INTERVAL 30 DAYS")
    ends = [("", last, 0, last)] if last else []
    made_end = spark.createDataFrame(ends, made.schema).select("point_id", "init_time", "lead_min", (F.col("valid_time") + later).alias("valid_time"))
    hours_end = made_end.select("point_id", F.col("valid_time").alias("hour"), F.lit(0.0).alias("t2m"), F.lit(0.0).alias("gust"))
    in_slices(made, "init_time", cuts, made_end, f"{root}/made")
    in_slices(hours, "hour", cuts, hours_end, f"{root}/hours")
    out = finished(spark, {"made": made.schema, "hours": hours.schema}, stateful.truth, len(cuts) + 2, root)
    return out.where("point_id <> ''").select("point_id", "init_time", "lead_min", "valid_time", "obs_t2m", "obs_gust")
