"""The optional streaming path: files of observations append to bronze, and touched days of silver are rebuilt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.lake import Lake
from fogbank.operators.silver import obs_qc


def hourly_counts(stream: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "2 hours") -> DataFrame:
    """Tumbling hours with a watermark: count and sum per key. Works on streams and on tables."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 hour"), key)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("hour"), key, "n", "total")
    )


def run_available(spark: SparkSession, source: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now and stops; a second run goes on where the first ended."""
    source.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps over its restarts: it stands in the checkpoint before the first batch."""
    return spark.read.text(f"{checkpoint.rstrip('/')}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def rebuild_touched(lake: Lake, checkpoint: str):
    """For foreachBatch: append a batch of observations (exactly once by stream and batch) and rebuild the days it touches.

    A batch's number alone is no name: another stream into the lake, or a new checkpoint, counts from 0 again.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        name = f"stream/{stream_id(batch.sparkSession, checkpoint)}/{batch_id}"
        if name not in lake.recorded_batches("bronze.obs"):
            lake.append_bronze("bronze.obs", batch, [name])
        days = [str(r.d) for r in batch.select(F.to_date("obs_time").alias("d")).distinct().orderBy("d").collect()]  # days, not rows
        for d in days:
            where = f"to_date(obs_time) = DATE '{d}'"
            lake.replace_partition("silver.obs_qc", obs_qc(lake.read("bronze.obs", where)), where)

    return on_batch


def ingest(lake: Lake, stream: DataFrame, checkpoint: str) -> None:
    stream.writeStream.foreachBatch(rebuild_touched(lake, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
