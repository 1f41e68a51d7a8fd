"""Streams with state of their own: the day's onset of marine air, and forecasts with the truth that arrives after them.

Both give what the batch operators give for every row that isn't later than the watermark allows, whatever batches the
rows come in and wherever a run ends and another one goes on. State is bounded by event time: a station holds the last
hour of its means, a day its first onset until it ends, a forecast waits for its truth until the watermark has passed it.
``transformWithState`` needs the RocksDB state store, see ``rocks_db``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fogbank.operators.features import GROUPS, LOCAL_TZ, PUSH_COOLER, PUSH_HOURS, PUSH_MOISTER
from fogbank.schemas import TARGETS

BUCKET, HOUR = timedelta(minutes=10), timedelta(hours=1)
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def _utc(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


def _ms(t: datetime) -> int:
    return round(t.replace(tzinfo=UTC).timestamp() * 1000)


class Pushes(StatefulProcessor):
    """Of one station: the buckets in which it got cooler and moister than an hour before.

    A bucket's mean is kept until no bucket an hour later can come any more; its timer removes it then.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.means = handle.getMapState("means", "variable string, t timestamp_ntz", "v double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = {(k[0], k[1]): v[0] for k, v in self.means.iterator()}
        new = {(r.variable, r.t): r.v for r in rows if r.v is not None}
        every = kept | new
        for (variable, t), v in new.items():
            if (variable, t) not in kept:
                self.means.updateValue((variable, t), (v,))
        for t in {t for _, t in new}:
            self.handle.registerTimer(_ms(t + HOUR + BUCKET))
        for t in sorted({t + d for _, t in new for d in (timedelta(0), HOUR)}):
            four = [every.get((variable, at)) for variable in ("t2m", "rh2m") for at in (t, t - HOUR)]
            # The last of the four to come decides, so a bucket is found once.
            if None not in four and any((variable, at) in new for variable in ("t2m", "rh2m") for at in (t, t - HOUR)):
                if four[0] - four[1] <= PUSH_COOLER and four[2] - four[3] >= PUSH_MOISTER:
                    yield Row(t=t, t_end=t + BUCKET - timedelta(microseconds=1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        t = _utc(expiredTimerInfo.getExpiryTimeInMs()) - HOUR - BUCKET
        for variable in ("t2m", "rh2m"):
            if self.means.containsKey((variable, t)):
                self.means.removeKey((variable, t))
        yield from ()

    def close(self) -> None:
        pass


class FirstOfDay(StatefulProcessor):
    """Of one local day: its first time, given once, when the day has ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "t timestamp_ntz")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        listed = [(r.t, r.day_end) for r in rows]
        if not self.first.exists():
            self.handle.registerTimer(_ms(listed[0][1]))
            self.first.update((min(t for t, _ in listed),))
        else:
            self.first.update((min(self.first.get()[0], *(t for t, _ in listed)),))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.first.exists():
            onset = self.first.get()[0]
            self.first.clear()
            yield Row(day=key[0], onset=onset)

    def close(self) -> None:
        pass


def push_onsets(obs: DataFrame, coast=GROUPS["coast"], late: str = "2 hours") -> DataFrame:
    """day, onset of a stream of checked observations, a row for each local day that has one, once the day has ended.

    Three stateful steps in a row, each with the stream's watermark: means of 10 minutes, a station's changes over an hour,
    a day's first.
    """
    rows = obs.where(F.col("station_id").isin(*coast) & F.col("variable").isin("t2m", "rh2m")).withWatermark("obs_time", late)
    windows = rows.groupBy(F.window("obs_time", "10 minutes").alias("w"), "station_id", "variable").agg(F.avg("value").alias("v"))
    naive = lambda c: F.to_timestamp_ntz(c)  # noqa: E731  # state holds UTC times without a zone, whatever the session's is
    means = windows.select("station_id", "variable", naive(F.col("w.start")).alias("t"), "v", F.window_time("w").alias("seen"))
    pushes = means.groupBy("station_id").transformWithState(Pushes(), "t timestamp_ntz, t_end timestamp", "Append", "EventTime", eventTimeColumnName="t_end")
    local = F.from_utc_timestamp(F.col("t").cast("timestamp"), LOCAL_TZ)
    day = F.to_date(local)
    end = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), LOCAL_TZ)
    hits = pushes.where(F.hour(local).between(*PUSH_HOURS)).select(day.alias("day"), "t", naive(end).alias("day_end"), "t_end")
    first = hits.groupBy("day").transformWithState(FirstOfDay(), "day date, onset timestamp_ntz", "Append", "EventTime")
    return first.select("day", F.col("onset").cast("timestamp").alias("onset"))


def truth(forecasts: DataFrame, hours: DataFrame, late: str = "2 hours", behind: str = "6 hours") -> DataFrame:
    """forecasts (a stream) with the observed values of their valid hour (another one), or nulls.

    A report counts if it comes before the watermark (``late`` behind the newest hour) has passed its hour; then every forecast
    of that hour that has none comes out with nulls, once. ``behind``: how far a cycle may come behind newer ones. Both sides
    are keyed by station and hour, and their watermarks bound what either has to keep.
    """
    made = forecasts.withWatermark("valid_time", behind)
    seen = hours.select(F.col("point_id").alias("seen_point"), F.col("hour").alias("seen_hour"), *[F.col(t).alias(f"obs_{t}") for t in TARGETS]).withWatermark("seen_hour", late)
    return made.join(seen, (F.col("point_id") == F.col("seen_point")) & (F.col("valid_time") == F.col("seen_hour")), "left_outer").drop("seen_point", "seen_hour")
