"""Streams with state against the batch operators, over batches, restarts and late rows."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fogbank.lake import Lake
from fogbank.operators import features
from fogbank.schemas import TABLES
from fogbank.streaming import live, stateful

OBS = "station_id string, variable string, obs_time timestamp, value double"
COAST = features.GROUPS["coast"][:2]


@pytest.fixture
def readings(at):
    """Six days of two coast stations and one other; most days have a push, some two, one at its other station first."""
    rnd = random.Random(4)
    rows = []
    for station in (*COAST, "INLAND"):
        for step in range(6 * 144):
            t = at(1) + timedelta(minutes=10 * step + rnd.randrange(10))
            hour = (t.hour + 16) % 24 + t.minute / 60  # local
            pushed = station != "INLAND" and t.day % 4 != 0 and (13 + t.day % 3 + (station == COAST[0]) <= hour < 17 or (t.day == 3 and hour >= 21))
            if rnd.random() < 0.95:
                rows.append((station, "t2m", t, 20.0 - 6 * pushed + rnd.uniform(-0.5, 0.5)))
            if rnd.random() < 0.95:
                rows.append((station, "rh2m", t, 50.0 + 20 * pushed + rnd.uniform(-1, 1)))
    return rows


def expected(spark, rows):
    return features.push_onsets(features.ten_minute_means(spark.createDataFrame(rows, OBS)), COAST).orderBy("day").collect()


def test_onsets_over_three_batches_with_late_rows_and_restarts(spark, tmp_path, at, readings):
    src, out, ck = (f"{tmp_path}/{n}" for n in ("src", "out", "ck"))
    rnd = random.Random(9)
    cuts = [at(2, 20), at(4, 21, 30), at(30)]
    batches = [[], [], []]
    for r in sorted(readings, key=lambda r: r[2]):
        k = next(i for i, c in enumerate(cuts) if r[2] < c)
        # Some of the last hour and a half of a batch come with the next one: late, but within the watermark.
        if k < 2 and cuts[k] - r[2] < timedelta(minutes=90) and rnd.random() < 0.5:
            k += 1
        batches[k].append(r)
    # Too late for the watermark: a day that was closed, which this would give an earlier onset.
    batches[2] += [(COAST[0], v, at(1, 19) + timedelta(minutes=5 + 60 * h), x) for h, (a, b) in enumerate(((20.0, 50.0), (10.0, 90.0))) for v, x in (("t2m", a), ("rh2m", b))]
    batches.append([(COAST[0], "t2m", at(20), 1.0)])  # time goes on, so that the last days end
    with stateful.rocks_db(spark):
        for rows in batches:
            spark.createDataFrame(rows, OBS).coalesce(1).write.mode("append").parquet(src)
            live.run_available(spark, stateful.push_onsets(spark.readStream.schema(OBS).parquet(src), COAST), out, ck)  # each run is a restart
    got = spark.read.parquet(out).orderBy("day").collect()
    want = expected(spark, readings)
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(want) >= 4
    assert got[0].onset != at(1, 20)


def test_state_is_removed_when_its_time_has_passed(spark, tmp_path, at, readings):
    src, out, ck = (f"{tmp_path}/{n}" for n in ("src", "out", "ck"))
    spark.createDataFrame(readings, OBS).coalesce(1).write.parquet(src)
    with stateful.rocks_db(spark):
        for day in (19, 20):
            spark.createDataFrame([(COAST[0], "t2m", at(day), 1.0)], OBS).coalesce(1).write.mode("append").parquet(src)
            stream = stateful.push_onsets(spark.readStream.schema(OBS).parquet(src), COAST)
            q = stream.writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out)
            q.awaitTermination()
    rows = [op["numRowsTotal"] for op in q.lastProgress["stateOperators"]]
    assert max(rows) <= 6  # of 3,400 means


def test_truth_over_batches_equals_the_batch_join_and_late_reports_give_nulls_once(spark, tmp_path, at):
    made, seen, out, ck = (f"{tmp_path}/{n}" for n in ("made", "seen", "out", "ck"))
    forecasts = [(p, at(1, h), lead, at(1, h) + timedelta(minutes=lead), float(h)) for p in "AB" for h in range(20) for lead in (0, 60, 120)]
    hours = [(p, at(1, h), 10.0 + h, None if h % 5 == 0 else 1.0) for p in "AB" for h in range(23) if (p, h) not in {("A", 7), ("B", 12)}]
    made_schema, seen_schema = "point_id string, init_time timestamp, lead_min int, valid_time timestamp, nwp_t2m double", "point_id string, hour timestamp, t2m double, gust double"
    late = ("A", at(1, 3), 99.0, 9.0)
    hours = [h for h in hours if h[:2] != late[:2]]
    cuts = [at(1, 8), at(1, 15), at(2)]
    for i, cut in enumerate([*cuts, None]):
        low = cuts[i - 1] if i else at(1)
        if cut:
            f = [r for r in forecasts if low <= r[1] < cut]
            h = [r for r in hours if low <= r[1] < cut]
        else:  # the fourth batch: a report of an hour that has been closed, and rows that end the day
            f, h = [("C", at(3), 0, at(3), 0.0)], [late, ("C", at(3), 0.0, 0.0)]
        spark.createDataFrame(f, made_schema).coalesce(1).write.mode("append").parquet(made)
        spark.createDataFrame(h, seen_schema).coalesce(1).write.mode("append").parquet(seen)
        stream = stateful.truth(spark.readStream.schema(made_schema).parquet(made), spark.readStream.schema(seen_schema).parquet(seen))
        live.run_available(spark, stream, out, ck)
    got = spark.read.parquet(out).where("point_id <> 'C'")
    truth = spark.createDataFrame(hours, seen_schema).select("point_id", F.col("hour").alias("valid_time"), F.col("t2m").alias("obs_t2m"), F.col("gust").alias("obs_gust"))
    want = spark.createDataFrame(forecasts, made_schema).join(truth, ["point_id", "valid_time"], "left").select(*got.columns)
    assert got.count() == len(forecasts) and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    gone = got.where("point_id = 'A' AND hour(valid_time) = 3").collect()
    assert len(gone) == 3 and all(r.obs_t2m is None for r in gone)


def test_two_streams_into_one_lake_lose_nothing(spark, tmp_path, at):
    lake = Lake(spark, f"file://{tmp_path}/lake", {k: TABLES[k] for k in ("bronze.obs", "silver.obs_qc")})
    lake.init()
    schema = "source string, station_id string, obs_time timestamp, variable string, value double, qc_flag string, ingested_at timestamp"
    for n, stream in ((1, "one"), (2, "two"), (3, "one")):
        spark.createDataFrame([("madis", f"S{n}", at(1, n), "t2m", float(n), None, at(2))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{stream}")
        live.ingest(lake, spark.readStream.schema(schema).parquet(f"{tmp_path}/{stream}"), f"file://{tmp_path}/ck-{stream}")
    assert sorted(r.value for r in lake.read("silver.obs_qc").collect()) == [1.0, 2.0, 3.0]
    assert len(lake.recorded_batches("bronze.obs")) == 3
    # The same batch again, as after a failure between its append and its end: not appended twice.
    again = live.rebuild_touched(lake, f"file://{tmp_path}/ck-one")
    again(spark.createDataFrame([("madis", "S1", at(1, 1), "t2m", 1.0, None, at(2))], schema), 0)
    assert lake.read("bronze.obs").count() == 3


def test_stream_query_takes_a_slice_as_one_batch_however_many_its_files_are(spark, monkeypatch):
    """As on a cluster, where a slice is several files: no row of it may be late for the rest."""
    from fogbank.plans import registry, streams

    runs, run = [], live.run_available

    def counted(*args):
        run(*args)
        runs.append(spark.read.text(f"{args[3]}/offsets").select(F.input_file_name()).distinct().count())

    monkeypatch.setattr(streams.live, "run_available", counted)
    monkeypatch.setattr(streams, "ROWS", 5_000)
    d = "/root/testdata/sf0.001"
    base = registry._base(spark, d).select("point_id", "init_time", "lead_min", "valid_time", "obs_t2m", "obs_gust").cache()
    got = registry.queries()["stream_truth"](spark, d)
    want = registry.rounded(base)
    assert base.count() > 4 * 5_000 and got.count() == base.count() and got.exceptAll(want).isEmpty()
    assert len(runs) == -(-base.count() // 5_000) + 1 and runs[-1] <= 2 * len(runs)
    base.unpersist()
