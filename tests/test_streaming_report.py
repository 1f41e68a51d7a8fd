import json

import pytest

from fogbank import report
from fogbank.cli import parser, tomorrow
from fogbank.lake import Lake
from fogbank.operators import scoring
from fogbank.schemas import TABLES
from fogbank.streaming import live

EVENTS = "ts timestamp, event_type string, value double"


def test_available_now_resumes(spark, tmp_path, at):
    src, out, ck = (f"{tmp_path}/{n}" for n in ("src", "out", "ck"))
    spark.createDataFrame([(at(1, 0, 5), "a", 1.0), (at(1, 0, 50), "a", 2.0), (at(1, 5), "b", 4.0)], EVENTS).write.parquet(src)
    counts = lambda: live.hourly_counts(spark.readStream.schema(EVENTS).parquet(src))
    live.run_available(spark, counts(), out, ck)
    spark.createDataFrame([(at(2, 9), "a", 1.0)], EVENTS).write.mode("append").parquet(src)
    live.run_available(spark, counts(), out, ck)
    got = {(r.hour.hour, r.event_type): (r.n, r.total) for r in spark.read.parquet(out).collect()}
    assert got[0, "a"] == (2, 3.0) and got[5, "b"] == (1, 4.0)


def test_stream_rebuilds_touched_days(spark, tmp_path, at):
    lake = Lake(spark, f"file://{tmp_path}/lake", {k: TABLES[k] for k in ("bronze.obs", "silver.obs_qc")})
    lake.init()
    schema = "source string, station_id string, obs_time timestamp, variable string, value double, qc_flag string, ingested_at timestamp"
    for i, v in enumerate((15.0, 16.0)):
        spark.createDataFrame([("madis", "A", at(1, 3), "t2m", v, None, at(2, i))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live.ingest(lake, spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/ck")
    assert lake.read("bronze.obs").count() == 2 and [r.value for r in lake.read("silver.obs_qc").collect()] == [16.0]


def test_reports_and_site(spark, tmp_path, at):
    lake = Lake(spark, f"file://{tmp_path}/lake", {k: TABLES[k] for k in ("silver.obs_qc", "gold.scores")})
    lake.init()
    (tmp_path / "r").mkdir()
    empty = json.loads((report.build_site(lake, tmp_path / "r", tmp_path / "s") / "data.json").read_text())
    assert empty["leaderboard"] == [] and empty["analytics"]["by_lead"] == []
    rows = [(m, "r", "backtest", "f", "t2m", "A", at(d), 60, at(d, 1), 10.0, mu, 1.0) for d in (1, 2) for m, mu in (("raw_hrrr", 12.0), ("x", 10.5))]
    s = scoring.score(spark.createDataFrame(rows, "model_name string, run_id string, kind string, fold string, variable string, point_id string, init_time timestamp, lead_min int, valid_time timestamp, obs double, mu double, sigma double"))
    lake.replace_partition("gold.scores", s, "kind = 'backtest'")
    report.write_reports(lake.read("gold.scores"), tmp_path / "r", meta={"gold_snapshot_id": 2**60})
    data = json.loads((report.build_site(lake, tmp_path / "r", tmp_path / "s") / "data.json").read_text())
    assert data["backtest"]["gold_snapshot_id"] == str(2**60) and len(data["analytics"]["by_lead"]) == 2 and data["leaderboard"]
    (tmp_path / "r" / "monthly_skill.csv").unlink()
    with pytest.raises(RuntimeError, match="incomplete"):
        report.build_site(lake, tmp_path / "r", tmp_path / "s")
    report.log_run(tmp_path / "runs.jsonl", {"m": 1}, {"crps": float("nan")})
    assert json.loads((tmp_path / "runs.jsonl").read_text())["metrics"] == {"crps": None}


def test_command_line(at):
    a = parser().parse_args(["--lake", "x", "build", "silver", "2025-01-01"])
    assert a.verb == "build" and a.end is None and str(tomorrow(at(3, 23))) == "2025-01-04"


def test_clean_keeps_times(at):
    assert report.clean({"a": [float("inf"), at(1)]}) == {"a": [None, "2025-01-01T00:00:00+00:00"]}
