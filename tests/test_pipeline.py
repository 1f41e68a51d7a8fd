import json
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest

from fogbank import cli, pipeline
from fogbank.lake import Lake
from fogbank.schemas import CYCLIC_FIELDS, LAG_FIELDS, NWP_FIELDS, REGIME_FIELDS, TABLES, TARGETS

STATIONS = ("A", "B", "C")


def day(month, d=1):
    return datetime(2025, month, d, tzinfo=UTC)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Five months of daily cycles at three stations; the forecast is 2 too cold, more so at B."""
    out = Lake(spark, f"file://{tmp_path_factory.mktemp('lake')}")
    out.init()
    rng = np.random.default_rng(1)
    names = TABLES["gold.training_examples"].schema.fieldNames()
    rows = []
    for k in range(150):
        init = day(1) + timedelta(days=k)
        for s in STATIONS:
            for lead in (0, 60, 240):
                x = dict.fromkeys((*[f"nwp_{f}" for f in (*NWP_FIELDS, *REGIME_FIELDS)], *CYCLIC_FIELDS, *LAG_FIELDS), 1.0)
                x |= {f"{p}_{t}": 0.5 for t in TARGETS for p in ("obs_last", "err_at_init", "bias14", "std14")}
                x |= {"nwp_t2m": 10.0 + rng.normal(), "nwp_gust": 5.0, "obs_gust": None, "lag_sd_t2m": float(rng.uniform(0.2, 2))}
                x["obs_t2m"] = x["nwp_t2m"] + (4.0 if s == "B" else 2.0) + rng.normal()
                x |= dict(point_id=s, init_time=init, issue_time=init + timedelta(minutes=55), lead_min=lead, valid_time=init + timedelta(minutes=lead))
                rows.append(tuple(x.get(n) for n in names))
    out.replace_partition("gold.training_examples", spark.createDataFrame(rows, TABLES["gold.training_examples"].schema))
    out.replace_partition("silver.static_features", spark.createDataFrame([(s, f, float(i)) for i, s in enumerate(STATIONS) for f in ("elev_m", "slope_deg")], "point_id string, feature string, value double"))
    up = [(day(1) + timedelta(days=k), "up_coast_t2m_d1h", float(k % 5)) for k in range(150)]
    out.replace_partition("gold.upwind_features", spark.createDataFrame(up, "init_time timestamp, feature string, value double"))
    return out


def test_champion_runs_from_the_lake(lake, tmp_path):
    rows, versions = pipeline.training_rows(lake, ["gbm_terrain_stack"])
    assert {"st_elev_m", "st_slope_deg", "up_coast_t2m_d1h"} <= set(rows.columns) and set(versions) == {"gold.training_examples", "silver.static_features", "gold.upwind_features"}
    scores = pipeline.run_backtest(lake, ["gbm_terrain_stack"], ["t2m"], tmp_path, end=day(5), rounds=8)
    by = {r.model_name: r for r in scores.groupBy("model_name").avg("crps").collect()}
    assert set(by) == {"raw_hrrr", "gbm_terrain_stack"} and by["gbm_terrain_stack"][1] < 0.8 * by["raw_hrrr"][1]
    assert {r.fold for r in scores.select("fold").distinct().collect()} == {"2025-04"} and lake.read("gold.forecasts").count() == scores.count() == 2 * 30 * 3 * 2
    meta = json.loads((tmp_path / "backtest_meta.json").read_text())
    assert meta["models"] == ["raw_hrrr", "gbm_terrain_stack"] and meta["window_end"].startswith("2025-05-01") and set(meta["runs"]) == {"raw_hrrr/t2m", "gbm_terrain_stack/t2m"}
    runs = [json.loads(x) for x in (tmp_path / "runs.jsonl").read_text().splitlines()]
    assert len(runs) == 2 and runs[1]["metrics"]["skill_1_3h"] > 0.2 and f"run-{runs[1]['tags']['run_id']}" in lake.tags("gold.training_examples")
    assert lake.spark.read.parquet(f"{lake.root}/_reports/backtest/scores.parquet").count() == scores.count() and (tmp_path / "leaderboard.csv").exists()


def test_holdout_and_its_checks(lake, tmp_path):
    scores = pipeline.run_holdout(lake, ["bias_rolling"], ["t2m"], tmp_path, [["A", " B "]])
    assert {r.point_id for r in scores.select("point_id").distinct().collect()} == {"A", "B"}
    meta = json.loads((tmp_path / "holdout" / "meta.json").read_text())
    assert meta["groups"] == [["A", "B"]] and meta["training_stations_by_group"] == {"0": ["C"]} and meta["models"] == ["bias_rolling"]
    run = lambda groups, targets=("t2m",), **k: pipeline.run_holdout(lake, ["raw_hrrr"], targets, tmp_path, groups, **k)
    for groups, more, message in (
        ([[" "]], {}, "named"), ([["Z"]], {}, "unknown"), ([["A", "B", "C"]], {}, "none is left"), ([["A"]], dict(targets=("gust",)), "too few"),
        ([["A"]], dict(start=day(9)), "no training rows"), ([["A"]], dict(start=day(2), end=day(1)), "before"), ([["A"]], dict(start=day(3)), "too few"),
    ):
        with pytest.raises(ValueError, match=message):
            run(groups, **more)


def test_windows():
    assert pipeline.window(datetime(2025, 1, 1), None) == (day(1), None)
    with pytest.raises(ValueError, match="not at nan"):
        pipeline.window(float("nan"), None)


def test_ablation(lake, tmp_path):
    rows, _ = pipeline.training_rows(lake, ["bias_rolling"])
    got = pipeline.run_ablation("bias", rows, [("bias_rolling", "raw_hrrr")], ["t2m"], tmp_path).where("point = 'all' AND bucket = '1-3 h'").first()
    assert got.change < 0 and got.lo <= got.change <= got.hi and (tmp_path / "paired.csv").exists() and json.loads((tmp_path / "meta.json").read_text())["pairs"] == [["bias_rolling", "raw_hrrr"]]


def test_blend_on_the_stored_rows(spark, lake, tmp_path):
    init = day(4, 10)
    score = lambda s, lead: ("raw_hrrr", "r", "backtest", "f", "t2m", s, init, lead, init + timedelta(minutes=lead), 12.0, 10.0, 2.0, -2.0, 1.0, 1)
    lake.replace_partition("gold.scores", spark.createDataFrame([score("A", 60), score("B", 60), score("C", 60)], "model_name string, run_id string, kind string, fold string, variable string, point_id string, init_time timestamp, lead_min int, valid_time timestamp, obs double, mu double, sigma double, error double, crps double, in_p10_p90 int"))
    cell = lambda s, v, x: ("nbm", "co", init, 60, init + timedelta(hours=1), s, v, "surface:0", 0, 0, x, 100.0, init)
    rows = [cell(s, v, x) for s in ("A", "B") for v, x in (("t2m", 284.15), ("t2m_sd", 1.5))]
    lake.append_bronze("bronze.nwp_point", spark.createDataFrame(rows, "model string, product string, init_time timestamp, lead_min int, valid_time timestamp, point_id string, variable string, level string, member int, k int, value double, grid_dist_m double, ingested_at timestamp"), ["nbm/1"])
    board = {(r.model_name, r.point): r for r in pipeline.run_blend_comparison(lake, [], tmp_path).collect()}
    assert {m for m, _ in board} == {"raw_hrrr", "nbm", "nbm_cal"} and board["nbm", "all"].n == 2 and board["nbm", "all"].bias == pytest.approx(-1)
    assert json.loads((tmp_path / "nbm" / "meta.json").read_text())["nbm_runs"] == 1


def test_verbs(at):
    parse = lambda *a: cli.parser().parse_args(["--lake", "x", *a])
    assert parse("holdout", "--groups", "A,B;C").groups == "A,B;C" and cli.groups("A,B;C") == [["A", "B"], ["C"]] and cli.groups("6") == 6
    assert parse("build", "static", "r", "z.npy", "h", "--corner", "1,2").cell == 10.0 and parse("ablation", "n", "a:b").pairs == "a:b"
    assert parse("backfill", "stations", "ndbc/X", "2025-01-01", "2025-02-01").refetch_days == 45 and parse("nbm").models == "bias_rolling"


def test_verbs_take_decoded_cycles_and_hours_in_and_resume(spark, tmp_path, capsys, monkeypatch):
    """backfill of a model's cycles and of network hours, ingest of the latest, each recorded under the id that its rows carry."""
    from datetime import UTC, datetime

    root, folder = f"file://{tmp_path}/lake", f"file://{tmp_path}/decoded"
    lake = Lake(spark, root)
    lake.init()
    t = lambda h: datetime(2025, 1, 1, h, tzinfo=UTC)
    cells = "product string, lead_min int, valid_time timestamp, point_id string, variable string, level string, member int, k int, value double"
    for h in (0, 2):
        spark.createDataFrame([("co", 60, t(h + 1), "P", "t2m", "2m", 0, 0, 280.0)], cells).write.parquet(f"{folder}/nbm/{t(h):%Y-%m-%dT%H}")
        report = [(0, "A ", "X", 37.5, -122.5, 3.0, int(t(h).timestamp()), 290.15, "V")]
        spark.createDataFrame(report, "pos int, stationId string, dataProvider string, latitude double, longitude double, elevation double, observationTime long, temperature double, temperatureDD string").write.parquet(f"{folder}/net/{t(h):%Y-%m-%dT%H}")
    monkeypatch.setattr(cli.session, "build", lambda *a: spark)
    run = lambda *a: cli.main(["--lake", root, *a])
    run("backfill", "nbm", "2025-01-01", "2025-01-02", f"{folder}/nbm")
    assert lake.recorded_batches("bronze.nwp_point") == {"nbm/2025-01-01T00", "nbm/2025-01-01T02"} == {r.ingest_batch for r in lake.read("bronze.nwp_point").collect()}
    run("backfill", "nbm", "2025-01-01", "2025-01-02", f"{folder}/nbm")
    run("ingest", "nwp", "nbm", "2025-01-01T02:00", f"{folder}/nbm")
    assert lake.read("bronze.nwp_point").count() == 2
    for _ in range(2):
        run("backfill", "madis", "2025-01-01", "2025-01-02", f"{folder}/net", "--bounds", "37,-123,38,-122")
    assert lake.recorded_batches("bronze.obs") == {"madis/2025-01-01T00", "madis/2025-01-01T02"} and lake.read("bronze.obs").count() == 2 and lake.read("bronze.stations").count() == 2
    assert "missing" in capsys.readouterr().out
