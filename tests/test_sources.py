import json
import math
from datetime import UTC, date, datetime

import numpy as np
import pytest

from fogbank.lake import Lake
from fogbank.operators import terrain
from fogbank.schemas import TABLES
from fogbank.sources import catalog, feeds, grids, parsers


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.strip().split("\n")], "value string")


def values(df):
    return {(r.station_id, r.variable): r.value for r in df.collect()}


def test_airport_csv(spark):
    head = "station,valid,tmpf,dwpf,sknt,drct,gust"
    got = values(parsers.asos(lines(spark, f"#DEBUG\n{head}\nKSFO,2025-10-01 00:56,64.00,M,13.00,280.00,"), head))
    assert got["KSFO", "t2m"] == pytest.approx(17.778, abs=1e-3) and got["KSFO", "wind10"] == pytest.approx(13 * 0.514444)
    assert ("KSFO", "d2m") not in got and ("KSFO", "gust") not in got


def test_hydrological_csv(spark):
    head = "station,utc_valid,PPQRZZZ,TAIRGZZ,TAIRZNZ"
    assert values(parsers.hads(lines(spark, f"{head}\nX1,2025-10-01 00:15:00,,50,\nX1,2025-10-01 01:15:00,,bad,"), head)) == {("X1", "t2m"): pytest.approx(10.0)}


def test_buoy_text(spark):
    text = "#YY MM DD hh mm WDIR WSPD GST WVHT DPD APD MWD PRES ATMP WTMP DEWP VIS TIDE\n#yr\n2025 10 01 00 10 280 5.0 99.0 MM MM MM MM 1015 14.5 999.0 MM MM MM"
    assert values(parsers.stdmet(lines(spark, text), "FTPC1")) == {("FTPC1", "wdir10"): 280, ("FTPC1", "wind10"): 5.0, ("FTPC1", "t2m"): 14.5}


def test_sensor_documents(spark):
    doc = json.dumps(dict(DateTime="2025/10/05T20:01:02z", current_temp_f=68, current_humidity=50, pressure=1010.5, pm2_5_atm=3.0, pm2_5_atm_b=4.0))
    assert values(parsers.sensor_json(lines(spark, doc), "pa"))["pa", "t_sensor"] == pytest.approx(20)
    hist = json.dumps(dict(fields=["time_stamp", "humidity", "temperature"], data=[[1759363200, 40, 50], [1759366800, None, 59]]))
    got = parsers.sensor_history(lines(spark, hist), "pa").collect()
    assert sorted((r.obs_time.hour, r.variable, round(r.value, 6)) for r in got) == [(0, "rh_sensor", 40), (0, "t_sensor", 10), (1, "t_sensor", 15)]


def test_network_hour_keeps_the_last_report_in_the_box(spark):
    cols = "pos long, stationId string, dataProvider string, latitude double, longitude double, elevation double, observationTime double, temperature double, temperatureDD string, altimeter double"
    df = spark.createDataFrame([(0, "A ", "P", 37.7, -122.5, 5.0, 1.76e9, 290.0, "V", 101300.0), (1, "A ", "P", 37.7, -122.5, 5.0, 1.76e9, 291.0, "B", float("nan")), (2, "far", "P", 10.0, 0.0, 0.0, 1.76e9, 290.0, "V", None)], cols)
    obs, stations = parsers.network_hour(df, (37.0, -123.0, 38.0, -122.0))
    assert sorted((r.station_id, r.variable, round(r.value, 2), r.qc_flag) for r in obs.collect()) == [("A", "altimeter", 1013.0, None), ("A", "t2m", 17.85, "B")]
    assert [r.station_id for r in stations.collect()] == ["A"]


def test_picked_cells_to_long(spark, at):
    df = spark.createDataFrame([("A", 0, at(1), 15, 37.7, 237.5, 1.5, 290.0, float("nan"))], "point_id string, k int, init_time timestamp, step_min int, latitude double, longitude double, distance_km double, t2m double, gust double")
    r = parsers.picked_to_long(df, ["t2m", "gust"], "hrrr", "subh", "b").collect()
    assert len(r) == 1 and (r[0].lead_min, r[0].grid_lon, r[0].grid_dist_m) == (15, -122.5, 1500.0) and r[0].valid_time.minute == 15


def test_grid_round_trip_and_neighbours(spark):
    g = grids.Lambert()
    x, y = g.project(37.77, -122.45)
    lat, lon = g.unproject(x, y)
    assert (float(lat), float(lon)) == (pytest.approx(37.77), pytest.approx(-122.45))
    near = g.neighbours(37.77, -122.45)
    assert len(near) == 4 and near == sorted(near, key=lambda n: n[2]) and near[0][2] < 2200
    with pytest.raises(ValueError, match="outside"):
        g.neighbours(0.0, 0.0)
    r0, r1, c0, c1 = g.window((37.6, -122.6, 37.9, -122.3))
    assert r0 < near[0][0] < r1 and c0 < near[0][1] < c1
    cells = [(r, c, *map(float, g.unproject(g.x0 + c * g.cell, g.y0 + r * g.cell))) for r in range(r0, r1) for c in range(c0, c1)]
    got = grids.nearest_cells(spark.createDataFrame([("A", 37.77, -122.45)], "point_id string, lat double, lon double"), spark.createDataFrame(cells, "row int, col int, cell_lat double, cell_lon double"))
    assert {(r.row, r.col) for r in got.collect()} == {(r, c) for r, c, _ in near}


def test_sequences_and_selectors():
    t = lambda d, h=0: datetime(2025, 1, d, h, tzinfo=UTC)
    assert len(grids.cycles(t(1), t(4), 3)) == 24 and {c.hour % 3 for c in grids.cycles(t(1), t(4), 3)} == {0, 1, 2}
    assert grids.months(date(2025, 1, 15), date(2025, 3, 2)) == [(date(2025, 1, 15), date(2025, 2, 1)), (date(2025, 2, 1), date(2025, 3, 1)), (date(2025, 3, 1), date(2025, 3, 2))]
    assert grids.lead_minutes("0-2") == [0, 60, 120] and grids.lead_minutes("0,3") == [0, 180]
    assert grids.select("regime, t2m") == [*grids.REGIME, "t2m"]
    with pytest.raises(ValueError, match="unknown"):
        grids.select("nope")


def test_transverse_mercator_and_routes():
    z = grids.Zone(10)
    # Known places: the meridian's arc to 45 degrees, and the zone's edge on the equator.
    assert [float(v) for v in z.plane(45.0, -123.0)] == pytest.approx([500_000, 0.9996 * 4984944.378], abs=0.001)
    assert float(z.plane(0.0, -120.0)[0]) == pytest.approx(833978.557, abs=0.001)
    lat, lon = np.meshgrid(np.linspace(1, 70, 24), np.linspace(-126, -120, 13))
    back = z.globe(*z.plane(lat, lon))
    assert np.abs(back[0] - lat).max() < 1e-9 and np.abs(back[1] - lon).max() < 1e-9
    pts = grids.densify("r", [(37.0, -122.0), (37.01, -122.0), (37.01, -121.99)], 250)
    assert [p["point_id"] for p in pts] == [f"r:{i}" for i in range(len(pts))] and len(pts) == 9  # 1109.9 m north, 889.8 m east
    assert (pts[0]["lat"], pts[0]["lon"]) == pytest.approx((37.0, -122.0)) and (pts[-1]["lat"], pts[-1]["lon"]) == pytest.approx((37.01, -121.99))
    # A degree of latitude has 110,988 m here, one of longitude 88,985 m, each 0.9997 of that in the plane; steps are of 249.9 m.
    step = (0.01 * 110_988 + 0.01 * 88_985) / 8
    assert pts[1]["lat"] == pytest.approx(37 + step / 110_988, abs=1 / 110_988) and pts[6]["lon"] == pytest.approx(-122 + (6 * step - 1109.88) / 88_985, abs=1 / 88_985)
    assert [round(pts[i]["bearing"]) % 360 for i in (0, 1, 7, 8)] == [0, 0, 90, 90]
    corner = grids.densify("c", [(37.0, -122.0), (37.001, -122.0), (37.001, -122.0 + 110.988 / 88_985)], 110.98)[1]  # 5 m to either side of the turn
    assert 30 < corner["bearing"] < 60 and grids.densify("d", [(37.0, -122.0), (37.00001, -122.0)], 250)[0]["bearing"] == pytest.approx(0, abs=1e-6)


def test_nearest_cells_widen_their_boxes_until_they_are_sure(spark):
    rng = np.random.default_rng(5)
    cells = [(i, 0, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-60, 60, 300), rng.uniform(-170, 170, 300), strict=True))]
    points = [(f"P{i}", float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-50, 50, 25), rng.uniform(-120, 120, 25), strict=True))]
    point_schema, cell_schema = "point_id string, lat double, lon double", "row int, col int, cell_lat double, cell_lon double"
    got: dict = {}
    for r in grids.nearest_cells(spark.createDataFrame(points, point_schema), spark.createDataFrame(cells, cell_schema), degrees=6.0).collect():
        got.setdefault(r.point_id, {})[r.k] = r.row

    def apart(a, o, b, p):
        a, o, b, p = map(math.radians, (a, o, b, p))
        return math.asin(math.sqrt(math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((p - o) / 2) ** 2))

    for name, a, o in points:
        want = sorted(cells, key=lambda c: apart(a, o, c[2], c[3]))[:4]
        assert [got[name][k] for k in range(4)] == [c[0] for c in want]
    few = grids.nearest_cells(spark.createDataFrame(points[:2], point_schema), spark.createDataFrame(cells[:3], cell_schema), degrees=50.0)
    assert few.count() == 6 and grids.nearest_cells(spark.createDataFrame(points[:2], point_schema), spark.createDataFrame([], cell_schema), degrees=50.0).count() == 0


def test_settings(tmp_path):
    (tmp_path / "r.geojson").write_text(json.dumps(dict(type="Feature", geometry=dict(type="LineString", coordinates=[[-122.0, 37.0], [-122.0, 37.01]]))))
    (tmp_path / "p.yaml").write_text("places: [{id: home, lat: '${LAT}', lon: -122.4}]\nstations: [{id: KSFO, lat: 37.6, lon: -122.4}]\nroutes: [{id: r, geojson: r.geojson, every_m: 500}]\n")
    assert len(catalog.load_registry(tmp_path / "p.yaml", {"LAT": "37.7"}).points()) == 5
    with pytest.raises(ValueError, match="LAT is not set"):
        catalog.load_registry(tmp_path / "p.yaml", {})
    (tmp_path / "q.yaml").write_text("places: [{id: a, lat: 1, lon: 2}]\nstations: [{id: a, lat: 1, lon: 2}]\n")
    with pytest.raises(ValueError, match="duplicate"):
        catalog.load_registry(tmp_path / "q.yaml")
    assert catalog.bounds("37,-123,38,-122") == (37, -123, 38, -122)
    for bad in ("1,2,3", "38,-123,37,-122", "nan,0,1,2"):
        with pytest.raises(ValueError):
            catalog.bounds(bad)
    now = datetime(2025, 1, 1, 5, 30, tzinfo=UTC)
    assert catalog.parse_init("latest-2", now).hour == 3 and catalog.parse_init("2025-01-01T02:00").tzinfo is UTC


def test_fetch_waits_and_gives_up():
    answers, waits = [(429, {"Retry-After": "3"}, b""), (200, {}, b"ok")], []
    assert catalog.fetch(lambda: answers.pop(0), sleep=waits.append) == b"ok" and waits == [3.0]
    assert catalog.fetch(lambda: (404, {}, b"")) is None
    with pytest.raises(OSError):
        catalog.fetch(lambda: (503, {}, b""), 2, lambda s: None)


def test_model_height_and_known_points(spark, at):
    cells = spark.createDataFrame([("P", 10.0, 50.0), ("P", 40.0, 300.0)], "point_id string, height double, dist_m double")
    assert terrain.model_terrain(cells).first().model_height == pytest.approx((10 / 100 + 40 / 300) / (1 / 100 + 1 / 300))
    registry = spark.createDataFrame([("P", 1.0, 2.0)], "point_id string, lat double, lon double")
    told = spark.createDataFrame([("P", 9.0, 9.0, at(1)), ("Q", 3.0, 4.0, at(1)), ("Q", None, 5.0, at(2))], "station_id string, lat double, lon double, ingested_at timestamp")
    assert sorted(map(tuple, terrain.known_points(registry, told).collect())) == [("P", 1.0, 2.0), ("Q", 3.0, 5.0)]
    x, y = grids.utm(37.77, -122.43)
    assert (x, y) == pytest.approx((550199.0, 4180469.0), abs=400) and grids.utm(0, -123) == pytest.approx((500_000, 0), abs=1e-6)


# --- feeds ------------------------------------------------------------------------

def test_realtime_hours(spark, tmp_path, at):
    lake = Lake(spark, f"file://{tmp_path}/l", {k: TABLES[k] for k in ("bronze.obs", "bronze.stations")})
    lake.init()
    report = spark.createDataFrame([(0, "A ", "X", 37.5, -122.5, 3.0, int(at(1, 4).timestamp()), 290.15, "V")], "pos int, stationId string, dataProvider string, latitude double, longitude double, elevation double, observationTime long, temperature double, temperatureDD string")
    pull = lambda minute: feeds.realtime(lake, lambda t: report if t.hour == 4 else None, (37, -123, 38, -122), now=at(1, 5, minute))
    assert pull(10) == pull(50) == dict(fetched=1, missing=1)
    assert lake.recorded_batches("bronze.obs") == {"madis-rt/2025-01-01T04@2025-01-01T05:10", "madis-rt/2025-01-01T04@2025-01-01T05:50"}
    assert [r.value for r in lake.read("bronze.obs").collect()] == [pytest.approx(17.0)] * 2 and lake.read("bronze.stations").first().station_id == "A"


def test_indoor_sensor_is_refused(spark):
    page = lambda place: json.dumps({"place": place, "DateTime": "2025/01/05T10:00:00z", "current_temp_f": 50.0}).encode()
    got = feeds.local_sensor(spark, lambda u, p: (200, {}, page("outside")), "h", "pa_1").collect()
    assert [(r.variable, r.value) for r in got] == [("t_sensor", pytest.approx(10))]
    with pytest.raises(ValueError, match="inside"):
        feeds.local_sensor(spark, lambda u, p: (200, {}, page("inside")), "h", "pa_1")


def test_messages_and_cycles(spark, at):
    index = "1:0:d=2025010100:TMP:2 m above ground:1 hour fcst:\n2:100:d=2025010100:TMP:2 m above ground:75 min fcst:\n3:250:d=2025010100:GUST:surface:1 hour fcst:\n4:400:d=2025010100:TMP:2 m above ground:1 hour fcst:ens std dev:\n"
    assert feeds.message_ranges(index, feeds.RRFS_MESSAGES) == [(0, 99), (250, 399), (400, None)]
    assert feeds.message_ranges(index, feeds.NBM_MEAN) == [(0, 99)] and feeds.message_ranges(index, feeds.NBM_SPREAD) == [(400, None)]
    asked = []

    def pick(init, lead, pattern):
        asked.append((lead, pattern))
        return spark.createDataFrame([("P", 0, init, 60 * lead, 37.0, 238.0, 1.5, 290.0, 5.0)], "point_id string, k int, init_time timestamp, step_min int, latitude double, longitude double, distance_km double, t2m double, i10fg double")

    got = {(r.lead_min, r.variable): r.value for r in feeds.nbm_cycle(pick, at(1), [1, 2]).collect()}
    assert set(got) == {(m, v) for m in (60, 120) for v in ("t2m", "t2m_sd", "gust", "gust_sd")} and len(asked) == 4
    assert feeds.rrfs_cycle(pick, at(1), [1]).first().ingest_batch == "rrfs/2025-01-01T00"


def test_archive_windows_are_read_by_tasks_and_kept(spark, tmp_path, at):
    full = np.arange(2 * 450 * 450, dtype="float32").reshape(2, 450, 450)
    full[:, 200, 200] = feeds.FILL
    log = tmp_path / "asked"
    log.mkdir()

    def chunk(name, kind, i, j):  # runs in the tasks: what was asked for is told by files
        (log / f"{name}-{kind}-{i}-{j}").touch()
        return None if name == "absent" else full[: 1 if kind == "anl" else 2, 150 * i : 150 * i + 150, 150 * j : 150 * j + 150]

    box = (140, 310, 190, 205)
    window = lambda *names: feeds.cycle_window(spark, f"file://{tmp_path}/store", at(1), names, box, chunk)
    got = {(r.lead_min, r.row, r.col): r.value for r in window("a").collect()}
    assert len(got) == 3 * 171 * 16 and {m for m, _, _ in got} == {0, 60, 120}
    assert got[0, 200, 200] is None and got[120, 140, 190] == full[1, 140, 190] and got[0, 310, 205] == full[0, 310, 205]
    assert len(list(log.iterdir())) == 2 * 3 * 1 + 2 * 3 * 0 + (2 * 3 if 205 // 150 != 190 // 150 else 0)
    for f in log.iterdir():
        f.unlink()
    assert window("a").count() == len(got) and not list(log.iterdir())
    assert {r.variable for r in window("a", "b").select("variable").distinct().collect()} == {"a", "b"} and {f.name[0] for f in log.iterdir()} == {"b"}
    with pytest.raises(catalog.Missing, match="absent"):
        window("a", "absent")


def test_elevation_tiles_are_read_by_tasks_once(spark, tmp_path):
    z = np.arange(30 * 50, dtype="float32").reshape(30, 50)
    log = tmp_path / "asked"
    log.mkdir()

    def tile(w, s, e, n):
        (log / f"{w:.0f}-{s:.0f}").touch()
        return z[int(s / 10) : int(n / 10), int(w / 10) : int(e / 10)]

    store = f"file://{tmp_path}/store"
    r = feeds.elevation(spark, store, tile, (0, 0, 500, 300), size=200)
    assert (r.rows, r.cols, r.x0, r.y0) == (30, 50, 5, 5) and len(list(log.iterdir())) == 6
    assert {(c.row, c.col): c.z for c in r.cells.collect()} == {(i, j): z[i, j] for i in range(30) for j in range(50)}
    for f in log.iterdir():
        f.unlink()
    assert feeds.elevation(spark, store, tile, (0, 0, 500, 300), size=200).cells.count() == 1500 and not list(log.iterdir())
    with pytest.raises(Exception, match="gaps"):
        feeds.elevation(spark, store, lambda *b: np.full((20, 20), np.nan), (0, 0, 200, 200), size=200)
    with pytest.raises(ValueError, match="box"):
        feeds.elevation(spark, store, tile, (0, 0, 505, 300))
