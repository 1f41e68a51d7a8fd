from datetime import timedelta

import numpy as np
import pytest

from fogbank.operators import features

OBS = "source string, station_id string, obs_time timestamp, variable string, value double, qc_flag string"


def test_network_changes_anomaly_and_west_less_east(spark, at):
    rows = []
    for s, lift in (("pa_w1", -6.0), ("pa_w2", -6.0), ("pa_e1", -2.0), ("pa_e2", -2.0)):
        for h in range(20 * 24):
            t = at(1) + timedelta(hours=h)
            last = h == 20 * 24 - 1
            rows.append(("purpleair", s, t, "t_sensor", float(t.hour) + (lift if last else 0.0), "ok"))
    lons = {"pa_w1": -122.5, "pa_w2": -122.49, "pa_e1": -122.42, "pa_e2": -122.41}
    f = features.network_features(spark.createDataFrame(rows, OBS), lons)
    got = {r.feature: r.value for r in f.where("init_time = TIMESTAMP '2025-01-21 00:00:00'").collect()}
    assert got["pa_w1_anom"] == pytest.approx(-6) and got["pa_mean_anom"] == pytest.approx(-4) and got["pa_west_east_anom"] == pytest.approx(-4)
    assert got["pa_e1_d1h"] == pytest.approx(-1.0) and got["pa_e1_d3h"] == pytest.approx(1.0)
    assert features.network_features(spark.createDataFrame(rows, OBS), {}).count() == 0


def test_upwind_push_and_anomaly(spark, at):
    rows, t0 = [], at(1)
    for i in range(9 * 144):
        t = t0 + timedelta(minutes=10 * i)
        push = t >= at(9, 22)  # 14:00 local
        rows.append(("madis", "604PG", t, "t2m", 15.0 - (3.0 if push else 0.0), "ok"))
        rows.append(("madis", "604PG", t, "rh2m", 60.0 + (10.0 if push else 0.0), "ok"))
        rows.append(("madis", "C5988", t, "t2m", 18.0, "ok"))
    f = features.upwind_features(spark.createDataFrame(rows, OBS))
    got = {(str(r.init_time), r.feature): r.value for r in f.where("init_time >= TIMESTAMP '2025-01-09 22:00:00'").collect()}
    at23 = lambda n: got.get(("2025-01-09 23:00:00", n))
    assert at23("up_coast_t2m_d1h") == pytest.approx(-3) and at23("up_coast_rh_d1h") == pytest.approx(10)
    assert at23("up_coast_t2m_anom") == pytest.approx(-3) and at23("up_coast_east_t2m_anom") == pytest.approx(-3)
    assert at23("up_push_age_min") == 60.0 and got.get(("2025-01-09 22:00:00", "up_push_age_min")) is None


def test_neighbours(spark, at):
    pts = spark.createDataFrame([("A", 37.77, -122.50), ("B", 37.77, -122.49), ("C", 37.77, -122.47), ("D", 37.77, -122.40)], "point_id string, lat double, lon double")
    p = features.nearest_pairs(pts)
    first = p.where("point_id = 'A' AND rank = 1").first()
    assert first.nb_id == "B" and first.dist_km == pytest.approx(0.88, abs=0.01)
    rows = [(n, at(1), 60, e, 1.0, 2.0, 3.0) for n, e in (("A", 9.0), ("B", 1.0), ("C", None), ("D", 3.0))]
    g = spark.createDataFrame(rows, "point_id string, init_time timestamp, lead_min int, err_at_init_t2m double, err_at_init_gust double, bias14_t2m double, bias14_gust double")
    r = features.neighbour_features(g, p).where("point_id = 'A'").first()
    d = {x.nb_id: x.dist_km for x in p.where("point_id = 'A'").collect()}
    assert r.nb1_err_at_init_t2m == 1.0 and r.nb2_err_at_init_t2m is None
    assert r.nbw_err_at_init_t2m == pytest.approx((1 / d["B"] + 3 / d["D"]) / (1 / d["B"] + 1 / d["D"]))


def test_missing_static_features_are_an_error(spark):
    g = spark.createDataFrame([("A",), ("B",)], "point_id string")
    with pytest.raises(ValueError, match="B"):
        features.attach(g, static=spark.createDataFrame([("A", 1.0)], "point_id string, st_elev double"))


def test_nearest_pairs_are_exact_wherever_points_lie(spark):
    rng = np.random.default_rng(5)
    crowd = [(37.7 + a, -122.4 + b) for a, b in rng.normal(0, 0.02, (60, 2))]
    at = crowd + [(37.7, -122.4)] * 8 + [(60 + a, 179.95 + 0.1 * (i % 2) - 360 * (i % 2)) for i, a in enumerate(rng.uniform(0, 1, 12))]
    at += [(float(a), float(b)) for a, b in zip(rng.uniform(-89.9, 89.9, 60), rng.uniform(-180, 180, 60), strict=True)] + [(89.99, 10.0), (89.99, -170.0), (-90.0, 0.0)]
    points = spark.createDataFrame([(f"p{i:03}", float(a), float(b)) for i, (a, b) in enumerate(at)], "point_id string, lat double, lon double")
    lat, lon = np.radians([a for a, _ in at]), np.radians([b for _, b in at])
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    dist = 12742 * np.arcsin(np.sqrt(np.minimum(1, h)))
    np.fill_diagonal(dist, np.inf)
    for few in (0, 1000):  # in boxes, and in a loop
        got = {}
        for r in features.nearest_pairs(points, 5, few).orderBy("point_id", "rank").collect():
            got.setdefault(int(r.point_id[1:]), []).append(r.dist_km)
        assert len(got) == len(at)
        for i, near in got.items():
            assert near == pytest.approx(np.sort(dist[i])[:5], abs=1e-5)
    assert features.nearest_pairs(points.where("point_id <= 'p002'"), 5, 0).count() == 6
    assert features.nearest_pairs(points.limit(0), 5).collect() == []


def test_network_features_of_stations_without_a_longitude(spark, at):
    """Those have features and count in the mean, but are on neither side; without others they are left out."""
    values = {"a": (10.0, 11.0), "b": (20.0, 24.0), "z": (30.0, 39.0)}
    data = [(s, at(d, 5), "t_sensor", v, "ok") for s, vs in values.items() for d, v in zip((1, 2), vs, strict=True)]
    obs = spark.createDataFrame(data, "station_id string, obs_time timestamp, variable string, value double, qc_flag string")
    lons = {"a": -122.5, "b": -122.4}
    all_ = {r.feature: r.value for r in features.network_features(obs, lons, others=True).collect()}
    assert all_ == {"pa_a_anom": 1.0, "pa_b_anom": 4.0, "pa_z_anom": 9.0, "pa_mean_anom": 14 / 3, "pa_west_east_anom": -3.0}
    some = {r.feature: r.value for r in features.network_features(obs, lons).collect()}
    assert some == {"pa_a_anom": 1.0, "pa_b_anom": 4.0, "pa_mean_anom": 2.5, "pa_west_east_anom": -3.0}


def test_network_features_query_has_every_station(spark, tmp_path):
    from fogbank.plans import registry, views

    n = 12 * views.USERS_PER_STATION
    e = spark.range(2 * n).selectExpr("id AS event_id", f"CAST(timestamp_micros(1704067200000000 + id div {n} * 3600000000 + id % {n} * 1000000) AS TIMESTAMP_NTZ) AS ts", f"id % {n} AS user_id", "'click' AS event_type", "double(id % 50) AS value", "'{}' AS props")
    e.write.parquet(f"{tmp_path}/events.parquet")
    names = {r.feature for r in registry.queries()["network_features"](spark, str(tmp_path)).collect()}
    assert {f"pa_S{i}_d1h" for i in (0, 8, 9, 10, 11)} <= names
