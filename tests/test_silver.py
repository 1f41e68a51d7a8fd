import math

import pytest
from pyspark.sql import functions as F

from fogbank.operators import silver

NWP = "model string, product string, init_time timestamp, lead_min int, valid_time timestamp, point_id string, variable string, level string, member int, k int, value double, grid_lon double, grid_dist_m double, ingested_at timestamp"
OBS = "source string, station_id string, obs_time timestamp, variable string, value double, qc_flag string, ingested_at timestamp"


def cell(at, variable, value, k=0, dist=500.0, level="surface:0", lon=-97.5, seen=1, member=0):
    return ("hrrr", "sfc", at(1), 60, at(1, 1), "A", variable, level, member, k, value, lon, dist, at(2, seen))


def aligned(spark, cells):
    return silver.nwp_aligned(spark.createDataFrame(cells, NWP)).first()


def test_inverse_distance_skips_missing_cells(spark, at):
    r = aligned(spark, [cell(at, "t2m", 290.0), cell(at, "t2m", 293.0, 1, 1000.0), cell(at, "gust", None)])
    assert r.t2m == pytest.approx((290 / 500 + 293 / 1000) / (1 / 500 + 1 / 1000) - 273.15)
    assert r.t2m_spread == pytest.approx(3.0) and r.gust is None


def test_latest_ingest_wins_and_other_members_are_left_out(spark, at):
    r = aligned(spark, [cell(at, "t2m", 290.0, seen=1), cell(at, "t2m", 280.0, seen=5), cell(at, "t2m", 300.0, seen=9, member=1)])
    assert r.t2m == pytest.approx(280 - 273.15) and r.ingested_at.hour == 5


@pytest.mark.parametrize("lon,turn", [(-97.5, 0.0), (-122.43, 0.6225146366376195 * 24.93)])
def test_wind_is_turned_to_earth(spark, at, lon, turn):
    r = aligned(spark, [cell(at, "u10", 0.0, lon=lon), cell(at, "v10", 10.0, lon=lon)])
    assert r.wdir10 == pytest.approx(180 - turn) and r.wind10 == pytest.approx(10)


def test_levels_become_fields(spark, at):
    r = aligned(
        spark,
        [cell(at, "gh", 300.0, level="cloudBase:0"), cell(at, "gh", 450.0, level="cloudCeiling:0"), cell(at, "t", 293.15, level="isobaricInhPa:925"), cell(at, "blh", 400.0), cell(at, "u", 3.0, level="isobaricInhPa:925"), cell(at, "v", 4.0, level="isobaricInhPa:925")],
    )
    assert (r.cloud_base, r.ceiling, r.hpbl) == (300, 450, 400) and r.t925 == pytest.approx(20)
    assert math.hypot(r.u925, r.v925) == pytest.approx(5)


def test_quality_flags_in_order(spark, at):
    def o(station, variable, value, flag=None, seen=1):
        return ("madis", station, at(1), variable, value, flag, at(2, seen))

    df = spark.createDataFrame(
        [o("X", "t2m", 15.0), o("X", "t2m", 16.0, seen=3), o("X", "gust", 120.0), o("X", "wind10", 5.0, "B"), o("X", "d2m", None), o("GGBC1", "t2m", -10.7), o("GGBC1", "wdir10", 116.0), o("FTPC1", "wdir10", 116.0), o("Y", "d2m", float("nan"), "X")], OBS
    )
    got = {(r.station_id, r.variable): (r.value, r.qc_flag) for r in silver.obs_qc(df).collect()}
    assert got["X", "t2m"] == (16.0, "ok") and got["X", "gust"][1] == "range" and got["X", "wind10"][1] == "source_rejected"
    assert got["X", "d2m"] == (None, "missing") and got["Y", "d2m"][1] == "missing"
    assert got["GGBC1", "t2m"][1] == "station_fault" and got["GGBC1", "wdir10"] == (250.0, "ok") and got["FTPC1", "wdir10"] == (116.0, "ok")


def test_blend_counts_the_weights_of_missing_values(spark, at):
    def n(variable, value, k, dist):
        return ("nbm", "core", at(1), 60, at(1, 1), "A", variable, "", 0, k, value, 0.0, dist, at(2))

    df = spark.createDataFrame([n("t2m", 290.0, 0, 1000.0), n("t2m", 292.0, 1, 3000.0), n("gust", 4.0, 0, 1000.0), n("gust", None, 1, 1000.0)], NWP)
    r = silver.nbm_aligned(df).first()
    assert r.t2m == pytest.approx((290 / 1000 + 292 / 3000) / (1 / 1000 + 1 / 3000) - 273.15) and r.gust == pytest.approx(2.0)


def test_empty_tables(spark):
    assert silver.nwp_aligned(spark.createDataFrame([], NWP)).count() == 0
    assert silver.obs_qc(spark.createDataFrame([], OBS)).select(F.count("*")).first()[0] == 0
