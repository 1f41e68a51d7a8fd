"""As-of features against the literal rule."""

import math
import random
import statistics
from datetime import timedelta

import pytest

from fogbank.operators import gold

NWP = "model string, init_time timestamp, lead_min int, valid_time timestamp, point_id string, t2m double, gust double, wind10 double"
OBS = "source string, station_id string, obs_time timestamp, variable string, value double, qc_flag string"


def forecasts(spark, at, points, hours, leads, value=lambda p, i, m: 10.0):
    t0 = at(1)
    return spark.createDataFrame(
        [("hrrr", t0 + timedelta(hours=i), 60 * m, t0 + timedelta(hours=i + m), p, value(p, i, m), 5.0, 3.0) for p in points for i in range(hours) for m in leads], NWP
    )


def reports(spark, seen):
    return spark.createDataFrame([("madis", p, t, v, x, "ok") for (p, t, v), x in seen.items()], OBS)


def test_snap_to_the_hour_and_gust_fill(spark, at):
    seen = {("A", at(1, 0, 56), "t2m"): 11.0, ("A", at(1, 1, 10), "t2m"): 12.0, ("A", at(1, 2, 30), "t2m"): 99.0, ("A", at(1, 1), "wind10"): 4.0}
    r = gold.hourly(reports(spark, seen)).collect()
    assert [(x.hour.hour, x.t2m, x.gust) for x in r] == [(1, 11.0, 4.0)]


def test_rolling_bias_equals_the_rule(spark, at):
    rnd = random.Random(7)
    points, hours, leads, late = ["A", "B", "L"], 20 * 24, [0, 1, 3, 6], {"L": 80}
    t0 = at(1)
    truth = {(p, t0 + timedelta(hours=h), "t2m"): 10 + rnd.gauss(0, 3) for p in points for h in range(hours + 6) if rnd.random() > 0.2}
    nwp = forecasts(spark, at, points, hours, leads, lambda p, i, m: 10.0 + (i * 7 + m) % 5)
    base = gold.base_rows(nwp, gold.hourly(reports(spark, truth)), late)
    got = gold.rolling_bias(base, late).toPandas()
    assert len(got) == len(points) * hours * len(leads)
    tested = 0
    for r in got.iloc[::53].itertuples():
        init, m = r.init_time.to_pydatetime().replace(tzinfo=t0.tzinfo), r.lead_min // 60
        issue, delay = init + timedelta(minutes=55), timedelta(minutes=late.get(r.point_id, 5))
        errors = []
        for i in range(hours):
            valid = t0 + timedelta(hours=i + m)
            if (x := truth.get((r.point_id, valid, "t2m"))) is not None and valid + delay <= issue and valid > issue - timedelta(days=14):
                errors.append(x - (10 + (i * 7 + m) % 5))
        if errors:
            tested += 1
            assert r.bias14_t2m == pytest.approx(statistics.mean(errors))
            if len(errors) > 1:
                assert r.std14_t2m == pytest.approx(statistics.stdev(errors))
        else:
            assert r.bias14_t2m != r.bias14_t2m
    assert tested > 50


def test_rolling_bias_keeps_nothing_of_older_errors(spark, at):
    # Errors of 20 days with two decimals; a mean that is off in the last bit moves a forecast that is equal to its truth to another bin.
    rnd, t0, hours = random.Random(11), at(1), 20 * 24
    truth = {("A", t0 + timedelta(hours=h), "t2m"): round(rnd.uniform(0, 99), 2) for h in range(hours + 2) if rnd.random() > 0.7}
    nwp = forecasts(spark, at, ["A"], hours, [1], lambda p, i, m: (100 + i * 7 % 80) / 10)
    got = gold.rolling_bias(gold.base_rows(nwp, gold.hourly(reports(spark, truth)))).collect()
    assert len(got) == hours
    for r in got:
        issue = r.init_time.replace(tzinfo=t0.tzinfo) + timedelta(minutes=55)
        seen = [(t0 + timedelta(hours=i + 1), (100 + i * 7 % 80) / 10) for i in range(hours)]
        errors = [truth["A", v, "t2m"] - x for v, x in seen if ("A", v, "t2m") in truth and issue - timedelta(days=14) < v + timedelta(minutes=5) <= issue]
        assert r.bias14_t2m == (math.fsum(errors) / len(errors) if errors else None)


def test_late_station_uses_the_hour_before(spark, at):
    nwp = forecasts(spark, at, ["GGBC1"], 6, [0, 1], lambda p, i, m: 10.0 * (i + 1))
    truth = {("GGBC1", at(1, h), "t2m"): 11.5 + h for h in range(7)}
    rows = gold.training_examples(nwp, reports(spark, truth))
    r = rows.where("lead_min = 60").orderBy("init_time").collect()[2]
    assert r.obs_last_t2m == 12.5 and r.err_at_init_t2m == 12.5 - 20.0 and r.obs_t2m == 14.5


def test_lag_ensemble(spark, at):
    nwp = forecasts(spark, at, ["A"], 5, range(9), lambda p, i, m: 10.0 + i)
    base = gold.base_rows(nwp, gold.hourly(reports(spark, {("A", at(1), "t2m"): 1.0})))
    r = gold.lag_ensemble(base, nwp).where("lead_min = 60").orderBy("init_time").collect()[3]
    assert (r.lag_n_t2m, r.lag_mean_t2m, r.lag_d1_t2m, r.lag_sd_gust) == (4, 11.5, 1.0, 0.0)
    assert base.agg({"lead_min": "max"}).first()[0] == 360


def test_training_examples_deal_their_wide_rows_once(spark):
    """The ensemble comes from windows over the forecasts as they are dealt for the truth: no pairs of cycles, no join of all rows by key."""
    from fogbank.plans import registry

    plan = registry.queries()["training_examples"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 3 and "Join Inner" not in plan and plan.count("rightHint=(strategy=merge)") == 0
