"""Gold after random changes of silver, against a full rebuild."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fogbank import refresh
from fogbank.lake import Lake
from fogbank.operators import features, gold
from fogbank.schemas import TABLES

DAYS, POINTS = 45, ("A", "B", "GGBC1")
NAMES = ("silver.nwp_aligned", "silver.obs_qc", "gold.training_examples", "gold.network_features", "gold.upwind_features")
TRAINING = ("gold.training_examples",)
NWP = "model string, init_time timestamp, lead_min int, valid_time timestamp, point_id string, t2m double, gust double"
OBS = "source string, station_id string, obs_time timestamp, variable string, qc_flag string, value double"


def forecasts(at, change=None):
    rnd = random.Random(1)
    out = []
    for d in range(DAYS):
        for h in (0, 6, 12, 13, 18):
            for p in POINTS:
                for lead in (0, 60, 120, 360):
                    init = at(1) + timedelta(days=d, hours=h)
                    v = 10 + rnd.gauss(0, 2) + (5.0 if change and change(p, init) else 0)
                    out.append(("hrrr", init, lead, init + timedelta(minutes=lead), p, v, v / 2))
    return out


def reports(at, lost=None):
    rnd = random.Random(2)
    out = []
    for d in range(DAYS):
        for h in range(24):
            for s in POINTS:
                t = at(1) + timedelta(days=d, hours=h, minutes=rnd.choice((-5, 0, 3)))
                for variable, base in (("t2m", 10), ("wind10", 3), ("rh2m", 60)):
                    v = base + rnd.gauss(0, 1)
                    if not (lost and lost(s, t)):
                        out.append(("madis", s, t, variable, "ok", v))
    return out


def put(spark, lake, at, change=None, lost=None):
    """Silver as rebuilt a day at a time for the days that differ, as ingests do."""
    lake.replace_partition("silver.nwp_aligned", spark.createDataFrame(forecasts(at, change), NWP))
    lake.replace_partition("silver.obs_qc", spark.createDataFrame(reports(at, lost), OBS))


def rebuilt(spark, lake, name, rows, schema, column, day):
    where = f"to_date({column}) = DATE '{day}'"
    lake.replace_partition(name, spark.createDataFrame(rows, schema).where(where), where)


def rounded(df):
    names = sorted(df.columns)
    return df.select(*[F.round(c, 9).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in names])


@pytest.fixture
def lake(spark, tmp_path):
    out = Lake(spark, f"file://{tmp_path}/lake", {k: TABLES[k] for k in NAMES})
    out.init()
    return out


def test_random_late_reports_and_cycles_give_what_a_full_rebuild_gives(spark, lake, at):
    late = lambda s, t: s == "B" and t.day == 20 and t.month == 1 and t.hour in (4, 5, 11)
    put(spark, lake, at, lost=late)
    assert set(refresh.refresh_gold(lake).values()) == {None}
    assert refresh.refresh_gold(lake) == {k: [] for k in NAMES[2:]}
    before = set(lake.files("gold.training_examples"))
    # Reports of 20 January come in late, and a cycle of the 22nd is read again.
    rebuilt(spark, lake, "silver.obs_qc", reports(at), OBS, "obs_time", "2025-01-20")
    again = lambda p, init: p == "A" and (init.day, init.month, init.hour) == (22, 1, 6)
    rebuilt(spark, lake, "silver.nwp_aligned", forecasts(at, again), NWP, "init_time", "2025-01-22")
    done = refresh.refresh_gold(lake)
    assert done["gold.training_examples"] == [(date(2025, 1, 19), date(2025, 2, 6))]
    nwp, obs = lake.read("silver.nwp_aligned"), lake.read("silver.obs_qc")
    full = gold.training_examples(nwp, obs)
    got = lake.read("gold.training_examples").select(*full.columns)
    assert got.count() == full.count() > 2000
    assert rounded(got).exceptAll(rounded(full)).isEmpty() and rounded(full).exceptAll(rounded(got)).isEmpty()
    ups = features.upwind_features(obs)
    got = lake.read("gold.upwind_features").select(*ups.columns)
    assert rounded(got).exceptAll(rounded(ups)).isEmpty() and rounded(ups).exceptAll(rounded(got)).isEmpty()
    # Files of other days are the same ones.
    now = set(lake.files("gold.training_examples"))
    day = lambda f: f.split("p_day=")[1][:10]
    assert {day(f) for f in before - now} == {str(date(2025, 1, 19) + timedelta(days=i)) for i in range(18)}
    assert len(before & now) >= 26 and refresh.refresh_gold(lake) == {k: [] for k in NAMES[2:]}


def test_a_rebuild_of_silver_that_changes_nothing_rewrites_nothing(spark, lake, at):
    put(spark, lake, at)
    refresh.refresh_gold(lake, tables=TRAINING)
    before = lake.files("gold.training_examples")
    rebuilt(spark, lake, "silver.obs_qc", reports(at), OBS, "obs_time", "2025-01-10")
    assert refresh.refresh_gold(lake, tables=TRAINING)["gold.training_examples"] == [] and lake.files("gold.training_examples") == before
    assert refresh.made_from(lake, "gold.training_examples")["silver.obs_qc"] == lake.current("silver.obs_qc")["version"]


def test_new_days_are_added(spark, lake, at):
    put(spark, lake, at)
    lake.replace_partition("silver.obs_qc", spark.createDataFrame([r for r in reports(at) if r[2] < at(1) + timedelta(days=40)], OBS))
    lake.replace_partition("silver.nwp_aligned", spark.createDataFrame([r for r in forecasts(at) if r[1] < at(1) + timedelta(days=40)], NWP))
    refresh.refresh_gold(lake, tables=TRAINING)
    put(spark, lake, at)
    refresh.refresh_gold(lake, tables=TRAINING)
    full = gold.training_examples(lake.read("silver.nwp_aligned"), lake.read("silver.obs_qc"))
    got = lake.read("gold.training_examples").select(*full.columns)
    assert rounded(got).exceptAll(rounded(full)).isEmpty() and rounded(full).exceptAll(rounded(got)).isEmpty()


def test_runs_of_days():
    d = lambda n: date(2025, 1, n)
    assert refresh.runs([d(3), d(1), d(2), d(7)]) == [(d(1), d(4)), (d(7), d(8))] and refresh.runs([]) == []
