"""The queries' plans on tables with many stations: what is estimated, what is broadcast."""

import pytest

from fogbank.operators import forecasters, gold
from fogbank.plans import registry, views

STATIONS, HOURS = 60, 240
#: More rows than this are no small table here; the forecasts have 187,200.
SMALL = 2_000


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Events of enough users for 60 stations, over ten days."""
    d = tmp_path_factory.mktemp("many")
    kinds = "array('click', 'view', 'purchase', 'signup', 'error')"
    e = spark.range(20_000).selectExpr(
        "id AS event_id", f"CAST(timestamp_micros(1704067200000000 + id * {HOURS * 3_600_000_000 // 20_000}) AS TIMESTAMP_NTZ) AS ts", f"id * 7919 % {STATIONS * views.USERS_PER_STATION} AS user_id",
        f"{kinds}[int(id * 31 % 7 % 5)] AS event_type", "double(id * 37 % 400) / 10 AS value", "'{}' AS props",
    )
    e.write.parquet(f"{d}/events.parquet")
    return str(d)


@pytest.fixture
def low(spark):
    """Tables above 32 kB are not broadcast: the hours that the events cover are smaller, the hourly reports larger."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "32k")
    yield
    spark.conf.set(key, before)


def broadcasts(plan) -> list[int]:
    """The rows of every broadcast of an executed plan."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if kind == "BroadcastExchangeExec" else []
    return own + [n for p in below for n in broadcasts(p)]


def ran(df) -> list[int]:
    query = df._jdf.queryExecution()
    query.executedPlan().executeCollect()
    return broadcasts(query.executedPlan())


def test_forecast_view_is_not_taken_for_small(spark, many):
    nwp = views.nwp(spark, many)
    assert nwp.count() == STATIONS * HOURS * (views.LEADS + 1)
    assert nwp._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= nwp.count() * len(nwp.columns) * 8


@pytest.mark.parametrize("name", ["station_bias", "usable_rows", "sigma_by_lead", "lag_ensemble", "spread_sigma_fit", "blend_scores", "lag_members_range_join", "training_examples"])
def test_forecasts_are_not_broadcast(spark, many, low, name):
    assert max(ran(registry.queries()[name](spark, many)), default=0) <= SMALL


def test_points_are_not_literals_of_the_plan(spark):
    m = forecasters.make("gbm_residual", "t2m")
    m.state |= {"points": {f"S{i}": i for i in range(500)}, "cols": []}
    df = m._numbered(spark.createDataFrame([("S7",), ("S499",), ("new",)], "point_id string"))
    assert "S450" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.point_id, r.point_number) for r in df.collect()) == [("S499", 499), ("S7", 7), ("new", None)]


def test_gbm_query_makes_its_training_rows_once(spark, many, monkeypatch):
    """What the fit gets is made already, and has the rows and features of the whole training table."""
    got = []

    class Seen(Exception):
        pass

    class Stand:
        def fit(self, train):
            got.append(train)
            raise Seen

    monkeypatch.setattr(registry.forecasters, "make", lambda *a, **k: Stand())
    with pytest.raises(Seen):
        registry.queries()["gbm_forecast"](spark, many)
    plan = got[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    nwp, obs = views.nwp(spark, many), registry._obs_qc(spark, many)
    lean = gold.training_examples(nwp, obs, views.LATE, labelled=True)
    whole = gold.training_examples(nwp, obs, views.LATE).where("obs_t2m IS NOT NULL OR obs_gust IS NOT NULL")
    digits = [f"round({c}, 9) AS {c}" if t == "double" else c for c, t in whole.dtypes]
    a, b = whole.selectExpr(*digits), lean.selectExpr(*digits)
    assert a.count() == b.count() > 1000 and a.exceptAll(b).isEmpty()


def test_blend_makes_no_bias(spark, many):
    """The blend stands on the raw model's rows, which need no bias and are the same among all models' rows."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    raw, every = registry._scores(spark, many, raw=True), registry._scores(spark, many)
    assert "stretch" in plan(every) and "stretch" not in plan(registry.queries()["blend_scores"](spark, many))
    whole = every.where("model_name = 'raw_hrrr'")
    assert raw.count() == whole.count() > 1000 and raw.exceptAll(whole).isEmpty()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bias_asks_once_a_row_and_groups_nothing(spark, many):
    """Rows go into the window once, errors twice more, and what comes out needs no second grouping."""
    base = registry._base(spark, many)
    plan = optimized(gold.rolling_bias(base, views.LATE))
    assert plan.count("Aggregate") == optimized(base.select(*gold.KEY, "obs_t2m")).count("Aggregate")
    assert "explode(sequence" not in plan.split("Window")[0]


def test_bias_of_pruned_columns_carries_no_others(spark, many):
    plan = optimized(gold.with_rolling_bias(registry._base(spark, many), views.LATE).select(*gold.KEY, "bias14_t2m"))
    assert "hour_sin" not in plan and "nwp_v925" not in plan


def test_scores_make_the_bias_of_rows_with_a_truth(spark, many):
    assert "LeftOuter" not in optimized(registry._scores(spark, many))


def test_neighbours_are_multiplied_after_the_shuffle(spark, many):
    plan = optimized(registry.queries()["neighbour_features"](spark, many))
    assert 0 <= plan.find("inline(near") < plan.find("RepartitionByExpression [init_time")


def test_sigma_by_lead_makes_its_table_once(spark):
    rows = spark.createDataFrame([(60, 2.0, 1.0), (60, 5.0, 1.0), (120, 4.0, 3.0), (180, 1.0, None)], "lead_min int, nwp_t2m double, obs_t2m double")
    out = forecasters.make("raw_hrrr", "t2m").fit(rows).predict(rows)
    assert optimized(out).count("Aggregate [lead_min") == 1
    assert {r.lead_min: round(r.sigma, 6) for r in out.collect()} == {60: 2.915476, 120: 1.0, 180: 1.957738}
