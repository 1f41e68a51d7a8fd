import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogbank.functions.core import crps, last_known, norm_cdf
from fogbank.operators import forecasters, scoring
from fogbank.plans import views


def test_normal_distribution_and_crps(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.0), (0.0, 1e-3, 5.0), (1.0, 2.0, -1.5)], "mu double, sigma double, obs double")
    got = [r.c for r in df.select(crps("mu", "sigma", "obs").alias("c")).collect()]
    assert got[0] == pytest.approx(0.23369498, abs=1e-8) and got[1] == pytest.approx(5.0 - 1e-3 / math.sqrt(math.pi), abs=1e-12)
    z = spark.range(-8000, 8001).select((F.col("id") / 1000).alias("z")).select("z", norm_cdf(F.col("z")).alias("p")).collect()
    assert max(abs(r.p - (1 + math.erf(r.z / math.sqrt(2))) / 2) for r in z) < 1e-14
    assert max(abs(r.p / (math.erfc(-r.z / math.sqrt(2)) / 2) - 1) for r in z) < 1e-12  # relative, so that tails are right
    odd = spark.createDataFrame([(None,), (float("inf"),), (float("-inf"),), (40.0,), (-0.0,)], "z double")
    assert [r.p for r in odd.select(norm_cdf(F.col("z")).alias("p")).collect()] == [None, 1.0, 0.0, 1.0, 0.5]


def test_the_sql_has_another_formula_with_the_same_values():
    import duckdb

    text = views.norm_cdf_sql("z")
    got = duckdb.sql(f"SELECT z, {text} AS p FROM (SELECT i / 1000 AS z FROM range(-8000, 8001) t(i))").fetchall()
    assert max(abs(p - (1 + math.erf(z / math.sqrt(2))) / 2) for z, p in got) < 1e-13


SCORES = "model_name string, variable string, point_id string, init_time timestamp, lead_min int, valid_time timestamp, obs double, mu double, sigma double"


def scored(spark, at, rows):
    return scoring.score(spark.createDataFrame(rows, SCORES))


def two_models(spark, at):
    rows = []
    for d in range(1, 11):
        for m in (60, 240):
            rows.append(("raw_hrrr", "t2m", "FTPC1" if d % 2 else "KOAK", at(d), m, at(d, m // 60), 10.0, 12.0, 2.0))
            rows.append(("better", "t2m", "FTPC1" if d % 2 else "KOAK", at(d), m, at(d, m // 60), 10.0, 10.5, 1.0))
    rows.append(("raw_hrrr", "t2m", "KSFO", at(20), 60, at(20, 1), 10.0, 30.0, 2.0))
    return scored(spark, at, rows)


def test_common_rows_leaderboard_and_gate(spark, at):
    s = two_models(spark, at)
    assert scoring.common_rows(s).count() == 40
    board = scoring.leaderboard(s, {"original": ("FTPC1",)}, draws=50)
    b = {(r.model_name, r.bucket, r.point): r for r in board.collect()}
    best = b["better", "1-3 h", "all"]
    assert best.n == 10 and best.skill == pytest.approx(1 - best.crps / b["raw_hrrr", "1-3 h", "all"].crps)
    assert best.skill_lo == pytest.approx(best.skill) and b["better", "4-6 h", "original"].n == 5
    assert scoring.gate(board, "better").first().passed and not scoring.gate(board, "raw_hrrr").first().passed
    change = scoring.paired_change(s, "better", "raw_hrrr", 50).where("point = 'all' AND bucket = '1-3 h'").first()
    assert change.change == pytest.approx(-best.skill) and change.lo <= change.change <= change.hi + 1e-12


@pytest.mark.parametrize("days", [31, 60, 97])
def test_bootstrap_interval_is_as_wide_as_a_true_one(spark, days):
    rng = np.random.default_rng(days)
    m, b = rng.gamma(2, 1, days), rng.gamma(2, 1.1, days)
    rows = [("t2m", "x", "1-3 h", "all", f"{d:03}", float(x), float(y)) for d, (x, y) in enumerate(zip(m, b, strict=True))]
    blocks = spark.createDataFrame(rows, BLOCKS)
    got = scoring.bootstrap(blocks).first()
    at = rng.integers(0, days, (20_000, days))
    lo, hi = np.percentile(1 - m[at].sum(1) / b[at].sum(1), [2.5, 97.5])
    assert got.skill == pytest.approx(1 - m.sum() / b.sum())
    assert got.skill_hi - got.skill_lo == pytest.approx(hi - lo, rel=0.15) and abs(got.skill_lo - lo) < 0.15 * (hi - lo)


BLOCKS = "variable string, model_name string, bucket string, point string, day string, crps double, crps_base double"


def test_bootstrap_follows_its_integer_rule_in_plain_loops(spark):
    m, b = [1.0, 4.0, 2.5], [2.0, 3.0, 5.0]
    blocks = spark.createDataFrame([("t2m", "x", "1-3 h", "all", str(d), m[d], b[d]) for d in range(3)], BLOCKS)
    draws = []
    for r in range(1, 151):  # more than one lot, the last one not full
        days = []
        for j in range(3):
            x = (r * 1664525 + j * 1013904223 + 12345) % 2147483647
            for _ in range(4):
                x = (x * x + 12345) % 2147483647
            days.append(x % 3)
        draws.append(1 - sum(m[i] for i in days) / sum(b[i] for i in days))
    lo, hi = np.percentile(draws, [2.5, 97.5])
    got = scoring.bootstrap(blocks, 150).first()
    assert (got.skill_lo, got.skill_hi) == (pytest.approx(lo), pytest.approx(hi))


def test_bootstrap_without_baseline_or_rows(spark):
    zero = spark.createDataFrame([("t2m", "x", "1-3 h", "all", str(d), 1.0, 0.0) for d in range(3)], BLOCKS)
    got = scoring.bootstrap(zero, 20, more={"n": F.count("*")}).first()
    assert (got.skill, got.skill_lo, got.skill_hi, got.n) == (None, None, None, 3)
    assert scoring.bootstrap(zero.limit(0), 20).collect() == []


def test_last_known_takes_each_column_from_its_last_row(spark):
    df = spark.createDataFrame([("a", 1, 5.0, "x"), ("a", 2, None, "y"), ("a", 3, None, None), ("b", 1, None, None), ("a", 2, None, "w")], "k string, t int, v double, s string")
    got = {r.k: (r.t, r.v, r.s) for r in last_known(df, ["k"], ["t"]).collect()}
    assert got == {"a": (3, 5.0, "y"), "b": (1, None, None)} and last_known(df.limit(0), ["k"], ["t"]).collect() == []


def test_month_excluded_rms(spark, at):
    rows = [("t2m", at(1), 60, 13.0, 10.0), ("t2m", at(2), 60, 11.0, 10.0)]
    df = spark.createDataFrame(rows, "variable string, init_time timestamp, lead_min int, mu double, obs double")
    assert [r.rms_other for r in scoring.month_excluded_rms(df).collect()] == [pytest.approx(math.sqrt(5))] * 2
    more = df.unionByName(df.withColumn("init_time", F.expr("init_time + INTERVAL 31 DAYS")).withColumn("mu", F.lit(14.0)))
    got = {(r.init_time.month): r.rms_other for r in scoring.month_excluded_rms(more).collect()}
    assert got == {1: pytest.approx(4.0), 2: pytest.approx(math.sqrt(5))}


def test_spread_fit(spark):
    rng = np.random.default_rng(3)
    spread = rng.uniform(0.2, 2, 5000)
    resid = rng.normal(0, np.sqrt(0.25 + spread**2))
    df = spark.createDataFrame([(60, float(a), float(b)) for a, b in zip(spread, resid, strict=True)], "lead_min int, spread double, resid double")
    r = forecasters.spread_fit(df).first()
    assert r.a == pytest.approx(0.25, abs=0.12) and r.b == pytest.approx(1, abs=0.15)
    assert forecasters.spread_fit(df.limit(50)).count() == 0


def test_folds_and_groups(spark, at):
    df = spark.sql("SELECT explode(sequence(TIMESTAMP '2025-01-10 00:00:00', TIMESTAMP '2025-06-20 00:00:00', INTERVAL 1 DAY)) AS init_time")
    assert [r.fold for r in scoring.monthly_folds(df).orderBy("fold").collect()] == ["2025-04", "2025-05", "2025-06"]
    wide = scoring.monthly_folds(df, 1, 3, 3).orderBy("fold").collect()
    assert [(r.fold, r.test_end.month) for r in wide] == [("2025-02", 5), ("2025-05", 8)]
    groups = scoring.station_groups(list("ABCDEFG"), 3)
    assert sorted(groups) == list("ABCDEFG") and sorted(groups.values()) == [0, 0, 0, 1, 1, 2, 2]


def gold_rows(spark):
    """Forecasts 2 C too cold, with the bias known."""
    return spark.sql("""SELECT p AS point_id, init_time, init_time + INTERVAL 55 MINUTES AS issue_time, lead_min, timestampadd(MINUTE, lead_min, init_time) AS valid_time, 10.0D + hour(init_time) AS nwp_t2m,
      12.0D + hour(init_time) + ((hash(p, init_time, lead_min) % 100) / 100.0D) AS obs_t2m, 2.0D AS bias14_t2m
    FROM (SELECT explode(array('A', 'B')) AS p) a, (SELECT explode(sequence(TIMESTAMP '2025-01-01 00:00:00', TIMESTAMP '2025-05-10 00:00:00', INTERVAL 12 HOURS)) AS init_time) b, (SELECT explode(array(0, 60, 120)) AS lead_min) c""")


def test_backtest_end_to_end(spark):
    s = forecasters.backtest(gold_rows(spark), ["raw_hrrr", "bias_rolling"], ["t2m"])
    got = s.groupBy("model_name").agg(F.avg("crps").alias("c"), F.avg("in_p10_p90").alias("in"), F.min("lead_min").alias("m"), F.countDistinct("fold").alias("f")).collect()
    by = {r.model_name: r for r in got}
    assert 1 - by["bias_rolling"].c / by["raw_hrrr"].c > 0.3 and by["raw_hrrr"].m == 60 and by["raw_hrrr"].f == 2
    assert 0.5 < by["bias_rolling"]["in"] <= 1


def test_holdout_checks(spark):
    g = gold_rows(spark)
    for groups, says in (([["Z"]], "unknown"), ([[" "]], "named"), ([["A", "B"]], "none is left")):
        with pytest.raises(ValueError, match=says):
            forecasters.checked_groups(g, groups)
    s = forecasters.holdout(g, ["raw_hrrr"], ["t2m"], [["A"]])
    assert {r.point_id for r in s.select("point_id").distinct().collect()} == {"A"}


def test_boosted_needs_its_inputs_and_learns(spark):
    g = gold_rows(spark)
    for c in ("hour_sin", "hour_cos", "doy_sin", "doy_cos"):
        g = g.withColumn(c, F.sin(F.hour("valid_time").cast("double")))
    with pytest.raises(ValueError, match="st_"):
        forecasters.make("gbm_terrain", "t2m").columns(g)
    with pytest.raises(ValueError, match="unknown model"):
        forecasters.make("nothing", "t2m")
    both = g.withColumns({"st_elev_m": F.lit(1.0), "nb1_t2m": F.lit(1.0), "nbw_t2m": F.lit(2.0), "nbm_t2m": F.lit(3.0)})
    with pytest.raises(ValueError, match="nb"):
        forecasters.make("gbm_terrain_neighbours", "t2m").columns(both.drop("nb1_t2m", "nbw_t2m"))
    assert {c for c in forecasters.make("gbm_nwp_neighbours", "t2m").columns(both) if c[:2] in ("nb", "st")} == {"st_elev_m", "nb1_t2m", "nbw_t2m"}
    m = forecasters.make("gbm_nwp", "t2m", rounds=5).fit(g)
    out = m.predict(g).agg(F.avg(F.abs(F.col("mu") - F.col("obs_t2m"))).alias("e"), F.min("sigma").alias("s")).first()
    assert out.e < 1.0 and out.s >= 0.1


def test_gbm_query_trains_with_the_default_rounds(spark, monkeypatch):
    from fogbank.plans import registry

    class Made(Exception):
        pass

    def make(name, target, **options):
        raise Made(options)

    monkeypatch.setattr(registry.forecasters, "make", make)
    with pytest.raises(Made) as made:
        registry.queries()["gbm_forecast"](spark, "/root/testdata/sf0.001")
    assert made.value.args == ({},)


def test_fits_at_once_give_the_same_scores_and_overlap(spark, monkeypatch):
    import threading
    import time

    g = gold_rows(spark)
    for c in ("hour_sin", "hour_cos", "doy_sin", "doy_cos"):
        g = g.withColumn(c, F.sin(F.hour("valid_time").cast("double")))
    spans, lock, real = [], threading.Lock(), forecasters.Fit.scores

    def timed(self, *a, **k):
        began = time.perf_counter()
        out = real(self, *a, **k)
        with lock:
            spans.append((began, time.perf_counter()))
        return out

    monkeypatch.setattr(forecasters.Fit, "scores", timed)
    names, made = ["raw_hrrr", "bias_rolling", "gbm_nwp"], []
    for at_once in (1, 4):
        spans.clear()
        made.append(forecasters.backtest(g, names, ["t2m"], at_once=at_once, rounds=3))
        overlap = any(a < d and c < b for i, (a, b) in enumerate(spans) for c, d in spans[i + 1 :])
        assert len(spans) == len(forecasters.planned_fits(g, names, ["t2m"])) and overlap == (at_once > 1)
    digits = [[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes] for m in made]
    one, four = (m.select(*d) for m, d in zip(made, digits, strict=True))
    assert one.count() == four.count() > 100 and one.exceptAll(four).isEmpty()


def test_bootstrap_explodes_no_draws_and_keeps_nulls_and_infinities_apart(spark):
    rows = [("t2m", "x", "1-3 h", p, str(d), m, 2.0 + d) for p, ms in (("null", [None, 4.0, 2.5]), ("inf", [float("inf"), 4.0, 2.5]), ("one", [None, None, 1.0])) for d, m in enumerate(ms)]
    frame = scoring.bootstrap(spark.createDataFrame(rows, BLOCKS), 150)
    assert "explode" not in frame._jdf.queryExecution().optimizedPlan().toString()
    got = {r.point: r for r in frame.collect()}
    for p, ms in (("null", [None, 4.0, 2.5]), ("inf", [float("inf"), 4.0, 2.5]), ("one", [None, None, 1.0])):
        draws = []
        for r in range(1, 151):
            days = []
            for j in range(3):
                x = (r * 1664525 + j * 1013904223 + 12345) % 2147483647
                for _ in range(4):
                    x = (x * x + 12345) % 2147483647
                days.append(x % 3)
            known = [ms[i] for i in days if ms[i] is not None]
            if known:
                draws.append(1 - sum(known) / sum(2.0 + i for i in days))
        draws.sort()
        at = 0.975 * (len(draws) - 1)
        assert got[p].skill_hi == pytest.approx(draws[int(at)] * (1 - at % 1) + draws[int(at) + 1] * (at % 1))


def test_month_excluded_rms_windows_over_months_only(spark, at):
    df = spark.createDataFrame([("t2m", at(1), 60, 13.0, 10.0), (None, at(1), 60, 12.0, 10.0)], "variable string, init_time timestamp, lead_min int, mu double, obs double")
    got = scoring.month_excluded_rms(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Window [", 1)[1] and sorted(r.rms_other for r in got.collect()) == [2.0, 3.0]


def test_a_forecast_equal_to_its_truth_but_for_rounding_is_in_the_bin_from_one_half(spark):
    # errors of three forecasts before, whose mean is the next forecast's error: 27.81 - 12.3 = (15.4 + 15.52 + 15.61) / 3
    mean = math.fsum(obs - nwp for obs, nwp in ((25.5, 10.1), (27.12, 11.6), (23.91, 8.3))) / 3
    up, down = (math.nextafter(39.87, math.inf * s) for s in (1, -1))
    same = [(27.81, 12.3 + mean, 20.0), (39.87, up, 24.0), (39.87, down, 24.0), (39.87, 39.87, 24.0), (0.0, 1e-15, 20.0), (50.0, math.nextafter(50.0, 99), 0.05)]
    other = [(1.0, 1.0 + 1e-9, 20.0), (1.0 + 1e-9, 1.0, 20.0), (math.inf, 1.0, 20.0), (-math.inf, 1.0, 20.0)]
    bins = []
    for rows in (same, other):
        frame = spark.createDataFrame([("t2m", "x", *r) for r in rows], "variable string, model_name string, obs double, mu double, sigma double")
        bins.append({r.bin: r.n for r in scoring.pit_histogram(frame).collect()})
    assert bins == [{5: len(same)}, {0: 1, 4: 1, 5: 1, 9: 1}]


def test_pit_histogram_query_puts_forecasts_of_one_earlier_error_where_its_sql_does(spark, tmp_path):
    import duckdb

    from fogbank.plans import registry

    # A report an hour after each of two cycles; the second's error is the first's in decimals, and by its last bits in bin 4 or 5.
    bins = []
    for k, (first, second) in enumerate(((15.07, 15.87), (30.33, 31.13))):
        folder = tmp_path / str(k)
        folder.mkdir()
        con = duckdb.connect()
        con.execute("CREATE TABLE events AS SELECT i AS event_id, make_timestamp((473400 + h) * 3600000000) AS ts, 0::BIGINT AS user_id, kind AS event_type, v::DOUBLE AS value FROM (VALUES "
            f"(1, -1, 'signup', 50), (2, 0, 'click', {first}), (3, 23, 'signup', 50), (4, 24, 'click', {second})) t(i, h, kind, v)")  # fmt: skip
        con.execute(f"COPY events TO '{folder}/events.parquet'")
        cols = ("variable", "model_name", "bin", "n")
        want = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()['pit_histogram']})").fetchall())
        got = sorted(tuple(r[c] for c in cols) for r in registry.queries()["pit_histogram"](spark, str(folder)).collect())
        assert got == want
        bins.append({r[2] for r in got if r[1] == "bias_rolling"})
    assert 4 in bins[0] and 4 not in bins[1] and 5 in bins[1]
