"""Silver to gold: training rows whose features were visible when the forecast was issued."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogbank.functions.core import finite, first_where, hours_after, micros, minutes_after
from fogbank.schemas import CYCLIC_FIELDS, LAG_FIELDS, NWP_FIELDS, REGIME_FIELDS, TABLES, TARGETS

# Fixed values of the visibility rule, in minutes.
ISSUE_DELAY, OBS_DELAY = 55, 5
LATE = {"GGBC1": 80}
BIAS_DAYS = 14
#: The as-of bias works on stretches of the time axis of so many days, each with BIAS_DAYS before it.
STRETCH_DAYS = 112
#: Sums of multiples of 1 / GRID are exact up to 2^53 / GRID; errors are split into such a multiple and a small rest.
GRID = 2.0**20
MAX_LEAD = 360
LAG_CYCLES = 6
SNAP_MIN = 20
KEY = ("point_id", "init_time", "lead_min")
BIAS = tuple(f"{s}14_{t}" for t in TARGETS for s in ("bias", "std"))


def snapped(obs: DataFrame) -> DataFrame:
    """The report nearest to each hour within 20 minutes, for each station and variable; adds ``hour``."""
    us = micros("obs_time")
    hour = F.timestamp_micros(us + 1_800_000_000 - F.pmod(us + 1_800_000_000, F.lit(3_600_000_000)))
    near = obs.where("qc_flag = 'ok'").withColumn("hour", hour).withColumn("off", F.abs(us - micros("hour"))).where(F.col("off") <= SNAP_MIN * 60_000_000)
    # An aggregate: reports of one hour combine before the shuffle. Ties: the earlier, then source and value.
    best = near.groupBy("station_id", "variable", "hour").agg(F.min(F.struct("off", "obs_time", "source", "value")).alias("b"))
    return best.select("station_id", "variable", "hour", "b.obs_time", "b.source", "b.value")


def hourly(obs: DataFrame) -> DataFrame:
    """point_id, hour, t2m, gust: a calm hour's gust is its wind."""
    wide = (
        snapped(obs)
        .groupBy(F.col("station_id").alias("point_id"), "hour")
        .agg(*[first_where("value", F.col("variable") == v).alias(v) for v in ("t2m", "wind10", "gust")])
    )
    gust = F.when(F.col("wind10").isNotNull(), F.greatest(F.coalesce("gust", "wind10"), "wind10"))
    return wide.select("point_id", "hour", "t2m", gust.alias("gust"))


def lag_hours(delay: int) -> int:
    """Hours before the cycle of the newest hourly report visible at issue time."""
    return max(0, math.ceil((delay - ISSUE_DELAY) / 60))


def _by_delay(late: dict[str, int], of, point: str = "point_id") -> Column:
    out = F.lit(of(OBS_DELAY))
    for p, m in sorted(late.items()):
        out = F.when(F.col(point) == p, of(m)).otherwise(out)
    return out


def cyclic(ts: str = "valid_time") -> list[Column]:
    """Time of day and year on circles."""
    day, year = 2 * F.pi() * F.hour(ts) / 24, 2 * F.pi() * F.dayofyear(ts) / 365.25
    return [F.sin(day).alias("hour_sin"), F.cos(day).alias("hour_cos"), F.sin(year).alias("doy_sin"), F.cos(year).alias("doy_cos")]


def base_rows(nwp: DataFrame, hours: DataFrame, late: dict[str, int] = LATE) -> DataFrame:
    """Forecast rows with their truth and the latest report visible at issue time, and the lagged ensemble that nwp may have."""
    wide = [F.col(f).alias(f"nwp_{f}") for f in (*NWP_FIELDS, *REGIME_FIELDS) if f in nwp.columns] + [c for c in nwp.columns if c in LAG_FIELDS]
    rows = (
        nwp.where((F.col("model") == "hrrr") & (F.col("lead_min") <= MAX_LEAD))
        .select("point_id", "init_time", minutes_after("init_time", ISSUE_DELAY).alias("issue_time"), "lead_min", "valid_time", *wide, *cyclic())
        .withColumn("seen_hour", hours_after("init_time", -_by_delay(late, lag_hours)))
    )
    truth = hours.select("point_id", F.col("hour").alias("valid_time"), *[F.col(t).alias(f"obs_{t}") for t in TARGETS])
    seen = hours.select("point_id", F.col("hour").alias("seen_hour"), *[F.col(t).alias(f"obs_last_{t}") for t in TARGETS])
    return rows.join(truth, ["point_id", "valid_time"], "left").join(seen, ["point_id", "seen_hour"], "left")


def init_error(base: DataFrame, nwp: DataFrame | None = None) -> DataFrame:
    """Adds the forecast's own error at the last visible report: that hour's cycle at lead 0 (of nwp, else of base)."""
    first = base if nwp is None else nwp.where("model = 'hrrr'").withColumnsRenamed({t: f"nwp_{t}" for t in TARGETS})
    zero = first.where("lead_min = 0").select("point_id", F.col("init_time").alias("seen_hour"), *[F.col(f"nwp_{t}").alias(f"zero_{t}") for t in TARGETS])
    out = base.join(zero, ["point_id", "seen_hour"], "left")
    for t in TARGETS:
        out = out.withColumn(f"err_at_init_{t}", F.col(f"obs_last_{t}") - F.col(f"zero_{t}"))
    return out.drop("seen_hour", *[f"zero_{t}" for t in TARGETS])


def lag_members(base: DataFrame, nwp: DataFrame) -> DataFrame:
    """Forecasts of the up to six earlier cycles for the same valid hour, and the row's own (k = 0).

    A member of a cycle k hours earlier is a row of the same point and valid time with k hours more lead. The rows of a
    point and valid time meet in one equality join, and the cycles are compared there: no forecast is copied before the
    shuffle, and a row meets each cycle that reaches its valid time once. Two large sides: never a broadcast.
    """
    made = nwp.where("model = 'hrrr'").select("point_id", "valid_time", F.col("init_time").alias("made_at"), *TARGETS)
    both = base.select(*KEY, "valid_time").join(made.hint("merge"), ["point_id", "valid_time"])
    hour = F.lit(3_600_000_000)
    age = micros("init_time") - micros("made_at")
    both = both.where(age.between(0, LAG_CYCLES * hour) & (F.pmod(age, hour) == 0))
    return both.select("point_id", "valid_time", "init_time", "lead_min", *TARGETS, (age / hour).cast("int").alias("k"))


def lag_ensemble(base: DataFrame, nwp: DataFrame) -> DataFrame:
    """Count, mean and spread of the members, and the change since the previous cycle."""
    aggs = []
    for t in TARGETS:
        now, before = first_where(t, F.col("k") == 0), first_where(t, F.col("k") == 1)
        aggs += [F.count(t).alias(f"lag_n_{t}"), F.avg(t).alias(f"lag_mean_{t}"), F.stddev_samp(t).alias(f"lag_sd_{t}"), (now - before).alias(f"lag_d1_{t}")]
    # The valid time follows from the key; with it the members, dealt by point and valid time, are not dealt again.
    return lag_members(base, nwp).groupBy("valid_time", *KEY).agg(*aggs).drop("valid_time")


def with_lag_ensemble(nwp: DataFrame) -> DataFrame:
    """nwp with lag_ensemble's columns, by windows over a point's forecasts of a valid time. nwp: one row per point, cycle and lead."""
    hour = 3_600_000_000
    made = micros("init_time")
    cycles = Window.partitionBy("point_id", "valid_time", F.pmod(made, F.lit(hour))).orderBy(made)
    members, before = cycles.rangeBetween(-LAG_CYCLES * hour, 0), cycles.rangeBetween(-hour, -hour)
    out = []
    for t in TARGETS:
        of = {"n": F.count(t).over(members), "mean": F.avg(t).over(members), "sd": F.stddev_samp(t).over(members), "d1": F.col(t) - F.max(t).over(before)}
        out += [c.alias(f"lag_{k}_{t}") for k, c in of.items()]
    return nwp.select("*", *out)


def rolling_bias(base: DataFrame, late: dict[str, int] = LATE) -> DataFrame:
    """KEY and the as-of bias of each row of base."""
    return with_rolling_bias(base.select(*KEY, "issue_time", "valid_time", *[f"{p}_{t}" for t in TARGETS for p in ("obs", "nwp")]), late).select(*KEY, *BIAS)


def with_rolling_bias(base: DataFrame, late: dict[str, int] = LATE) -> DataFrame:
    """Adds the mean and spread of the errors of the last 14 days that were visible at issue time.

    Errors and questions share one axis: an error stands where it becomes visible and again, taken away, where the window leaves
    it behind; a question stands at its issue time. A running sum is the window's then, so the work per row doesn't grow
    with the window (a sliding frame would be summed anew for each row), one sort serves every lead and delay, and rows
    without an error are there once.

    The sums that are taken away are exact for errors as they occur (see GRID), so nothing of the errors before a window is
    left in its mean: it is the window's sum, rounded once, over the count.

    The axis is cut into stretches, so that a window's partition holds STRETCH_DAYS and the 14 before them, however long the
    history is; an error near the end of one stands in the next as well. NaN counts as missing, infinity as it is.
    """
    delay = _by_delay(late, lambda m: m) * 60
    issue, valid = F.unix_seconds("issue_time"), F.unix_seconds("valid_time")
    errors = {t: finite(F.col(f"obs_{t}") - F.col(f"nwp_{t}")) for t in TARGETS}
    long, window = STRETCH_DAYS * 86400, BIAS_DAYS * 86400
    stretch = lambda at: F.floor(at / long)
    seen, left = valid + delay, valid + window
    ask, come, go = F.lit(0), F.lit(1), F.lit(-1)
    some = (F.coalesce(*errors.values()).isNotNull()) & (seen < left)
    kind = F.col("kind")
    # Columns, not a struct, travel with the question: those that nobody reads are left out.
    events = base.withColumn("kind", F.explode(F.when(some, F.array(ask, come, go)).otherwise(F.array(ask))))
    within = F.when(kind == 0, F.sequence(stretch(issue), stretch(issue))).otherwise(F.sequence(stretch(seen), stretch(left)))
    rows = [F.when(kind == 0, F.col(c)).alias(c) for c in base.columns if c not in ("point_id", "lead_min")]
    signed = [F.when(kind != 0, e).alias(f"r_{t}") for t, e in errors.items()]
    axis = F.when(kind == 0, issue).when(kind == 1, seen).otherwise(left).alias("axis")
    both = events.select("point_id", "lead_min", "kind", axis, *rows, *signed, F.explode(within).alias("stretch"))
    # By point and lead: what is grouped by forecast afterwards lies right already.
    both = both.repartition("point_id", "lead_min")
    upto = Window.partitionBy("point_id", "lead_min", "stretch").orderBy("axis").rangeBetween(Window.unboundedPreceding, 0)

    def coarse(r: Column) -> Column:
        return F.when(F.abs(r) < 2.0**52 / GRID, F.rint(r * GRID) / GRID).otherwise(r)

    def rest_of(r: Column) -> Column:
        return F.when(F.abs(r) < 2.0**52 / GRID, r - coarse(r)).when(r.isNotNull(), 0.0)

    kinds = (("n", lambda r: F.sum(F.when(r.isNotNull(), kind))), ("s", lambda r: F.sum(kind * coarse(r))), ("e", lambda r: F.sum(kind * rest_of(r))), ("q", lambda r: F.sum(kind * r * r)))
    sums = [F.coalesce(f(F.col(f"r_{t}")).over(upto), F.lit(0)).alias(f"{k}_{t}") for t in TARGETS for k, f in kinds]
    inside = both.select(*base.columns, "kind", *sums).where("kind = 0")
    out = []
    for t in TARGETS:
        n, total, square = F.col(f"n_{t}"), F.col(f"s_{t}") + F.col(f"e_{t}"), F.col(f"q_{t}")
        spread = square - F.try_divide(total * total, n)
        spread = F.when(spread > 1e-11 * square, spread).otherwise(0.0)  # what rounding leaves of equal errors
        out += [F.try_divide(total, n).alias(f"bias14_{t}"), F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1))).alias(f"std14_{t}")]
    return inside.select(*base.columns, *out)


def training_examples(nwp: DataFrame, obs: DataFrame, late: dict[str, int] = LATE, labelled: bool = False) -> DataFrame:
    """gold.training_examples from silver.nwp_aligned and silver.obs_qc. labelled: only the rows with a truth of some target.

    Rows without any truth add nothing to the features of others, so they are left out before the features are made.
    """
    if labelled:
        base = base_rows(nwp, hourly(obs), late).where(F.coalesce(*[f"obs_{t}" for t in TARGETS]).isNotNull())
        out = init_error(with_rolling_bias(base, late), nwp).join(lag_ensemble(base.select(*KEY, "valid_time"), nwp), list(KEY), "left")
    else:
        # Forecasts are dealt by valid time while they are narrow, for their ensemble and truth; what follows from a row's times is made last.
        made = with_lag_ensemble(nwp.where("model = 'hrrr'").repartition("point_id", "valid_time"))
        base = base_rows(made, hourly(obs), late).drop(*CYCLIC_FIELDS)
        out = with_rolling_bias(init_error(base, nwp), late).select("*", *cyclic())
    names = TABLES["gold.training_examples"].schema.fieldNames()
    return out.select(*[n for n in names if n in out.columns])
