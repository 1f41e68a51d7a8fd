"""Forecast scores, paired evaluation, bootstrap intervals, leaderboards and report tables."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fogbank.functions.core import Z90, crps, hours_after, lead_bucket, norm_cdf

BASELINE = "raw_hrrr"
KEY = ("variable", "point_id", "init_time", "lead_min")
LOCAL_TZ = "America/Los_Angeles"
# The stations of the first gate.
ORIGINAL = ("FTPC1", "KOAK", "KSFO", "SFOC1")
GATE_MODEL = "gbm_residual"
BUCKETS = ("1-3 h", "4-6 h")
# A bootstrap index in integers, which any engine repeats: x = (r * a + j * b + s) mod p for draw r and place j, then
# STEPS times x = (x * x + s) mod p; the day is x mod days. No product passes 2^62.
DRAWS = 1000
MIX = dict(a=1664525, b=1013904223, s=12345, p=2**31 - 1)
STEPS = 4


def score(df: DataFrame) -> DataFrame:
    """Adds the quantiles, error, CRPS and whether the truth lies within p10 to p90."""
    return (
        df.withColumn("p10", F.col("mu") - Z90 * F.col("sigma"))
        .withColumn("p50", F.col("mu"))
        .withColumn("p90", F.col("mu") + Z90 * F.col("sigma"))
        .withColumn("error", F.col("mu") - F.col("obs"))
        .withColumn("crps", crps("mu", "sigma", "obs"))
        .withColumn("in_p10_p90", ((F.col("obs") >= F.col("p10")) & (F.col("obs") <= F.col("p90"))).cast("int"))
    )


def rms_by_lead(df: DataFrame, resid: str = "resid") -> DataFrame:
    return df.where(F.col(resid).isNotNull()).groupBy("lead_min").agg(F.sqrt(F.avg(F.col(resid) * F.col(resid))).alias("rms"))


def by_forecast(scores: DataFrame) -> DataFrame:
    """One row per forecast with the list of its models' rows: at most one per model, so the lists are short."""
    rest = [c for c in scores.columns if c not in KEY]
    return scores.groupBy(*KEY).agg(F.collect_list(F.struct(*rest)).alias("made"))


def common_rows(scores: DataFrame) -> DataFrame:
    """Only the forecasts that every model of the variable made."""
    return _made_by_all(scores).select(*KEY, F.inline("made")).select(*scores.columns)


def _made_by_all(scores: DataFrame) -> DataFrame:
    """by_forecast() of the common rows. A variable's models are counted over the same lists, so that the scores are dealt once."""
    made = by_forecast(scores)
    models = made.select("variable", F.explode("made.model_name").alias("name")).groupBy("variable").agg(F.countDistinct("name").alias("models"))
    both = made.join(F.broadcast(models), "variable")  # one row per variable: a handful
    return both.where(F.size(F.array_distinct("made.model_name")) == F.col("models")).drop("models")


def paired(scores: DataFrame, base: str = BASELINE, common: bool = False) -> DataFrame:
    """Rows of every model next to the base model's CRPS for the same forecast. common: of common_rows() only."""
    ours = F.filter("made", lambda x: x["model_name"] == base)
    made = _made_by_all(scores) if common else by_forecast(scores)
    rows = made.withColumn("crps_base", F.get(ours, F.lit(0))["crps"]).where(F.col("crps_base").isNotNull())
    rows = rows.select(*KEY, "crps_base", F.inline("made")).select(*scores.columns, "crps_base")
    return rows.withColumn("bucket", lead_bucket("lead_min")).withColumn("day", F.to_date("valid_time"))


def skill():
    return 1 - F.try_divide(F.sum("crps"), F.sum("crps_base"))


def pooled(pairs: DataFrame, groups: dict[str, Collection[str]] | None = None) -> DataFrame:
    """Each row under its point, under ``all``, and under each named group that holds its point."""
    names = [F.array(F.col("point_id"), F.lit("all"))] + [F.when(F.col("point_id").isin(list(ids)), F.array(F.lit(g))).otherwise(F.array()) for g, ids in (groups or {}).items()]
    return pairs.withColumn("point", F.explode(F.concat(*names)))


CELL = ("variable", "model_name", "bucket", "point")


def day_blocks(pairs: DataFrame, by=CELL) -> DataFrame:
    """Sums per day: whole days are what the bootstrap draws."""
    return pairs.groupBy(*by, "day").agg(F.sum("crps").alias("crps"), F.sum("crps_base").alias("crps_base"), F.count("*").alias("n"))


#: Cells whose draws are in memory at once: 8 MB for 1,000 draws.
TOGETHER = 1000


@lru_cache(4)
def _places(draws: int, days: int) -> tuple[np.ndarray, np.ndarray]:
    """The day of each draw (from 1) and place (from 0), and how often each draw holds each day."""
    x = (np.arange(1, draws + 1)[:, None] * MIX["a"] + np.arange(days) * MIX["b"] + MIX["s"]) % MIX["p"]
    for _ in range(STEPS):
        x = (x * x + MIX["s"]) % MIX["p"]
    place = x % days
    return place, np.bincount((place + np.arange(draws)[:, None] * days).ravel(), minlength=draws * days).reshape(draws, days).astype(float)


def _ends(m: np.ma.MaskedArray, b: np.ma.MaskedArray, draws: int, at=(0.025, 0.975)) -> np.ndarray:
    """The quantiles of the skill of cells (rows) whose days (columns) are drawn; NaN where no draw has a skill."""
    place, held = _places(draws, m.shape[1])

    def sums(v: np.ma.MaskedArray) -> tuple[np.ndarray, np.ndarray]:
        known, v = ~np.ma.getmaskarray(v), v.filled(0.0)
        wild = ~np.isfinite(v).all(1)
        out = np.where(wild[:, None], 0.0, v) @ held.T
        for i in np.flatnonzero(wild):  # a day that isn't drawn must not count, not even as 0 x infinity
            out[i] = v[i][place].sum(1)
        return out, np.ones(out.shape, bool) if known.all() else known @ held.T > 0

    with np.errstate(all="ignore"):
        (sm, has_m), (sb, has_b) = sums(m), sums(b)
        has = has_m & has_b & (sb != 0)
        drawn = np.sort(np.where(has, 1 - sm / sb, np.nan), 1)  # NaN comes last
        n, out = has.sum(1), []
        for q in at:
            spot = (n - 1) * q
            low = np.maximum(np.floor(spot), 0).astype(int)[:, None]
            high = np.maximum(np.ceil(spot), 0).astype(int)[:, None]
            a, z = (np.take_along_axis(drawn, i, 1)[:, 0] for i in (low, high))
            out.append(np.where(high[:, 0] == low[:, 0], a, a * (high[:, 0] - spot) + z * (spot - low[:, 0])))
    return np.ma.masked_array(out, np.stack([n == 0] * len(at))).T


def bootstrap(blocks: DataFrame, draws: int = DRAWS, by=CELL, more: dict | None = None) -> DataFrame:
    """skill, skill_lo, skill_hi per cell: days are drawn with replacement by an integer rule that any engine repeats.

    A cell's days are arrays (one entry per day), so the blocks are read once. The rule depends on the number of days only: how
    often each draw holds each day is one matrix for all cells of so many days, and their draws' sums are a product with it.
    ``more`` adds aggregates of the blocks. A draw whose baseline sums to zero has no skill and is left out of the interval.
    """
    more = more or {}
    days = F.array_sort(F.collect_list(F.struct("day", "crps", "crps_base"))).alias("d")
    cells = blocks.groupBy(*by).agg(days, skill().alias("skill"), *[v.alias(k) for k, v in more.items()])
    fixed = [*by, "skill", *more]
    lists = cells.select(*fixed, F.col("d.crps").cast("array<double>").alias("m"), F.col("d.crps_base").cast("array<double>").alias("b"))

    def part(lists: pa.ListArray, size: int, rows: np.ndarray) -> np.ma.MaskedArray:
        got = lists.take(pa.array(rows)).flatten()
        return np.ma.masked_array(got.fill_null(0.0).to_numpy(zero_copy_only=False), got.is_null().to_numpy(zero_copy_only=False)).reshape(len(rows), size)

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, b = batch.column("m"), batch.column("b")
            sizes = m.value_lengths().to_numpy()
            ends = np.ma.masked_all((batch.num_rows, 2))
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                for rows in np.array_split(mine, -(-len(mine) // TOGETHER)):
                    ends[rows] = _ends(part(m, size, rows), part(b, size, rows), draws)
            mask = np.ma.getmaskarray(ends)
            made = [pa.array(ends.data[:, i], pa.float64(), mask=mask[:, i]) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in fixed], *made], names=[*fixed, "skill_lo", "skill_hi"])

    ends = [T.StructField(c, T.DoubleType()) for c in ("skill_lo", "skill_hi")]
    return lists.mapInArrow(intervals, T.StructType([*[lists.schema[c] for c in fixed], *ends]))


def leaderboard(scores: DataFrame, groups: dict[str, Collection[str]] | None = None, draws: int = DRAWS) -> DataFrame:
    """One row per variable, model, lead bucket and point (or ``all``, or a group), on common rows.

    All figures come from one set of day sums.
    """
    used = scores.select(*KEY, "model_name", "valid_time", "crps", "error", "in_p10_p90")
    rows = pooled(paired(used, common=True).where(F.col("bucket").isNotNull()), groups)
    means = {"mae": F.abs("error"), "bias": F.col("error"), "coverage_80": F.col("in_p10_p90")}
    days = rows.groupBy(*CELL, "day").agg(F.sum("crps").alias("crps"), F.sum("crps_base").alias("crps_base"), F.count("*").alias("rows"), *[F.sum(v).alias(f"s_{k}") for k, v in means.items()])
    total = F.sum("rows")
    more = {"n": total, "mean_crps": F.sum("crps") / total} | {k: F.sum(f"s_{k}") / total for k in means}
    return bootstrap(days, draws, more=more).withColumnRenamed("mean_crps", "crps").select(*CELL, "n", "crps", *means, "skill", "skill_lo", "skill_hi")


def monthly_skill(scores: DataFrame) -> DataFrame:
    month = F.date_format("init_time", "yyyy-MM").alias("month")
    out = paired(scores.select(*KEY, "model_name", "valid_time", "crps", "error"), common=True).groupBy("variable", "model_name", month).agg(
        F.avg("crps").alias("crps"), F.avg("crps_base").alias("crps_base"), F.avg(F.abs("error")).alias("mae"), F.count("*").alias("n")
    )
    return out.withColumn("skill", 1 - F.try_divide("crps", "crps_base"))


def paired_change(scores: DataFrame, model: str, base: str, draws: int = DRAWS) -> DataFrame:
    """CRPS change of a model against another per variable, bucket and point; negative is better."""
    rows = pooled(paired(scores.select(*KEY, "model_name", "valid_time", "crps"), base).where((F.col("model_name") == model) & F.col("bucket").isNotNull()))
    out = bootstrap(day_blocks(rows), draws, more={"n": F.sum("n")})
    return out.select(*CELL, "n", (-F.col("skill")).alias("change"), (-F.col("skill_hi")).alias("lo"), (-F.col("skill_lo")).alias("hi"), F.lit(base).alias("base"))


def gate(board: DataFrame, model: str = GATE_MODEL) -> DataFrame:
    """variable, point, passed: the interval of every lead bucket lies above 0, and both buckets are there.

    The point is ``original`` where the board has it, else ``all``; the board is evaluated once.
    """
    mine = F.col("model_name") == model
    per = board.where(F.col("point").isin("original", "all")).groupBy("variable", "point")
    rows = per.agg(F.bool_and(F.when(mine, F.col("skill_lo") > 0)).alias("above"), F.count(F.when(mine, 1)).alias("cells"))
    # Two rows per variable: a handful for the one task.
    has = F.max((F.col("point") == "original").cast("int")).over(Window.partitionBy())
    chosen = rows.withColumn("has", has).where((F.col("cells") > 0) & (F.col("point") == F.when(F.col("has") == 1, "original").otherwise("all")))
    return chosen.select("variable", "point", (F.col("above") & (F.col("cells") == len(BUCKETS))).alias("passed"))


# --- report tables ----------------------------------------------------------------

#: Standard deviations below which an error is rounding: sums in doubles leave about 1e-16 to 1e-13.
NO_ERROR = 1e-12


def local_hour(ts: str = "valid_time"):
    return F.hour(F.from_utc_timestamp(ts, LOCAL_TZ))


def by_lead(scores: DataFrame) -> DataFrame:
    rows = paired(scores).withColumn("lead_h", F.floor(F.col("lead_min") / 60))
    return rows.groupBy("variable", "model_name", "lead_h").agg(F.count("*").alias("n"), F.avg("crps").alias("crps"), skill().alias("skill"), F.avg(F.abs("error")).alias("mae"), F.avg("in_p10_p90").alias("coverage_80"))


def by_local_hour(scores: DataFrame) -> DataFrame:
    return scores.groupBy("variable", "model_name", local_hour().alias("local_hour")).agg(F.count("*").alias("n"), F.avg(F.abs("error")).alias("mae"), F.avg("error").alias("bias"))


def pit_histogram(scores: DataFrame, no_error: float = NO_ERROR) -> DataFrame:
    """Forecasts per tenth of the probability integral transform. One that is equal to its truth but for rounding (by less than no_error
    of its sigma) is at one half, where bin 5 begins: the last bits of its sums don't choose its bin, unless no_error is 0."""
    z = (F.col("obs") - F.col("mu")) / F.col("sigma")
    # A column of its own: repeated in each place of norm_cdf's polynomials, the rule took ten times as long.
    rows = scores.withColumn("z", F.when(F.abs(z) < no_error, 0.0).otherwise(z))
    pit = norm_cdf(F.col("z"))
    return rows.withColumn("bin", F.least(F.floor(pit * 10), F.lit(9)).cast("int")).where("bin IS NOT NULL").groupBy("variable", "model_name", "bin").agg(F.count("*").alias("n"))


def raw_bias(scores: DataFrame) -> DataFrame:
    """Observed less forecast of the raw model by month and local hour."""
    month = F.date_format(F.from_utc_timestamp("valid_time", LOCAL_TZ), "yyyy-MM").alias("month")
    return scores.where(F.col("model_name") == BASELINE).groupBy("variable", "point_id", month, local_hour().alias("local_hour")).agg((-F.avg("error")).alias("obs_minus_hrrr"), F.count("*").alias("n"))


def freshness(obs: DataFrame) -> DataFrame:
    """Per station: sources, first and last report, rows, and the share that is flagged."""
    return obs.groupBy("station_id").agg(
        F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("source"),
        F.min("obs_time").alias("first"), F.max("obs_time").alias("last"), F.count("*").alias("rows"), F.avg((F.col("qc_flag") != "ok").cast("int")).alias("flagged"),
    )


# --- the blend as a benchmark -----------------------------------------------------

BLEND_FLOOR = 0.05


def month_excluded_rms(rows: DataFrame, by=("variable",)) -> DataFrame:
    """Adds rms_other: the root mean square error per lead over all other months; a lone month uses its own."""
    keys = (*by, "lead_min", "month")
    sq = (F.col("mu") - F.col("obs")) * (F.col("mu") - F.col("obs"))
    rows = rows.withColumn("month", F.date_format("init_time", "yyyy-MM"))
    # Sums of months, which combine before the shuffle: no task holds a lead's rows.
    months = rows.groupBy(*keys).agg(F.sum(sq).alias("q"), F.count(sq).alias("n"))
    lead = Window.partitionBy(*keys[:-1])
    total, n = F.sum("q").over(lead), F.sum("n").over(lead)
    others = n - F.col("n")
    ms = F.when(others > 0, F.try_divide(total - F.col("q"), others)).otherwise(F.try_divide(total, n))
    table = months.select(*[F.col(c).alias(f"of_{c}") for c in keys], F.sqrt(F.greatest(ms, F.lit(0.0))).alias("rms_other"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys]
    out = rows.join(F.broadcast(table), same, "left")  # tens of leads by months
    return out.drop("month", *[f"of_{c}" for c in keys])


def blend_scores(blend: DataFrame, scores: DataFrame) -> DataFrame:
    """Scored rows ``nbm`` (own spread) and ``nbm_cal`` (month-excluded RMS) on the raw model's rows."""
    base = scores.where(F.col("model_name") == BASELINE).select(*KEY, "valid_time", "obs")
    out = None
    for t in ("t2m", "gust"):
        n = blend.where(F.col(t).isNotNull() & F.col(f"{t}_sd").isNotNull()).select("point_id", "init_time", "lead_min", F.col(t).alias("mu"), F.col(f"{t}_sd").alias("sd"))
        m = base.where(F.col("variable") == t).join(n, ["point_id", "init_time", "lead_min"])
        out = m if out is None else out.unionByName(m)
    out = month_excluded_rms(out)
    floor = F.lit(BLEND_FLOOR)
    both = [F.struct(F.lit(name).alias("model_name"), F.greatest(c, floor).alias("sigma")) for name, c in (("nbm", "sd"), ("nbm_cal", "rms_other"))]
    return score(out.select(*[c for c in out.columns if c not in ("sd", "rms_other")], F.inline(F.array(*both))))


# --- folds ------------------------------------------------------------------------


def monthly_folds(rows: DataFrame, min_train_months: int = 3, every: int = 1, months: int = 1) -> DataFrame:
    """fold, test_start, test_end: months from the first one after the training months."""
    span = rows.agg(F.date_trunc("month", F.min("init_time")).alias("a"), F.max("init_time").alias("b")).where("a IS NOT NULL")
    start = F.add_months("a", min_train_months).cast("timestamp")
    listed = span.where(start <= F.col("b")).select(F.posexplode(F.sequence(start, F.date_trunc("month", "b"), F.expr("INTERVAL 1 MONTH"))).alias("i", "test_start"))
    listed = listed.where(F.col("i") % every == 0)
    return listed.select(F.date_format("test_start", "yyyy-MM").alias("fold"), "test_start", F.add_months("test_start", months).cast("timestamp").alias("test_end"))


def assign_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row once per fold that tests or trains on it, with ``role``.

    Folds are a few rows per year, so the range join is a broadcast.
    """
    test = (F.col("init_time") >= F.col("test_start")) & (F.col("init_time") < F.col("test_end")) & (F.col("lead_min") >= 60)
    train = F.col("valid_time") < F.col("test_start")
    role = F.when(test, "test").when(train, "train")
    return rows.join(F.broadcast(folds), test | train).withColumn("role", role)


def station_groups(stations: Collection[str], n: int, seed: int = 7) -> dict[str, int]:
    """Station to group: a fixed shuffle dealt round."""
    order = np.random.default_rng(seed).permutation(sorted(stations))
    return {str(s): i % n for i, s in enumerate(order)}


def cycles(start, end, stride_h: int, spark) -> DataFrame:
    """init_time of the cycles in [start, end) whose hour count since the epoch day divides by stride."""
    one = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), hours_after(F.lit(end).cast("timestamp"), -1), F.expr("INTERVAL 1 HOUR"))).alias("init_time"))
    return one.where(F.pmod(F.floor(micros_of_day_hours()), F.lit(stride_h)) == 0)


def micros_of_day_hours():
    """Epoch days plus the hour of the day, which the stride divides."""
    return F.unix_date(F.to_date("init_time")) + F.hour("init_time")
