"""Probabilistic forecasters behind fit(train) and predict(rows), and the backtests that run them.

fit and predict take and return DataFrames. The tree models learn the forecast's error by ``boosting``; missing inputs
stay missing, and the station is a category.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Collection
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogbank.functions.core import finite
from fogbank.operators import boosting
from fogbank.operators.scoring import assign_folds, monthly_folds, rms_by_lead, score, station_groups
from fogbank.schemas import CYCLIC_FIELDS, LAG_FIELDS, NWP_FIELDS, REGIME_FIELDS, TARGETS
from fogbank.session import durable, release, shared_dir

SIGMA_FLOOR = 0.1
#: What a group's inputs are called, where that is more than a prefix: nb1_..., nbw_..., but not the blend's nbm_... columns.
PATTERNS = {"nb": r"nb(\d+|w)_"}
GATE_AXIS = 270.0
REGIME_DERIVED = ("inv925", "inv850", "wind925", "onshore925")


def with_regime(df: DataFrame) -> DataFrame:
    """Inversion strength over the point, and the flow at 925 mb with its part through the gate."""
    a = F.radians(F.lit(GATE_AXIS))
    return (
        df.withColumn("inv925", F.col("nwp_t925") - F.col("nwp_t2m"))
        .withColumn("inv850", F.col("nwp_t850") - F.col("nwp_t2m"))
        .withColumn("wind925", F.hypot("nwp_u925", "nwp_v925"))
        .withColumn("onshore925", -(F.col("nwp_u925") * F.sin(a) + F.col("nwp_v925") * F.cos(a)))
    )


def usable(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(f"obs_{target}").isNotNull() & F.col(f"nwp_{target}").isNotNull())


def sigma_by_lead(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Adds sigma: the lead's RMS, else the median of all leads, not below the floor. table: one row per lead."""
    known = F.when(F.col("lead_min").isNotNull() & F.col("rms").isNotNull(), F.struct("lead_min", "rms"))
    # One row with a map of tens of leads, so that the table, which stands on the training rows, is made once.
    all_ = table.agg(F.percentile("rms", 0.5).alias("middle"), F.map_from_entries(F.collect_list(known)).alias("by_lead"))
    out = rows.join(F.broadcast(all_))
    rms = F.try_element_at("by_lead", F.col("lead_min"))
    return out.withColumn("sigma", F.greatest(F.coalesce(rms, "middle", F.lit(1.0)), F.lit(SIGMA_FLOOR))).drop("by_lead", "middle")


@dataclass
class Shifted:
    """The forecast plus a correction that is a column; sigma from the training errors per lead."""

    target: str
    name: str = "raw_hrrr"
    table: DataFrame | None = None

    def mu(self) -> Column:
        base = F.col(f"nwp_{self.target}")
        return base + F.coalesce(F.col(f"bias14_{self.target}"), F.lit(0.0)) if self.name == "bias_rolling" else base

    def fit(self, train: DataFrame) -> Shifted:
        self.table = rms_by_lead(train.withColumn("resid", F.col(f"obs_{self.target}") - self.mu()))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return sigma_by_lead(rows.withColumn("mu", self.mu()), self.table)


def spread_fit(rows: DataFrame, least_rows: int = 100) -> DataFrame:
    """lead_min, a, b of sigma^2 = a + b * spread^2. rows: lead_min, spread, resid."""
    s2, r2 = F.col("spread") * F.col("spread"), F.col("resid") * F.col("resid")
    good = rows.where(F.col("spread").isNotNull() & F.col("resid").isNotNull()).select("lead_min", s2.alias("s2"), r2.alias("r2"))
    b = F.greatest(F.try_divide(F.covar_samp("s2", "r2"), F.var_samp("s2")), F.lit(0.0))
    sums = good.groupBy("lead_min").agg(F.count("*").alias("n"), F.var_samp("s2").alias("v"), b.alias("b"), F.avg("r2").alias("r"), F.avg("s2").alias("s"))
    return sums.where((F.col("n") >= least_rows) & (F.col("v") > 0)).select("lead_min", F.greatest(F.col("r") - F.col("b") * F.col("s"), F.lit(0.01)).alias("a"), "b")


@dataclass
class Boosted:
    """Leaf-wise boosted trees on the forecast's error; sigma from the last 15% of the training rows by time."""

    target: str
    name: str
    own: bool = True  # uses the point's own reports
    extra: tuple[str, ...] = ()  # input groups: st_, nb, up_, pa_ prefixes
    point: bool = False
    regime: bool = False
    lagged: bool = False
    spread_sigma: bool = False
    settings: boosting.Settings = boosting.Settings()
    held: float = 0.15
    state: dict = field(default_factory=dict)

    def columns(self, df: DataFrame) -> list[str]:
        """The inputs; a group that the frame lacks is an error."""
        cols = [f"nwp_{f}" for f in NWP_FIELDS if f"nwp_{f}" in df.columns] + [*CYCLIC_FIELDS, "lead_min"]
        if self.own:
            cols += [f"{p}_{t}" for t in TARGETS for p in ("obs_last", "err_at_init", "bias14", "std14")]
        if self.regime:
            cols += [f"nwp_{f}" for f in REGIME_FIELDS] + list(REGIME_DERIVED)
        if self.lagged:
            cols += [f for f in LAG_FIELDS if f.endswith(f"_{self.target}")]
        for group in self.extra:
            found = sorted(c for c in df.columns if re.match(PATTERNS.get(group, group), c))
            if not found:
                raise ValueError(f"{self.name} needs the {group}* features joined onto the training rows")
            cols += found
        return cols

    def _numbered(self, df: DataFrame) -> DataFrame:
        """df with the inputs as doubles (missing: null) and the station's number; inputs that df lacks are missing."""
        df = with_regime(df) if self.regime else df
        if self.point:
            # A table, as the points may be thousands: as literals they would be in the plan of every step of the fit.
            known = df.sparkSession.createDataFrame(sorted(self.state["points"].items()), "point_id string, point_number int")
            df = df.join(F.broadcast(known), "point_id", "left")  # one row per station
        values = [finite(F.col(c).cast("double")) if c in df.columns else F.lit(None).cast("double") for c in self.state["cols"]]
        return df.select("*", *[v.alias(f"x_{c}") for v, c in zip(values, self.state["cols"], strict=True)])

    def fit(self, train: DataFrame) -> Boosted:
        if self.point:
            self.state["points"] = {r.point_id: i for i, r in enumerate(train.select("point_id").distinct().orderBy("point_id").collect())}
        self.state["cols"] = self.columns(with_regime(train) if self.regime else train)
        # The cut is the time of the row at 85% of the time order, exactly; times are counted, so few of them are held.
        cut = train.agg(F.expr(f"percentile_disc({1 - self.held}) WITHIN GROUP (ORDER BY unix_seconds(valid_time))")).first()[0]
        rows = self._numbered(train).withColumn("error", F.col(f"obs_{self.target}") - F.col(f"nwp_{self.target}"))
        late = F.unix_seconds("valid_time") > F.lit(cut)
        names = [f"x_{c}" for c in self.state["cols"]]
        key = ["point_id", F.unix_micros("init_time"), "lead_min"]
        self.state["model"] = boosting.fit(rows, names, "error", late, key, "point_number" if self.point else None, self.settings)
        held = rows.where(late).withColumn("resid", F.col("error") - self.state["model"].column(rows))
        self.state["table"] = rms_by_lead(held)
        if self.spread_sigma:
            self.state["spread"] = spread_fit(held.select("lead_min", F.col(f"lag_sd_{self.target}").alias("spread"), "resid"))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        keep = rows.columns
        numbered = self._numbered(rows)
        out = numbered.select(*keep, (F.col(f"nwp_{self.target}") + self.state["model"].column(numbered)).alias("mu"))
        out = sigma_by_lead(out, self.state["table"])
        if self.spread_sigma:
            spread = F.col(f"lag_sd_{self.target}")
            grown = F.sqrt(F.col("a") + F.col("b") * spread * spread)
            out = out.join(F.broadcast(self.state["spread"]), "lead_min", "left")  # tens of leads
            out = out.withColumn("sigma", F.greatest(F.coalesce(grown, "sigma"), F.lit(SIGMA_FLOOR))).drop("a", "b")
        return out


# The registry: every forecaster by name, as its options.
BOOSTED = {
    "gbm_residual": dict(point=True),
    "gbm_purpleair": dict(point=True, extra=("pa_",)),
    "gbm_terrain": dict(extra=("st_",)),
    "gbm_nwp": dict(own=False),
    "gbm_nwp_terrain": dict(own=False, extra=("st_",)),
    "gbm_nwp_neighbours": dict(own=False, extra=("st_", "nb")),
    "gbm_terrain_neighbours": dict(extra=("st_", "nb")),
    "gbm_terrain_regime": dict(extra=("st_",), regime=True),
    "gbm_nwp_terrain_regime": dict(own=False, extra=("st_",), regime=True),
    "gbm_terrain_lagged": dict(extra=("st_",), lagged=True),
    "gbm_terrain_lagged_sigma": dict(extra=("st_",), lagged=True, spread_sigma=True),
    "gbm_terrain_upwind": dict(extra=("st_", "up_")),
    "gbm_nwp_terrain_upwind": dict(own=False, extra=("st_", "up_")),
    "gbm_terrain_regime_upwind": dict(extra=("st_", "up_"), regime=True),
    "gbm_terrain_stack": dict(extra=("st_", "up_"), regime=True, lagged=True, spread_sigma=True),
}
MODELS = ("raw_hrrr", "bias_rolling", *BOOSTED)


def make(name: str, target: str, **options) -> Shifted | Boosted:
    if name in ("raw_hrrr", "bias_rolling"):
        return Shifted(target, name)
    if name not in BOOSTED:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(MODELS)}")
    tuned = {k: options.pop(k) for k in tuple(options) if k in boosting.Settings.__dataclass_fields__}
    return Boosted(target, name, **(BOOSTED[name] | options | dict(settings=boosting.Settings(**tuned))))


@dataclass(frozen=True)
class Fit:
    """One model of one target, trained on what was known before a fold and tested in it, maybe with stations left out."""

    model: str
    target: str
    fold: str
    start: datetime
    end: datetime
    held_out: tuple[str, ...] = ()

    def rows(self, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
        good, others, own = usable(gold, self.target), F.lit(True), F.lit(True)
        if self.held_out:
            own = F.col("point_id").isin(*self.held_out)
            others = ~own
        begin, end = F.lit(self.start), F.lit(self.end)
        tested = (F.col("init_time") >= begin) & (F.col("init_time") < end) & (F.col("lead_min") >= 60)
        return good.where(others & (F.col("valid_time") < begin)), good.where(own & tested)

    def scores(self, gold: DataFrame, **options) -> DataFrame | None:
        """The test rows with their forecasts and scores; None without rows to train or test on."""
        train, test = self.rows(gold)
        if train.isEmpty() or test.isEmpty():
            return None
        made = make(self.model, self.target, **(options if self.model in BOOSTED else {})).fit(train).predict(test)
        fixed = dict(model_name=self.model, run_id="", kind="backtest", fold=self.fold, variable=self.target)
        key = ["point_id", "init_time", "issue_time", "lead_min", "valid_time"]
        return score(made.select(*[F.lit(v).alias(k) for k, v in fixed.items()], *key, F.col(f"obs_{self.target}").alias("obs"), "mu", "sigma"))


def planned_fits(gold: DataFrame, names: Collection[str], targets: Collection[str], groups: list[list[str]] | None = None, min_train_months: int = 3, fold_months: int = 1) -> list[Fit]:
    """All fits of a backtest: a few for each month, model and target, and each group of stations that is left out."""
    out = []
    for target in targets:
        folds = monthly_folds(usable(gold, target), min_train_months, fold_months, fold_months).orderBy("test_start").collect()
        for fold, (k, group) in product(folds, enumerate(groups or [()])):
            name = f"{fold.fold}/g{k}" if groups else fold.fold
            out += [Fit(model, target, name, fold.test_start, fold.test_end, tuple(group)) for model in names]
    return out


def run_fits(gold: DataFrame, fits: list[Fit], at_once: int = 4, **options) -> DataFrame:
    """The scores of all fits, at most ``at_once`` of which run at a time, each in a scheduler pool of its own.

    The training rows are made once for all of them, and each fit's scores are written once; jobs of different fits share the
    cluster, fairly where the session's scheduler is fair.
    """
    spark, scratch = gold.sparkSession, []
    rows = durable(gold, scratch)
    path = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}"

    def work(numbered: tuple[int, Fit]) -> int:
        i, fit = numbered
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{i % at_once}")
        scores = fit.scores(rows, **options)
        if scores is not None:
            scores.write.parquet(f"{path}/{i}")
        return scores is not None

    with ThreadPoolExecutor(at_once) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(work), enumerate(fits)))
    release(scratch)
    if not any(done):
        raise ValueError("no fold has both training and test rows")
    return spark.read.parquet(*[f"{path}/{i}" for i, ok in enumerate(done) if ok])


def backtest(gold: DataFrame, names: Collection[str], targets: Collection[str], min_train_months: int = 3, at_once: int = 4, **options) -> DataFrame:
    """Rolling origin: each month is forecast by models trained on all rows known before it."""
    return run_fits(gold, planned_fits(gold, names, targets, None, min_train_months), at_once, **options)


def holdout(gold: DataFrame, names: Collection[str], targets: Collection[str], groups: list[list[str]], min_train_months: int = 3, fold_months: int = 3, at_once: int = 4, **options) -> DataFrame:
    """Leave stations out: each group is forecast by models trained on the other stations before the fold."""
    checked_groups(gold, groups)
    return run_fits(gold, planned_fits(gold, names, targets, groups, min_train_months, fold_months), at_once, **options)


def checked_groups(gold: DataFrame, groups: list[list[str]]) -> None:
    """Held-out groups must be known stations, not blank, and leave someone to train on."""
    known = {r.point_id for r in gold.select("point_id").distinct().collect()}  # a station list
    named = [s for g in groups for s in g]
    if not named or any(not s or not s.strip() for s in named):
        raise ValueError("held-out stations must be named")
    if unknown := sorted(set(named) - known):
        raise ValueError(f"unknown stations: {', '.join(unknown)}")
    if len(groups) == 1 and set(groups[0]) == known:
        raise ValueError("all stations are held out: none is left to train on")


def fold_roles(rows: DataFrame, min_train_months: int = 3) -> DataFrame:
    return assign_folds(rows, monthly_folds(rows, min_train_months))


__all__ = ["BOOSTED", "MODELS", "Boosted", "Shifted", "backtest", "holdout", "make", "spread_fit", "station_groups", "with_regime"]
