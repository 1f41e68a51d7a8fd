"""From the lake to reports: training rows with the features that models need, backtests, comparisons and ablations."""

from __future__ import annotations

import json
import math
import subprocess
import uuid
from collections.abc import Collection, Iterable
from datetime import UTC, datetime
from functools import reduce
from itertools import chain, product
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogbank import report
from fogbank.functions.core import wider
from fogbank.lake import Lake
from fogbank.operators import features, forecasters, scoring, silver, terrain

GROUPS = {"original": scoring.ORIGINAL}
#: A model's input prefixes and the tables that hold them.
TABLE_OF = {"pa_": "gold.network_features", "up_": "gold.upwind_features", "st_": "silver.static_features"}


def revision() -> str:
    """The commit of the code that runs, with -dirty if files differ from it."""
    try:
        said = subprocess.run(["git", "describe", "--always", "--dirty", "--exclude=*"], capture_output=True, text=True, cwd=Path(__file__).parent)
    except OSError:
        return "unknown"
    return said.stdout.strip() or "unknown"


# --- inputs -----------------------------------------------------------------------


def window(start: datetime | None, end: datetime | None) -> tuple[datetime | None, datetime | None]:
    """The run's half-open window in UTC; a time without zone is UTC."""

    def utc(t):
        if t is None:
            return None
        if isinstance(t, float) and not math.isfinite(t) or not isinstance(t, datetime):
            raise ValueError(f"a window ends at a time, not at {t!r}")
        return t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)

    start, end = utc(start), utc(end)
    if start and end and start >= end:
        raise ValueError("the window's start must be before its end")
    return start, end


def within(rows: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    rows = rows if start is None else rows.where(F.col("init_time") >= F.lit(start))
    return rows if end is None else rows.where(F.col("init_time") < F.lit(end))


def needs(names: Collection[str]) -> set[str]:
    return {prefix for n in names for prefix in forecasters.BOOSTED.get(n, {}).get("extra", ())}


def wide_table(long: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """One row per key with a column per feature; the feature names are a short list."""
    found = sorted(r.feature for r in long.select("feature").distinct().collect())
    out = wider(long, [key], found)
    return out.select(key, *[F.col(c).alias(c if c.startswith(prefix) else prefix + c) for c in found])


def training_rows(lake: Lake, names: Collection[str], points: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """gold.training_examples with the features that the models need, and the versions read.

    points: point_id, lat, lon, for the models that use neighbours.
    """
    versions = {"gold.training_examples": lake.current("gold.training_examples")["version"]}
    rows, want = lake.read("gold.training_examples", version=versions["gold.training_examples"]), needs(names)
    got: dict[str, DataFrame] = {}
    for prefix, table in TABLE_OF.items():
        if prefix in want:
            versions[table] = lake.current(table)["version"]
            got[prefix] = wide_table(lake.read(table, version=versions[table]), "point_id" if prefix == "st_" else "init_time", prefix)
    near = None
    if "nb" in want:
        if points is None:
            raise ValueError("models with neighbours need the stations' positions")
        near = features.neighbour_features(rows, features.nearest_pairs(points.join(rows.select("point_id").distinct(), "point_id", "left_semi")))
    return features.attach(rows, got.get("pa_"), got.get("up_"), got.get("st_"), near), versions


def checked(rows: DataFrame, targets: Collection[str]) -> None:
    """An error where there is nothing to train or test on."""
    if not rows.limit(1).count():
        raise ValueError("the window holds no training rows")
    short = [t for t in targets if not scoring.monthly_folds(forecasters.usable(rows, t)).limit(1).count()]
    if short:
        raise ValueError(f"the window has too few usable rows for {', '.join(short)}")


def with_baseline(names: Collection[str]) -> list[str]:
    return list(dict.fromkeys([*([] if scoring.BASELINE in names else [scoring.BASELINE]), *names]))


def meta(start, end, **more) -> dict:
    return dict(git_sha=revision(), generated_at=datetime.now(UTC), window_start=start, window_end=end, **more)


def inputs(lake: Lake, names: Collection[str], targets: Collection[str], start, end, points: DataFrame | None) -> tuple[DataFrame, dict[str, int], tuple]:
    """A run's checked rows, the versions that they are of, and its window."""
    span = window(start, end)
    rows, versions = training_rows(lake, names, points)
    rows = within(rows, *span)
    checked(rows, targets)
    return rows, versions, span


def folder(*parts: str | Path) -> Path:
    out = Path(*parts)
    out.mkdir(parents=True, exist_ok=True)
    return out


def told(out: Path, board: DataFrame, about: dict, **tables: DataFrame) -> DataFrame:
    """Writes a report's leaderboard, further tables and what they are about; gives the leaderboard."""
    for name, df in {"leaderboard": board, **tables}.items():
        order = [c for c in ("variable", "model_name", "bucket", "point") if c in df.columns] if name != "leaderboard" else ["variable", "bucket", "point", "skill"]
        df.orderBy(*order).toPandas().to_csv(out / f"{name}.csv", index=False)  # a row per model and cell
    (out / "meta.json").write_text(json.dumps(report.clean(about), indent=2, default=str))
    return board


# --- drivers ----------------------------------------------------------------------

BACKTEST = "kind = 'backtest'"
LOGGED = ("crps", "mae", "skill", "skill_lo", "coverage_80")


def run_backtest(lake: Lake, names: Collection[str], targets: Collection[str], reports: str | Path, start=None, end=None, points: DataFrame | None = None, **options) -> DataFrame:
    """Rolling backtest: replaces the lake's backtest forecasts and scores, logs each model's run, writes the reports."""
    names = with_baseline(names)
    rows, versions, span = inputs(lake, names, targets, start, end, points)
    runs = {(n, t): uuid.uuid4().hex for t in targets for n in names}
    run_of = F.create_map(*[F.lit(x) for (n, t), run in runs.items() for x in (f"{n}/{t}", run)])
    # Fits write their scores once; both tables come from there.
    made = forecasters.backtest(rows, names, targets, **options).withColumn("run_id", F.element_at(run_of, F.concat_ws("/", "model_name", "variable")))
    for table in ("gold.forecasts", "gold.scores"):
        lake.replace_partition(table, made, BACKTEST)
    scores, version = lake.read("gold.scores", BACKTEST), versions["gold.training_examples"]
    log = folder(reports) / "runs.jsonl"
    cells = scoring.leaderboard(scores, GROUPS).where("point = 'all'").collect()  # a row per model, target and bucket
    for (n, t), run in runs.items():
        lake.tag("gold.training_examples", f"run-{run}", version)
        about = dict(model=n, target=t, versions=versions, window_start=span[0], window_end=span[1])
        short = {c: c["bucket"].translate({32: None, ord("-"): "_"}) for c in cells if (c["model_name"], c["variable"]) == (n, t)}
        report.log_run(log, about, {f"{k}_{b}": c[k] for c, b in short.items() for k in LOGGED}, dict(run_id=run, kind="backtest", git_sha=revision()))
    report.write_reports(scores, reports, GROUPS, meta(*span, gold_snapshot_id=version, models=names, targets=list(targets), runs={f"{n}/{t}": r for (n, t), r in runs.items()}), f"{lake.root}/_reports/backtest")
    return scores


def station_sets(rows: DataFrame, groups: int | list[list[str]], targets: Collection[str]) -> tuple[list[str], list[list[str]]]:
    """All stations, and the groups to leave out: so many, or the named ones, if there are rows to train and test on for each."""
    stations = sorted(r.point_id for r in rows.select("point_id").distinct().collect())
    if isinstance(groups, int):
        number = scoring.station_groups(stations, groups)
        return stations, [[s for s in stations if number[s] == k] for k in range(groups)]
    named = [sorted({s.strip() for s in g} - {""}) for g in groups]
    if not named or not all(named):
        raise ValueError("held-out stations must be named")
    forecasters.checked_groups(rows, named)
    fits = forecasters.planned_fits(rows, [scoring.BASELINE], targets, named, fold_months=3)
    for target, group in product(targets, named):
        mine = [f for f in fits if f.target == target and f.held_out == tuple(group)]
        if forecasters.usable(rows, target).where(F.col("point_id").isin(group)).isEmpty():
            raise ValueError(f"the held-out stations have no usable rows for {target}")
        if not any(not train.isEmpty() and not test.isEmpty() for train, test in (f.rows(rows) for f in mine)):
            raise ValueError(f"too few rows to train or test on for {target}")
    return stations, named


def run_holdout(lake: Lake, names: Collection[str], targets: Collection[str], reports: str | Path, groups: int | list[list[str]] = 6, start=None, end=None, points: DataFrame | None = None, **options) -> DataFrame:
    """Leave stations out; nothing goes into the lake, so the rolling backtest stays. groups: how many, or the stations of each."""
    if isinstance(groups, list) and not any(s.strip() for g in groups for s in g):
        raise ValueError("held-out stations must be named")
    rows, versions, span = inputs(lake, names, targets, start, end, points)
    stations, left_out = station_sets(rows, groups, targets)
    out = folder(reports, "holdout")
    kept = f"{lake.root}/_reports/holdout/scores.parquet"  # where the tasks and later readers find it
    forecasters.holdout(rows, with_baseline(names), targets, left_out, **options).write.mode("overwrite").parquet(kept)
    scores = rows.sparkSession.read.parquet(kept)
    trained_on = {str(i): sorted(set(stations) - set(g)) for i, g in enumerate(left_out)}
    told(out, scoring.leaderboard(scores, GROUPS), meta(*span, snapshots=versions, groups=left_out, training_stations_by_group=trained_on, models=list(names), targets=list(targets)))
    return scores


def run_blend_comparison(lake: Lake, names: Collection[str], reports: str | Path) -> DataFrame:
    """The blend on the rows of the stored backtest, for the runs of it that bronze has; all models on common rows."""
    versions = {t: lake.current(t)["version"] for t in ("bronze.nwp_point", "gold.scores")}
    read = lambda t, where: lake.read(t, where, version=versions[t])
    blend = silver.nbm_aligned(read("bronze.nwp_point", "model = 'nbm'"))
    runs = blend.select("init_time").distinct()
    stored = read("gold.scores", BACKTEST).where(F.col("model_name").isin(*with_baseline(names))).join(runs, "init_time", "left_semi").drop("run_id", "kind", "fold")
    board = scoring.leaderboard(stored.unionByName(scoring.blend_scores(blend, stored), allowMissingColumns=True), GROUPS)
    return told(folder(reports, "nbm"), board, meta(None, None, snapshots=versions, nbm_runs=runs.count()))


def run_ablation(name: str, rows: DataFrame, pairs: Iterable[tuple[str, str]], targets: Collection[str], reports: str | Path | None = None, groups: list[list[str]] | None = None, **options) -> DataFrame:
    """The paired change of each (model, base) on common rows, from rolling folds or, with groups, with stations left out."""
    pairs = [tuple(p) for p in pairs]
    names = sorted({scoring.BASELINE, *chain.from_iterable(pairs)})
    scored = scoring.common_rows(forecasters.holdout(rows, names, targets, groups, **options) if groups else forecasters.backtest(rows, names, targets, **options))
    changes = reduce(DataFrame.unionByName, (scoring.paired_change(scored, *p) for p in pairs))
    if reports is not None:
        told(folder(reports), scoring.leaderboard(scored, GROUPS), dict(name=name, pairs=pairs, targets=list(targets)), paired=changes)
    return changes


def build_static(lake: Lake, registry: DataFrame, raster: terrain.Raster, heights: DataFrame, place) -> None:
    """silver.static_features of every known point, in full. heights: point_id, height, dist_m of the model's cells around
    each point; place(lat, lon) gives the raster's metres."""
    known = terrain.known_points(registry, lake.read("bronze.stations"))
    spots = [(r.point_id, *map(float, place(r.lat, r.lon))) for r in known.collect()]  # a list of stations
    points = known.sparkSession.createDataFrame(spots, "point_id string, x double, y double")
    lake.replace_partition("silver.static_features", terrain.static_features(points.join(terrain.model_terrain(heights), "point_id"), raster))
