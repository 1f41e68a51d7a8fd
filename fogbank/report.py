"""Reports: leaderboard and monthly CSV, the experiment log, and the site's data file."""

from __future__ import annotations

import json
import math
import shutil
from datetime import UTC, date, datetime
from pathlib import Path

from pyspark.sql import DataFrame

from fogbank.lake import Lake
from fogbank.operators import scoring

FILES = ("leaderboard.csv", "monthly_skill.csv", "backtest_meta.json")


def clean(value):
    """JSON without NaN or infinities; times as ISO text."""
    if isinstance(value, dict):
        return {k: clean(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [clean(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, datetime | date):
        return value.isoformat()
    return value


def records(df: DataFrame) -> list[dict]:
    """Rows of a report table: these have a row per model and cell, not per forecast."""
    return [clean(r.asDict()) for r in df.collect()]


def write_reports(scores: DataFrame, out: str | Path, groups: dict | None = None, meta: dict | None = None, store: str | None = None) -> None:
    """Small tables to the driver's folder ``out``; the scores themselves, written by tasks, to ``store`` on any file system."""
    out = Path(out)
    out.mkdir(parents=True, exist_ok=True)
    if store:
        scores.write.mode("overwrite").parquet(f"{store}/scores.parquet")
    scoring.leaderboard(scores, groups).orderBy("variable", "bucket", "point", "skill").toPandas().to_csv(out / FILES[0], index=False)
    scoring.monthly_skill(scores).orderBy("variable", "model_name", "month").toPandas().to_csv(out / FILES[1], index=False)
    (out / FILES[2]).write_text(json.dumps(clean(meta or {}), default=str))


def log_run(path: str | Path, params: dict, metrics: dict, tags: dict | None = None) -> None:
    """One line per fitted model and target."""
    with Path(path).open("a") as f:
        f.write(json.dumps(clean(dict(at=datetime.now(UTC), params=params, metrics=metrics, tags=tags or {}))) + "\n")


def analytics(scores: DataFrame) -> dict:
    common = scoring.common_rows(scores)
    return dict(by_lead=records(scoring.by_lead(common)), by_hour=records(scoring.by_local_hour(common)), pit=records(scoring.pit_histogram(common)), raw_bias=records(scoring.raw_bias(common)))


def freshness(lake: Lake) -> dict:
    tables = []
    for name in lake.tables:
        snaps = lake.snapshots(name)
        tables.append(dict(table=name, snapshots=len(snaps), updated=snaps[-1]["committed_at"] if snaps else None, files=len(lake.files(name)) if snaps else 0))
    return dict(tables=tables, stations=records(scoring.freshness(lake.read("silver.obs_qc")).orderBy("station_id")))


def build_site(lake: Lake, reports: str | Path, out: str | Path) -> Path:
    """Writes data.json and the pages that read it; reports must be complete or absent. Snapshot ids are text, as browsers round large numbers."""
    import pandas as pd

    files = [Path(reports) / f for f in FILES]
    if any(f.exists() for f in files) and not all(f.exists() for f in files):
        raise RuntimeError(f"reports are incomplete: expected {', '.join(FILES)}")
    there = all(f.exists() for f in files)
    board = pd.read_csv(files[0]).to_dict("records") if there else []
    monthly = pd.read_csv(files[1]).to_dict("records") if there else []
    meta = json.loads(files[2].read_text()) if there else None
    if meta and "gold_snapshot_id" in meta:
        meta["gold_snapshot_id"] = str(meta["gold_snapshot_id"])
    scores = lake.read("gold.scores", "kind = 'backtest'")
    data = dict(generated_at=datetime.now(UTC), backtest=meta, leaderboard=board, monthly=monthly, freshness=freshness(lake), analytics=analytics(scores))
    out = Path(out)
    out.mkdir(parents=True, exist_ok=True)
    (out / "data.json").write_text(json.dumps(clean(data), default=str))
    for page in (Path(__file__).parent / "site").iterdir():
        shutil.copy(page, out / page.name)
    return out
