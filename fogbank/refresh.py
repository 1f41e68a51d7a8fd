"""Gold rebuilt for what changed in silver since it was built, and nothing else.

A gold commit records the versions of silver that it was made of. The files that silver has gained and lost since then give the
rows that differ; each of them reaches the gold rows of its point from a few hours before it to the end of the bias window. Those
are made again from as much of silver as they depend on, and replace theirs; files of other days keep their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogbank.lake import Lake
from fogbank.operators import features, gold

#: What each gold table is made of: silver's table, and the columns of its point and time.
SOURCES = {
    "gold.training_examples": (("silver.nwp_aligned", "point_id", "init_time"), ("silver.obs_qc", "station_id", "obs_time")),
    "gold.network_features": (("silver.obs_qc", "station_id", "obs_time"),),
    "gold.upwind_features": (("silver.obs_qc", "station_id", "obs_time"),),
}
#: A row of silver reaches init times from so many hours before its own time (a truth, up to the longest lead after issue) ...
HOURS_BEFORE = gold.MAX_LEAD // 60 + 1
#: ... to so many after it: the windows of bias and anomaly, a forecast's lead or the lagged cycles, and the latest report's delay.
HOURS_AFTER = 24 * gold.BIAS_DAYS + max(gold.MAX_LEAD // 60, gold.LAG_CYCLES) + 3


def marks(lake: Lake, table: str) -> list[str]:
    return [f"from/{name}@{lake.current(name)['version']}" for name, *_ in SOURCES[table]]


def made_from(lake: Lake, table: str) -> dict[str, int] | None:
    """The versions of silver that the table was last built from."""
    for commit in reversed(lake.snapshots(table)):
        found = dict(b.removeprefix("from/").split("@") for b in commit["batches"] if b.startswith("from/"))
        if found:
            return {k: int(v) for k, v in found.items()}
    return None


def touched(lake: Lake, table: str, since: dict[str, int]) -> DataFrame:
    """point_id, day: the rows of a gold table that what has changed in silver can reach."""
    parts = []
    for name, point, time in SOURCES[table]:
        changed = lake.changes(name, since[name]).select(F.col(point).alias("point_id"), F.date_trunc("hour", time).alias("t")).distinct()
        first, last = (F.to_date(F.col("t") + F.expr(f"INTERVAL {h} HOURS")) for h in (-HOURS_BEFORE, HOURS_AFTER))
        parts.append(changed.select("point_id", F.explode(F.sequence(first, last)).alias("day")))
    return reduce(DataFrame.unionByName, parts).distinct()


def runs(days: Iterable[date]) -> list[tuple[date, date]]:
    """Days as runs without gaps: first day, and the day after the last."""
    out: list[tuple[date, date]] = []
    for d in sorted(days):
        if out and out[-1][1] == d:
            out[-1] = (out[-1][0], d + timedelta(days=1))
        else:
            out.append((d, d + timedelta(days=1)))
    return out


def _within(column: str, first: date, last: date) -> str:
    return f"{column} >= TIMESTAMP '{first} 00:00:00' AND {column} < TIMESTAMP '{last} 00:00:00'"


def refresh(lake: Lake, table: str, make: Callable[..., DataFrame], by_point: bool) -> list[tuple[date, date]] | None:
    """Brings a gold table up to date; the runs of days that were made again, or None if all of it was.

    make: the table's rows from its silver tables, in SOURCES' order. by_point: a row depends on its own point's silver alone.
    """
    since, now = made_from(lake, table), marks(lake, table)
    if since is None:
        lake.replace_partition(table, make(*[lake.read(name) for name, *_ in SOURCES[table]]), batches=now)
        return None
    if all(since[name] == lake.current(name)["version"] for name, *_ in SOURCES[table]):
        return []
    pairs = touched(lake, table, since)
    have = lake.read(table).agg(F.max(F.to_date("init_time")).alias("d")).first().d
    latest = lake.read(SOURCES[table][0][0]).agg(F.max(F.to_date(SOURCES[table][0][2])).alias("d")).first().d
    top = max((d for d in (have, latest) if d), default=None)
    # Days, not rows; the windows of the newest rows reach beyond what there is.
    days = [r.day for r in pairs.select("day").distinct().collect() if top and r.day <= top + timedelta(days=1)]
    spans = runs(days)
    for i, (first, last) in enumerate(spans):
        where = _within("init_time", first, last)
        mine = pairs.where((F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(last)))
        reach = (first - timedelta(hours=HOURS_AFTER + 24), last + timedelta(hours=HOURS_BEFORE + 24))
        silver = []
        for name, point, time in SOURCES[table]:
            part = lake.read(name, _within(time, *reach))
            silver.append(part.join(mine.select(F.col("point_id").alias(point)).distinct(), point, "left_semi").select(*part.columns) if by_point else part)
        new = make(*silver).where(where)
        if by_point:
            of = [F.col("day") == F.to_date("init_time"), F.col("point_id") == F.col("touched_point")]
            keys = mine.withColumnRenamed("point_id", "touched_point")
            new = new.join(keys, of, "left_semi").unionByName(lake.read(table, where).join(keys, of, "left_anti"), allowMissingColumns=True)
        lake.replace_partition(table, new, where, batches=now if i + 1 == len(spans) else ())
    if not spans:
        lake.mark(table, now)
    return spans


def refresh_gold(lake: Lake, sensors: dict[str, float] | None = None, tables: Iterable[str] = tuple(SOURCES)) -> dict[str, list[tuple[date, date]] | None]:
    """Gold tables that are made of silver, all three if not told which; the runs of days that were made again, by table."""
    makers = {
        "gold.training_examples": (lambda nwp, obs: gold.training_examples(nwp.where("model = 'hrrr'"), obs), True),
        "gold.network_features": (lambda obs: features.network_features(obs.where("source = 'purpleair'"), sensors or {}), False),
        "gold.upwind_features": (features.upwind_features, False),
    }
    return {table: refresh(lake, table, *makers[table]) for table in tables}
