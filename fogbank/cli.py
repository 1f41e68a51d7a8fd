"""Command line: lake, points, backfill, ingest, build, backtest, holdout, ablation, compare, nbm and site verbs over a lake."""

from __future__ import annotations

import argparse
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank import pipeline, report, session
from fogbank.lake import Lake, batch_id, copy_bronze
from fogbank.operators import scoring, silver, terrain
from fogbank.refresh import refresh_gold
from fogbank.sources import feeds, parsers
from fogbank.sources.catalog import Missing, backfill, bounds, load_registry, parse_init
from fogbank.sources.grids import cycles, utm
from fogbank.sources.web import http_get


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fogbank", description=__doc__)
    p.add_argument("--lake", required=True, help="root folder of the lake")
    sub = p.add_subparsers(dest="verb", required=True)
    lake = sub.add_parser("lake").add_subparsers(dest="what", required=True)
    lake.add_parser("init")
    snaps = lake.add_parser("snapshots")
    snaps.add_argument("table")
    copy = lake.add_parser("copy")
    copy.add_argument("target")
    points = sub.add_parser("points")
    points.add_argument("registry")
    build = sub.add_parser("build").add_subparsers(dest="what", required=True)
    s = build.add_parser("silver")
    s.add_argument("start", type=date.fromisoformat)
    s.add_argument("end", type=date.fromisoformat, nargs="?", default=None, help="exclusive; tomorrow (UTC) if left out")
    g = build.add_parser("gold", help="what has changed in silver since the last build")
    g.add_argument("--sensors", default="", help="sensors and their longitudes: ID=LON,ID=LON")
    t = build.add_parser("static")
    t.add_argument("registry")
    t.add_argument("raster", help="Parquet of the raster's cells: row (from the south), col, z")
    t.add_argument("heights", help="Parquet: point_id, height, dist_m of the model's cells")
    t.add_argument("--corner", required=True, help="metres east and north of the first cell's south-west corner: X,Y")
    t.add_argument("--cell", type=float, default=10.0)
    fill = sub.add_parser("backfill", help="what bronze hasn't recorded of a span of time").add_subparsers(dest="what", required=True)
    months = fill.add_parser("stations", help="station months from the web")
    months.add_argument("stations", help="SOURCE/STATION,SOURCE/STATION")
    months.add_argument("--refetch-days", type=int, default=feeds.REFETCH_DAYS)
    # Decoded hours and cycles come as Parquet, one folder for each: YYYY-MM-DDTHH.
    network = fill.add_parser("madis", help="network hours")
    network.add_argument("--bounds", required=True, help="south,west,north,east")
    runs = [fill.add_parser(model, help="picked cells of model cycles, long") for model in CYCLES]
    for one in (months, network, *runs):
        one.add_argument("start", type=date.fromisoformat)
        one.add_argument("end", type=date.fromisoformat)
    ingest = sub.add_parser("ingest", help="the newest of a source").add_subparsers(dest="what", required=True)
    hours = ingest.add_parser("network", help="the last network hours")
    hours.add_argument("--bounds", required=True, help="south,west,north,east")
    hours.add_argument("--hours", type=int, default=2)
    nwp = ingest.add_parser("nwp", help="one cycle of a model")
    nwp.add_argument("model", choices=CYCLES)
    nwp.add_argument("init", help="latest, latest-N or an ISO time")
    for one in (network, *runs, hours, nwp):
        one.add_argument("folder", help="decoded Parquet, one folder an hour or cycle: YYYY-MM-DDTHH")
        one.add_argument("--stride", type=int, default=1, help="every so many hours")
    reports = ingest.add_parser("obs", help="this month's station reports")
    reports.add_argument("stations", help="SOURCE/STATION,SOURCE/STATION")
    sensor = ingest.add_parser("purpleair", help="a sensor's own page")
    sensor.add_argument("host")
    sensor.add_argument("station")
    for verb in ("backtest", "holdout", "ablation"):
        back = sub.add_parser(verb)
        back.add_argument("--targets", default="t2m,gust")
        back.add_argument("--reports", default="reports")
        back.add_argument("--registry", default="", help="positions, for models with neighbours")
        if verb == "ablation":
            back.add_argument("name")
            back.add_argument("pairs", help="MODEL:BASE,MODEL:BASE")
        else:
            back.add_argument("--models", default="raw_hrrr,bias_rolling")
            back.add_argument("--start", type=datetime.fromisoformat, default=None)
            back.add_argument("--end", type=datetime.fromisoformat, default=None)
        if verb != "backtest":
            back.add_argument("--groups", default="6", help="how many groups of stations, or the groups: A,B;C,D")
    nbm = sub.add_parser("nbm")
    nbm.add_argument("--models", default="bias_rolling")
    nbm.add_argument("--reports", default="reports")
    comp = sub.add_parser("compare")
    comp.add_argument("model")
    comp.add_argument("base")
    site = sub.add_parser("site")
    site.add_argument("out")
    site.add_argument("--reports", default="reports")
    return p


def tomorrow(now: datetime | None = None) -> date:
    return (now or datetime.now(UTC)).date() + timedelta(days=1)


def build_silver(lake: Lake, start: date, end: date) -> None:
    """Both silver tables over [start, end) in one plan each; every run replaces the whole range."""
    lo, hi = f"TIMESTAMP '{start} 00:00:00'", f"TIMESTAMP '{end} 00:00:00'"
    for name, source, col, make in (("silver.nwp_aligned", "bronze.nwp_point", "init_time", silver.nwp_aligned), ("silver.obs_qc", "bronze.obs", "obs_time", silver.obs_qc)):
        where = f"{col} >= {lo} AND {col} < {hi}"
        lake.replace_partition(name, make(lake.read(source, where)), where)


#: The models whose cycles can be taken in.
CYCLES = ("hrrr", "nbm", "rrfs")


def stations(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split("/", 1)) for x in text.split(",")]


def cycles_between(start: date, end: date, stride: int) -> list[datetime]:
    at = lambda d: datetime(d.year, d.month, d.day, tzinfo=UTC)
    return cycles(at(start), at(end), stride)


def decoded(spark: SparkSession, folder: str, t: datetime) -> DataFrame | None:
    """An hour's or a cycle's decoded rows, None if the source has none."""
    path = f"{folder.rstrip('/')}/{t:%Y-%m-%dT%H}"
    return spark.read.parquet(path) if feeds.written(spark, path) else None


def there(df: DataFrame | None, t: datetime) -> DataFrame:
    if df is None:
        raise Missing(f"{t:%Y-%m-%dT%H}")
    return df


def backfill_cycles(lake: Lake, model: str, folder: str, inits: list[datetime]) -> int:
    """Appends the cycles that bronze hasn't recorded; rows carry the id that is recorded."""

    def load(init: datetime) -> DataFrame:
        rows = there(decoded(lake.spark, folder, init), init)
        return rows.withColumns({"model": F.lit(model), "init_time": F.lit(init), "ingest_batch": F.lit(batch_id(model, init)), "ingested_at": F.current_timestamp()})

    return backfill(lake, "bronze.nwp_point", model, inits, load)


def backfill_network(lake: Lake, folder: str, box: tuple[float, float, float, float], hours: list[datetime]) -> dict[str, int]:
    """Observations and stations of the hours that bronze hasn't recorded."""
    part = lambda i: lambda t: parsers.network_hour(there(decoded(lake.spark, folder, t), t), box, batch_id("madis", t))[i]
    # Stations first: the hours' observations are what tells that they are done.
    return {table: backfill(lake, table, "madis", hours, part(i)) for table, i in (("bronze.stations", 1), ("bronze.obs", 0))}


def positions(spark, path: str):
    return load_registry(path).frame(spark) if path else None


def groups(text: str) -> int | list[list[str]]:
    return int(text) if text.isdigit() else [g.split(",") for g in text.split(";") if g]


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session.build()
    lake = Lake(spark, a.lake)
    match a.verb, getattr(a, "what", None):
        case "lake", "init":
            lake.init()
        case "lake", "snapshots":
            for s in lake.snapshots(a.table):
                print(s["version"], s["committed_at"], s["op"], s["rows"])
        case "lake", "copy":
            target = Lake(spark, a.target)
            target.init()
            print(copy_bronze(lake, target))
        case "points", _:
            load_registry(a.registry).frame(spark).orderBy("point_id").show(1000, False)
        case "build", "silver":
            build_silver(lake, a.start, a.end or tomorrow())
        case "build", "gold":
            sensors = {k: float(v) for k, v in (x.split("=") for x in a.sensors.split(",") if x)}
            for table, days in refresh_gold(lake, sensors).items():
                print(table, "built" if days is None else ", ".join(f"{a} to {b}" for a, b in days) or "unchanged")
        case "build", "static":
            west, south = map(float, a.corner.split(","))
            cells = spark.read.parquet(a.raster)
            size = cells.agg(F.max("row").alias("row"), F.max("col").alias("col")).first()
            raster = terrain.Raster(cells, size.row + 1, size.col + 1, west + a.cell / 2, south + a.cell / 2, a.cell)
            pipeline.build_static(lake, positions(spark, a.registry), raster, spark.read.parquet(a.heights), utm)
        case "backfill", "stations":
            print(feeds.station_backfill(lake, stations(a.stations), a.start, a.end, a.refetch_days))
        case "ingest", "obs":
            today = datetime.now(UTC).date()
            print(feeds.station_backfill(lake, stations(a.stations), today.replace(day=1), today + timedelta(days=1)))
        case "backfill", "madis":
            print(backfill_network(lake, a.folder, bounds(a.bounds), cycles_between(a.start, a.end, a.stride)))
        case "ingest", "network":
            print(feeds.realtime(lake, lambda t: decoded(spark, a.folder, t), bounds(a.bounds), a.hours))
        case "backfill", model:
            print(backfill_cycles(lake, model, a.folder, cycles_between(a.start, a.end, a.stride)))
        case "ingest", "nwp":
            print(backfill_cycles(lake, a.model, a.folder, [parse_init(a.init)]))
        case "ingest", "purpleair":
            name = batch_id("purpleair", a.station, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M"))
            print(lake.append_bronze("bronze.obs", feeds.local_sensor(spark, http_get, a.host, a.station, name), [name]))
        case "backtest", _:
            pipeline.run_backtest(lake, a.models.split(","), a.targets.split(","), a.reports, a.start, a.end, positions(spark, a.registry))
        case "holdout", _:
            pipeline.run_holdout(lake, a.models.split(","), a.targets.split(","), a.reports, groups(a.groups), a.start, a.end, positions(spark, a.registry))
        case "ablation", _:
            pairs = [tuple(p.split(":")) for p in a.pairs.split(",")]
            rows, _ = pipeline.training_rows(lake, [m for p in pairs for m in p], positions(spark, a.registry))
            out = groups(a.groups)
            pipeline.run_ablation(a.name, rows, pairs, a.targets.split(","), f"{a.reports}/{a.name}", None if isinstance(out, int) else out).show(1000, False)
        case "nbm", _:
            pipeline.run_blend_comparison(lake, a.models.split(","), a.reports).orderBy("variable", "bucket", "point", "skill").show(1000, False)
        case "compare", _:
            scoring.paired_change(lake.read("gold.scores"), a.model, a.base).orderBy("variable", "bucket", "point").show(1000, False)
        case "site", _:
            report.build_site(lake, a.reports, a.out)


if __name__ == "__main__":
    main()
