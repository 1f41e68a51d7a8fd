"""What to ask each source for, and how its answers become bronze rows.

Stations' reports come through the data source in ``web``, whose tasks make the requests. Every other function that reaches a
source takes the call as an argument: ``get(url, params)`` answers (status, headers, body).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, date, datetime, timedelta
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.lake import Lake
from fogbank.operators.terrain import Raster
from fogbank.session import durable, release
from fogbank.sources import parsers, web
from fogbank.sources.catalog import Missing, fetch

Get = Callable[[str, dict], tuple[int, dict, bytes]]

# The sensors' public address; how many days back a month is asked for again.
SENSORS = "https://api.purpleair.com/v1"
REFETCH_DAYS = 45


def ask(get: Get, url: str, params: dict | None = None, **options) -> str | None:
    body = fetch(lambda: get(url, params or {}), **options)
    return None if body is None else body.decode("utf-8", "replace")


# --- stations ---------------------------------------------------------------------


def observations(lines: DataFrame) -> DataFrame:
    """bronze.obs rows of lines from the web (a table or a stream), each within its batch's span of time."""
    parsers_of = {"iem_asos": parsers.asos, "iem_hads": parsers.hads, "ndbc": parsers.stdmet}
    out = None
    for source, parse in parsers_of.items():
        # The span rides in the batch's name, as parsers keep that one column.
        named = F.concat_ws("|", "batch", F.unix_micros("first"), F.unix_micros("last"))
        rows = parse(lines.where(F.col("source") == source).withColumn("batch", named), batch=None)
        out = rows if out is None else out.unionByName(rows)
    part = lambda i: F.element_at(F.split("ingest_batch", r"\|"), i)
    t = F.unix_micros("obs_time")
    return out.where((t >= part(2).cast("long")) & (t < part(3).cast("long"))).withColumn("ingest_batch", part(1))


def planned(lake: Lake, stations: Iterable[tuple[str, str]], start: date, end: date, recent: date) -> DataFrame:
    """source, station, first, last, batch, todo: the months of each station, less those that bronze.obs has recorded.

    Months that end after ``recent`` are to do in any case, as late reports and corrections come in.
    """
    spark = lake.spark
    listed = spark.createDataFrame(sorted(set(stations)), "source string, station string")
    month = F.explode(F.sequence(F.lit(start.replace(day=1)), F.lit(end - timedelta(days=1)), F.expr("INTERVAL 1 MONTH")))
    spans = listed.select("source", "station", month.alias("month")).select(
        "source", "station", F.greatest("month", F.lit(start)).alias("first"), F.least(F.add_months("month", 1), F.lit(end)).alias("last")
    )
    named = spans.withColumn("batch", F.concat_ws("/", "source", "station", F.date_format("first", "yyyy-MM")))
    done = spark.createDataFrame([(b,) for b in sorted(lake.recorded_batches("bronze.obs"))], "batch string").withColumn("recorded", F.lit(True))
    return named.join(done, "batch", "left").withColumn("todo", F.col("recorded").isNull() | (F.col("last") > F.lit(recent))).drop("recorded")


def station_reports(spark: SparkSession, work: list[tuple[str, str, date, date]], **places: str) -> DataFrame:
    """Lines of the stations' months, fetched by the tasks that read them."""
    spark.dataSource.register(web.StationReports)
    asked = json.dumps([(a, b, str(c), str(d)) for a, b, c, d in work])
    return spark.read.format("station_reports").options(work=asked, **places).load()


def station_backfill(lake: Lake, stations: Iterable[tuple[str, str]], start: date, end: date, refetch_days: int = REFETCH_DAYS, today: date | None = None, log=print, **places: str) -> dict[str, int]:
    """Appends each (source, station)'s months that bronze.obs has not recorded, in one commit.

    The months are fetched in parallel by tasks and written down once before they are parsed. Silver keeps the latest of a
    report's versions. places: other addresses of the sources (iem, ndbc).
    """
    today = today or datetime.now(UTC).date()
    plan = planned(lake, stations, start, end, today - timedelta(days=refetch_days)).collect() if start < end else []  # a row a station-month
    work = [(r.source, r.station, r.first, r.last) for r in plan if r.todo]
    out = dict(appended=0, skipped=len(plan) - len(work), empty=0)
    if not work:
        return out
    scratch: list = []
    rows = observations(durable(station_reports(lake.spark, work, **places), scratch))
    names = {r.ingest_batch for r in rows.select("ingest_batch").distinct().collect()}
    for r in plan:
        if r.todo and r.batch not in names:
            log(f"  missing: {r.batch}")
    if names:
        lake.append_bronze("bronze.obs", rows, names)
    release(scratch)
    return out | dict(appended=len(names), empty=len(work) - len(names))


def station_stream(spark: SparkSession, stations: Iterable[tuple[str, str]], start: datetime, **options: str) -> DataFrame:
    """A stream of bronze.obs rows of the stations' whole hours from start on; ``now`` ends the time that it sees."""
    spark.dataSource.register(web.StationReports)
    listed = json.dumps(sorted(set(stations)))
    return observations(spark.readStream.format("station_reports").options(stations=listed, start=start.isoformat(), **options).load())


# --- network hours ----------------------------------------------------------------


def realtime(lake: Lake, load: Callable[[datetime], DataFrame | None], box: tuple[float, float, float, float], n_hours: int = 2, now: datetime | None = None) -> dict[str, int]:
    """The current hour's file and those before it; one append to each table for a pull.

    load gives an hour's decoded reports, or None. The batch names the pull too, so a growing file is read again.
    """
    pulled = (now or datetime.now(UTC)).astimezone(UTC)
    ages = range(n_hours)[::-1]
    loaded = {f"madis-rt/{h:%Y-%m-%dT%H}@{pulled:%Y-%m-%dT%H:%M}": load(h.replace(minute=0, second=0, microsecond=0)) for h in (pulled - timedelta(hours=a) for a in ages)}
    there = {name: reports for name, reports in loaded.items() if reports is not None}
    parsed = [parsers.network_hour(reports, box, name) for name, reports in there.items()]
    for table, parts in zip(("bronze.obs", "bronze.stations"), zip(*parsed, strict=True), strict=False):
        lake.append_bronze(table, reduce(DataFrame.unionByName, parts), list(there))
    return dict(fetched=len(there), missing=n_hours - len(there))


# --- sensors ----------------------------------------------------------------------


def local_sensor(spark: SparkSession, get: Get, host: str, station_id: str, batch: str = "") -> DataFrame:
    """A sensor's own page; one that says it stands indoors is refused."""
    text = ask(get, f"http://{host}/json") or "{}"
    place = json.loads(text).get("place")
    if place not in (None, "", "outside"):
        raise ValueError(f"{host} says that it is {place!r}; an outdoor sensor is wanted")
    return parsers.sensor_json(spark.createDataFrame([(text,)], "value string"), station_id, batch)


def sensor_history(spark: SparkSession, get: Get, index: int, start: datetime, end: datetime, station_id: str, batch: str = "", average: int = 10) -> DataFrame:
    fields = ",".join(parsers.HISTORY)
    params = {"start_timestamp": int(start.timestamp()), "end_timestamp": int(end.timestamp()), "average": average, "fields": fields}
    text = ask(get, f"{SENSORS}/sensors/{index}/history", params)
    if text is None:
        raise Missing(f"sensor {index}")
    return parsers.sensor_history(spark.createDataFrame([(text,)], "value string"), station_id, batch)


# --- model messages ---------------------------------------------------------------

# Patterns of the messages to read. Steps in minutes are left out: only whole hours have "hour fcst".
RRFS_MESSAGES = (
    r":(?:TMP|DPT):2 m above ground:\d+ hour fcst:|:(?:UGRD|VGRD):10 m above ground:\d+ hour fcst:"
    r"|:(?:GUST|VIS|DSWRF):surface:\d+ hour fcst:|:HGT:cloud ceiling:\d+ hour fcst:"
)
NBM_MEAN = r":(?:TMP:2 m|GUST:10 m) above ground:\d+ hour fcst:$"
NBM_SPREAD = r":(?:TMP:2 m|GUST:10 m) above ground:\d+ hour fcst:ens std dev:$"
NBM_NAMES = {"t2m": "t2m", "i10fg": "gust"}
RRFS_LEADS = tuple(range(1, 7))


def message_ranges(index: str, pattern: str) -> list[tuple[int, int | None]]:
    """First and last byte of an index's messages that match; the last message has no end."""
    rows = [x.split(":", 2) for x in index.splitlines() if x.count(":") > 2]
    starts = [int(r[1]) for r in rows]
    ends = [next((s - 1 for s in starts[i + 1 :] if s > starts[i]), None) for i in range(len(rows))]
    return [(s, e) for r, s, e in zip(rows, starts, ends, strict=True) if re.search(pattern, ":" + r[2])]


Pick = Callable[[datetime, int, str], DataFrame]


def rrfs_cycle(pick: Pick, init: datetime, leads: Iterable[int] = RRFS_LEADS) -> DataFrame:
    """One cycle's whole hours as bronze.nwp_point rows. pick(init, lead, pattern): the picked cells, or Missing."""
    return _joined([_long(pick(init, lead, RRFS_MESSAGES), "rrfs", "subh", f"rrfs/{init:%Y-%m-%dT%H}") for lead in leads])


def nbm_cycle(pick: Pick, init: datetime, leads: Iterable[int]) -> DataFrame:
    """One run of the blend: means, and their spread as variables with _sd."""
    parts = []
    for lead in leads:
        for pattern, suffix in ((NBM_MEAN, ""), (NBM_SPREAD, "_sd")):
            long = _long(pick(init, lead, pattern), "nbm", "co", f"nbm/{init:%Y-%m-%dT%H}")
            name = F.element_at(F.create_map(*[F.lit(x) for k, v in NBM_NAMES.items() for x in (k, v + suffix)]), F.col("variable"))
            parts.append(long.withColumn("variable", name).where("variable IS NOT NULL"))
    return _joined(parts)


_CELL_COLUMNS = {"point_id", "k", "init_time", "step_min", "latitude", "longitude", "distance_km", "level"}


def _long(picked: DataFrame, model: str, product: str, batch: str) -> DataFrame:
    return parsers.picked_to_long(picked, [c for c in picked.columns if c not in _CELL_COLUMNS], model, product, batch)


def _joined(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- archive windows and elevation ------------------------------------------------

CHUNK, FILL, CACHE_LEADS = 150, -9999.0, 18
#: A piece of an archive's field: (name, ``anl`` or ``fcst``, chunk row, chunk column) to an array (time, row, col), or None.
Chunk = Callable[[str, str, int, int], "np.ndarray | None"]
CELL = "variable string, lead_min int, row int, col int, value float"


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def cycle_window(spark: SparkSession, store: str, init: datetime, names: Iterable[str], box: tuple[int, int, int, int], chunk: Chunk) -> DataFrame:
    """init_time, variable, lead_min, row, col, value of a cycle's fields over the cells of box (rows and columns, first and last).

    The tasks read the archive's chunks; fields are kept below ``store`` (any file system), by window, cycle and variable, and
    only those that it lacks are read. Fill values are null, the analysis is lead 0. An absent chunk raises Missing.
    """
    names = list(dict.fromkeys(names))
    r0, r1, c0, c1 = box
    base = f"{store.rstrip('/')}/cells_{r0}-{r1}_{c0}-{c1}/{init:%Y%m%d%H}"
    place = {n: f"{base}/variable={n}" for n in names}
    lacking = [n for n in names if not written(spark, place[n])]
    if lacking:
        asked = [(n, kind, i, j) for n in lacking for kind in ("anl", "fcst") for i in range(r0 // CHUNK, r1 // CHUNK + 1) for j in range(c0 // CHUNK, c1 // CHUNK + 1)]

        def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for n, kind, i, j in (row for b in batches for row in b.itertuples(index=False)):
                got = chunk(n, kind, int(i), int(j))
                if got is None:
                    yield pd.DataFrame({"variable": [n], "lead_min": [None], "row": [None], "col": [None], "value": [None]})
                    continue
                rows, cols = np.arange(got.shape[1]) + i * CHUNK, np.arange(got.shape[2]) + j * CHUNK
                inside = got[: 1 if kind == "anl" else CACHE_LEADS][:, (rows >= r0) & (rows <= r1)][:, :, (cols >= c0) & (cols <= c1)].astype("float32")
                rows, cols = rows[(rows >= r0) & (rows <= r1)], cols[(cols >= c0) & (cols <= c1)]
                lead, row, col = np.meshgrid(np.arange(len(inside)) + (kind == "fcst"), rows, cols, indexing="ij")
                yield pd.DataFrame({"variable": n, "lead_min": lead.ravel() * 60, "row": row.ravel(), "col": col.ravel(), "value": inside.ravel()})

        scratch: list = []
        pieces = spark.createDataFrame(asked, "name string, kind string, i int, j int").repartition(len(asked))  # a task for each chunk
        read = durable(pieces.mapInPandas(cells, CELL), scratch)
        if gone := read.where("lead_min IS NULL").select("variable").distinct().collect():
            release(scratch)
            raise Missing(f"{init:%Y-%m-%dT%HZ} {', '.join(sorted(r.variable for r in gone))}")
        for n in lacking:
            mine = read.where(F.col("variable") == n).drop("variable")
            mine.withColumn("value", F.when(F.col("value") != FILL, F.col("value"))).write.mode("overwrite").parquet(place[n])
        release(scratch)
    out = spark.read.schema(CELL).option("basePath", base).parquet(*place.values())
    return out.select(F.lit(init).alias("init_time"), "variable", "lead_min", "row", "col", "value")


def elevation(spark: SparkSession, store: str, tile: Callable[[float, float, float, float], np.ndarray], box: tuple[float, float, float, float], cell: float = 10.0, size: float = 10_000.0) -> Raster:
    """The elevation over box (west, south, east, north; metres), a table of cells below ``store`` that is made once.

    tile(west, south, east, north) gives heights from south to north; the tasks call it, a tile each. A tile of another shape
    or with gaps is an error.
    """
    west, south, east, north = box
    cells = [(hi - lo) / cell for lo, hi in ((south, north), (west, east))]
    if not all(map(math.isfinite, box)) or min(cells) <= 0 or any(abs(n - round(n)) > 1e-6 for n in cells):
        raise ValueError(f"{box} is not a box of whole cells of {cell} m")
    n_rows, n_cols = map(round, cells)
    step = max(1, round(size / cell))
    path = f"{store.rstrip('/')}/elevation_{'_'.join(f'{v:.0f}' for v in (*box, cell))}"

    def heights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, c in (row for b in batches for row in b.itertuples(index=False)):
            rows, cols = min(step, n_rows - r), min(step, n_cols - c)
            w, s = west + c * cell, south + r * cell
            z = np.asarray(tile(w, s, w + cols * cell, s + rows * cell), dtype="float32")
            if z.shape != (rows, cols) or not np.isfinite(z).all():
                raise ValueError(f"the elevation tile at {w:.0f}, {s:.0f} has gaps or the wrong shape {z.shape}")
            row, col = np.indices(z.shape)
            yield pd.DataFrame({"row": (row + r).ravel(), "col": (col + c).ravel(), "z": z.ravel()})

    if not written(spark, path):
        corners = [(r, c) for r in range(0, n_rows, step) for c in range(0, n_cols, step)]
        spark.createDataFrame(corners, "r int, c int").repartition(len(corners)).mapInPandas(heights, "row int, col int, z float").write.mode("overwrite").parquet(path)
    return Raster(spark.read.schema("row int, col int, z float").parquet(path), n_rows, n_cols, west + cell / 2, south + cell / 2, cell)
