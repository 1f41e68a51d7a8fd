"""Station reports from the web as a Spark data source: requests are made by the tasks, and texts never pass the driver.

``StationReports`` reads whole months in a batch (a task for each station and month; for buoys, whose archive has a file a
year, for each station and year) and hours as a stream, whose offsets are the hours. It yields lines as they came, with their
file's header; ``feeds`` parses them by column expressions. Options: ``work`` (months: JSON list of source, station, first day,
end day) or ``stations`` (JSON list of source, station) and ``start`` for a stream; ``iem`` and ``ndbc``, the addresses.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from itertools import groupby
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from fogbank.sources.catalog import fetch

# The sources' public addresses, their parameters and the names of months in a path.
IEM = "https://mesonet.agron.iastate.edu/cgi-bin/request"
NDBC = "https://www.ndbc.noaa.gov"
ASOS_FIELDS = ("tmpf", "dwpf", "sknt", "drct", "gust")
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SOURCES = ("iem_asos", "iem_hads", "ndbc")
LINES = "source string, station string, batch string, first timestamp, last timestamp, header string, value string"


def http_get(url: str, params: dict) -> tuple[int, dict, bytes]:
    """One request; answers of any status are returned."""
    try:
        with urlopen(f"{url}?{urlencode(params, doseq=True)}" if params else url, timeout=120) as r:
            return r.status, dict(r.headers), r.read()
    except HTTPError as err:
        return err.code, dict(err.headers), err.read()


def asos_request(station: str, first: date, last: date, base: str = IEM) -> tuple[str, dict]:
    sid = station[1:] if len(station) == 4 and station[0] == "K" else station
    fixed = {"station": sid, "tz": "Etc/UTC", "format": "onlycomma", "latlon": "no", "missing": "empty", "trace": "empty", "report_type": ("3", "4"), "data": ASOS_FIELDS}
    return f"{base}/asos.py", fixed | {f"{part}{i}": getattr(d, part) for i, d in ((1, first), (2, last)) for part in ("year", "month", "day")}


def hads_request(station: str, first: date, last: date, base: str = IEM) -> tuple[str, dict]:
    return f"{base}/hads.py", {"network": "CA_DCP", "stations": station, "what": "txt", "delim": "comma", "sts": f"{first}T00:00Z", "ets": f"{last}T00:00Z"}


def buoy_file(station: str, kind: str, year: int = 0, month: int = 0, base: str = NDBC) -> tuple[str, dict]:
    """Where a buoy's reports are: a file for the ``year``, for the ``month``, or the ``latest`` 45 days."""
    s, view = station.lower(), f"{base}/view_text_file.php"
    if kind == "year":
        return view, {"filename": f"{s}h{year}.txt.gz", "dir": "data/historical/stdmet/"}
    if kind == "month":
        return view, {"filename": f"{s}{month:x}{year}.txt.gz", "dir": f"data/stdmet/{MONTH_NAMES[month - 1]}/"}
    return f"{base}/data/realtime2/{station.upper()}.txt", {}


class Ask:
    """Texts from the web, each asked for once by a task."""

    def __init__(self, options: dict):
        self.iem, self.ndbc = options.get("iem", IEM), options.get("ndbc", NDBC)
        self.had: dict[tuple, list[str]] = {}

    def lines(self, url: str, params: dict) -> list[str]:
        key = (url, str(params))
        if key not in self.had:
            body = fetch(lambda: http_get(url, params))
            self.had[key] = [] if body is None else [x for x in body.decode("utf-8", "replace").splitlines() if x.strip()]
        return self.had[key]

    def reports(self, source: str, station: str, first: date, last: date) -> tuple[str, list[str]]:
        """The header and the lines of a station's file that has the days from first to before last."""
        if source == "ndbc":
            months = re.compile(rf"(?:{first.year}|{first.year % 100:02d})\s+0?{first.month}\s")
            for kind in ("year", "month", "latest"):
                got = self.lines(*buoy_file(station, kind, first.year, first.month, self.ndbc))
                # Anything without a comment on top is a page that says that there is no such file.
                if got and got[0].startswith("#") and (mine := [x for x in got if months.match(x)]):
                    return "", mine
            return "", []
        request = asos_request if source == "iem_asos" else hads_request
        got = [x for x in self.lines(*request(station, first, last, self.iem)) if not x.startswith("#")]
        return (got[0], got[1:]) if got else ("", [])


class Work(InputPartition):
    """What a task asks for: one station, and its (batch, first, last)."""

    def __init__(self, source: str, station: str, spans: list[tuple[str, datetime, datetime]]):
        self.source, self.station, self.spans = source, station, spans


def _read(work: Work, options: dict) -> Iterator[pa.RecordBatch]:
    ask = Ask(options)
    for batch, first, last in work.spans:
        end = (last - timedelta(microseconds=1)).date() + timedelta(days=1)
        header, lines = ask.reports(work.source, work.station, first.date(), end)
        if lines:
            n = len(lines)
            fixed = [pa.array([x] * n, pa.string()) for x in (work.source, work.station, batch)]
            times = [pa.array([t] * n, pa.timestamp("us", "UTC")) for t in (first, last)]
            yield pa.RecordBatch.from_arrays([*fixed, *times, pa.array([header] * n), pa.array(lines)], names=["source", "station", "batch", "first", "last", "header", "value"])


def _midnight(d: str) -> datetime:
    return datetime.fromisoformat(d).replace(tzinfo=UTC)


class StationReports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "station_reports"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return Months(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Hours(dict(self.options))


class Months(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.work = [tuple(w) for w in json.loads(options["work"])]
        if unknown := sorted({w[0] for w in self.work} - set(SOURCES)):
            raise ValueError(f"unknown source {', '.join(unknown)}")

    def partitions(self) -> list[Work]:
        """One for each station and month, for buoys and year: what shares a file is one task's."""
        shares = lambda w: (w[0], w[1], w[2][:4] if w[0] == "ndbc" else w[2])
        return [Work(k[0], k[1], [(batch_name(w[0], w[1], w[2]), _midnight(w[2]), _midnight(w[3])) for w in ws]) for k, ws in groupby(sorted(self.work), shares)]

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.options)


def batch_name(source: str, station: str, first: str) -> str:
    """The id under which bronze records a station's month."""
    return f"{source}/{station}/{first[:7]}"


class Hours(DataSourceStreamReader):
    """Whole hours of all stations; an offset is the hour up to which they have been read."""

    def __init__(self, options: dict):
        self.options = options
        self.stations = [tuple(s) for s in json.loads(options["stations"])]

    def initialOffset(self) -> dict:
        return {"hour": self.options["start"]}

    def latestOffset(self) -> dict:
        now = self.options.get("now")
        t = datetime.fromisoformat(now) if now else datetime.now(UTC)
        return {"hour": t.replace(minute=0, second=0, microsecond=0).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Work]:
        a, b = (datetime.fromisoformat(x["hour"]) for x in (start, end))
        days = [datetime(a.year, a.month, a.day, tzinfo=UTC) + timedelta(days=i) for i in range((b - a).days + 2)]
        spans = [(f"hours/{max(d, a):%Y-%m-%dT%H}/{min(d + timedelta(days=1), b):%Y-%m-%dT%H}", max(d, a), min(d + timedelta(days=1), b)) for d in days if max(d, a) < min(d + timedelta(days=1), b)]
        return [Work(source, station, spans) for source, station in self.stations]

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.options)

    def commit(self, end: dict) -> None:
        pass
