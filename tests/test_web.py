"""The web data source against a server of its own."""

import threading
import time
from collections import Counter
from datetime import UTC, date, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from fogbank.lake import Lake
from fogbank.schemas import TABLES
from fogbank.sources import feeds, web
from fogbank.streaming import live

BUOY = "#YY  MM DD hh mm WDIR WSPD GST  WVHT   DPD   APD MWD   PRES  ATMP  WTMP  DEWP  VIS  TIDE\n#yr  mo dy hr mn degT m/s  m/s m sec sec degT hPa degC degC degC mi ft\n"


class Source(BaseHTTPRequestHandler):
    """Airport reports at each hour of the days asked for, buoys with a year's, a month's or only the latest file."""

    def log_message(self, *_):
        pass

    def do_GET(self):
        seen, url = self.server.seen, urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query).items()}
        with self.server.lock:
            seen["now"] += 1
            seen["most"] = max(seen["most"], seen["now"])
            seen[q.get("filename") or q.get("station") or q.get("stations") or url.path] += 1
        time.sleep(self.server.wait)
        status, body, headers = self.answer(url.path, q)
        with self.server.lock:
            seen["now"] -= 1
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body.encode())

    def answer(self, path, q):
        if path == "/asos.py":
            if q["station"] == "BUSY" and self.server.seen["BUSY"] == 1:
                return 429, "", {"Retry-After": "0"}
            if q["station"] == "GONE":
                return 404, "", {}
            first, last = (datetime(*(int(q[f"{k}{i}"]) for k in ("year", "month", "day"))) for i in (1, 2))
            times = [first + timedelta(hours=h) for h in range(24 * (last - first).days + 1)]  # one too many, as the source has it
            return 200, "#DEBUG\nstation,valid,tmpf,dwpf,sknt,drct,gust\n" + "".join(f"{q['station']},{t:%Y-%m-%d %H:56},50,M,10,270,\n" for t in times), {}
        if path == "/hads.py":
            return 200, "utc_valid,station,XX,TAIRGZZ\n2025-01-05 00:15:00,H1,1,32\n2025-02-05 00:15:00,H1,1,41\n", {}
        name = q.get("filename", "")
        line = lambda y, m: f"{y} {m:02d} 05 10 00 270 5.0 7.0 99.00 99.00 99.00 999 1015.0 12.0 999.0 999.0 99.0 99.00\n"
        if name.startswith("yearh"):
            return 200, BUOY + line(2024, 11) + line(2024, 12), {}
        if name.startswith("month12024"):
            return 200, BUOY + line(2024, 1), {}
        if path == "/data/realtime2/LATE.txt":
            return 200, BUOY + line(2025, 1), {}
        return (404, "", {}) if "h2025" in name else (200, "<html>no such file", {})


@pytest.fixture
def source():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Source)
    server.seen, server.lock, server.wait = Counter(), threading.Lock(), 0.0
    threading.Thread(target=server.serve_forever, daemon=True).start()
    server.places = dict.fromkeys(("iem", "ndbc"), f"http://127.0.0.1:{server.server_port}")
    yield server
    server.shutdown()


@pytest.fixture
def lake(spark, tmp_path):
    out = Lake(spark, f"file://{tmp_path}/l", {"bronze.obs": TABLES["bronze.obs"]})
    out.init()
    return out


def test_requests():
    url, p = web.asos_request("KSFO", date(2025, 1, 1), date(2025, 2, 1))
    assert url.endswith("/asos.py") and p["station"] == "SFO" and (p["month1"], p["month2"]) == (1, 2) and p["data"] == web.ASOS_FIELDS
    assert web.hads_request("X", date(2025, 1, 1), date(2025, 2, 1))[1]["ets"] == "2025-02-01T00:00Z"
    assert [web.buoy_file("FTPC1", k, 2025, 11)[1].get("filename") for k in ("year", "month", "latest")] == ["ftpc1h2025.txt.gz", "ftpc1b2025.txt.gz", None]
    assert web.buoy_file("ftpc1", "latest")[0].endswith("/FTPC1.txt")


def test_a_hundred_station_months_come_in_parallel_in_one_commit(lake, source):
    source.wait = 0.05
    stations = [("iem_asos", f"A{i:02d}") for i in range(25)]
    got = feeds.station_backfill(lake, stations, date(2025, 1, 1), date(2025, 5, 1), today=date(2026, 1, 1), **source.places)
    assert got == dict(appended=100, skipped=0, empty=0) and source.seen["most"] > 1
    assert [s["op"] for s in lake.snapshots("bronze.obs")] == ["create", "append"] and len(lake.recorded_batches("bronze.obs")) == 100
    assert lake.read("bronze.obs", "variable = 't2m'").count() == 25 * 120 * 24
    asked = sum(source.seen.values())
    assert feeds.station_backfill(lake, stations, date(2025, 1, 1), date(2025, 5, 1), today=date(2026, 1, 1), **source.places)["skipped"] == 100
    assert sum(source.seen.values()) == asked


def test_months_resume_are_asked_again_while_recent_and_may_be_missing(lake, source):
    said = []
    stations = [("iem_asos", "KSFO"), ("iem_asos", "GONE"), ("iem_asos", "BUSY"), ("ndbc", "LATE"), ("iem_hads", "H1"), ("ndbc", "NONE")]
    run = lambda today: feeds.station_backfill(lake, stations, date(2025, 1, 1), date(2025, 2, 1), today=today, log=said.append, **source.places)
    assert run(date(2025, 2, 10)) == dict(appended=4, skipped=0, empty=2) and sorted(said) == ["  missing: iem_asos/GONE/2025-01", "  missing: ndbc/NONE/2025-01"]
    got = {(r.source, r.station_id, r.variable): r.value for r in lake.read("bronze.obs").collect()}
    assert got["iem_asos", "SFO", "t2m"] == pytest.approx(10) and got["ndbc", "LATE", "gust"] == 7.0 and got["iem_hads", "H1", "t2m"] == 0.0
    assert ("iem_asos", "SFO", "d2m") not in got and source.seen["BUSY"] == 2
    # Late January is within 45 days, so all of it is asked for again; in June only what had nothing is.
    assert run(date(2025, 2, 10))["appended"] == 4
    assert run(date(2025, 6, 1)) == dict(appended=0, skipped=4, empty=2)
    assert lake.read("bronze.obs", "source = 'iem_hads'").count() == 2 and {r.ingest_batch for r in lake.read("bronze.obs", "source = 'ndbc'").collect()} == {"ndbc/LATE/2025-01"}
    with pytest.raises(Exception, match="unknown source"):
        feeds.station_backfill(lake, [("x", "A")], date(2025, 1, 1), date(2025, 2, 1), **source.places)
    assert feeds.station_backfill(lake, stations, date(2025, 2, 1), date(2025, 2, 1)) == dict(appended=0, skipped=0, empty=0)


def test_a_buoys_year_file_is_asked_for_once(lake, source):
    got = feeds.station_backfill(lake, [("ndbc", "YEAR"), ("ndbc", "MONTH")], date(2024, 1, 1), date(2025, 1, 1), today=date(2026, 1, 1), log=lambda _: None, **source.places)
    assert got == dict(appended=3, skipped=0, empty=21)
    assert source.seen["yearh2024.txt.gz"] == 1 and source.seen["monthh2024.txt.gz"] == 1
    assert lake.recorded_batches("bronze.obs") == {"ndbc/YEAR/2024-11", "ndbc/YEAR/2024-12", "ndbc/MONTH/2024-01"}


def test_a_stream_of_hours_goes_on_where_it_ended(spark, tmp_path, source):
    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"
    start = datetime(2025, 1, 1, 22, tzinfo=UTC)
    for hours in (1, 5, 5, 30):
        now = (start + timedelta(hours=hours, minutes=20)).isoformat()
        live.run_available(spark, feeds.station_stream(spark, [("iem_asos", "KSFO"), ("iem_asos", "OAK")], start, now=now, **source.places), out, ck)
    rows = spark.read.parquet(out).where("variable = 't2m'").collect()
    want = {(s, start + timedelta(hours=h, minutes=56)) for s in ("SFO", "OAK") for h in range(30)}
    assert len(rows) == 60 and {(r.station_id, r.obs_time.replace(tzinfo=UTC)) for r in rows} == want


def test_no_text_passes_the_driver(spark, source):
    """The plan of a backfill's rows reads the source and parses; nothing of it is a local relation."""
    rows = feeds.observations(feeds.station_reports(spark, [("iem_asos", "A", date(2025, 1, 1), date(2025, 2, 1)), ("iem_asos", "B", date(2025, 1, 1), date(2025, 2, 1))], **source.places))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "station_reports" in plan and "LocalRelation" not in plan
    assert feeds.station_reports(spark, [("iem_asos", c, date(2025, m, 1), date(2025, m + 1, 1)) for c in "AB" for m in (1, 2, 3)], **source.places).rdd.getNumPartitions() == 6
