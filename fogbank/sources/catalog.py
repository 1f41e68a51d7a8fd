"""Configuration: points and stations, model runs, bounds, and the fetchers' interface."""

from __future__ import annotations

import json
import math
import os
import re
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from fogbank.lake import Lake, batch_id
from fogbank.sources.grids import densify


@dataclass
class Registry:
    """Places, stations and route points as one dimension table."""

    places: list[dict] = field(default_factory=list)
    stations: list[dict] = field(default_factory=list)
    routes: list[dict] = field(default_factory=list)

    def points(self) -> list[dict]:
        out = [dict(point_id=p["id"], kind=k, lat=float(p["lat"]), lon=float(p["lon"]), bearing=None) for k, ps in (("place", self.places), ("station", self.stations)) for p in ps]
        return out + [dict(point_id=p["point_id"], kind="route", lat=p["lat"], lon=p["lon"], bearing=p["bearing"]) for r in self.routes for p in r["points"]]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.points(), "point_id string, kind string, lat double, lon double, bearing double")


def expand(value, env=os.environ):
    """Replaces ${NAME} by the environment's value in nested settings; an unset name is an error."""
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def found(m: re.Match) -> str:
        if m[1] not in env:
            raise ValueError(f"{m[1]} is not set")
        return env[m[1]]

    return re.sub(r"\$\{(\w+)\}", found, value)


def load_registry(path: str | Path, env=os.environ) -> Registry:
    """A YAML file with places, stations and routes (GeoJSON lines, made into equally spaced points)."""
    import yaml

    path = Path(path)
    data = expand(yaml.safe_load(path.read_text()) or {}, env)
    reg = Registry(list(data.get("places") or []), list(data.get("stations") or []))
    for r in data.get("routes") or []:
        shape = json.loads((path.parent / r["geojson"]).read_text())
        shape = shape["features"][0] if shape.get("type") == "FeatureCollection" else shape
        line = [(lat, lon) for lon, lat, *_ in shape.get("geometry", shape)["coordinates"]]
        reg.routes.append(dict(id=r["id"], points=densify(r["id"], line, float(r.get("every_m", 250)))))
    ids = [x["id"] for group in (reg.places, reg.stations, reg.routes) for x in group]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"duplicate ids: {', '.join(twice)}")
    return reg


@dataclass(frozen=True)
class Model:
    """A model's product, lead hours, members, and the message patterns to fetch."""

    name: str
    product: str
    leads: tuple[int, ...]
    members: tuple[int, ...] = (0,)
    search: str = ""


def load_models(path: str | Path) -> dict[str, Model]:
    import yaml

    out = {}
    for name, m in (yaml.safe_load(Path(path).read_text()) or {}).items():
        first, last, step = (*m["lead_hours"], 1)[:3]  # the last hour is included
        out[name] = Model(name, m["product"], tuple(range(first, last + 1, step)), tuple(m.get("members", (0,))), m.get("search", ""))
    return out


def bounds(text: str) -> tuple[float, float, float, float]:
    """``south,west,north,east``: four finite numbers in order."""
    try:
        s, w, n, e = (float(x) for x in text.split(","))
    except ValueError as err:
        raise ValueError(f"bounds must be four numbers, not {text!r}") from err
    if not all(map(math.isfinite, (s, w, n, e))) or not (-90 <= s < n <= 90 and -180 <= w < e <= 180):
        raise ValueError(f"bounds must be finite and ordered south,west,north,east: {text!r}")
    return s, w, n, e


def parse_init(text: str, now: datetime | None = None) -> datetime:
    """``latest``, ``latest-N`` (hours back from the current hour) or an ISO time, in UTC."""
    if m := re.fullmatch(r"latest(?:-(\d+))?", text):
        hour = (now or datetime.now(UTC)).replace(minute=0, second=0, microsecond=0)
        return hour - timedelta(hours=int(m[1] or 0))
    t = datetime.fromisoformat(text)
    return t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)


class Missing(Exception):
    """The source has no such batch."""


def fetch(get: Callable[[], tuple[int, dict, bytes]], tries: int = 4, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """Calls get until it answers: waits after 429 as told, gives None for 404, unpacks gzip."""
    import gzip

    for i in range(tries):
        status, headers, body = get()
        if status == 404:
            return None
        if status == 429 or status >= 500:
            sleep(float(headers.get("Retry-After", 2**i)))
            continue
        if status != 200:
            raise OSError(f"the source answered {status}")
        return gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
    raise OSError(f"no answer after {tries} tries")


def backfill(lake: Lake, identifier: str, kind: str, keys: Iterable, load: Callable[[object], DataFrame], refetch: Iterable = (), group: int = 24, log=print) -> int:
    """Loads the batches that the table has not recorded, and those to refetch; a commit per group.

    load gives a batch's rows or raises Missing. Appends happen one at a time: a table has one writer.
    """
    done, again, rows = lake.recorded_batches(identifier), set(refetch), 0
    todo = [k for k in keys if batch_id(kind, k) not in done or k in again]
    for i in range(0, len(todo), group):
        frames, ids = [], []
        for key in todo[i : i + group]:
            try:
                frames.append(load(key))
                ids.append(batch_id(kind, key))
            except Missing as err:
                log(f"  {kind} {key}: missing ({err})")
        if frames:
            all_ = frames[0]
            for f in frames[1:]:
                all_ = all_.unionByName(f, allowMissingColumns=True)
            if version := lake.append_bronze(identifier, all_, ids):
                rows += lake.current(identifier)["rows"]
                log(f"  {identifier} version {version}: {len(ids)} batches")
    return rows
