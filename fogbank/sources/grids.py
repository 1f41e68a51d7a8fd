"""Grid geometry: a Lambert conformal grid's cells near points, windows, routes, and time sequences."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fogbank.functions.core import EARTH_KM, great_circle_km
from fogbank.session import durable


@dataclass(frozen=True)
class Lambert:
    """A spherical Lambert conformal grid with one standard parallel."""

    # The grid that the archive is on.

    lat0: float = 38.5
    lon0: float = -97.5
    radius: float = 6371229.0
    cell: float = 3000.0
    x0: float = -2697520.1425
    y0: float = -1587306.1526
    nx: int = 1799
    ny: int = 1059

    def project(self, lat, lon):
        """Metres east and north of the origin."""
        n = math.sin(math.radians(self.lat0))
        scale = math.cos(math.radians(self.lat0)) * math.tan(math.pi / 4 + math.radians(self.lat0) / 2) ** n / n
        rho = self.radius * scale / np.tan(np.pi / 4 + np.radians(lat) / 2) ** n
        rho0 = self.radius * scale / math.tan(math.pi / 4 + math.radians(self.lat0) / 2) ** n
        theta = n * np.radians(np.asarray(lon) - self.lon0)
        return rho * np.sin(theta), rho0 - rho * np.cos(theta)

    def unproject(self, x, y):
        n = math.sin(math.radians(self.lat0))
        scale = math.cos(math.radians(self.lat0)) * math.tan(math.pi / 4 + math.radians(self.lat0) / 2) ** n / n
        rho0 = self.radius * scale / math.tan(math.pi / 4 + math.radians(self.lat0) / 2) ** n
        rho = np.hypot(x, rho0 - np.asarray(y))
        theta = np.arctan2(x, rho0 - np.asarray(y))
        lat = 2 * np.arctan((self.radius * scale / rho) ** (1 / n)) - np.pi / 2
        return np.degrees(lat), self.lon0 + np.degrees(theta) / n

    def fraction(self, lat, lon):
        """Row and column, with fractions."""
        x, y = self.project(lat, lon)
        return (np.asarray(y) - self.y0) / self.cell, (np.asarray(x) - self.x0) / self.cell

    def neighbours(self, lat: float, lon: float, k: int = 4) -> list[tuple[int, int, float]]:
        """The k nearest cells (row, col, metres) of the 25 around a point; ties by row, then column."""
        row, col = self.fraction(lat, lon)
        r, c = round(float(row)), round(float(col))
        if not (2 <= r < self.ny - 2 and 2 <= c < self.nx - 2):
            raise ValueError(f"({lat}, {lon}) is outside the grid")
        around = [(math.hypot((i - row), (j - col)) * self.cell, i, j) for i in range(r - 2, r + 3) for j in range(c - 2, c + 3)]
        return [(i, j, d) for d, i, j in sorted(around)[:k]]

    def window(self, bounds: tuple[float, float, float, float], margin: int = 3) -> tuple[int, int, int, int]:
        """First and last row and column that cover (south, west, north, east) with a margin."""
        south, west, north, east = bounds
        rows, cols = zip(*[self.fraction(a, o) for a in (south, north) for o in (west, east)], strict=True)
        box = (math.floor(min(rows)) - margin, math.ceil(max(rows)) + margin, math.floor(min(cols)) - margin, math.ceil(max(cols)) + margin)
        if box[0] < 0 or box[2] < 0 or box[1] >= self.ny or box[3] >= self.nx:
            raise ValueError(f"{bounds} reaches outside the grid")
        return box


# The ellipsoid, and a transverse Mercator zone's scale and false easting.
AXIS, FLATTENING, ZONE_SCALE, ZONE_EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0


class Zone:
    """A northern zone of the universal transverse Mercator grid, by Krueger's series to the fourth order (well under 1 mm)."""

    def __init__(self, zone: int = 10):
        n = FLATTENING / (2 - FLATTENING)
        self.middle = 6 * zone - 183
        self.radius = ZONE_SCALE * AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.e = 2 * math.sqrt(n) / (1 + n)
        # The series' coefficients, to the plane, back, and from the conformal latitude to the geographic one.
        self.there = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        self.back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
        self.latitude = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)

    def plane(self, lat, lon) -> tuple[np.ndarray, np.ndarray]:
        """Metres east and north."""
        s, lam = np.sin(np.radians(lat)), np.radians(np.asarray(lon) - self.middle)
        t = np.sinh(np.arctanh(s) - self.e * np.arctanh(self.e * s))
        xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.hypot(1, t))
        x = eta + sum(c * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, c in enumerate(self.there, 1))
        y = xi + sum(c * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, c in enumerate(self.there, 1))
        return ZONE_EAST + self.radius * x, self.radius * y

    def globe(self, x, y) -> tuple[np.ndarray, np.ndarray]:
        """Latitude and longitude of metres east and north."""
        xi, eta = np.asarray(y) / self.radius, (np.asarray(x) - ZONE_EAST) / self.radius
        a = xi - sum(c * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, c in enumerate(self.back, 1))
        b = eta - sum(c * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, c in enumerate(self.back, 1))
        chi = np.arcsin(np.sin(a) / np.cosh(b))
        lat = chi + sum(c * np.sin(2 * j * chi) for j, c in enumerate(self.latitude, 1))
        return np.degrees(lat), self.middle + np.degrees(np.arctan2(np.sinh(b), np.cos(a)))


def utm(lat: float, lon: float, zone: int = 10) -> tuple[float, float]:
    """Metres east and north of a northern zone."""
    x, y = Zone(zone).plane(lat, lon)
    return float(x), float(y)


def nearest_cells(points: DataFrame, cells: DataFrame, k: int = 4, degrees: float = 0.1) -> DataFrame:
    """The k nearest cells of each point. points: point_id, lat, lon; cells: row, col, cell_lat, cell_lon.

    Both sides are keyed by boxes, and a point looks into the nine around its own, so the join is on equal keys. A point is
    settled if its k cells are nearer than anything outside those boxes can be; the others look again in boxes twice as
    wide, till the nine hold everything. Fewer than k cells come out only where there are no more.
    """
    left, out = points.select("point_id", "lat", "lon"), None
    while True:
        box = lambda c, d=degrees: F.floor(F.col(c) / d)
        keyed = cells.select("row", "col", "cell_lat", "cell_lon", box("cell_lat").alias("bi"), box("cell_lon").alias("bj"))
        steps = lambda c: F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)]))
        asked = left.withColumns({"i": box("lat"), "j": box("lon")}).withColumn("bi", steps("i")).withColumn("bj", steps("j"))
        d = asked.join(keyed, ["bi", "bj"]).withColumn("dist_m", 1000 * great_circle_km("lat", "lon", "cell_lat", "cell_lon"))
        w = Window.partitionBy("point_id").orderBy("dist_m", "row", "col")
        ranked = d.withColumn("k", F.row_number().over(w) - 1).where(F.col("k") < k).select("point_id", "k", "row", "col", "cell_lat", "cell_lon", "dist_m")
        out = ranked if out is None else out.unionByName(ranked)
        if degrees >= 180:
            return out
        # Outside the boxes a cell is at least a box's width off, along a meridian or to another one.
        aside = F.asin(F.cos(F.radians("lat")) * math.sin(math.radians(min(degrees, 90.0))))
        free = 1000 * EARTH_KM * F.least(F.lit(math.radians(degrees)), aside)
        held: list = []
        first = durable(out, held)
        far = first.groupBy("point_id").agg(F.count("*").alias("n"), F.max("dist_m").alias("far"))
        open_ = points.select("point_id", "lat", "lon").join(far, "point_id", "left").where((F.coalesce("n", F.lit(0)) < k) | (F.col("far") > free)).select("point_id", "lat", "lon")
        if open_.isEmpty():
            return first
        out, left, degrees = first.join(open_, "point_id", "left_anti"), durable(open_), 2 * degrees


def extract(archive: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Archive cells (init_time, lead_min, variable, row, col, value) at points' cells; fill values become null.

    neighbours (point_id, k, row, col, dist_m) is four rows per point; its measured size decides whether it is broadcast.
    """
    value = F.nanvl(F.nullif("value", F.lit(-9999.0)), F.lit(None).cast("double"))
    return archive.join(neighbours, ["row", "col"]).withColumn("value", value)


# Groups of archive variables.
REGIME = ("t925", "t850", "u925", "v925", "hpbl")
SURFACE = ("t2m", "d2m", "rh2m", "u10", "v10", "gust", "prate", "vis", "lcc", "tcc", "cloud_base", "ceiling", "dswrf")


NAMED = {"surface": SURFACE, "regime": REGIME, "all": SURFACE + REGIME} | {v: (v,) for v in SURFACE + REGIME}


def select(spec: str) -> list[str]:
    """Variables of a comma list of groups and names, each once; an unknown one is an error."""
    asked = [p for p in re.split(r"[\s,]+", spec) if p]
    if unknown := sorted(set(asked) - NAMED.keys()):
        raise ValueError(f"unknown variable or group {', '.join(unknown)}")
    return list(dict.fromkeys(chain.from_iterable(NAMED[p] for p in asked)))


def bearing(lat1, lon1, lat2, lon2):
    """Degrees from north on the ellipsoid from one point to another one near by."""
    middle = np.radians((np.asarray(lat1) + lat2) / 2)
    e2 = FLATTENING * (2 - FLATTENING)
    w = 1 - e2 * np.sin(middle) ** 2
    east = np.cos(middle) / np.sqrt(w) * (np.asarray(lon2) - lon1)  # by the curvature across the meridian, and along it
    return np.degrees(np.arctan2(east, (1 - e2) / w**1.5 * (np.asarray(lat2) - lat1))) % 360


CHORD_M = 10.0


def densify(target: str, line: list[tuple[float, float]], every_m: float, zone: int = 10) -> list[dict]:
    """Points at equal steps of about every_m along a line of (lat, lon), ends included: point_id, seq, lat, lon, bearing.

    Lengths are those of the zone's plane; a point's bearing is that of a chord of CHORD_M around it, within the line.
    """
    plane = Zone(zone)
    x, y = plane.plane(*np.array(line, dtype=float).T)
    at = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])
    place = lambda d: plane.globe(np.interp(d, at, x), np.interp(d, at, y))
    where = np.linspace(0, at[-1], max(1, round(at[-1] / every_m)) + 1)
    lat, lon = place(where)
    heads = bearing(*place(np.maximum(where - CHORD_M / 2, 0)), *place(np.minimum(where + CHORD_M / 2, at[-1])))
    return [dict(point_id=f"{target}:{i}", seq=i, lat=float(a), lon=float(o), bearing=float(h)) for i, (a, o, h) in enumerate(zip(lat, lon, heads, strict=True))]


def cycles(start: datetime, end: datetime, stride_h: int = 1) -> list[datetime]:
    """Hours in [start, end) whose epoch day plus hour divides by stride, so successive days take turns."""
    hour, out = start.replace(minute=0, second=0, microsecond=0), []
    hour = hour if hour >= start else hour + timedelta(hours=1)
    while hour < end:
        if ((hour - datetime(1970, 1, 1, tzinfo=hour.tzinfo)).days + hour.hour) % stride_h == 0:
            out.append(hour)
        hour += timedelta(hours=1)
    return out


def hours(start: date, end: date) -> list[datetime]:
    first = datetime(start.year, start.month, start.day, tzinfo=UTC)
    return [first + timedelta(hours=i) for i in range((end - start).days * 24)]


def months(start: date, end: date) -> list[tuple[date, date]]:
    """Calendar months of [start, end), the first and last one clipped."""
    out = []
    while start < end:
        following = date(start.year + start.month // 12, start.month % 12 + 1, 1)
        out.append((start, min(following, end)))
        start = following
    return out


def lead_minutes(text: str) -> list[int]:
    """``0-6`` or ``0,1,3`` hours to minutes."""
    first, dash, last = text.partition("-")
    return [60 * h for h in (range(int(first), int(last) + 1) if dash else map(int, text.split(",")))]
