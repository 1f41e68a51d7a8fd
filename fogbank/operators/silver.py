"""Bronze to silver: latest report, quality flags, and grid cells combined at points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogbank.functions.core import inverse_distance, latest, weighted_mean, wind_from
from fogbank.schemas import NWP_FIELDS, REGIME_FIELDS

# The grid's rotation constant and orientation longitude.
ROTATION, ORIENTATION = 0.6225146366376195, -97.5
KELVIN = 273.15
#: A cell's least distance in metres when it is weighted.
LEAST_M = 100.0

# Physical bounds by variable, inclusive.
RANGES = {
    "t2m": (-15.0, 50.0), "d2m": (-40.0, 35.0), "wind10": (0.0, 60.0), "gust": (0.0, 80.0), "wdir10": (0.0, 360.0),
    "pm25_a": (0.0, 1000.0), "pm25_b": (0.0, 1000.0), "rh_sensor": (0.0, 100.0), "solar": (0.0, 1400.0),
}
# Known faults (station, variable), and vanes that turn the wrong way with the sum of the two readings.
FAULTS = (("GGBC1", "t2m"), ("GGBC1", "d2m"))
MIRRORED = {"GGBC1": 6.0}
# Cell fields after renaming.
CELL_FIELDS = ("t2m", "d2m", "rh2m", "u10", "v10", "gust", "prate", "vis", "lcc", "tcc", "cloud_base", "ceiling", "dswrf", "t925", "t850", "u925", "v925", "hpbl")
IN_KELVIN = ("t2m", "d2m", "t925", "t850")


def _lookup(table: dict, key: Column) -> Column:
    """A constant table as a map literal: joins of a handful of rows need no join."""
    if not table:
        return F.lit(None).cast("double")
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def flagged(obs: DataFrame, ranges=RANGES, faults=FAULTS, mirrored=MIRRORED) -> DataFrame:
    """Adds the quality flag, first reason first, and turns mirrored vanes back."""
    low = _lookup({k: v[0] for k, v in ranges.items()}, F.col("variable"))
    high = _lookup({k: v[1] for k, v in ranges.items()}, F.col("variable"))
    fault = F.concat_ws("|", "station_id", "variable").isin([f"{s}|{v}" for s, v in faults]) if faults else F.lit(False)
    turned = _lookup(mirrored, F.col("station_id"))
    value = F.col("value")
    flag = (
        F.when(value.isNull() | F.isnan(value), "missing")
        .when(fault, "station_fault")
        .when(F.col("qc_flag").isin("B", "X"), "source_rejected")
        .when((value < low) | (value > high), "range")
        .otherwise("ok")
    )
    right_way = F.when((F.col("variable") == "wdir10") & turned.isNotNull(), (turned - value + 720) % 360).otherwise(value)
    return obs.withColumn("flag", flag).withColumn("value", right_way).withColumn("qc_flag", F.col("flag")).drop("flag")


def obs_qc(bronze: DataFrame, ranges=RANGES, faults=FAULTS, mirrored=MIRRORED) -> DataFrame:
    """silver.obs_qc from bronze.obs: the latest report of each (source, station, time, variable), flagged."""
    last = latest(bronze, ["source", "station_id", "obs_time", "variable"], ["ingested_at"])
    return flagged(last, ranges, faults, mirrored).select("source", "station_id", "obs_time", "variable", "value", "qc_flag", "ingested_at")


def field_name(variable: str = "variable", level: str = "level") -> Column:
    v, at = F.col(variable), F.col(level)
    return (
        F.when((v == "gh") & (at == "cloudBase:0"), "cloud_base")
        .when((v == "gh") & (at == "cloudCeiling:0"), "ceiling")
        .when(v == "r2", "rh2m")
        .when(v == "sdswrf", "dswrf")
        .when(v.isin("t", "u", "v") & at.like("isobaricInhPa:%"), F.concat(v, F.replace(at, F.lit("isobaricInhPa:"), F.lit(""))))
        .when(v == "blh", "hpbl")
        .otherwise(v)
    )


NWP_KEY = ("model", "product", "init_time", "lead_min", "point_id", "variable", "level", "member", "k")
RUN_KEY = ("model", "init_time", "lead_min", "valid_time", "point_id")


def latest_cells(bronze: DataFrame) -> DataFrame:
    return latest(bronze.where("member = 0"), NWP_KEY, ["ingested_at"])


def cells(last: DataFrame) -> DataFrame:
    """One row per grid cell with a column for each field; ``seen`` is the cell's latest ingest."""
    field = field_name()
    return (
        last.withColumn("field", field)
        .groupBy(*RUN_KEY, "k", "grid_lon", "grid_dist_m")
        .agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in CELL_FIELDS], F.max("ingested_at").alias("seen"))
    )


def earth_relative(df: DataFrame, u: str, v: str, lon: str = "grid_lon") -> tuple[Column, Column]:
    """A grid-relative wind turned to east and north."""
    angle = F.radians(F.lit(ROTATION) * (F.col(lon) - F.lit(ORIENTATION)))
    return F.cos(angle) * F.col(u) + F.sin(angle) * F.col(v), F.cos(angle) * F.col(v) - F.sin(angle) * F.col(u)


def at_points(cell: DataFrame) -> DataFrame:
    """Cells combined by inverse distance; the wind is the mean of the cells' speeds."""
    for u, v in (("u10", "v10"), ("u925", "v925")):
        east, north = earth_relative(cell, u, v)
        cell = cell.withColumn("east", east).withColumn("north", north)
        cell = cell.withColumn(u, F.col("east")).withColumn(v, F.col("north")).drop("east", "north")
    cell = cell.withColumn("speed", F.sqrt(F.col("u10") * F.col("u10") + F.col("v10") * F.col("v10"))).withColumn("w", inverse_distance("grid_dist_m", LEAST_M))
    mean = lambda f: weighted_mean(F.col(f) - KELVIN if f in IN_KELVIN else F.col(f), "w").alias(f)
    out = cell.groupBy(*RUN_KEY).agg(
        *[mean(f) for f in CELL_FIELDS],
        weighted_mean("speed", "w").alias("wind10"),
        (F.max("t2m") - F.min("t2m")).alias("t2m_spread"),
        (F.max("gust") - F.min("gust")).alias("gust_spread"),
        F.max("seen").alias("ingested_at"),
    )
    return out.withColumn("wdir10", wind_from("u10", "v10")).select(*RUN_KEY, *NWP_FIELDS, "ingested_at", *REGIME_FIELDS)


def nwp_aligned(bronze: DataFrame) -> DataFrame:
    """silver.nwp_aligned from bronze.nwp_point."""
    return at_points(cells(latest_cells(bronze)))


def nbm_aligned(bronze: DataFrame) -> DataFrame:
    """The blend's mean and spread at points; the weights of missing values count here."""
    last = latest(bronze.where("model = 'nbm'"), ["init_time", "lead_min", "point_id", "variable", "k"], ["ingested_at"])
    last = last.withColumn("w", inverse_distance("grid_dist_m", LEAST_M))
    one = lambda v: F.try_divide(F.sum(F.when(F.col("variable") == v, F.col("w") * F.col("value"))), F.sum(F.when(F.col("variable") == v, F.col("w"))))
    return last.groupBy("init_time", "lead_min", "point_id").agg((one("t2m") - KELVIN).alias("t2m"), *[one(v).alias(v) for v in ("t2m_sd", "gust", "gust_sd")])
