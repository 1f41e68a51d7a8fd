"""Raw text and JSON of weather sources to long observation frames.

All parsing is done by column expressions over lines that Spark has read, so files of any number are parsed in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogbank.functions.core import longer

KNOT, MPH = 0.514444, 0.44704
OUT = ("source", "station_id", "obs_time", "variable", "value", "qc_flag", "ingest_batch", "ingested_at")


def celsius(f: Column) -> Column:
    return (f - 32) * 5 / 9


def number(c: str | Column) -> Column:
    """A double, or null where the text isn't one."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("double")


def observed(df: DataFrame, source: str, batch: str | None, values: list[str]) -> DataFrame:
    """station_id, obs_time and value columns to bronze.obs rows; missing values are left out. Without a batch: df's own."""
    df = df if batch is None else df.withColumn("batch", F.lit(batch))
    long = longer(df.withColumns({v: F.nanvl(F.col(v), F.lit(None).cast("double")) for v in values}), ["station_id", "obs_time", "batch"], values)
    return long.select(
        F.lit(source).alias("source"), "station_id", "obs_time", "variable", "value", F.lit(None).cast("string").alias("qc_flag"),
        F.col("batch").alias("ingest_batch"), F.current_timestamp().alias("ingested_at"),
    )


def csv_columns(lines: DataFrame, names: list[str], comment: str = "#") -> DataFrame:
    """Columns of CSV lines (column ``value``), found by the header line's names; the header may vary per file.

    Lines' own batch, if they have one, stays.
    """
    header = F.col("header")
    rows = lines.where(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    parts = F.split("value", ",")
    at = lambda n: F.get(parts, F.array_position(header, F.lit(n)).cast("int") - 1)
    own = [F.col("batch")] if "batch" in lines.columns else []
    return rows.select(*own, *[F.when(F.trim(at(n)).isin("", "M"), None).otherwise(F.trim(at(n))).alias(n) for n in names])


def with_header(lines: DataFrame, header: str | None) -> DataFrame:
    """Lines with their header's names as a list: one header for all, or each line's own (a text, as read)."""
    if header is None:
        return lines.withColumn("header", F.transform(F.split("header", ","), F.trim))
    return lines.where(F.col("value") != header).withColumn("header", F.array(*[F.lit(h.strip()) for h in header.split(",")]))


def asos(lines: DataFrame, header: str | None = None, batch: str | None = "") -> DataFrame:
    """Airport CSV: station, valid, tmpf, dwpf, sknt, drct, gust; Fahrenheit and knots."""
    c = csv_columns(with_header(lines, header), ["station", "valid", "tmpf", "dwpf", "sknt", "drct", "gust"])
    wide = c.select(
        *[x for x in ("batch",) if batch is None], F.col("station").alias("station_id"), F.to_timestamp("valid", "yyyy-MM-dd HH:mm").alias("obs_time"),
        celsius(number("tmpf")).alias("t2m"), celsius(number("dwpf")).alias("d2m"), (number("sknt") * KNOT).alias("wind10"),
        number("drct").alias("wdir10"), (number("gust") * KNOT).alias("gust"),
    )
    return observed(wide, "iem_asos", batch, ["t2m", "d2m", "wind10", "wdir10", "gust"])


def hads(lines: DataFrame, header: str | None = None, batch: str | None = "") -> DataFrame:
    """Hydrological CSV: station, utc_valid and the air temperature column TAIRGZZ in Fahrenheit."""
    c = csv_columns(with_header(lines, header), ["station", "utc_valid", "TAIRGZZ"])
    time = F.coalesce(F.try_to_timestamp("utc_valid", F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp("utc_valid", F.lit("yyyy-MM-dd HH:mm")))
    return observed(c.select(*[x for x in ("batch",) if batch is None], F.col("station").alias("station_id"), time.alias("obs_time"), celsius(number("TAIRGZZ")).alias("t2m")), "iem_hads", batch, ["t2m"])


# Positions of the buoy columns after the five of time, and the sentinels that mean missing.
BUOY = {"wdir10": (5, 999.0), "wind10": (6, 99.0), "gust": (7, 99.0), "t2m": (13, 999.0), "sst": (14, 999.0), "d2m": (15, 999.0)}


def stdmet(lines: DataFrame, station_id: str | None = None, batch: str | None = "") -> DataFrame:
    """Buoy text: white space columns, comment lines start with #, years of two or four digits. Without a station: the lines' own."""
    p = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.try_element_at(p, F.lit(i + 1))
    year = number(at(0)).cast("int")
    full = F.when(year < 100, year + 1900).otherwise(year)
    time = F.try_make_timestamp(full, *[number(at(i)).cast("int") for i in (1, 2, 3, 4)], F.lit(0))
    rows = lines.where(~F.col("value").startswith("#") & ~F.col("value").startswith("YY") & (F.trim("value") != ""))
    vals = [F.when(number(at(i)) < lim, number(at(i))).alias(v) for v, (i, lim) in BUOY.items()]
    station = F.col("station") if station_id is None else F.lit(station_id)
    wide = rows.select(*[x for x in ("batch",) if batch is None], station.alias("station_id"), time.alias("obs_time"), *vals).where("obs_time IS NOT NULL")
    return observed(wide, "ndbc", batch, list(BUOY))


# A sensor's fields and their variables.
SENSOR = {"current_temp_f": "t_sensor", "current_humidity": "rh_sensor", "pressure": "p_sensor", "pm2_5_atm": "pm25_a", "pm2_5_atm_b": "pm25_b"}


def sensor_json(docs: DataFrame, station_id: str, batch: str = "") -> DataFrame:
    """One JSON document of a local sensor per row (column ``value``)."""
    doc = F.from_json("value", ", ".join(["DateTime string", *[f"{k} double" for k in SENSOR]]))
    d = docs.select(doc.alias("d"))
    time = F.to_timestamp(F.regexp_replace("d.DateTime", "z$", ""), "yyyy/MM/dd'T'HH:mm:ss")
    wide = d.select(F.lit(station_id).alias("station_id"), time.alias("obs_time"), *[(celsius(F.col(f"d.{k}")) if k == "current_temp_f" else F.col(f"d.{k}")).alias(v) for k, v in SENSOR.items()])
    return observed(wide, "purpleair", batch, list(SENSOR.values()))


HISTORY = {"temperature": "t_sensor", "humidity": "rh_sensor", "pressure": "p_sensor", "pm2.5_atm_a": "pm25_a", "pm2.5_atm_b": "pm25_b"}


def sensor_history(docs: DataFrame, station_id: str, batch: str = "") -> DataFrame:
    """JSON with ``fields`` (names) and ``data`` (rows in that order); the first name is time_stamp, in epoch seconds."""
    d = docs.select(F.from_json("value", "fields array<string>, data array<array<double>>").alias("d"))
    rows = d.select(F.col("d.fields").alias("f"), F.explode("d.data").alias("x"))
    at = lambda n: F.get("x", F.array_position("f", F.lit(n)).cast("int") - 1)
    time = F.timestamp_seconds(at("time_stamp").cast("long"))
    wide = rows.select(F.lit(station_id).alias("station_id"), time.alias("obs_time"), *[(celsius(at(k)) if k == "temperature" else at(k)).alias(v) for k, v in HISTORY.items()])
    return observed(wide, "purpleair", batch, list(HISTORY.values()))


# Network report fields, their variables, and offset and scale into SI.
NETWORK = {
    "temperature": ("t2m", -273.15, 1.0), "dewpoint": ("d2m", -273.15, 1.0), "relHumidity": ("rh2m", 0.0, 1.0), "altimeter": ("altimeter", 0.0, 0.01),
    "windSpeed": ("wind10", 0.0, 1.0), "windDir": ("wdir10", 0.0, 1.0), "windGust": ("gust", 0.0, 1.0), "solarRadiation": ("solar", 0.0, 1.0),
}


def network_hour(reports: DataFrame, box: tuple[float, float, float, float], batch: str = "") -> tuple[DataFrame, DataFrame]:
    """Observations and stations of one decoded network hour.

    reports: ``pos`` (order in the file), stationId, dataProvider, latitude, longitude, elevation, observationTime (epoch
    seconds), NETWORK's fields with a quality letter each (name + DD). box: south, west, north, east. The last report
    of a station, time and variable wins.
    """
    south, west, north, east = box
    inside = reports.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
    inside = inside.withColumn("station_id", F.trim("stationId")).withColumn("obs_time", F.timestamp_seconds("observationTime"))
    have = [f for f in NETWORK if f in reports.columns]
    flag = lambda f: F.col(f"{f}DD") if f"{f}DD" in reports.columns else F.lit(None)
    each = F.array(*[F.struct(F.lit(NETWORK[f][0]).alias("variable"), ((F.col(f) + NETWORK[f][1]) * NETWORK[f][2]).cast("double").alias("value"), F.trim(flag(f).cast("string")).alias("qc_flag")) for f in have])
    rows = inside.select("pos", "station_id", "obs_time", F.explode(each).alias("e")).select("pos", "station_id", "obs_time", "e.*")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    last = rows.where(finite).groupBy("station_id", "obs_time", "variable").agg(F.max_by(F.struct("value", "qc_flag"), "pos").alias("b"))
    obs = last.select(F.lit("madis").alias("source"), "station_id", "obs_time", "variable", "b.value", "b.qc_flag", F.lit(batch).alias("ingest_batch"), F.current_timestamp().alias("ingested_at"))
    at = inside.groupBy("station_id").agg(F.max_by(F.struct(F.trim("dataProvider").alias("provider"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("elevation").alias("elevation_m")), "pos").alias("b"))
    stations = at.select(F.lit("madis").alias("source"), "station_id", "b.*", F.lit(batch).alias("ingest_batch"), F.current_timestamp().alias("ingested_at"))
    return obs, stations


def picked_to_long(picked: DataFrame, variables: list[str], model: str, product: str, batch: str, member: int = 0) -> DataFrame:
    """Picked grid cells to bronze.nwp_point rows.

    picked: point_id, k, init_time, step_min, latitude, longitude (0 to 360), distance_km, one column per variable, and
    optionally ``level``; wide variables become rows, longitudes wrap to -180..180, distances become metres.
    """
    ids = ["point_id", "k", "init_time", "step_min", "latitude", "longitude", "distance_km", "level"]
    base = picked if "level" in picked.columns else picked.withColumn("level", F.lit("surface:0"))
    long = longer(base.select(*ids, *[F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")).alias(v) for v in variables]), ids, variables)
    return long.select(
        F.lit(model).alias("model"), F.lit(product).alias("product"), "init_time", F.col("step_min").cast("int").alias("lead_min"),
        F.timestamp_micros(F.unix_micros("init_time") + F.col("step_min").cast("long") * 60_000_000).alias("valid_time"), "point_id", "variable", "level",
        F.lit(member).alias("member"), F.col("k").cast("int").alias("k"), "value", F.col("latitude").alias("grid_lat"),
        (F.pmod(F.col("longitude") + 180, F.lit(360.0)) - 180).alias("grid_lon"), (F.col("distance_km") * 1000).alias("grid_dist_m"),
        F.lit(batch).alias("ingest_batch"), F.current_timestamp().alias("ingested_at"),
    )
