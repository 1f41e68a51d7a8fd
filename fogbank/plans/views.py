"""Weather-shaped frames over the synthetic tables, and the same as SQL text for the side-by-side check.

Observations come from ``events`` (an event type per variable, users dealt to stations, every fifth report sent again
with a correction), forecasts from integer arithmetic over the hours that events cover, grid cells and positions from
integer arithmetic over suppliers and orders' days. There are eight stations, or one for every 18 users where that is more,
so forecasts grow with the data.
"""

from __future__ import annotations

import math
import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.session import table

STATIONS, LEADS = 8, 12
USERS_PER_STATION = 18
FAULTS, MIRRORED = (("S1", "t2m"),), {"S2": 6.0}
RANGES = {"t2m": (0.0, 100.0), "gust": (0.0, 150.0)}
#: Station to minutes of visibility delay.
LATE = {"S3": 80}

#: The number of tasks that make the forecasts, as _sql() puts it in.
_TASKS = "{tasks}"
STATIONS_PER_TASK = 64

_VARIABLE = "CASE event_type WHEN 'click' THEN 't2m' WHEN 'view' THEN 'wind10' WHEN 'purchase' THEN 'gust' WHEN 'signup' THEN 'rh2m' ELSE 'wdir10' END"
#: The number of stations, as SQL; Spark's texts get the number itself.
_COUNT = f"(SELECT greatest({STATIONS}, CAST(floor(count(DISTINCT user_id) / {USERS_PER_STATION}.0) AS BIGINT)) FROM events)"
_OBS = f"""SELECT CASE WHEN user_id % 2 = 0 THEN 'madis' ELSE 'iem_asos' END AS source, concat('S', user_id % {_COUNT}) AS station_id,
  ts AS obs_time, {_VARIABLE} AS variable, value, CASE user_id % 11 WHEN 3 THEN 'B' WHEN 5 THEN 'V' ELSE '' END AS qc_flag, event_id AS ingest_id, ts AS ingested_at
FROM events"""
OBS = f"{_OBS} UNION ALL SELECT source, station_id, obs_time, variable, value + 1, qc_flag, ingest_id, ingested_at + INTERVAL 1 HOUR FROM ({_OBS}) t WHERE ingest_id % 5 = 0"


def _nwp(spark: bool) -> str:
    hour = "(unix_micros(init_time) div 3600000000)" if spark else "(epoch_us(init_time) // 3600000000)"
    valid = "timestamp_micros(unix_micros(init_time) + lead * 3600000000)" if spark else "make_timestamp(epoch_us(init_time) + lead * 3600000000)"
    cycles = "SELECT DISTINCT date_trunc('hour', ts) AS init_time FROM events"
    # Ranges, not exploded lists: Spark counts a range's rows but takes an exploded list for one, and then broadcasts the whole view.
    each = f"SELECT init_time, s, lead FROM (SELECT /*+ REPARTITION({_TASKS}) */ init_time, s FROM ({cycles}) t CROSS JOIN range({_COUNT}) r(s)) u CROSS JOIN range({LEADS + 1}) l(lead)"
    if not spark:
        each = f"SELECT init_time, s, unnest(range({LEADS + 1})) AS lead FROM (SELECT  init_time, unnest(range({_COUNT})) AS s FROM ({cycles}) t) u"
    d = lambda text: f"CAST({text} AS DOUBLE) / 10"
    return f"""SELECT 'hrrr' AS model, init_time, CAST(lead * 60 AS INT) AS lead_min, {valid} AS valid_time, concat('S', s) AS point_id,
  {d(f"100 + ({hour} * 7 + lead * 7 + s * 3 + lead * (s + 1)) % 80")} AS t2m, {d(f"30 + ({hour} * 5 + lead * 8 + s * 11) % 120")} AS gust,
  {d(f"20 + ({hour} * 3 + lead * 5 + s * 7) % 70")} AS wind10, {d(f"120 + ({hour} * 11 + s * 5 + lead) % 90")} AS t925,
  {d(f"80 + ({hour} * 13 + s * 2 + lead) % 90")} AS t850, {d(f"({hour} * 3 + s + lead) % 100 - 50")} AS u925, {d(f"({hour} * 5 + s * 3 + lead) % 100 - 50")} AS v925
FROM ({each}) w"""


_LEVELS = "CASE j WHEN 0 THEN 't2m' WHEN 1 THEN 'u10' WHEN 2 THEN 'v10' WHEN 3 THEN 'gust' WHEN 4 THEN 'gh' WHEN 5 THEN 'gh' WHEN 6 THEN 't' WHEN 7 THEN 't' WHEN 8 THEN 'u' WHEN 9 THEN 'v' WHEN 10 THEN 'blh' WHEN 11 THEN 'r2' WHEN 12 THEN 'sdswrf' ELSE 'd2m' END"
_AT = "CASE j WHEN 4 THEN 'cloudBase:0' WHEN 5 THEN 'cloudCeiling:0' WHEN 6 THEN 'isobaricInhPa:925' WHEN 7 THEN 'isobaricInhPa:850' WHEN 8 THEN 'isobaricInhPa:925' WHEN 9 THEN 'isobaricInhPa:925' ELSE 'surface:0' END"


def _cells(spark: bool, model: str = "hrrr") -> str:
    """Four cells around each station for each day's first cycle that events cover, sent twice."""
    x = lambda n: f"explode(sequence(0, {n - 1}))" if spark else f"unnest(range({n}))"
    hour = "(unix_micros(init_time) div 3600000000)" if spark else "(epoch_us(init_time) // 3600000000)"
    valid = "timestamp_micros(unix_micros(init_time) + lead * 3600000000)" if spark else "make_timestamp(epoch_us(init_time) + lead * 3600000000)"
    seen = "timestamp_micros(unix_micros(init_time) + (lead + again * 5) * 3600000000)" if spark else "make_timestamp(epoch_us(init_time) + (lead + again * 5) * 3600000000)"
    name = _LEVELS if model == "hrrr" else "CASE j WHEN 0 THEN 't2m' WHEN 1 THEN 't2m_sd' WHEN 2 THEN 'gust' ELSE 'gust_sd' END"
    n = 14 if model == "hrrr" else 4
    days = "SELECT DISTINCT date_trunc('day', ts) AS init_time FROM events"
    each = f"SELECT /*+ REPARTITION({_TASKS}) */ init_time, s FROM ({days}) a CROSS JOIN range({_COUNT}) r(s)" if spark else f"SELECT init_time, unnest(range({_COUNT})) AS s FROM ({days}) a"
    return f"""SELECT '{model}' AS model, 'sfc' AS product, init_time, CAST(lead * 60 AS INT) AS lead_min, {valid} AS valid_time, concat('S', s) AS point_id,
  {name} AS variable, {_AT} AS level, 0 AS member, CAST(k AS INT) AS k,
  CASE WHEN ({hour} + j * 3 + k + s) % 13 = 0 THEN NULL ELSE CAST(2500 + ({hour} * 7 + lead * 3 + j * 17 + k * 5 + s * 29 + again * 11) % 500 AS DOUBLE) / 10 END AS value,
  CAST(-1224 - k - s AS DOUBLE) / 10 AS grid_lon, CAST(50 + k * 700 + s * 10 AS DOUBLE) AS grid_dist_m, {seen} AS ingested_at
FROM (SELECT *, {x(2)} AS again FROM (SELECT *, {x(n)} AS j FROM (SELECT *, {x(4)} AS k FROM (SELECT *, {x(3)} AS lead FROM ({each}) b) c) d) e) f"""


def _coast(spark: bool) -> str:
    """10-minute means of three coast stations for each day that events cover; on three days of four it turns cool and moist
    at some time after local noon, at each station a little later."""
    x = lambda n: f"explode(sequence(0, {n - 1}))" if spark else f"unnest(range({n}))"
    number = "datediff(day, DATE '1970-01-01')" if spark else "datediff('day', TIMESTAMP '1970-01-01', day)"
    time = "timestamp_micros(unix_micros(day) + slot * 600000000L)" if spark else "make_timestamp(epoch_us(day) + slot * 600000000)"
    return f"""SELECT concat('S', s) AS station_id, CASE WHEN j = 0 THEN 't2m' ELSE 'rh2m' END AS variable, {time} AS t,
  CAST((slot * 7 + s * 3 + j) % 10 AS DOUBLE) / 10 + CASE WHEN d % 4 > 0 AND slot >= 118 + (d * 5 + s * 2) % 24 THEN CASE WHEN j = 0 THEN 12 ELSE 78 END ELSE CASE WHEN j = 0 THEN 18 ELSE 60 END END AS v
FROM (SELECT *, {number} AS d FROM (SELECT *, {x(2)} AS j FROM (SELECT *, {x(144)} AS slot FROM (SELECT day, {x(3)} AS s FROM (SELECT DISTINCT date_trunc('day', ts) AS day FROM events) a) b) c) e) f"""


NUDGE = 1.7e-10

POINTS = "SELECT concat('P', s_suppkey) AS point_id, 37.6e0 + CAST(s_suppkey * 37 % 300 AS DOUBLE) / 1000 AS lat, -122.6e0 + CAST(s_suppkey * 91 % 301 AS DOUBLE) / 1000 AS lon FROM supplier"


@cache
def stations(spark: SparkSession, sf_dir: str) -> int:
    return spark.sql(f"SELECT {_COUNT.replace('FROM events', 'FROM {t}')} AS n", t=table(spark, sf_dir, "events")).first().n


def _sql(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    if _COUNT in text:
        n = stations(spark, sf_dir)
        text = text.replace(_COUNT, str(n)).replace(_TASKS, str(max(8, n // STATIONS_PER_TASK)))
    return spark.sql(text.replace(f"FROM {name}", "FROM {t}"), t=table(spark, sf_dir, name))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, OBS, "events")


def nwp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _nwp(True), "events")


def cells(spark: SparkSession, sf_dir: str, model: str = "hrrr") -> DataFrame:
    return _sql(spark, sf_dir, _cells(True, model), "events")


def coast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _coast(True), "events")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, POINTS, "supplier")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, time stamps without zone."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f.name), f.dataType.typeName()
        if kind == "double":
            # the nudge keeps exact halves, which the engines sum to either side of, from rounding apart
            c = F.round(c + F.lit(NUDGE), digits) + F.lit(0.0)
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- the same, and what the operators make of them, in SQL for the check ----------


_FLAG = f"""CASE WHEN value IS NULL OR isnan(value) THEN 'missing' WHEN station_id = 'S1' AND variable = 't2m' THEN 'station_fault' WHEN qc_flag IN ('B', 'X') THEN 'source_rejected'
  WHEN variable = 't2m' AND (value < {RANGES['t2m'][0]} OR value > {RANGES['t2m'][1]}) OR variable = 'gust' AND (value < {RANGES['gust'][0]} OR value > {RANGES['gust'][1]}) THEN 'range' ELSE 'ok' END"""
_FIELDS = ("t2m", "d2m", "rh2m", "u10", "v10", "gust", "prate", "vis", "lcc", "tcc", "cloud_base", "ceiling", "dswrf", "t925", "t850", "u925", "v925", "hpbl")
_ANGLE = "radians(0.6225146366376195 * (grid_lon + 97.5))"
_KELVIN = ("t2m", "d2m", "t925", "t850")

CTES = {
    "obs_v": OBS,
    "obs_latest": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, station_id, obs_time, variable ORDER BY ingested_at DESC, value DESC, qc_flag DESC, ingest_id DESC) AS rn FROM obs_v) WHERE rn = 1",
    "obs_qc": f"SELECT source, station_id, obs_time, variable, CASE WHEN variable = 'wdir10' AND station_id = 'S2' THEN (6.0 - value + 720) % 360 ELSE value END AS value, {_FLAG} AS qc_flag, ingested_at FROM obs_latest",
    "snap": """SELECT station_id, variable, hour, obs_time, source, value FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id, variable, hour ORDER BY abs(epoch_us(obs_time) - epoch_us(hour)), obs_time, source, value) AS rn FROM (
    SELECT *, date_trunc('hour', obs_time + INTERVAL 30 MINUTE) AS hour FROM obs_qc WHERE qc_flag = 'ok') WHERE abs(epoch_us(obs_time) - epoch_us(hour)) <= 1200000000) WHERE rn = 1""",
    "hours": """SELECT point_id, hour, t2m, CASE WHEN wind10 IS NULL THEN NULL ELSE greatest(coalesce(g, wind10), wind10) END AS gust FROM (
  SELECT station_id AS point_id, hour, max(value) FILTER (WHERE variable = 't2m') AS t2m, max(value) FILTER (WHERE variable = 'wind10') AS wind10, max(value) FILTER (WHERE variable = 'gust') AS g FROM snap GROUP BY ALL)""",
    "nwp_v": _nwp(False),
    "base": """SELECT n.point_id, n.init_time, n.init_time + INTERVAL 55 MINUTE AS issue_time, n.lead_min, n.valid_time, n.t2m AS nwp_t2m, n.gust AS nwp_gust, n.wind10 AS nwp_wind10,
  n.t925 AS nwp_t925, n.t850 AS nwp_t850, n.u925 AS nwp_u925, n.v925 AS nwp_v925,
  sin(2 * pi() * hour(n.valid_time) / 24) AS hour_sin, cos(2 * pi() * hour(n.valid_time) / 24) AS hour_cos,
  sin(2 * pi() * dayofyear(n.valid_time) / 365.25) AS doy_sin, cos(2 * pi() * dayofyear(n.valid_time) / 365.25) AS doy_cos,
  o.t2m AS obs_t2m, o.gust AS obs_gust, l.t2m AS obs_last_t2m, l.gust AS obs_last_gust, n.init_time - to_hours(CASE n.point_id WHEN 'S3' THEN 1 ELSE 0 END) AS seen_hour
FROM nwp_v n LEFT JOIN hours o ON o.point_id = n.point_id AND o.hour = n.valid_time
LEFT JOIN hours l ON l.point_id = n.point_id AND l.hour = n.init_time - to_hours(CASE n.point_id WHEN 'S3' THEN 1 ELSE 0 END) WHERE n.lead_min <= 360""",
    "init_err": """SELECT b.point_id, b.init_time, b.lead_min, b.obs_last_t2m - z.nwp_t2m AS err_at_init_t2m, b.obs_last_gust - z.nwp_gust AS err_at_init_gust
FROM base b LEFT JOIN base z ON z.point_id = b.point_id AND z.lead_min = 0 AND z.init_time = b.seen_hour""",
    "members": """SELECT b.point_id, b.init_time, b.lead_min, b.valid_time, m.k, m.t2m, m.gust
FROM base b JOIN (SELECT point_id, valid_time, init_time + to_hours(k) AS init_time, k::INT AS k, t2m, gust FROM (SELECT *, unnest(range(7)) AS k FROM nwp_v)) m USING (point_id, valid_time, init_time)""",
    "lagged": """SELECT point_id, init_time, lead_min, count(t2m) AS lag_n_t2m, avg(t2m) AS lag_mean_t2m, stddev_samp(t2m) AS lag_sd_t2m, max(t2m) FILTER (WHERE k = 0) - max(t2m) FILTER (WHERE k = 1) AS lag_d1_t2m,
  count(gust) AS lag_n_gust, avg(gust) AS lag_mean_gust, stddev_samp(gust) AS lag_sd_gust, max(gust) FILTER (WHERE k = 0) - max(gust) FILTER (WHERE k = 1) AS lag_d1_gust FROM members GROUP BY ALL""",
    "rolling": " UNION ALL ".join(
        f"""SELECT point_id, init_time, lead_min, avg(r_t2m) OVER w AS bias14_t2m, stddev_samp(r_t2m) OVER w AS std14_t2m, avg(r_gust) OVER w AS bias14_gust, stddev_samp(r_gust) OVER w AS std14_gust
FROM (SELECT *, obs_t2m - nwp_t2m AS r_t2m, obs_gust - nwp_gust AS r_gust FROM base WHERE lead_min = {m} AND {cond})
WINDOW w AS (PARTITION BY point_id ORDER BY epoch_us(valid_time) RANGE BETWEEN {(14 * 86400 + (m - 55) * 60 - 1) * 1_000_000} PRECEDING AND {abs(m - 55 + d) * 60_000_000} {'PRECEDING' if m - 55 + d >= 0 else 'FOLLOWING'})"""
        for m in range(0, 361, 60)
        for d, cond in ((5, "point_id <> 'S3'"), (80, "point_id = 'S3'"))
    ),
    "scores": f"""SELECT *, mu - obs AS error, CASE WHEN obs >= mu - 1.2815515655446004 * sigma AND obs <= mu + 1.2815515655446004 * sigma THEN 1 ELSE 0 END AS in_p10_p90, __CRPS__ AS crps FROM (
  SELECT 'raw_hrrr' AS model_name, 't2m' AS variable, point_id, init_time, lead_min, valid_time, obs_t2m AS obs, nwp_t2m AS mu, 20.0::DOUBLE + lead_min / 60 AS sigma FROM base WHERE lead_min >= 60 AND obs_t2m IS NOT NULL
  UNION ALL SELECT 'bias_rolling', 't2m', point_id, init_time, lead_min, valid_time, obs_t2m, nwp_t2m + coalesce(bias14_t2m, 0), 18.0::DOUBLE + lead_min / 60 FROM base JOIN rolling USING (point_id, init_time, lead_min) WHERE lead_min >= 60 AND obs_t2m IS NOT NULL
  UNION ALL SELECT 'shifted', 't2m', point_id, init_time, lead_min, valid_time, obs_t2m, nwp_t2m + 10, 15.0::DOUBLE FROM base WHERE lead_min >= 60 AND obs_t2m IS NOT NULL AND nwp_t2m > 11
  UNION ALL SELECT 'raw_hrrr', 'gust', point_id, init_time, lead_min, valid_time, obs_gust, nwp_gust, 25.0::DOUBLE FROM base WHERE lead_min >= 60 AND obs_gust IS NOT NULL)""",
    "common": "SELECT s.* FROM scores s SEMI JOIN (SELECT variable, point_id, init_time, lead_min FROM scores JOIN (SELECT variable, count(DISTINCT model_name) AS n FROM scores GROUP BY 1) v USING (variable) GROUP BY variable, point_id, init_time, lead_min HAVING count(DISTINCT model_name) = any_value(n)) k USING (variable, point_id, init_time, lead_min)",
    "pairs_all": """SELECT s.*, b.crps AS crps_base, CASE WHEN lead_min // 60 BETWEEN 1 AND 3 THEN '1-3 h' WHEN lead_min // 60 BETWEEN 4 AND 6 THEN '4-6 h' END AS bucket, valid_time::DATE AS day
FROM common s JOIN (SELECT variable, point_id, init_time, lead_min, crps FROM common WHERE model_name = 'raw_hrrr') b USING (variable, point_id, init_time, lead_min)""",
    "pooled": "SELECT * FROM (SELECT *, unnest([point_id, 'all']) AS point FROM pairs_all WHERE bucket IS NOT NULL) UNION ALL SELECT *, 'original' AS point FROM pairs_all WHERE bucket IS NOT NULL AND point_id IN ('S0', 'S4')",
    "blocks": "SELECT variable, model_name, bucket, point, day, sum(crps) AS crps, sum(crps_base) AS crps_base, count(*) AS n FROM pooled GROUP BY ALL",
    # days drawn by mixed integers: x = (r * A + j * B + S) mod P, then four times x = (x * x + S) mod P
    "boot": """SELECT variable, model_name, bucket, point, 1 - any_value(sc) / any_value(sb) AS skill, quantile_cont(draw, 0.025) AS skill_lo, quantile_cont(draw, 0.975) AS skill_hi FROM (
  SELECT variable, model_name, bucket, point, r, 1 - sum(m[(x % len(m)) + 1]) / sum(b[(x % len(m)) + 1]) AS draw, any_value(list_sum(m)) AS sc, any_value(list_sum(b)) AS sb FROM ("""
    + "SELECT * REPLACE ((x * x + 12345) % 2147483647 AS x) FROM (" * 4
    + """SELECT *, (r * 1664525 + j * 1013904223 + 12345) % 2147483647 AS x FROM (SELECT *, unnest(range(len(m))) AS j FROM (SELECT *, unnest(range(1, 1001)) AS r FROM (
    SELECT variable, model_name, bucket, point, list(crps ORDER BY day) AS m, list(crps_base ORDER BY day) AS b FROM blocks GROUP BY ALL)))))))) GROUP BY variable, model_name, bucket, point, r) GROUP BY variable, model_name, bucket, point""",
    "board": """SELECT variable, model_name, bucket, point, count(*) AS n, avg(crps) AS crps, avg(abs(error)) AS mae, avg(error) AS bias, avg(in_p10_p90) AS coverage_80, any_value(skill) AS skill, any_value(skill_lo) AS skill_lo, any_value(skill_hi) AS skill_hi
FROM pooled JOIN boot USING (variable, model_name, bucket, point) GROUP BY ALL""",
    "blend_rows": """SELECT * FROM (SELECT s.variable, point_id, init_time, lead_min, strftime(init_time, '%Y-%m') AS month, s.obs, CASE s.variable WHEN 't2m' THEN n.t2m + 0.5 ELSE n.gust + 1 END AS mu,
  CASE WHEN s.variable = 'gust' THEN 0.01 WHEN lead_min <> 120 THEN 1 + lead_min / 600.0 END::DOUBLE AS sd FROM scores s JOIN nwp_v n USING (point_id, init_time, lead_min) WHERE s.model_name = 'raw_hrrr') WHERE sd IS NOT NULL""",
    "blend_sq": "SELECT variable, lead_min, month, sum(pow(mu - obs, 2)) AS q, count(*) AS n FROM blend_rows GROUP BY ALL",
    "blend_rms": """SELECT variable, lead_min, month, sqrt(greatest(CASE WHEN sum(n) OVER w > n THEN (sum(q) OVER w - q) / (sum(n) OVER w - n) ELSE q / n END, 0)) AS rms FROM blend_sq WINDOW w AS (PARTITION BY variable, lead_min)""",
    "blend_scored": """SELECT *, mu - obs AS error, CASE WHEN obs >= mu - 1.2815515655446004 * sigma AND obs <= mu + 1.2815515655446004 * sigma THEN 1 ELSE 0 END AS in_p10_p90, __CRPS__ AS crps FROM (
  SELECT 'nbm' AS model_name, variable, point_id, init_time, lead_min, obs, mu, greatest(sd, 0.05::DOUBLE) AS sigma FROM blend_rows
  UNION ALL SELECT 'nbm_cal', variable, point_id, init_time, lead_min, obs, mu, greatest(rms, 0.05::DOUBLE) FROM blend_rows JOIN blend_rms USING (variable, lead_min, month))""",
    "cells_v": _cells(False),
    "blend_v": _cells(False, "nbm"),
    "cells_latest": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model, product, init_time, lead_min, point_id, variable, level, member, k ORDER BY ingested_at DESC, value DESC) AS rn FROM cells_v WHERE member = 0) WHERE rn = 1",
    "cell": "SELECT model, init_time, lead_min, valid_time, point_id, k, grid_lon, grid_dist_m, " + ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS {f}" for f in _FIELDS) + """, max(ingested_at) AS seen FROM (
  SELECT *, CASE WHEN variable = 'gh' AND level = 'cloudBase:0' THEN 'cloud_base' WHEN variable = 'gh' AND level = 'cloudCeiling:0' THEN 'ceiling' WHEN variable = 'r2' THEN 'rh2m' WHEN variable = 'sdswrf' THEN 'dswrf'
    WHEN variable IN ('t', 'u', 'v') AND level LIKE 'isobaricInhPa:%' THEN variable || replace(level, 'isobaricInhPa:', '') WHEN variable = 'blh' THEN 'hpbl' ELSE variable END AS field FROM cells_latest) GROUP BY ALL""",
    "earth": f"""SELECT * EXCLUDE (u10, v10, u925, v925), cos({_ANGLE}) * u10 + sin({_ANGLE}) * v10 AS u10, cos({_ANGLE}) * v10 - sin({_ANGLE}) * u10 AS v10,
  cos({_ANGLE}) * u925 + sin({_ANGLE}) * v925 AS u925, cos({_ANGLE}) * v925 - sin({_ANGLE}) * u925 AS v925, 1 / greatest(grid_dist_m, 100.0::DOUBLE) AS w FROM cell""",
    "idw": "SELECT model, init_time, lead_min, valid_time, point_id, "
    + ", ".join(f"sum(w * ({f}{' - 273.15' if f in _KELVIN else ''})) / sum(w) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in _FIELDS)
    + ", sum(w * sqrt(u10 * u10 + v10 * v10)) / sum(w) FILTER (WHERE u10 * v10 IS NOT NULL) AS wind10, max(t2m) - min(t2m) AS t2m_spread, max(gust) - min(gust) AS gust_spread, max(seen) AS ingested_at FROM earth GROUP BY ALL",
    "h1": "SELECT station_id, date_trunc('hour', obs_time) AS hour, avg(value) AS v FROM obs_qc WHERE variable = 't2m' AND qc_flag = 'ok' GROUP BY ALL",
    "net": """SELECT h.station_id, h.hour, h.v, h.v - a.v AS d1h, h.v - c.v AS d3h,
  h.v - avg(h.v) OVER (PARTITION BY h.station_id, hour(h.hour) ORDER BY epoch(h.hour) RANGE BETWEEN 1209600 PRECEDING AND 3600 PRECEDING) AS anom, h.station_id IN ('S0', 'S1', 'S2', 'S4') AS west
FROM h1 h LEFT JOIN h1 a ON a.station_id = h.station_id AND a.hour = h.hour - INTERVAL 1 HOUR LEFT JOIN h1 c ON c.station_id = h.station_id AND c.hour = h.hour - INTERVAL 3 HOUR""",
    "ten": "SELECT station_id, variable, time_bucket(INTERVAL 10 MINUTE, obs_time) AS t, avg(value) AS v FROM obs_qc WHERE qc_flag = 'ok' AND variable IN ('t2m', 'rh2m') GROUP BY ALL",
    "slot": """SELECT station_id, variable, t, CASE WHEN count(v) OVER w >= 7 THEN v - avg(v) OVER w END AS value FROM ten
WINDOW w AS (PARTITION BY station_id, variable, (epoch_us(t) // 600000000) % 144 ORDER BY epoch_us(t) // 86400000000 RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING)""",
    "ch": "SELECT a.station_id, a.variable, a.t, a.v - b.v AS d1h, a.v - c.v AS d3h FROM ten a LEFT JOIN ten b ON b.station_id = a.station_id AND b.variable = a.variable AND b.t = a.t - INTERVAL 1 HOUR LEFT JOIN ten c ON c.station_id = a.station_id AND c.variable = a.variable AND c.t = a.t - INTERVAL 3 HOUR",
    "coast_v": _coast(False),
    "coast_ch": "SELECT a.station_id, a.variable, a.t, a.v - b.v AS d1h FROM coast_v a LEFT JOIN coast_v b ON b.station_id = a.station_id AND b.variable = a.variable AND b.t = a.t - INTERVAL 1 HOUR",
    "points_v": POINTS,
    "pairs_v": """SELECT point_id, nb_id, rank, dist_km FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(dist_km, 6), nb_id)::INT AS rank FROM (
  SELECT a.point_id, b.point_id AS nb_id, 12742.0 * asin(least(1.0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))) AS dist_km
  FROM points_v a JOIN points_v b ON a.point_id <> b.point_id)) WHERE rank <= 5""",
}


#: From here on the normal distribution's tail is taken by its asymptotic series; below, by a power series of SERIES terms.
TAIL, SERIES = 6, 80


def norm_cdf_sql(z: str) -> str:
    """The normal distribution function for the SQL, another way than the operator's: series instead of rational functions."""
    density = f"(exp(-{z} * {z} / 2) / {math.sqrt(2 * math.pi)!r})"
    series = "1"
    for k in range(SERIES, 0, -1):
        series = f"(1 + {z} * {z} / {2 * k + 1} * {series})"
    tail = f"({density} / abs({z}) * (1 - 1 / pow({z}, 2) + 3 / pow({z}, 4) - 15 / pow({z}, 6) + 105 / pow({z}, 8)))"
    return f"(CASE WHEN abs({z}) < {TAIL} THEN 0.5 + {density} * {z} * {series} WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


def crps_sql(mu: str, sigma: str, obs: str) -> str:
    z = f"(({obs} - {mu}) / {sigma})"
    return f"({sigma} * ({z} * (2 * {norm_cdf_sql(z)} - 1) + 2 * exp(-{z} * {z} / 2) / {math.sqrt(2 * math.pi)!r} - {1 / math.sqrt(math.pi)!r}))"


def oracle(select: str) -> str:
    """select over the named parts; only those that it needs, in order."""
    need, queue = set(), [select]
    while queue:
        text = queue.pop()
        for n, body in CTES.items():
            if n not in need and re.search(rf"\b{n}\b", text):
                need.add(n)
                queue.append(body)
    # A part that others read more than once is made once.
    parts = [f"{n} AS MATERIALIZED ({CTES[n].replace('__CRPS__', crps_sql('mu', 'sigma', 'obs'))})" for n in CTES if n in need]
    return (f"WITH {', '.join(parts)} " if parts else "") + select
