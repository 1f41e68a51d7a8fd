"""Feature tables of the sensor network, the upwind stations, and neighbouring stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fogbank.functions.core import bucket, first_where, great_circle_km, hours_after, inverse_distance, longer, micros, minutes_after, weighted_mean

DAY = 86400
# The stations along a marine push's path.
GROUPS = {
    "coast": ("604PG", "D5422", "AV684", "F8022"),
    "ridge": ("PG800", "070PG", "G0189", "F2543"),
    "east": ("C5988", "E9227", "E5830", "F4637", "F6803", "F8548", "G3010", "G6226", "438PG"),
}
PUSH_COOLER, PUSH_MOISTER, PUSH_HOURS = -2.0, 8.0, (11, 22)
LOCAL_TZ = "America/Los_Angeles"
NEAREST, RANKED, LEAST_KM = 5, 3, 0.2
NEIGHBOUR_FIELDS = ("err_at_init_t2m", "err_at_init_gust", "bias14_t2m", "bias14_gust")


# --- sensor network ---------------------------------------------------------------


def hourly_means(obs: DataFrame, variable: str = "t_sensor") -> DataFrame:
    """station_id, hour, v: the mean of each clock hour."""
    return obs.where((F.col("variable") == variable) & (F.col("qc_flag") == "ok")).groupBy("station_id", F.date_trunc("hour", "obs_time").alias("hour")).agg(F.avg("value").alias("v"))


def lagged_changes(hours: DataFrame) -> DataFrame:
    """Changes over 1 and 3 hours; joined by hour, so a gap stays missing."""
    out = hours
    for n in (1, 3):
        past = hours.select("station_id", hours_after("hour", n).alias("hour"), F.col("v").alias("past"))
        out = out.join(past, ["station_id", "hour"], "left").withColumn(f"d{n}h", F.col("v") - F.col("past")).drop("past")
    return out


def same_hour_anomaly(hours: DataFrame) -> DataFrame:
    """Adds anom: the value less its mean at the same hour of the last 14 days."""
    w = Window.partitionBy("station_id", F.hour("hour")).orderBy(F.unix_seconds("hour")).rangeBetween(-14 * DAY, -3600)
    return hours.withColumn("anom", F.col("v") - F.avg("v").over(w))


def network_features(obs: DataFrame, sensors: dict[str, float], others: bool = False) -> DataFrame:
    """gold.network_features; sensors: station id to longitude. Sensors west of the median count as west.

    others: stations without a longitude have features and count in the mean as well, but are neither west nor east.
    """
    lons = sorted(sensors.values())
    west = [s for s, lon in sensors.items() if lon < lons[len(lons) // 2]] if lons else []
    known = F.col("station_id").isin(list(sensors))
    hours = hourly_means(obs if others else obs.where(known))
    per = same_hour_anomaly(lagged_changes(hours)).withColumn("init_time", hours_after("hour", 1)).withColumn("west", F.when(known, F.col("station_id").isin(west)))
    own = longer(per, ["init_time", "station_id"], ["d1h", "d3h", "anom"], "stat")
    own = own.select("init_time", F.concat(F.lit("pa_"), F.replace("station_id", F.lit("pa_"), F.lit("")), F.lit("_"), F.col("stat")).alias("feature"), "value")
    all_ = per.groupBy("init_time").agg(F.avg("anom").alias("pa_mean_anom"), west_less_east().alias("pa_west_east_anom"))
    return own.unionByName(longer(all_, ["init_time"], ["pa_mean_anom", "pa_west_east_anom"], "feature"))


def west_less_east():
    return F.avg(F.when(F.col("west"), F.col("anom"))) - F.avg(F.when(~F.col("west"), F.col("anom")))


# --- upwind stations --------------------------------------------------------------


def ten_minute_means(obs: DataFrame, variables=("t2m", "rh2m")) -> DataFrame:
    """station_id, variable, t, v: means of 10-minute buckets."""
    return obs.where(F.col("variable").isin(*variables)).groupBy("station_id", "variable", bucket("obs_time", 10).alias("t")).agg(F.avg("value").alias("v"))


def change(means: DataFrame, hours: int) -> DataFrame:
    """Value less the value so many hours before: what a lag on the full 10-minute grid gives."""
    past = means.select("station_id", "variable", hours_after("t", hours).alias("t"), F.col("v").alias("past"))
    return means.join(past, ["station_id", "variable", "t"], "left").select("station_id", "variable", "t", (F.col("v") - F.col("past")).alias("value"))


def slot_anomaly(means: DataFrame) -> DataFrame:
    """Value less the mean of the 14 previous days at the same 10-minute slot; at least 7 of them must be there.

    On the full grid the previous 14 rows of a slot are the previous 14 days, so a range over days needs no gaps filled.
    """
    slot = F.pmod(F.floor(micros("t") / 600_000_000), F.lit(144))
    day = F.floor(micros("t") / (DAY * 1_000_000))
    w = Window.partitionBy("station_id", "variable", slot).orderBy(day).rangeBetween(-14, -1)
    return means.select("station_id", "variable", "t", F.when(F.count("v").over(w) >= 7, F.col("v") - F.avg("v").over(w)).alias("value"))


def push_onsets(means: DataFrame, coast=GROUPS["coast"]) -> DataFrame:
    """day, onset: the first bucket of each local day in which a coast station got 2 C cooler and 8 points moister."""
    hourly = change(means.where(F.col("station_id").isin(*coast)), 1)
    both = hourly.groupBy("station_id", "t").agg(first_where("value", F.col("variable") == "t2m").alias("dt"), first_where("value", F.col("variable") == "rh2m").alias("drh"))
    local = F.from_utc_timestamp("t", LOCAL_TZ)
    hit = both.where((F.col("dt") <= PUSH_COOLER) & (F.col("drh") >= PUSH_MOISTER) & F.hour(local).between(*PUSH_HOURS))
    return hit.groupBy(F.to_date(local).alias("day")).agg(F.min("t").alias("onset"))


def push_age(cycles: DataFrame, onsets: DataFrame) -> DataFrame:
    """cycles: init_time. Minutes since the local day's onset, once its bucket has ended."""
    out = cycles.withColumn("day", F.to_date(F.from_utc_timestamp("init_time", LOCAL_TZ))).join(F.broadcast(onsets), "day", "left")  # one row per day
    age = (micros("init_time") - micros("onset")) / 60_000_000
    return out.select("init_time", F.when(age >= 10, age).alias("up_push_age_min"))


def upwind_features(obs: DataFrame, groups=GROUPS) -> DataFrame:
    """gold.upwind_features: group means of station changes and anomalies at whole hours, coast less east, push age."""
    means = ten_minute_means(obs.where("qc_flag = 'ok'")).where(F.col("v").isNotNull())
    parts = [change(means, 1).withColumn("stat", F.lit("d1h")), change(means, 3).withColumn("stat", F.lit("d3h")), slot_anomaly(means).withColumn("stat", F.lit("anom"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("init_time", minutes_after("t", 10)).where((F.minute("init_time") == 0) & F.col("value").isNotNull())
    member = F.create_map(*[F.lit(x) for g, ids in groups.items() for s in ids for x in (s, g)])
    grouped = (
        rows.withColumn("grp", F.element_at(member, F.col("station_id")))
        .where(F.col("grp").isNotNull())
        .withColumn("var", F.when(F.col("variable") == "rh2m", "rh").otherwise(F.col("variable")))
        .groupBy("init_time", "grp", "var", "stat")
        .agg(F.avg("value").alias("value"))
    )
    named = grouped.select("init_time", F.concat_ws("_", F.lit("up"), "grp", "var", "stat").alias("feature"), "value")
    pair = grouped.where("stat = 'anom'").groupBy("init_time", "var").agg((first_where("value", F.col("grp") == "coast") - first_where("value", F.col("grp") == "east")).alias("value"))
    pair = pair.select("init_time", F.concat(F.lit("up_coast_east_"), F.col("var"), F.lit("_anom")).alias("feature"), "value").where("value IS NOT NULL")
    # every whole hour that the temperature series spans, as on its full grid
    span = means.where("variable = 't2m'").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    first, last = bucket(minutes_after("a", 60), 60), bucket(minutes_after("b", 10), 60)
    cycles = span.where("a IS NOT NULL").select(F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))).alias("init_time"))
    age = longer(push_age(cycles, push_onsets(means, groups["coast"])), ["init_time"], ["up_push_age_min"], "feature")
    return named.unionByName(pair).unionByName(age)


# --- neighbours -------------------------------------------------------------------


#: Levels of boxes: 360 degrees wide at level 0, half as wide at each further one.
BOX_LEVELS = 20
#: Stations that are broadcast and compared with one another: 24 bytes and an id each, four million pairs at most.
FEW_POINTS = 2000


def nearest_pairs(points: DataFrame, n: int = NEAREST, few: int = FEW_POINTS) -> DataFrame:
    """point_id, nb_id, rank, dist_km: each station's nearest others, exactly. points: point_id, lat, lon.

    Up to ``few`` stations, which are counted, are compared in a broadcast loop; more meet in boxes, with the same result.
    """
    other = points.select(F.col("point_id").alias("nb_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    if points.limit(few + 1).count() <= few:
        d = points.select("point_id", "lat", "lon").join(F.broadcast(other), F.col("point_id") != F.col("nb_id"))
    else:
        d = in_boxes(points, n)
    d = d.withColumn("dist_km", great_circle_km("lat", "lon", "lat2", "lon2"))
    w = Window.partitionBy("point_id").orderBy(F.round("dist_km", 6), "nb_id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("point_id", "nb_id", "rank", "dist_km")


def in_boxes(points: DataFrame, n: int) -> DataFrame:
    """Pairs (point_id, lat, lon, nb_id, lat2, lon2) among which are each station's n nearest.

    Stations are keyed by boxes of several widths. The narrowest box around a station that holds n others bounds the
    distance of its n-th neighbour by the box's diagonal; the station then looks into the nine boxes around it at the first level
    wide enough for that distance. All joins are on equal keys, and no side is broadcast unasked. Stations so near a pole
    that no level is wide enough, and tables of fewer stations than asked for, use level 0, which is one box.
    """
    wide = lambda level: F.lit(360.0) / F.pow(F.lit(2.0), level)
    levels = F.explode(F.sequence(F.lit(0), F.lit(BOX_LEVELS))).alias("level")
    boxed = points.select("point_id", "lat", "lon", levels).withColumn("bi", F.floor((F.col("lat") + 90) / wide("level")))
    boxed = boxed.withColumn("bj", F.pmod(F.floor((F.col("lon") + 180) / wide("level")), F.pow(F.lit(2.0), "level").cast("long")))
    full = boxed.groupBy("level", "bi", "bj").agg(F.count("*").alias("held")).where(F.col("held") > n)
    finest = boxed.join(full, ["level", "bi", "bj"]).groupBy("point_id").agg(F.max("level").alias("finest"))

    # In degrees: how far the n-th neighbour may be, and how far east or west that distance reaches at this latitude.
    far = wide("finest") * 1.4143
    reach = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(far)) / F.cos(F.radians("lat")))))
    fits = lambda k: (far <= wide(F.lit(k))) & (F.abs("lat") + far < 90) & (reach <= wide(F.lit(k)))
    level = F.coalesce(*[F.when(fits(k), F.lit(k)) for k in range(BOX_LEVELS, 0, -1)], F.lit(0))
    asks = points.select("point_id", "lat", "lon").join(finest, "point_id", "left").withColumn("level", level)
    boxes, steps = F.pow(F.lit(2.0), "level").cast("long"), F.array(*[F.lit(i) for i in (-1, 0, 1)])
    east = F.floor((F.col("lon") + 180) / wide("level"))
    asks = asks.withColumn("bi", F.explode(F.transform(steps, lambda i: F.floor((F.col("lat") + 90) / wide("level")) + i)))
    asks = asks.withColumn("bj", F.explode(F.array_distinct(F.transform(steps, lambda i: F.pmod(east + i, boxes)))))

    other = boxed.select("level", "bi", "bj", F.col("point_id").alias("nb_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return asks.join(other, ["level", "bi", "bj"]).where("point_id <> nb_id")


def neighbour_features(gold: DataFrame, pairs: DataFrame) -> DataFrame:
    """nb1..nb3 and inverse-distance features from the nearest stations' rows of the same cycle and lead."""
    p = pairs.withColumn("w", inverse_distance("dist_km", LEAST_KM))
    g = gold.select(F.col("point_id").alias("nb_id"), "init_time", "lead_min", *NEIGHBOUR_FIELDS)
    ranked = [first_where(f, F.col("rank") == k).alias(f"nb{k}_{f}") for k in range(1, RANKED + 1) for f in NEIGHBOUR_FIELDS]
    away = [first_where("dist_km", F.col("rank") == k).alias(f"nb{k}_dist_km") for k in range(1, RANKED + 1)]
    mean = [weighted_mean(f, "w").alias(f"nbw_{f}") for f in NEIGHBOUR_FIELDS]
    # A row travels once, with the list of those whose neighbour it is, to the others of its cycle and lead; it is multiplied there.
    near = p.groupBy("nb_id").agg(F.collect_list(F.struct("point_id", "rank", "dist_km", "w")).alias("near"))
    met = g.join(near, "nb_id").repartition("init_time", "lead_min").select("init_time", "lead_min", *NEIGHBOUR_FIELDS, F.inline("near"))
    return met.groupBy("point_id", "init_time", "lead_min").agg(*ranked, *away, *mean)


def attach(gold: DataFrame, network=None, upwind=None, static=None, neighbours=None) -> DataFrame:
    """Training rows with feature tables joined on; long tables must have been widened. Unknown points are an error."""
    for extra, key in ((network, ["init_time"]), (upwind, ["init_time"]), (static, ["point_id"]), (neighbours, ["point_id", "init_time", "lead_min"])):
        if extra is None:
            continue
        if key == ["point_id"] and (missing := [r.point_id for r in gold.select("point_id").distinct().join(extra, "point_id", "left_anti").limit(20).collect()]):
            raise ValueError(f"no static features for {sorted(missing)}")
        gold = gold.join(extra, key, "left")
    return gold
