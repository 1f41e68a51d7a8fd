"""Column expressions and frame verbs that several operators use."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: The 90th percentile of the standard normal.
Z90 = 1.2815515655446004
# W. J. Cody's rational approximations of the error function (1969), coefficients from the highest power down; for
# erf(x) / x in x^2 below 0.46875, for erfc(x) exp(x^2) in x below 4, and for the rest of it in 1 / x^2 beyond.
NEAR = 0.46875
NEAR_TOP = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
NEAR_BOTTOM = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
FAR = 4.0
MIDDLE_TOP = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
    8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
)
MIDDLE_BOTTOM = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
    3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
)
FAR_TOP = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
FAR_BOTTOM = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def polynomial(coefficients: Iterable[float], x: Column) -> Column:
    """From the highest power down."""
    return reduce(lambda total, c: total * x + c, map(F.lit, coefficients))


def erfc(x: Column) -> Column:
    """The complementary error function of numbers from 0 on, to double precision in its tail, too."""
    ratio = lambda top, bottom, y: polynomial(top, y) / polynomial(bottom, y)
    s, small = x * x, F.exp(-x * x)
    beyond = (1 / math.sqrt(math.pi) - ratio(FAR_TOP, FAR_BOTTOM, 1 / s) / s) / x
    return F.when(x <= NEAR, 1 - x * ratio(NEAR_TOP, NEAR_BOTTOM, s)).when(x <= FAR, small * ratio(MIDDLE_TOP, MIDDLE_BOTTOM, x)).otherwise(small * beyond)


def norm_cdf(z: Column) -> Column:
    """The normal distribution function."""
    side = F.signum(z)
    return (1 + side) / 2 - side * erfc(F.abs(z) / math.sqrt(2)) / 2


def crps(mu: str | Column, sigma: str | Column, obs: str | Column) -> Column:
    """Continuous ranked probability score of a Gaussian."""
    z = (col(obs) - col(mu)) / col(sigma)
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return col(sigma) * (z * (2 * norm_cdf(z) - 1) + 2 * density - 1 / math.sqrt(math.pi))


def finite(c: str | Column) -> Column:
    """NaN to null."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def first_where(value: str | Column, cond: Column) -> Column:
    """An aggregate: the value where cond holds (null kept, as a lone match would be)."""
    return F.max(F.when(cond, col(value)))


def weighted_mean(value: str | Column, weight: str | Column, skip_null: bool = True) -> Column:
    """An aggregate: sum(w x) / sum(w); skip_null leaves the weights of missing values out."""
    v, w = col(value), col(weight)
    total = F.sum(F.when(v.isNotNull(), w)) if skip_null else F.sum(w)
    return F.try_divide(F.sum(v * w), total)


def inverse_distance(dist: str | Column, least: float) -> Column:
    return 1.0 / F.greatest(col(dist), F.lit(float(least)))


def latest(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """One row per key: the greatest by order, ties by the other columns, so the result is determined.

    An aggregate rather than a window: copies combine before the shuffle, so a hot key costs no more than others.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"best.{c}").alias(c) for c in df.columns])


def last_known(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """One row per key: the greatest order and each other column's last non-null value, ties by the greatest value."""
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = [F.max(F.when(F.col(c).isNotNull(), F.struct(*order, c)))[c].alias(c) for c in rest]
    out = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("last_order"), *best)
    return out.select(*[F.col(f"last_order.{c}").alias(c) if c in order else F.col(c) for c in df.columns])


def micros(ts: str | Column) -> Column:
    return F.unix_micros(col(ts))


def hours_after(ts: str | Column, hours: int | Column) -> Column:
    h = F.lit(hours) if isinstance(hours, int) else hours
    return F.timestamp_micros(micros(ts) + h.cast("long") * 3_600_000_000)


def minutes_after(ts: str | Column, minutes: int | Column) -> Column:
    m = F.lit(minutes) if isinstance(minutes, int) else minutes
    return F.timestamp_micros(micros(ts) + m.cast("long") * 60_000_000)


def bucket(ts: str | Column, minutes: int) -> Column:
    """The start of the bucket of so many minutes that ts lies in."""
    width = minutes * 60_000_000
    return F.timestamp_micros(micros(ts) - F.pmod(micros(ts), F.lit(width)))


def lead_bucket(lead_min: str | Column) -> Column:
    h = F.floor(col(lead_min) / 60)
    return F.when(h.between(1, 3), "1-3 h").when(h.between(4, 6), "4-6 h")


def wind_from(u: str | Column, v: str | Column) -> Column:
    """The direction, in degrees, that a wind blows from."""
    return F.pmod(F.degrees(F.atan2(-col(u), -col(v))) + 360, F.lit(360.0))


def great_circle_km(lat1, lon1, lat2, lon2) -> Column:
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    x, y = F.sin((b - a) / 2), F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(x * x + F.cos(a) * F.cos(b) * y * y)))


def trailing(keys: Iterable[str], seconds: str | Column, lo: int, hi: int):
    """A window over seconds: from lo to hi after each row, both inclusive."""
    return Window.partitionBy(*keys).orderBy(col(seconds)).rangeBetween(lo, hi)


def longer(df: DataFrame, ids: Iterable[str], values: Iterable[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long; missing values are left out."""
    return df.unpivot(list(ids), list(values), name, value).where(F.col(value).isNotNull())


def wider(df: DataFrame, ids: Iterable[str], names: Iterable[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Long to wide, with the columns given, so no extra pass finds them."""
    return df.groupBy(*ids).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])
