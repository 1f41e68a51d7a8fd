"""The lake's eleven tables: columns, natural keys and partitions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

STR, INT, DBL, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

# The column names that the tables share.
NWP_FIELDS = (
    "t2m", "d2m", "rh2m", "u10", "v10", "wind10", "wdir10", "gust", "prate", "vis", "lcc", "tcc",
    "cloud_base", "ceiling", "dswrf", "t2m_spread", "gust_spread",
)
REGIME_FIELDS = ("t925", "t850", "u925", "v925", "hpbl")
TARGETS = ("t2m", "gust")
LAG_FIELDS = tuple(f"lag_{s}_{t}" for t in TARGETS for s in ("n", "mean", "sd", "d1"))
CYCLIC_FIELDS = ("hour_sin", "hour_cos", "doy_sin", "doy_cos")


@dataclass(frozen=True)
class TableDef:
    """A lake table: its columns, the columns that must not be null, and how it is partitioned."""

    namespace: str
    name: str
    schema: T.StructType
    identity: tuple[str, ...] = ()
    day: str | None = None
    key: tuple[str, ...] = field(default=())

    @property
    def identifier(self) -> str:
        return f"{self.namespace}.{self.name}"


def struct(required: str, optional: str = "", **kinds: T.DataType) -> T.StructType:
    """Columns by name; the type is String unless given in kinds."""
    cols = [(c, False) for c in required.split()] + [(c, True) for c in optional.split()]
    return T.StructType([T.StructField(c, kinds.get(c, STR), null) for c, null in cols])


def _times(*names: str) -> dict[str, T.DataType]:
    return dict.fromkeys(names, TS)


_RUN = _times("init_time", "valid_time", "issue_time", "obs_time", "ingested_at") | {"lead_min": INT, "member": INT, "k": INT}
_NUM = dict.fromkeys(("value", "grid_lat", "grid_lon", "grid_dist_m", "lat", "lon", "elevation_m", "mu", "sigma", "p10", "p50", "p90", "obs", "error", "crps"), DBL)
_WIDE = dict.fromkeys((*NWP_FIELDS, *REGIME_FIELDS), DBL)
_GOLD = (
    [f"nwp_{f}" for f in (*NWP_FIELDS, *REGIME_FIELDS)]
    + list(CYCLIC_FIELDS)
    + [f"{p}_{t}" for t in TARGETS for p in ("obs_last", "err_at_init", "bias14", "std14", "obs")]
    + list(LAG_FIELDS)
)
_NWP_KEY = ("model", "product", "init_time", "lead_min", "point_id", "variable", "level", "member", "k")
_SCORE_KEY = ("model_name", "run_id", "kind", "fold", "variable", "point_id", "init_time", "lead_min")

TABLES = {
    t.identifier: t
    for t in (
        TableDef(
            "bronze", "nwp_point",
            struct("model product init_time lead_min valid_time point_id variable level member k", "value grid_lat grid_lon grid_dist_m ingest_batch ingested_at", **_RUN, **_NUM),
            ("model",), "init_time", _NWP_KEY,
        ),
        TableDef("bronze", "obs", struct("source station_id obs_time variable", "value qc_flag ingest_batch ingested_at", **_RUN, **_NUM), ("source",), "obs_time", ("source", "station_id", "obs_time", "variable")),
        TableDef("bronze", "stations", struct("source station_id", "provider lat lon elevation_m ingest_batch ingested_at", **_RUN, **_NUM), ("source",), "ingested_at", ("source", "station_id")),
        TableDef("silver", "obs_qc", struct("source station_id obs_time variable qc_flag", "value ingested_at", **_RUN, **_NUM), ("source",), "obs_time", ("source", "station_id", "obs_time", "variable")),
        TableDef("silver", "nwp_aligned", struct("model init_time lead_min valid_time point_id", " ".join((*NWP_FIELDS, "ingested_at", *REGIME_FIELDS)), **_RUN, **_WIDE), ("model",), "init_time", ("model", "init_time", "lead_min", "point_id")),
        TableDef("silver", "static_features", struct("point_id feature", "value", **_NUM), key=("point_id", "feature")),
        TableDef("gold", "training_examples", struct("point_id init_time issue_time lead_min valid_time", " ".join(_GOLD), **_RUN, **dict.fromkeys(_GOLD, DBL)), day="init_time", key=("point_id", "init_time", "lead_min")),
        TableDef("gold", "network_features", struct("init_time feature", "value", **_RUN, **_NUM), key=("init_time", "feature")),
        TableDef("gold", "upwind_features", struct("init_time feature", "value", **_RUN, **_NUM), key=("init_time", "feature")),
        TableDef("gold", "forecasts", struct(" ".join((*_SCORE_KEY, "issue_time", "valid_time")), "mu sigma p10 p50 p90", **_RUN, **_NUM), ("model_name",), "valid_time", _SCORE_KEY),
        TableDef("gold", "scores", struct(" ".join((*_SCORE_KEY, "valid_time")), "obs mu sigma error crps in_p10_p90", **_RUN, **_NUM, in_p10_p90=INT), ("model_name",), "valid_time", _SCORE_KEY),
    )
}
