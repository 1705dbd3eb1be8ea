"""Column contracts of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

from tidepanel.operators import features
from tidepanel.operators.gold import COLUMNS, CONTEXT
from tidepanel.operators.quality import MODEL_COUNTS, MODEL_PERCENT, MODEL_SHARES, PERCENTAGES, TRACES, Field

_COUNTS = {f"{m}_{s}" for m in ("travellers", "overnight_stays") for s in ("total", "domestic", "foreign")}
_SHARES = {f"{r}_{m}_share" for r in ("domestic", "foreign") for m in ("travellers", "overnight_stays")}
_BOOLEAN = set("complete_month_available covid_period is_christmas_period is_easter_period is_provisional is_summer".split())
_OTHER = {"date_month": T.DateType(), "target_date_month": T.DateType(), "year": T.ShortType(), "month": T.ByteType(), "quarter": T.ByteType(), "forecast_horizon": T.ByteType(), "created_at": T.TimestampType()}
_STRING = (
    set("territory_id source_territory_code source_territory_name territory_name territory_level autonomous_community_id autonomous_community_name province_id coverage_quality month_id month_name season".split())
    | set("data_status data_version demand_snapshot_id demand_source_frequency pipeline_run_id source_snapshot_id supply_snapshot_id".split())
    | set("target_month_id evaluation_split data_quality_flag".split())
)
_REQUIRED = set(
    "territory_id territory_name territory_level month_id date_month year month quarter season data_status is_provisional demand_snapshot_id supply_snapshot_id".split()
    + "target_month_id target_date_month forecast_horizon evaluation_split data_quality_flag".split() + TRACES
)
_ALLOWED = {
    "territory_level": ("province",), "season": ("winter", "spring", "summer", "autumn"), "coverage_quality": ("high", "medium", "low", "insufficient"), "quarter": (1, 2, 3, 4),
    "data_status": ("provisional", "final_or_not_marked_provisional", "unknown"), "demand_source_frequency": ("monthly",), "forecast_horizon": (1,),
    "data_quality_flag": ("ok", "missing_target", "missing_lag", "insufficient_history", "provisional_target", "outlier_review"),
}
_LOW = _COUNTS | _SHARES | set(PERCENTAGES) | set(MODEL_COUNTS) | set(MODEL_PERCENT) | set(MODEL_SHARES) | {"establishments_estimated", "places_estimated", "staff_employed", "average_stay"}
_HIGH = {x: 1.0 for x in (*_SHARES, *MODEL_SHARES)} | {x: 100.0 for x in (*PERCENTAGES, *MODEL_PERCENT)} | {"month": 12.0}


def _type(name: str) -> T.DataType:
    if name in CONTEXT:
        return T.DoubleType() if CONTEXT[name] == "double" else T.StringType()
    return _OTHER.get(name) or (T.LongType() if name in _COUNTS else T.BooleanType() if name in _BOOLEAN else T.StringType() if name in _STRING else T.DoubleType())


def _field(name: str) -> Field:
    return Field(name, _type(name), name not in _REQUIRED, _ALLOWED.get(name, ()), 1.0 if name == "month" else 0.0 if name in _LOW else None, _HIGH.get(name))


GOLD = [_field(n) for n in COLUMNS]
MODEL = [_field(n) for n in features.COLUMNS]
