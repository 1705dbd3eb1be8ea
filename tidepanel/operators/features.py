"""Leakage-free modelling table: one window sort for all lags and rolling means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.config import Fold
from tidepanel.functions import expr as X
from tidepanel.operators import panel

#: measure -> lags in months
LAG_MONTHS = {
    "overnight_stays_total": (1, 3, 12), "occupancy_rate_pct": (1, 12), "weekend_occupancy_rate_pct": (1,), "average_stay": (1, 12),
    **{f"{origin}_overnight_stays_share": (1,) for origin in ("domestic", "foreign")}, **{x: (1,) for x in ("places_estimated", "establishments_estimated", "staff_employed")},
}
LAGS = [(x, k, f"lag_{k}_{x.removesuffix('_total')}") for x, months in LAG_MONTHS.items() for k in months]
CORE = [n for _, _, n in LAGS[:3]] + [f"rolling_mean_{k}m_overnight_stays" for k in (3, 12)]
HISTORY = [*CORE, "yoy_change_overnight_stays", *(n for _, _, n in LAGS[3:])]
COLUMNS = (
    "territory_id territory_name territory_level target_month_id target_date_month forecast_horizon target_overnight_stays_total "
    "target_occupancy_rate_pct year month quarter is_summer is_christmas_period covid_period"
).split() + HISTORY + "evaluation_split data_quality_flag is_provisional source_snapshot_id pipeline_run_id data_version created_at".split()


def with_history(gold: DataFrame) -> DataFrame:
    """Calendar lags, complete-window means and the change between lags 1 and 13."""
    v = F.col("overnight_stays_total").cast("double")
    df = gold.withColumn("month_index", X.month_index("date_month"))
    df = df.withColumns(
        {n: panel.calendar_lag(F.col(c).cast("double"), k) for c, k, n in LAGS}
        | {f"rolling_mean_{k}m_overnight_stays": panel.calendar_mean(v, k) for k in (3, 12)}
        | {"_lag_13": panel.calendar_lag(v, 13)}
    )
    return df.withColumn("yoy_change_overnight_stays", X.pct_change_nonzero("lag_1_overnight_stays", "_lag_13")).drop("_lag_13", "month_index")


def evaluation_split(date, folds: tuple[Fold, ...]):
    """Later folds overwrite earlier ones, so the CASE lists them last to first."""
    out = F.when(F.lit(False), "")
    for f in reversed(folds):
        out = out.when(X.c(date).between(F.lit(f.start), F.lit(f.end)), f.name)
    return out.otherwise("train")


def quality_flag(date, months: int = 12):
    """missing_target; else provisional_target, insufficient_history, missing_lag or ok.

    History is insufficient before the territory's first observation plus ``months``; only
    after that a missing core lag is a gap.
    """
    first = F.min(X.c(date)).over(W.partitionBy("territory_id"))
    return (
        F.when(F.col("overnight_stays_total").isNull(), "missing_target")
        .when(F.coalesce("is_provisional", F.lit(False)), "provisional_target")
        .when(X.c(date) < F.add_months(first, months), "insufficient_history")
        .when(~X.all_present(*CORE), "missing_lag")
        .otherwise("ok")
    )


def build(gold: DataFrame, folds: tuple[Fold, ...], *, run_id: str, version: str, created_at: str) -> DataFrame:
    """The 37 columns of the modelling table."""
    df = with_history(gold)
    df = df.withColumns({"evaluation_split": evaluation_split("date_month", folds), "data_quality_flag": quality_flag("date_month")})
    df = df.withColumns({
        "target_month_id": F.col("month_id"), "target_date_month": F.col("date_month"), "forecast_horizon": F.lit(1).cast("tinyint"),
        "target_overnight_stays_total": F.col("overnight_stays_total").cast("double"), "target_occupancy_rate_pct": F.col("occupancy_rate_pct"),
        "pipeline_run_id": F.lit(run_id), "data_version": F.lit(version), "created_at": F.lit(created_at).cast("timestamp"),
    })
    return df.select(*COLUMNS)
