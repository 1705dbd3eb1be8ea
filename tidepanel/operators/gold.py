"""Fact table: pivots, ratios, changes, seasonality and pressure over the dense grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.operators import panel

DEMAND = [("travellers", "domestic"), ("travellers", "foreign"), ("overnight_stays", "domestic"), ("overnight_stays", "foreign")]
SUPPLY = "establishments_estimated occupancy_rate_pct places_estimated room_occupancy_rate_pct staff_employed weekend_occupancy_rate_pct".split()
RATIOS = (
    "domestic_overnight_stays_share domestic_travellers_share foreign_overnight_stays_share foreign_travellers_share overnight_stays_per_place "
    "travellers_per_establishment weekend_dependence_index"
).split()
KEY = ["territory_id", "month_id"]
CONTEXT = {
    "price_index": "double", "price_yoy_change_pct": "double", "price_source_frequency": "string", "price_territory_level": "string",
    "resident_avg_spend_context": "double", "foreign_avg_spend_context": "double", "spend_context_frequency": "string",
    "spend_context_territory_level": "string", "business_context_frequency": "string", "business_context_territory_level": "string",
}
COLUMNS = (
    "territory_id source_territory_code source_territory_name territory_name territory_level autonomous_community_id autonomous_community_name "
    "province_id coverage_quality month_id date_month year month month_name quarter season is_summer is_christmas_period is_easter_period "
    "covid_period complete_month_available travellers_total travellers_domestic travellers_foreign overnight_stays_total overnight_stays_domestic "
    "overnight_stays_foreign average_stay establishments_estimated places_estimated occupancy_rate_pct weekend_occupancy_rate_pct "
    "room_occupancy_rate_pct staff_employed domestic_travellers_share foreign_travellers_share domestic_overnight_stays_share "
    "foreign_overnight_stays_share overnight_stays_per_place travellers_per_establishment weekend_dependence_index overnight_stays_mom_change_pct "
    "overnight_stays_yoy_change_pct seasonality_index tourism_pressure_index demand_source_frequency"
).split() + list(CONTEXT) + (
    "data_status is_provisional demand_snapshot_id supply_snapshot_id source_snapshot_id pipeline_run_id data_version created_at"
).split()


def demand_wide(long: DataFrame) -> DataFrame:
    """Conditional aggregation instead of a pivot, so that all four columns always exist."""
    pick = [
        F.first(F.when((F.col("metric") == m) & (F.col("residence") == r), X.integer_or_fail("value", f"{m}_{r}")), ignorenulls=True).alias(f"{m}_{r}")
        for m, r in DEMAND
    ]
    wide = long.groupBy(*KEY).agg(*pick, F.bool_or("is_provisional").alias("is_provisional"))
    for m in ("travellers", "overnight_stays"):
        wide = wide.withColumn(f"{m}_total", F.col(f"{m}_domestic") + F.col(f"{m}_foreign"))
    return wide.withColumn("average_stay", X.safe_divide("overnight_stays_total", "travellers_total"))


def supply_wide(long: DataFrame) -> DataFrame:
    """As ``demand_wide``; a pivot would aggregate and shuffle twice."""
    return long.groupBy(*KEY).agg(*(F.first(F.when(F.col("metric") == m, F.col("value")), ignorenulls=True).alias(m) for m in SUPPLY))


def with_ratios(df: DataFrame) -> DataFrame:
    d = X.safe_divide
    return df.withColumns({
        "domestic_travellers_share": d("travellers_domestic", "travellers_total"),
        "foreign_travellers_share": d("travellers_foreign", "travellers_total"),
        "domestic_overnight_stays_share": d("overnight_stays_domestic", "overnight_stays_total"),
        "foreign_overnight_stays_share": d("overnight_stays_foreign", "overnight_stays_total"),
        "overnight_stays_per_place": d("overnight_stays_total", "places_estimated"),
        "travellers_per_establishment": d("travellers_total", "establishments_estimated"),
        "weekend_dependence_index": d(F.col("weekend_occupancy_rate_pct") - F.col("occupancy_rate_pct"), "occupancy_rate_pct") * 100,
    })


def with_changes(df: DataFrame) -> DataFrame:
    """Month-on-month and year-on-year, by position: the grid must still be dense."""
    v = "overnight_stays_total"
    return df.withColumns({
        "overnight_stays_mom_change_pct": X.pct_change_positive(v, panel.row_lag(v, 1)),
        "overnight_stays_yoy_change_pct": X.pct_change_positive(v, panel.row_lag(v, 12)),
    })


def seasonal_profile(df: DataFrame) -> DataFrame:
    """(territory, month of year) mean without shock and provisional months, scaled to the peak."""
    usable = ~F.coalesce("covid_period", F.lit(False)) & ~F.coalesce("is_provisional", F.lit(False))
    mean = df.where(usable).groupBy("territory_id", "month").agg(F.avg("overnight_stays_total").alias("_mean"))
    peak = F.max("_mean").over(W.partitionBy("territory_id"))
    return mean.select("territory_id", "month", (X.safe_divide("_mean", peak) * 100).alias("seasonality_index"))


def with_seasonality(df: DataFrame) -> DataFrame:
    """``seasonal_profile`` on every row of its month of the year, as windows over the table itself."""
    usable = ~F.coalesce("covid_period", F.lit(False)) & ~F.coalesce("is_provisional", F.lit(False))
    mean = F.avg(F.when(usable, F.col("overnight_stays_total"))).over(W.partitionBy("territory_id", "month"))
    peak = F.max("_mean").over(W.partitionBy("territory_id"))
    return df.withColumn("_mean", mean).withColumn("seasonality_index", X.safe_divide("_mean", peak) * 100).drop("_mean")


def with_pressure(df: DataFrame, weights: tuple[float, ...] = (0.4, 0.3, 0.2, 0.1)) -> DataFrame:
    parts = [
        X.clip("occupancy_rate_pct", 0, 100),
        panel.percentile_rank_average("overnight_stays_per_place", ["month_id"]),
        panel.percentile_rank_average("overnight_stays_yoy_change_pct", ["month_id"]),
        X.clip("weekend_occupancy_rate_pct", 0, 100),
    ]
    names = [f"_p{i}" for i in range(4)]
    scored = df.withColumns(dict(zip(names, parts)))
    score = X.round2(X.weighted_available_score([(F.col(n), w) for n, w in zip(names, weights)]))
    return scored.withColumn("tourism_pressure_index", F.when(X.all_present(*names), X.clip(score, 0, 100))).drop(*names)


def derived(demand: DataFrame, supply: DataFrame, territory: DataFrame, calendar: DataFrame) -> DataFrame:
    """The dense grid with all measures; the order of the steps is part of the meaning."""
    grid = panel.base_grid(territory, calendar)
    joined = grid.join(demand_wide(demand), KEY, "left").join(supply_wide(supply), KEY, "left")
    return with_pressure(with_seasonality(with_changes(with_ratios(joined))))


def observed(df: DataFrame) -> DataFrame:
    """Rows with a demand measure: the last step, as changes need the dense grid."""
    return df.where(X.any_present("travellers_total", "overnight_stays_total"))


def build(demand: DataFrame, supply: DataFrame, territory: DataFrame, calendar: DataFrame, *, demand_snapshot: str, supply_snapshot: str, run_id: str, version: str, created_at: str) -> DataFrame:
    """The 64 columns of the fact table."""
    df = observed(derived(demand, supply, territory, calendar))
    df = df.withColumns({k: F.lit(None).cast(t) for k, t in CONTEXT.items()} | {
        "demand_source_frequency": F.lit("monthly"),
        "data_status": X.data_status("is_provisional"),
        "is_provisional": F.coalesce("is_provisional", F.lit(False)),
        "demand_snapshot_id": F.lit(demand_snapshot),
        "supply_snapshot_id": F.lit(supply_snapshot),
        "source_snapshot_id": X.fingerprint(F.lit(demand_snapshot), F.lit(supply_snapshot)),
        "pipeline_run_id": F.lit(run_id),
        "data_version": F.lit(version),
        "created_at": F.lit(created_at).cast("timestamp"),
    })
    return df.select(*COLUMNS)
