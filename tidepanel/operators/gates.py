"""Gates: checks whose failure stops a build before its table replaces the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.operators import panel, quality
from tidepanel.operators.quality import Check, not_null, rows_where


class GateError(ValueError):
    """A table that must not be written."""


def enforce(results: DataFrame, name: str) -> None:
    """Raise with every failed check of the results, which are a row a check."""
    failed = results.where("status = 'FAIL'").collect()
    if failed:
        raise GateError(f"{name}: " + ", ".join(f"{r.check} ({r.violations})" for r in failed))


def not_empty() -> Check:
    return Check("not_empty", F.when(F.count("*") > 0, 0).otherwise(1))


def processed(long: DataFrame, keys: list[str], territories: int) -> DataFrame:
    """Of a long table: its key, the number of territories, no negatives, percentages."""
    checks = [
        not_empty(),
        Check("territory_count", F.abs(F.count_distinct("territory_id") - territories)),
        rows_where("non_negative:value", F.col("value") < 0),
        rows_where("range:percent", F.col("metric").endswith("_pct") & ~F.col("value").between(0, 100)),
    ]
    return quality.run(long, checks).unionByName(quality.unique_key(long, keys))


def territories(dimension: DataFrame, expected: int, level: str = "province") -> DataFrame:
    checks = [Check("territory_count", F.abs(F.count("*") - expected)), *not_null("territory_id", "territory_name", "territory_level"), rows_where("territory_level", F.col("territory_level") != level)]
    return quality.run(dimension, checks).unionByName(quality.unique_key(dimension, ["territory_id"]))


def calendar(dimension: DataFrame) -> DataFrame:
    """No gap between months, in order, each at its first day, each once."""
    c = panel.continuity(dimension)
    rows = [("not_empty", F.when(F.col("months") > 0, 0).otherwise(1)), ("continuity", F.col("breaks")), ("month_start", F.col("not_month_start"))]
    listed = F.array(*(F.struct(F.lit(n).alias("check"), v.cast("bigint").alias("violations")) for n, v in rows))
    found = c.select(F.explode(listed).alias("r")).select("r.check", F.when(F.col("r.violations") == 0, "PASS").otherwise("FAIL").alias("status"), F.lit("fail").alias("severity"), "r.violations")
    return found.unionByName(quality.unique_key(dimension, ["month_id"]))


def grid_keys(territory: DataFrame, months: DataFrame) -> DataFrame:
    """The cross join's two keys."""
    return quality.unique_key(territory, ["territory_id"], "unique_territory").unionByName(quality.unique_key(months, ["month_id"], "unique_month"))


def joined_keys(demand: DataFrame, supply: DataFrame) -> DataFrame:
    """One value for each cell of the pivots, so that the joins to the grid are one to one."""
    d = quality.unique_key(demand, ["territory_id", "month_id", "metric", "residence"], "unique_demand")
    return d.unionByName(quality.unique_key(supply, ["territory_id", "month_id", "metric"], "unique_supply"))


def facts(gold: DataFrame) -> DataFrame:
    """Of a fact table about to be written."""
    return quality.run(gold, [not_empty(), *quality.gold_checks()]).unionByName(quality.unique_key(gold, ["territory_id", "month_id"]))


def modelling(model: DataFrame, folds, provisional: str) -> DataFrame:
    """Of a modelling table about to be written."""
    later = rows_where("target_known_if_ok", (F.col("data_quality_flag") == "ok") & F.col("target_overnight_stays_total").isNull())
    history = rows_where("history_known_if_ok", (F.col("data_quality_flag") == "ok") & ~X.all_present("lag_1_overnight_stays", "lag_12_overnight_stays"))
    checks = [not_empty(), later, history, *quality.model_checks(folds, provisional)]
    return quality.run(model, checks).unionByName(quality.unique_key(model, ["territory_id", "target_month_id", "forecast_horizon"]))
