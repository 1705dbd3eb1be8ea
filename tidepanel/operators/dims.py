"""Territory and calendar dimensions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.operators.panel import month_series


def availability(long: DataFrame, months: int | Column) -> DataFrame:
    """Months with a value, their span, their share and its class, by territory."""
    has = F.col("value").isNotNull()
    by = long.groupBy("territory_id").agg(
        F.count_distinct(F.when(has, F.col("month_id"))).alias("available_months"),
        F.min(F.when(has, F.col("month_id"))).alias("first_available_month"),
        F.max(F.when(has, F.col("month_id"))).alias("last_available_month"),
    )
    total = F.lit(months) if isinstance(months, int) else months
    ratio = F.col("available_months") / total
    return by.withColumn("coverage_ratio", ratio).withColumn("coverage_quality", X.coverage_class("coverage_ratio"))


def territory_dimension(territories: DataFrame, long: DataFrame, months: int, generated_at: str) -> DataFrame:
    """``territories``: territory_id, territory_name, source code and name, community id and name."""
    several = territories.groupBy("territory_id").agg(F.count_distinct("territory_name").alias("n")).where("n > 1").count()
    if several:
        raise ValueError(f"{several} territories have two descriptions")
    return (
        territories.distinct()
        .join(availability(long, months).drop("available_months", "coverage_ratio"), "territory_id", "left")
        .select(
            "territory_id", "territory_name", F.lit("province").alias("territory_level"), *"source_territory_code source_territory_name".split(),
            *"autonomous_community_id autonomous_community_name".split(), F.col("territory_id").alias("province_id"),
            F.col("first_available_month").isNotNull().alias("is_rural_tourism_available"),
            "first_available_month", "last_available_month", F.coalesce("coverage_quality", F.lit("insufficient")).alias("coverage_quality"),
            F.lit(generated_at).alias("generated_at_utc"),
        )
    )


def complete_before(file_names: DataFrame, column: str) -> date | None:
    """First day of the month in which the newest snapshot was taken: that month is not complete yet."""
    return file_names.agg(F.trunc(F.max(X.snapshot_time(column)), "MM")).first()[0]


def calendar_dimension(dates: DataFrame, first: Column, last: Column, shock: tuple[str, str], complete_before: str, generated_at: str) -> DataFrame:
    """A row for each month from first to last, aggregates over ``dates``."""
    m = F.col("month")
    flags = dates.agg(first.alias("a"), last.alias("b")).select(F.explode(month_series(F.col("a"), F.col("b"))).alias("date_month"))
    return flags.withColumn("month", F.month("date_month").cast("tinyint")).select(
        X.month_id("date_month").alias("month_id"),
        "date_month",
        F.year("date_month").cast("smallint").alias("year"),
        "month",
        X.month_name("month").alias("month_name"),
        F.quarter("date_month").cast("tinyint").alias("quarter"),
        X.season("month").alias("season"),
        m.between(6, 9).alias("is_summer"),
        m.isin(12, 1).alias("is_christmas_period"),
        F.lit(None).cast("boolean").alias("is_easter_period"),
        F.col("date_month").between(F.lit(shock[0]).cast("date"), F.lit(shock[1]).cast("date")).alias("covid_period"),
        (F.col("date_month") < F.lit(complete_before).cast("date")).alias("complete_month_available"),
        F.lit(generated_at).alias("generated_at_utc"),
    )
