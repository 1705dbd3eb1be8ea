"""Panel operators: dense grid, exact calendar lags, complete-window means, percentile ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions import expr as X


def require_columns(df: DataFrame, expected: list[str], name: str = "input") -> DataFrame:
    missing = [x for x in expected if x not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows beyond the first of their key."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def require_unique(df: DataFrame, keys: list[str], name: str = "input") -> DataFrame:
    n = duplicate_keys(df, keys).first()[0]
    if n:
        raise ValueError(f"{name}: {n} rows repeat a key {keys}")
    return df


def require_single(df: DataFrame, column: str, name: str = "input") -> str:
    """The one value of ``column``; raises where there is none or more than one."""
    n, value = single_value(df, column).first()
    if n != 1:
        raise ValueError(f"{name}: {n} distinct values of {column}, not one")
    return value


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def month_series(first: Column, last: Column) -> Column:
    return F.sequence(first, last, F.expr("interval 1 month"))


def base_grid(territories: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every territory by every month. The calendar's size is fixed by its date range.

    Both keys must be unique (``gates.grid_keys`` checks stored dimensions).
    """
    return territories.crossJoin(F.broadcast(calendar))


def _calendar(by: list[str], index: str, first: int, last: int):
    return W.partitionBy(*by).orderBy(index).rangeBetween(first, last)


def calendar_lag(value: Column | str, months: int, by: list[str] = ["territory_id"], index: str = "month_index") -> Column:
    """Value exactly ``months`` earlier, NULL where that month is missing. Keys are unique."""
    return F.first(X.c(value)).over(_calendar(by, index, -months, -months))


def calendar_mean(value: Column | str, months: int, by: list[str] = ["territory_id"], index: str = "month_index") -> Column:
    """Mean of the ``months`` months before this one, NULL unless all of them have a value."""
    w = _calendar(by, index, -months, -1)
    return F.when(F.count(X.c(value)).over(w) == months, F.avg(X.c(value)).over(w))


def calendar_lag_join(targets: DataFrame, source: DataFrame, value: str, months: int, out: str, date: str = "target_date_month") -> DataFrame:
    """The lag as a join, for targets that the source doesn't hold."""
    s = source.select("territory_id", F.add_months("date_month", months).alias(date), F.col(value).alias(out))
    return targets.join(s, ["territory_id", date], "left")


def calendar_mean_join(targets: DataFrame, source: DataFrame, value: str, months: int, out: str, date: str = "target_date_month") -> DataFrame:
    """The complete-window mean as one range join on the months ahead of each source row."""
    ahead = F.explode(F.sequence(F.lit(1), F.lit(months)))
    s = source.select("territory_id", F.col(value).alias("_v"), "date_month", ahead.alias("_k"))
    s = s.groupBy("territory_id", F.expr("cast(add_months(date_month, _k) as date)").alias(date))
    s = s.agg(F.when(F.count("_v") == months, F.avg("_v")).alias(out))
    return targets.join(s, ["territory_id", date], "left")


def row_lag(value: Column | str, rows: int, by: str = "territory_id", order: str = "date_month") -> Column:
    """Positional lag: equals the calendar lag on the dense grid only."""
    return F.lag(X.c(value), rows).over(W.partitionBy(by).orderBy(order))


def percentile_rank_average(value: Column | str, by: list[str]) -> Column:
    """Average-tie percentile rank, 0-100; NULLs neither rank nor count."""
    v = X.c(value)
    w = W.partitionBy(*by).orderBy(v.asc_nulls_last())
    last = F.count(v).over(w.rangeBetween(W.unboundedPreceding, W.currentRow))  # counts the row's ties too: one sort serves both
    return F.when(v.isNotNull(), (F.rank().over(w) + last) / 2 / F.count(v).over(W.partitionBy(*by)) * 100)


def continuity(calendar: DataFrame, date: str = "date_month") -> DataFrame:
    """One row: months, gaps between neighbours and days that start no month."""
    step = X.month_index(date) - F.lag(X.month_index(date)).over(W.orderBy(date))
    return calendar.select(date, step.alias("_s")).agg(
        F.count("*").alias("months"),
        F.count_if(F.col("_s") != 1).alias("breaks"),
        F.count_if(F.dayofmonth(date) != 1).alias("not_month_start"),
    )


def single_value(df: DataFrame, column: str) -> DataFrame:
    """One row: distinct values, and the value if there is exactly one."""
    n = F.count_distinct(column)
    return df.agg(n.alias("distinct_values"), F.when(n == 1, F.max(column)).alias("value"))
