"""Exploratory aggregates of the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import expr as X

def total(x: str):
    """Sum that is 0, not NULL, without values."""
    return F.coalesce(F.sum(x), F.lit(0))


def national_monthly(gold: DataFrame) -> DataFrame:
    """Sums over territories; a month without any value is 0, not NULL."""
    return gold.groupBy("date_month").agg(*(total(x).alias(x) for x in ("travellers_total", "overnight_stays_total")))


def annual_summary(gold: DataFrame) -> DataFrame:
    """Years with all twelve months."""
    out = gold.groupBy("year").agg(
        total("overnight_stays_total").alias("overnight_stays_total"),
        F.count_distinct("month_id").alias("months"),
        F.bool_or("is_provisional").alias("any_provisional"),
    )
    return out.where("months = 12")


def shock_comparison(gold: DataFrame, shock: tuple[str, str]) -> DataFrame:
    d = F.col("date_month")
    period = F.when(d < F.lit(shock[0]).cast("date"), "before").when(d <= F.lit(shock[1]).cast("date"), "shock").otherwise("after")
    monthly = national_monthly(gold).withColumn("period", period)
    return monthly.groupBy("period").agg(F.count("*").alias("months"), F.avg("overnight_stays_total").alias("mean_overnight_stays"))


def seasonal_profile(gold: DataFrame, territory: str | None = None) -> DataFrame:
    usable = ~F.coalesce("covid_period", F.lit(False)) & ~F.coalesce("is_provisional", F.lit(False))
    df = gold.where(usable)
    if territory is not None:
        df = df.where(F.col("territory_id") == territory)
    return df.groupBy("month").agg(F.avg("overnight_stays_total").alias("mean_overnight_stays"), F.count("*").alias("rows"))


def ranking(gold: DataFrame, year: int, top: int) -> DataFrame:
    out = gold.where(F.col("year") == year).groupBy("territory_id", "territory_name").agg(
        F.sum("overnight_stays_total").alias("overnight_stays_total"), F.avg("occupancy_rate_pct").alias("mean_occupancy_rate_pct")
    )
    return out.orderBy(F.desc_nulls_last("overnight_stays_total"), "territory_id").limit(top)


def foreign_share(gold: DataFrame, keys: list[str]) -> DataFrame:
    """Share of sums, not mean of shares."""
    d, f = total("overnight_stays_domestic"), total("overnight_stays_foreign")
    return gold.groupBy(*keys).agg(d.alias("domestic"), f.alias("foreign"), X.safe_divide(f, d + f).alias("foreign_share"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles (linear), max of each column."""
    one = []
    for x in columns:
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        one.append(F.struct(
            F.lit(x).alias("measure"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).cast("double").alias("min"),
            q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(x).cast("double").alias("max"),
        ).alias(x))
    return df.agg(*one).select(F.explode(F.array(*columns)).alias("r")).select("r.*")


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation over complete pairs."""
    return df.dropna(subset=[a, b]).agg(F.count("*").alias("pairs"), F.corr(a, b).alias("correlation"))


def peak_month(gold: DataFrame) -> DataFrame:
    """Month of the highest national total; the earliest on ties."""
    m = national_monthly(gold)
    best = F.max(F.struct(F.col("overnight_stays_total"), (-F.unix_date("date_month")).alias("k"), F.col("date_month")))
    return m.agg(best.alias("b")).select("b.date_month", "b.overnight_stays_total")


def split_quality_counts(model: DataFrame) -> DataFrame:
    return model.groupBy("evaluation_split", "data_quality_flag").agg(F.count("*").alias("rows"))


def best_and_worst(paired: DataFrame, n: int) -> DataFrame:
    """The n highest and n lowest improvements."""
    key = "mae_improvement_pct"
    best = paired.orderBy(F.desc_nulls_last(key), "territory_id").limit(n).withColumn("side", F.lit("best"))
    worst = paired.orderBy(F.asc_nulls_last(key), "territory_id").limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst).select("side", "territory_id", key)


def latest_snapshot(gold: DataFrame, top: int) -> DataFrame:
    """The latest month that has a year-on-year change, ranked by it."""
    y = "overnight_stays_yoy_change_pct"
    last = gold.where(F.col(y).isNotNull()).agg(F.max("date_month").alias("date_month"))
    df = gold.join(F.broadcast(last), "date_month").where(F.col(y).isNotNull())
    return df.orderBy(F.desc(y), "territory_id").limit(top).select("territory_id", "month_id", y)


def last_months(gold: DataFrame, n: int) -> DataFrame:
    return national_monthly(gold).orderBy(F.desc("date_month")).limit(n)


def table_summary(df: DataFrame, territory: str, month: str, measures: list[str]) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"), F.count_distinct(territory).alias("territories"), F.min(month).alias("first_month"), F.max(month).alias("last_month"),
        *(F.count_if(F.col(m).isNull()).alias(f"null_{m}") for m in measures),
    )
