"""A monthly panel over the order tables, shaped like the long statistics tables.

Territory: nation of the customer (demand) or supplier (supply). Month: of the order or
shipment. Travellers: orders; overnight stays: quantities of the orders' lines; residence:
by market segment. ``CTES`` are the same definitions in SQL.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.config import Fold, PanelConfig
from tidepanel.functions import expr as X
from tidepanel.operators import dims, features, gold

CONFIG = PanelConfig(
    folds=(
        Fold("validation_1", date(1996, 9, 1), date(1997, 8, 1)),
        Fold("validation_2", date(1997, 9, 1), date(1998, 8, 1)),
        Fold("validation_3", date(1998, 9, 1), date(1999, 8, 1)),
        Fold("test", date(1999, 9, 1), date(2000, 8, 1)),
        Fold("provisional_monitoring", date(2000, 9, 1), date(2001, 8, 1)),
    ),
    provisional_start=date(2000, 9, 1),
    shock=(date(1998, 1, 1), date(1998, 12, 1)),
    numeric_features=tuple("covid_period is_christmas_period is_summer quarter year".split() + features.HISTORY),
    categorical_features=("territory_id", "month"),
    boolean_features=tuple("covid_period is_christmas_period is_summer".split()),
)
SPLITS = [f.name for f in CONFIG.folds[:4]]
DOMESTIC = ["BUILDING", "HOUSEHOLD", "FURNITURE"]
CREATED = "2024-01-01T00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def territory_id(key) -> Column:
    return F.concat(F.lit("T-"), F.lpad(X.c(key).cast("string"), 2, "0"))


def month(ts) -> Column:
    return F.trunc(X.c(ts).cast("date"), "MM")


def orders_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(territory_id, month, residence, travellers, stays).

    Lines are summed by order first: that shuffle is reused by the join on the order key.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    residence = F.when(F.col("c_mktsegment").isin(*DOMESTIC), "domestic").otherwise("foreign")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(territory_id("c_nationkey").alias("territory_id"), month("o_orderdate").alias("month"), residence.alias("residence")).agg(
        F.count("*").alias("travellers"), F.sum("qty").alias("overnight_stays")
    )


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long demand: one row a metric and residence."""
    cells = orders_by_cell(spark, sf_dir)
    stack = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("travellers", "overnight_stays"))))
    return cells.select("territory_id", "month", "residence", stack.alias("s")).select(
        "territory_id", "s.metric", "residence", X.month_id("month").alias("month_id"), "month", "s.value",
        (F.col("month") >= F.lit(CONFIG.provisional_start)).alias("is_provisional"),
    )


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long supply: six metrics by supplier nation and month of shipment."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    n = F.count("*")
    cells = lines.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(territory_id("s_nationkey").alias("territory_id"), month("l_shipdate").alias("month")).agg(
        F.count_distinct("l_suppkey").cast("double").alias("establishments_estimated"),
        F.sum("l_quantity").alias("places_estimated"),
        (exact("l_discount") / n * 1000).alias("occupancy_rate_pct"),
        (exact("l_tax") / n * 1000).alias("weekend_occupancy_rate_pct"),
        (exact("l_discount") / n * 900).alias("room_occupancy_rate_pct"),
        n.cast("double").alias("staff_employed"),
    )
    stack = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in gold.SUPPLY)))
    return cells.select("territory_id", "month", stack.alias("s")).select("territory_id", "s.metric", X.month_id("month").alias("month_id"), "month", "s.value")


def territory(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    code = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        territory_id("n_nationkey").alias("territory_id"), code.alias("source_territory_code"), F.col("n_name").alias("source_territory_name"),
        F.col("n_name").alias("territory_name"), F.lit("province").alias("territory_level"),
        F.concat(F.lit("R-"), F.col("r_regionkey").cast("string")).alias("autonomous_community_id"), F.col("r_name").alias("autonomous_community_name"),
        territory_id("n_nationkey").alias("province_id"), F.lit("high").alias("coverage_quality"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = table(spark, sf_dir, "orders").select("o_orderdate")
    return dims.calendar_dimension(dates, F.min(month("o_orderdate")), F.max(month("o_orderdate")), tuple(map(str, CONFIG.shock)), str(CONFIG.provisional_start), CREATED).drop("generated_at_utc")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.derived(demand(spark, sf_dir), supply(spark, sf_dir), territory(spark, sf_dir), calendar(spark, sf_dir))


def gold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.build(
        demand(spark, sf_dir), supply(spark, sf_dir), territory(spark, sf_dir), calendar(spark, sf_dir),
        demand_snapshot="demand-1", supply_snapshot="supply-1", run_id="run-1", version="1.0.0", created_at=CREATED,
    )


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.build(gold_table(spark, sf_dir), CONFIG.folds, run_id="run-1", version="1.0.0", created_at=CREATED)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired predictions of two formulas, so that every evaluation is plain SQL.

    Baseline: lag 12; candidate: the mean of lag 12 and the rolling mean of twelve months.
    """
    from tidepanel.operators import evaluate

    df = model_table(spark, sf_dir).where(F.col("evaluation_split").isin(*SPLITS) & evaluate.evaluable())
    raw = (F.col("lag_12_overnight_stays") + F.coalesce("rolling_mean_12m_overnight_stays", "lag_12_overnight_stays")) / 2
    return df.select(
        *"evaluation_split month target_date_month target_month_id territory_id territory_name".split(), F.lit("blend").alias("model"),
        F.col("target_overnight_stays_total").alias("actual"), F.col("lag_12_overnight_stays").alias("baseline_prediction"),
        raw.alias("model_prediction_raw"), X.clip(raw, low=0).alias("model_prediction"),
    )


def _case_split() -> str:
    folds = " ".join(f"when date_month between date '{f.start}' and date '{f.end}' then '{f.name}'" for f in reversed(CONFIG.folds))
    return f"case {folds} else 'train' end"


_T = lambda k: f"'T-' || lpad(cast({k} as varchar), 2, '0')"
_DIV = lambda n, d: f"case when {d} > 0 then cast({n} as double) / {d} end"
_PCT = lambda n, p: f"case when {p} > 0 then cast({n} - {p} as double) / {p} * cast(100 as double) end"


def _rank(v: str) -> str:
    return (
        f"case when {v} is not null then (rank() over (partition by month_id order by {v} asc nulls last) + (count({v}) over (partition by month_id, {v}) - 1) / cast(2 as double))"
        f" / count({v}) over (partition by month_id) * 100 end"
    )


_WEIGHTS = list(CONFIG.pressure_weights)
_W = [f"cast({w} as double)" for w in _WEIGHTS]
_SUPPLY = ", ".join(f"max(case when metric = '{m}' then value end) as {m}" for m in gold.SUPPLY)
_LAG = lambda v, k: f"first_value(cast({v} as double)) over (partition by territory_id order by month_index range between {k} preceding and {k} preceding)"


def _mean(k: int) -> str:
    w = f"over (partition by territory_id order by month_index range between {k} preceding and 1 preceding)"
    return f"case when count(overnight_stays_total) {w} = {k} then avg(cast(overnight_stays_total as double)) {w} end"


#: name -> (needed CTEs, body)
_PARTS: dict[str, tuple[list[str], str]] = {
    "cells": ([], f"""select {_T('c_nationkey')} as territory_id, cast(date_trunc('month', o_orderdate) as date) as month,
        case when c_mktsegment in ('BUILDING', 'HOUSEHOLD', 'FURNITURE') then 'domestic' else 'foreign' end as residence, count(*) as travellers, sum(qty) as overnight_stays
        from orders join customer on o_custkey = c_custkey left join (select l_orderkey, sum(l_quantity) as qty from lineitem group by l_orderkey) on l_orderkey = o_orderkey group by all"""),
    "demand": (["cells"], f"""select territory_id, metric, residence, strftime(month, '%Y-%m') as month_id, month, value, month >= date '{CONFIG.provisional_start}' as is_provisional from (
        select territory_id, month, residence, 'travellers' as metric, cast(travellers as double) as value from cells
        union all select territory_id, month, residence, 'overnight_stays', cast(overnight_stays as double) from cells)"""),
    "supply_cells": ([], f"""select {_T('s_nationkey')} as territory_id, cast(date_trunc('month', l_shipdate) as date) as month,
        cast(count(distinct l_suppkey) as double) as establishments_estimated, sum(l_quantity) as places_estimated,
        cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*) * 1000 as occupancy_rate_pct,
        cast(sum(cast(l_tax as decimal(18,2))) as double) / count(*) * 1000 as weekend_occupancy_rate_pct,
        cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*) * 900 as room_occupancy_rate_pct, cast(count(*) as double) as staff_employed
        from lineitem join supplier on l_suppkey = s_suppkey group by all"""),
    "supply": (["supply_cells"], " union all ".join(f"select territory_id, '{m}' as metric, strftime(month, '%Y-%m') as month_id, month, {m} as value from supply_cells" for m in gold.SUPPLY)),
    "territory": ([], f"""select {_T('n_nationkey')} as territory_id, lpad(cast(n_nationkey as varchar), 2, '0') as source_territory_code, n_name as source_territory_name, n_name as territory_name,
        'province' as territory_level, 'R-' || r_regionkey as autonomous_community_id, r_name as autonomous_community_name, {_T('n_nationkey')} as province_id, 'high' as coverage_quality
        from nation join region on n_regionkey = r_regionkey"""),
    "calendar": ([], f"""select strftime(d, '%Y-%m') as month_id, d as date_month, cast(year(d) as smallint) as year, cast(month(d) as tinyint) as month,
        lower(monthname(d)) as month_name, cast(quarter(d) as tinyint) as quarter,
        case when month(d) in (12, 1, 2) then 'winter' when month(d) between 3 and 5 then 'spring' when month(d) between 6 and 8 then 'summer' else 'autumn' end as season,
        month(d) between 6 and 9 as is_summer, month(d) in (12, 1) as is_christmas_period, cast(null as boolean) as is_easter_period,
        d between date '{CONFIG.shock[0]}' and date '{CONFIG.shock[1]}' as covid_period, d < date '{CONFIG.provisional_start}' as complete_month_available
        from (select cast(unnest(generate_series(a, b, interval 1 month)) as date) as d from (select date_trunc('month', min(o_orderdate)) as a, date_trunc('month', max(o_orderdate)) as b from orders))"""),
    "demand_wide": (["demand"], """select *, travellers_domestic + travellers_foreign as travellers_total, overnight_stays_domestic + overnight_stays_foreign as overnight_stays_total,
        case when travellers_domestic + travellers_foreign > 0 then cast(overnight_stays_domestic + overnight_stays_foreign as double) / (travellers_domestic + travellers_foreign) end as average_stay from (
        select territory_id, month_id, """ + ", ".join(f"max(case when metric = '{m}' and residence = '{r}' then cast(value as bigint) end) as {m}_{r}" for m, r in gold.DEMAND) + """,
        bool_or(is_provisional) as is_provisional from demand group by territory_id, month_id)"""),
    "supply_wide": (["supply"], f"select territory_id, month_id, {_SUPPLY} from supply group by territory_id, month_id"),
    "grid": (["territory", "calendar"], "select * from territory cross join calendar"),
    "joined": (["grid", "demand_wide", "supply_wide"], "select * from grid left join demand_wide using (territory_id, month_id) left join supply_wide using (territory_id, month_id)"),
    "ratios": (["joined"], f"""select *, {_DIV('travellers_domestic', 'travellers_total')} as domestic_travellers_share, {_DIV('travellers_foreign', 'travellers_total')} as foreign_travellers_share,
        {_DIV('overnight_stays_domestic', 'overnight_stays_total')} as domestic_overnight_stays_share, {_DIV('overnight_stays_foreign', 'overnight_stays_total')} as foreign_overnight_stays_share,
        {_DIV('overnight_stays_total', 'places_estimated')} as overnight_stays_per_place, {_DIV('travellers_total', 'establishments_estimated')} as travellers_per_establishment,
        {_DIV('(weekend_occupancy_rate_pct - occupancy_rate_pct)', 'occupancy_rate_pct')} * 100 as weekend_dependence_index from joined"""),
    "changes": (["ratios"], f"""select * exclude (p1, p12), {_PCT('overnight_stays_total', 'p1')} as overnight_stays_mom_change_pct, {_PCT('overnight_stays_total', 'p12')} as overnight_stays_yoy_change_pct from (
        select *, lag(overnight_stays_total, 1) over w as p1, lag(overnight_stays_total, 12) over w as p12 from ratios window w as (partition by territory_id order by date_month))"""),
    "profile": (["joined"], f"""select territory_id, month, {_DIV('m', 'max(m) over (partition by territory_id)')} * 100 as seasonality_index from (
        select territory_id, month, avg(overnight_stays_total) as m from joined where not coalesce(covid_period, false) and not coalesce(is_provisional, false) group by territory_id, month)"""),
    "facts": (["changes", "profile"], f"""select * exclude (a, b, c, d), case when a is not null and b is not null and c is not null and d is not null then
        greatest(0.0, least(100.0, round_even((a * {_W[0]} + b * {_W[1]} + c * {_W[2]} + d * {_W[3]}) / ({' + '.join(_W)}) * 100, 0) / 100)) end as tourism_pressure_index from (
        select *, case when occupancy_rate_pct is not null then greatest(0.0, least(100.0, occupancy_rate_pct)) end as a, {_rank('overnight_stays_per_place')} as b,
        {_rank('overnight_stays_yoy_change_pct')} as c, case when weekend_occupancy_rate_pct is not null then greatest(0.0, least(100.0, weekend_occupancy_rate_pct)) end as d
        from changes left join profile using (territory_id, month))"""),
    "gold": (["facts"], """select * exclude (is_provisional), coalesce(is_provisional, false) as is_provisional,
        case when is_provisional then 'provisional' when not is_provisional then 'final_or_not_marked_provisional' else 'unknown' end as data_status
        from facts where travellers_total is not null or overnight_stays_total is not null"""),
    "model": (["gold"], f"""select *, {_case_split()} as evaluation_split,
        case when overnight_stays_total is null then 'missing_target' when is_provisional then 'provisional_target'
        when date_month < min(date_month) over (partition by territory_id) + interval 12 month then 'insufficient_history'
        when lag_1_overnight_stays is null or lag_3_overnight_stays is null or lag_12_overnight_stays is null or rolling_mean_3m_overnight_stays is null or rolling_mean_12m_overnight_stays is null then 'missing_lag'
        else 'ok' end as data_quality_flag from (
        select *, case when _lag_13 <> 0 then (lag_1_overnight_stays - _lag_13) / _lag_13 * 100 end as yoy_change_overnight_stays from (
        select *, """ + ", ".join(f"{_LAG(c, k)} as {n}" for c, k, n in features.LAGS) + f""", {_mean(3)} as rolling_mean_3m_overnight_stays, {_mean(12)} as rolling_mean_12m_overnight_stays,
        {_LAG('overnight_stays_total', 13)} as _lag_13 from (select *, year(date_month) * 12 + month(date_month) as month_index from gold)))"""),
    "forecast": (["model"], f"""select *, prediction - actual as error, abs(prediction - actual) as absolute_error, (prediction - actual) * (prediction - actual) as squared_error from (
        select territory_id, territory_name, month_id, date_month, month, season, evaluation_split, cast(overnight_stays_total as double) as actual, lag_12_overnight_stays as prediction
        from model where evaluation_split in ({', '.join(f"'{s}'" for s in SPLITS)}) and overnight_stays_total is not null and lag_12_overnight_stays is not null and not is_provisional)"""),
    "predictions": (["model"], f"""select *, greatest(0.0, model_prediction_raw) as model_prediction from (
        select territory_id, territory_name, month_id as target_month_id, date_month as target_date_month, month, evaluation_split, 'blend' as model, cast(overnight_stays_total as double) as actual,
        lag_12_overnight_stays as baseline_prediction, (lag_12_overnight_stays + coalesce(rolling_mean_12m_overnight_stays, lag_12_overnight_stays)) / 2 as model_prediction_raw
        from model where evaluation_split in ({', '.join(f"'{s}'" for s in SPLITS)}) and overnight_stays_total is not null and lag_12_overnight_stays is not null and not is_provisional)"""),
}


def sql(body: str, *needed: str) -> str:
    """``body`` behind the CTEs that it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _PARTS[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needed:
        add(n)
    ctes = ",\n".join(f"{n} as ({_PARTS[n][1]})" for n in order)
    return (f"with {ctes}\n" if order else "") + body


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
