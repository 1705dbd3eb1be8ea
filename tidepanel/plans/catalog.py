"""All queries of the panel engine and their SQL equivalents, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.operators import dims, evaluate, explore, features, gold, ml, normalize, panel, quality
from tidepanel.plans import proxy as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SHOCK = tuple(map(str, P.CONFIG.shock))


def query(name: str, sql: str | None = None, *needed: str):
    """Register a query; ``sql`` is its body over the named CTEs of the proxy panel."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = P.sql(sql, *needed)
        return f

    return register


def cols(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


# == scalars and normalisation
RAW = ["9.220", "45,73", " 1.234,5 ", ".", "..", "", "-12", "abc", "0"]
TERRITORIES = ["38 Santa Cruz de Tenerife", "01 Araba", "no code", "7  x"]
PERIODS = ["2026M05", "2026M13", "1999M12", "2026-05", ""]


def values(spark: SparkSession, items: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in items], "raw string")


@query("parse_spanish_number", f"""select raw, case when t in ('', '.', '..') then null else try_cast(replace(replace(t, '.', ''), ',', '.') as double) end as value
    from (select raw, trim(raw) as t from (values {', '.join(f"('{x}')" for x in RAW)}) v(raw))""")
def _(spark, d):
    return values(spark, RAW).select("raw", X.spanish_number("raw").alias("value"))


@query("parse_order_totals", """select o_orderkey, try_cast(replace(replace(t, '.', ''), ',', '.') as double) as value from (
    select o_orderkey, replace(cast(cast(o_totalprice as decimal(18,2)) as varchar), '.', ',') as t from orders)""")
def _(spark, d):
    """Order totals written the Spanish way and parsed back."""
    t = F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    return P.table(spark, d, "orders").select("o_orderkey", X.spanish_number(t).alias("value"))


@query("territory_parse", r"select raw, nullif(regexp_extract(trim(raw), '^(\d{2})\s+(.+)$', 1), '') as code, nullif(trim(regexp_extract(trim(raw), '^(\d{2})\s+(.+)$', 2)), '') as name from (values "
    + ", ".join(f"('{x}')" for x in TERRITORIES) + ") v(raw)")
def _(spark, d):
    return values(spark, TERRITORIES).select("raw", X.territory_code("raw").alias("code"), X.territory_name("raw").alias("name"))


@query("period_parse", r"""select raw, m as month, strftime(m, '%Y-%m') as month_id, cast(year(m) as integer) as year, cast(month(m) as integer) as month_number from (
    select raw, case when regexp_matches(raw, '^[0-9]{4}M(?:0[1-9]|1[012])$') then cast(replace(raw, 'M', '-') || '-01' as date) end as m from (values """
    + ", ".join(f"('{x}')" for x in PERIODS) + ") v(raw))")
def _(spark, d):
    m = X.period_month("raw")
    return values(spark, PERIODS).select("raw", m.alias("month"), X.month_id(m).alias("month_id"), F.year(m).alias("year"), F.month(m).alias("month_number"))


@query("malformed_periods", r"select distinct raw from (values " + ", ".join(f"('{x}')" for x in PERIODS) + r") v(raw) where not regexp_matches(raw, '^[0-9]{4}M(?:0[1-9]|1[012])$')")
def _(spark, d):
    return values(spark, PERIODS).where(~X.is_period("raw")).distinct()


@query("integer_cast_violations", "select count(*) as rows, count(*) filter (where abs(l_quantity - round_even(l_quantity, 0)) > 1e-6) as fractional, cast(sum(cast(round_even(l_quantity, 0) as bigint)) as bigint) as total from lineitem")
def _(spark, d):
    v, bad = X.integer_or_violation("l_quantity")
    return P.table(spark, d, "lineitem").agg(F.count("*").alias("rows"), F.count_if(bad).alias("fractional"), F.sum(v).alias("total"))


@query("snapshot_fingerprint", "select r_name, sha256('demand:' || r_name || '|supply:' || r_regionkey) as fingerprint from region")
def _(spark, d):
    return P.table(spark, d, "region").select("r_name", X.fingerprint("r_name", F.col("r_regionkey").cast("string")).alias("fingerprint"))


@query("segment_codes", "select c_mktsegment, case c_mktsegment when 'BUILDING' then 'domestic' when 'HOUSEHOLD' then 'domestic' when 'FURNITURE' then 'domestic' end as residence, count(*) as rows from customer group by all")
def _(spark, d):
    mapped = P.table(spark, d, "customer").withColumn("residence", X.lookup("c_mktsegment", {k: "domestic" for k in P.DOMESTIC}))
    return mapped.groupBy("c_mktsegment", "residence").agg(F.count("*").alias("rows"))


@query("processed_union", "select territory_id, metric, residence, month_id, value from demand union all select territory_id, metric, null, month_id, value from supply", "demand", "supply")
def _(spark, d):
    names = ["territory_id", "metric", "residence", "month_id", "value"]
    s = P.supply(spark, d).withColumn("residence", F.lit(None).cast("string"))
    return P.demand(spark, d).select(*names).unionByName(s.select(*names))


@query("value_flags", "select quality_flag, value_missing, is_provisional, count(*) as rows from (select value is null as value_missing, case when value is null then 'missing_value' else 'ok' end as quality_flag, is_provisional from demand) group by all", "demand")
def _(spark, d):
    lineage = dict(file_name="f", source_id="1", table_id=1, snapshot_id="s", processed_at=P.CREATED)
    return normalize.add_lineage(P.demand(spark, d), **lineage).groupBy("quality_flag", "value_missing", "is_provisional").agg(F.count("*").alias("rows"))


# == dimensions
@query("calendar_dimension", "select month_id, date_month, year, month, month_name, quarter, season, is_summer, is_christmas_period, covid_period, complete_month_available from calendar", "calendar")
def _(spark, d):
    return P.calendar(spark, d).drop("is_easter_period")


@query("calendar_continuity", """select count(*) as months, count(*) filter (where s <> 1) as breaks, count(*) filter (where day(date_month) <> 1) as not_month_start from (
    select date_month, year(date_month) * 12 + month(date_month) - lag(year(date_month) * 12 + month(date_month)) over (order by date_month) as s from calendar)""", "calendar")
def _(spark, d):
    return panel.continuity(P.calendar(spark, d))


@query("territory_availability", """select *, case when coverage_ratio >= 0.95 then 'high' when coverage_ratio >= 0.80 then 'medium' when coverage_ratio >= 0.50 then 'low' else 'insufficient' end as coverage_quality from (
    select territory_id, count(distinct month_id) filter (where value is not null) as available_months, min(month_id) filter (where value is not null) as first_available_month,
    max(month_id) filter (where value is not null) as last_available_month, count(distinct month_id) filter (where value is not null) / cast(80 as double) as coverage_ratio from demand group by territory_id)""", "demand")
def _(spark, d):
    return dims.availability(P.demand(spark, d), 80)


@query("territory_dimension", """select territory_id, territory_name, territory_level, source_territory_code, source_territory_name, autonomous_community_id, autonomous_community_name, province_id,
    first_available_month is not null as is_rural_tourism_available, first_available_month, last_available_month,
    case when n / cast(80 as double) >= 0.95 then 'high' when n / cast(80 as double) >= 0.80 then 'medium' when n / cast(80 as double) >= 0.50 then 'low' else 'insufficient' end as coverage_quality from territory left join (
    select territory_id, count(distinct month_id) filter (where value is not null) as n, min(month_id) filter (where value is not null) as first_available_month,
    max(month_id) filter (where value is not null) as last_available_month from demand group by territory_id) using (territory_id)""", "territory", "demand")
def _(spark, d):
    t = P.territory(spark, d).drop("territory_level", "province_id", "coverage_quality")
    return dims.territory_dimension(t, P.demand(spark, d), 80, P.CREATED).drop("generated_at_utc")


# == fact table
@query("base_grid", "select territory_id, month_id, date_month from grid", "grid")
def _(spark, d):
    return panel.base_grid(P.territory(spark, d), P.calendar(spark, d)).select("territory_id", "month_id", "date_month")


_COUNTS = [f"{m}_{s}" for m in ("travellers", "overnight_stays") for s in ("total", "domestic", "foreign")]
_DW = [*gold.KEY, *_COUNTS, "average_stay", "is_provisional"]


@query("demand_wide_pivot", f"select {', '.join(_DW)} from demand_wide", "demand_wide")
def _(spark, d):
    return gold.demand_wide(P.demand(spark, d)).select(*_DW)


@query("supply_wide_pivot", "select * from supply_wide", "supply_wide")
def _(spark, d):
    return gold.supply_wide(P.supply(spark, d))


@query("gold_demand_supply_join", "select territory_id, month_id, travellers_total, overnight_stays_total, places_estimated, occupancy_rate_pct from joined", "joined")
def _(spark, d):
    grid = panel.base_grid(P.territory(spark, d), P.calendar(spark, d))
    both = grid.join(gold.demand_wide(P.demand(spark, d)), gold.KEY, "left").join(gold.supply_wide(P.supply(spark, d)), gold.KEY, "left")
    return both.select("territory_id", "month_id", "travellers_total", "overnight_stays_total", "places_estimated", "occupancy_rate_pct")


def of_facts(name: str, *columns: str):
    """A query over derived columns of the dense grid."""
    names = ["territory_id", "month_id", *columns]
    query(name, f"select {', '.join(names)} from facts", "facts")(lambda spark, d: P.facts(spark, d).select(*names))


of_facts("profile_ratios", *gold.RATIOS)
of_facts("mom_yoy_change", "overnight_stays_mom_change_pct", "overnight_stays_yoy_change_pct")
of_facts("seasonality_index", "seasonality_index")
of_facts("tourism_pressure_index", "tourism_pressure_index")


@query("pct_rank_avg", f"select territory_id, month_id, {P._rank('overnight_stays_per_place')} as pct_rank from facts", "facts")
def _(spark, d):
    df = P.facts(spark, d)
    return df.select("territory_id", "month_id", panel.percentile_rank_average("overnight_stays_per_place", ["month_id"]).alias("pct_rank"))


@query("weighted_available_score", """select territory_id, month_id, case when w > 0 then t / w end as score from (select territory_id, month_id,
    coalesce(occupancy_rate_pct, 0) * cast(0.6 as double) + coalesce(weekend_occupancy_rate_pct, 0) * cast(0.4 as double) as t,
    case when occupancy_rate_pct is not null then cast(0.6 as double) else 0 end + case when weekend_occupancy_rate_pct is not null then cast(0.4 as double) else 0 end as w from joined)""", "joined")
def _(spark, d):
    df = panel.base_grid(P.territory(spark, d), P.calendar(spark, d)).join(gold.supply_wide(P.supply(spark, d)), gold.KEY, "left")
    return df.select("territory_id", "month_id", X.weighted_available_score([(F.col("occupancy_rate_pct"), 0.6), (F.col("weekend_occupancy_rate_pct"), 0.4)]).alias("score"))


@query("gold_demand_filter", "select count(*) as grid_rows, count(*) filter (where travellers_total is not null or overnight_stays_total is not null) as kept, count(*) filter (where travellers_total is null and overnight_stays_total is null) as removed from joined", "joined")
def _(spark, d):
    grid = panel.base_grid(P.territory(spark, d), P.calendar(spark, d)).join(gold.demand_wide(P.demand(spark, d)), gold.KEY, "left")
    has = X.any_present("travellers_total", "overnight_stays_total")
    return grid.agg(F.count("*").alias("grid_rows"), F.count_if(has).alias("kept"), F.count_if(~has).alias("removed"))


_GOLD = [c for c in gold.COLUMNS if c not in (*gold.CONTEXT, *"created_at data_version demand_snapshot_id demand_source_frequency is_easter_period pipeline_run_id source_snapshot_id supply_snapshot_id".split())]


@query("gold_table", f"select {', '.join(_GOLD)}, sha256('demand:demand-1|supply:supply-1') as source_snapshot_id, 'monthly' as demand_source_frequency from gold", "gold")
def _(spark, d):
    return P.gold_table(spark, d).select(*_GOLD, "source_snapshot_id", "demand_source_frequency")


@query("data_status", "select data_status, is_provisional, count(*) as rows from gold group by all", "gold")
def _(spark, d):
    return P.gold_table(spark, d).groupBy("data_status", "is_provisional").agg(F.count("*").alias("rows"))


# == features
def of_model(name: str, *columns: str):
    names = ["territory_id", "target_month_id", *columns]
    sql = ", ".join(f"month_id as {n}" if n == "target_month_id" else n for n in names)
    query(name, f"select {sql} from model", "model")(lambda spark, d: P.model_table(spark, d).select(*names))


of_model("calendar_lags", *(n for _, _, n in features.LAGS))
of_model("rolling_means", "rolling_mean_3m_overnight_stays", "rolling_mean_12m_overnight_stays")
of_model("historical_yoy", "yoy_change_overnight_stays")
of_model("evaluation_split", "evaluation_split")
of_model("data_quality_flag", "data_quality_flag")


@query("modeling_table", f"""select territory_id, territory_name, territory_level, month_id as target_month_id, date_month as target_date_month, cast(1 as tinyint) as forecast_horizon,
    cast(overnight_stays_total as double) as target_overnight_stays_total, occupancy_rate_pct as target_occupancy_rate_pct, year, month, quarter, is_summer, is_christmas_period, covid_period,
    {', '.join(features.HISTORY)}, evaluation_split, data_quality_flag, is_provisional from model""", "model")
def _(spark, d):
    return P.model_table(spark, d).drop("source_snapshot_id", "pipeline_run_id", "data_version", "created_at")


@query("lag_self_join", """select g.territory_id, g.month_id, cast(s.overnight_stays_total as double) as lag_12 from gold g left join gold s
    on s.territory_id = g.territory_id and s.date_month + interval 12 month = g.date_month""", "gold")
def _(spark, d):
    g = P.gold_table(spark, d)
    targets = g.select("territory_id", "month_id", F.col("date_month").alias("target_date_month"))
    return panel.calendar_lag_join(targets, g, "overnight_stays_total", 12, "lag_12").select("territory_id", "month_id", F.col("lag_12").cast("double").alias("lag_12"))


@query("rolling_self_join", """select g.territory_id, g.month_id, case when count(s.overnight_stays_total) = 3 then avg(s.overnight_stays_total) end as mean_3 from gold g left join gold s
    on s.territory_id = g.territory_id and s.date_month < g.date_month and s.date_month >= g.date_month - interval 3 month group by all""", "gold")
def _(spark, d):
    g = P.gold_table(spark, d)
    targets = g.select("territory_id", "month_id", F.col("date_month").alias("target_date_month"))
    return panel.calendar_mean_join(targets, g, "overnight_stays_total", 3, "mean_3").select("territory_id", "month_id", "mean_3")


@query("fold_train_counts", "select f.name as fold, count(*) as train_rows from (values " + ", ".join(f"('{f.name}', date '{f.train_end}')" for f in P.CONFIG.folds[:4]) + """) f(name, train_end)
    join model on date_month <= f.train_end and overnight_stays_total is not null and lag_12_overnight_stays is not null and not is_provisional group by f.name""", "model")
def _(spark, d):
    folds = spark.createDataFrame([(f.name, f.train_end) for f in P.CONFIG.folds[:4]], "fold string, train_end date")
    rows = P.model_table(spark, d).where(evaluate.evaluable()).select("target_date_month")
    return rows.join(F.broadcast(folds), F.col("target_date_month") <= F.col("train_end")).groupBy("fold").agg(F.count("*").alias("train_rows"))


@query("evaluable_rows", "select evaluation_split, count(*) as rows from forecast group by all", "forecast")
def _(spark, d):
    df = P.model_table(spark, d).where(F.col("evaluation_split").isin(*P.SPLITS) & evaluate.evaluable())
    return df.groupBy("evaluation_split").agg(F.count("*").alias("rows"))


# == evaluation
_M = "count(*) as rows, avg(absolute_error) as mae, sqrt(avg(squared_error)) as rmse, case when sum(abs(actual)) <> 0 then sum(absolute_error) / sum(abs(actual)) * 100 end as wape_pct, avg(error) as mean_bias"


def forecast(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.baseline_forecast(P.model_table(spark, d), P.SPLITS)


@query("metrics_by_split", f"select evaluation_split as split, {_M} from forecast group by all union all select 'overall', {_M} from forecast", "forecast")
def _(spark, d):
    return evaluate.metrics_with_overall(forecast(spark, d))


@query("baseline_forecast", "select territory_id, month_id as target_month_id, evaluation_split, actual, prediction from forecast", "forecast")
def _(spark, d):
    return forecast(spark, d).select("territory_id", "target_month_id", "evaluation_split", "actual", "prediction")


@query("prediction_errors", "select territory_id, month_id as target_month_id, error, absolute_error, squared_error from forecast", "forecast")
def _(spark, d):
    return forecast(spark, d).select("territory_id", "target_month_id", "error", "absolute_error", "squared_error")


@query("metrics_by_territory", f"select territory_id, {_M} from forecast group by all", "forecast")
def _(spark, d):
    return evaluate.metrics(forecast(spark, d), ["territory_id"])


@query("metrics_by_month", f"select month, {_M} from forecast group by all", "forecast")
def _(spark, d):
    return evaluate.metrics(forecast(spark, d), ["month"])


@query("metrics_by_season", f"select season, {_M} from forecast group by all", "forecast")
def _(spark, d):
    return evaluate.metrics(forecast(spark, d).withColumn("season", X.season("month")), ["season"])


@query("metrics_in_order", f"select p as position, split, rows, mae from (values (0, 'test'), (1, 'validation_1'), (2, 'absent')) v(p, split) left join (select evaluation_split as split, {_M} from forecast group by all) using (split)", "forecast")
def _(spark, d):
    m = evaluate.metrics(forecast(spark, d), ["evaluation_split"]).withColumnRenamed("evaluation_split", "split")
    return evaluate.in_order(spark, m, ["test", "validation_1", "absent"]).select("position", "split", "rows", "mae")


@query("evaluation_coverage", f"""select evaluation_split, count(*) as rows, count(overnight_stays_total) as with_target, count(lag_12_overnight_stays) as with_lag_12,
    count(*) filter (where is_provisional) as provisional, count(*) filter (where overnight_stays_total is not null and lag_12_overnight_stays is not null and not is_provisional) as evaluable
    from model where evaluation_split in ({', '.join(f"'{s}'" for s in P.SPLITS)}) group by all""", "model")
def _(spark, d):
    return evaluate.coverage(P.model_table(spark, d), P.SPLITS)


_E = lambda p, pre="": f"avg(abs({p} - actual)) as {pre}mae, sqrt(avg(({p} - actual) * ({p} - actual))) as {pre}rmse, case when sum(abs(actual)) <> 0 then sum(abs({p} - actual)) / sum(abs(actual)) * 100 end as {pre}wape_pct, avg({p} - actual) as {pre}mean_bias"
_VAL = "'validation_1', 'validation_2', 'validation_3'"


@query("metrics_pooled", f"""select model, count(*) as rows, {_E('model_prediction')} from predictions where evaluation_split in ({_VAL}) group by model
    union all select 'baseline', count(*), {_E('baseline_prediction')} from predictions where evaluation_split in ({_VAL})""", "predictions")
def _(spark, d):
    return evaluate.pooled(P.predictions(spark, d), P.SPLITS[:3])


def _paired_sql(key: str) -> str:
    return f"""select *, case when baseline_mae <> 0 then (baseline_mae - model_mae) / baseline_mae * 100 end as mae_improvement_pct, model_mae < baseline_mae as model_improves from (
    select {key}, count(*) as rows, {_E('baseline_prediction', 'baseline_')}, {_E('model_prediction', 'model_')} from predictions group by {key})"""


@query("paired_metrics_by_territory", _paired_sql("territory_id"), "predictions")
def _(spark, d):
    return evaluate.paired(P.predictions(spark, d), ["territory_id"])


@query("paired_metrics_by_month", _paired_sql("month"), "predictions")
def _(spark, d):
    return evaluate.paired(P.predictions(spark, d), ["month"])


@query("model_comparison", """select *, case when baseline_mae <> 0 then (baseline_mae - model_mae) / baseline_mae * 100 end as mae_improvement_pct,
    case when baseline_rmse <> 0 then (baseline_rmse - model_rmse) / baseline_rmse * 100 end as rmse_improvement_pct from (
    select evaluation_split, avg(abs(baseline_prediction - actual)) as baseline_mae, sqrt(avg((baseline_prediction - actual) * (baseline_prediction - actual))) as baseline_rmse,
    avg(abs(model_prediction - actual)) as model_mae, sqrt(avg((model_prediction - actual) * (model_prediction - actual))) as model_rmse from predictions group by evaluation_split)""", "predictions")
def _(spark, d):
    p = P.predictions(spark, d)
    # one row a prediction and model, so that both metric families come from one scan
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), F.col(c).alias("prediction")) for n, c in (("baseline", "baseline_prediction"), ("blend", "model_prediction")))))
    long = evaluate.metrics(p.select("evaluation_split", "actual", sides.alias("s")).select("evaluation_split", "actual", "s.*"), ["evaluation_split", "model"])
    return evaluate.comparison(long, "baseline", "blend")


@query("promotion_decision", f"""select *, coalesce(validation_improvement_pct >= 5, false) as validation_pass, coalesce(test_improvement_pct >= 5, false) as test_pass, territories_improved * 2 > territories as majority_pass,
    coalesce(validation_improvement_pct >= 5, false) and coalesce(test_improvement_pct >= 5, false) and territories_improved * 2 > territories as promoted from (
    select case when vb <> 0 then (vb - vm) / vb * 100 end as validation_improvement_pct, case when tb <> 0 then (tb - tm) / tb * 100 end as test_improvement_pct, territories, territories_improved from (
    select avg(abs(baseline_prediction - actual)) filter (where evaluation_split in ({_VAL})) as vb, avg(abs(model_prediction - actual)) filter (where evaluation_split in ({_VAL})) as vm,
    avg(abs(baseline_prediction - actual)) filter (where evaluation_split = 'test') as tb, avg(abs(model_prediction - actual)) filter (where evaluation_split = 'test') as tm from predictions),
    (select count(*) as territories, count(*) filter (where m < b) as territories_improved from (select avg(abs(model_prediction - actual)) as m, avg(abs(baseline_prediction - actual)) as b
     from predictions where evaluation_split = 'test' group by territory_id)))""", "predictions")
def _(spark, d):
    return evaluate.promotion(P.predictions(spark, d), P.SPLITS[:3], "test")


@query("topk_best_worst", """select * from (select 'best' as side, territory_id, mae_improvement_pct from p order by mae_improvement_pct desc nulls last, territory_id limit 5)
    union all select * from (select 'worst', territory_id, mae_improvement_pct from p order by mae_improvement_pct asc nulls last, territory_id limit 5)""".replace("from p ", f"from ({_paired_sql('territory_id')}) "), "predictions")
def _(spark, d):
    return explore.best_and_worst(evaluate.paired(P.predictions(spark, d), ["territory_id"]), 5)


# == quality
@query("missing_territory_months", "select t.territory_id, c.month_id from (select distinct territory_id from gold) t cross join calendar c where not exists (select 1 from gold g where g.territory_id = t.territory_id and g.month_id = c.month_id)", "gold")
def _(spark, d):
    return quality.missing_pairs(P.gold_table(spark, d), P.calendar(spark, d))


@query("referential_integrity", "select c_nationkey as nation from customer except select s_nationkey from supplier where s_acctbal > 9000")
def _(spark, d):
    """Customers' nations without a supplier of a high balance."""
    s = P.table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("nation"))
    return quality.orphans(P.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), s, "nation")


@query("documented_missing_months", "select month_id from calendar where month in (1, 2) intersect select month_id from facts where travellers_domestic is null or travellers_foreign is null", "facts")
def _(spark, d):
    gaps = P.facts(spark, d).where(~X.all_present("travellers_domestic", "travellers_foreign"))
    return quality.documented(gaps, P.calendar(spark, d).where(F.col("month").isin(1, 2)))


@query("snapshot_members", "select n_name from nation where n_regionkey in (select r_regionkey from region where r_name < 'B')")
def _(spark, d):
    r = P.table(spark, d, "region").where("r_name < 'B'")
    return P.table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_name")


@query("duplicate_key_count", "select cast(coalesce(sum(n - 1), 0) as bigint) as duplicate_rows from (select count(*) as n from orders group by o_custkey, date_trunc('month', o_orderdate))")
def _(spark, d):
    return panel.duplicate_keys(P.table(spark, d, "orders").select("o_custkey", P.month("o_orderdate").alias("m")), ["o_custkey", "m"])


@query("first_per_key", "select o_custkey, o_orderkey, o_orderpriority from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")
def _(spark, d):
    return panel.first_per_key(P.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("single_value_check", "select count(distinct o_orderstatus) as distinct_values, case when count(distinct o_orderstatus) = 1 then max(o_orderstatus) end as value from orders")
def _(spark, d):
    return panel.single_value(P.table(spark, d, "orders"), "o_orderstatus")


_MISS = "average_stay occupancy_rate_pct overnight_stays_total overnight_stays_yoy_change_pct seasonality_index tourism_pressure_index travellers_total".split()


@query("missingness_report", " union all ".join(f"select '{c}' as \"column\", count(*) filter (where {c} is null) as nulls, count(*) filter (where {c} is null) * cast(100 as double) / count(*) as null_pct from gold" for c in _MISS), "gold")
def _(spark, d):
    return quality.missingness(P.gold_table(spark, d), _MISS)


def _check_sql(conditions: list[tuple[str, str, str]], source: str) -> str:
    rows = [f"select '{n}' as \"check\", '{s}' as severity, count(*) filter (where {c}) as violations from {source}" for n, c, s in conditions]
    return "select \"check\", case when violations = 0 then 'PASS' when severity = 'warn' then 'WARN' else 'FAIL' end as status, severity, violations from (" + " union all ".join(rows) + ")"


_SHARES = [tuple(f"{r}_{m}_share" for r in ("domestic", "foreign")) for m in ("travellers", "overnight_stays")]
_GOLD_RULES = (
    [(f"not_null:{c}", f"{c} is null", "fail") for c in ("territory_id", "month_id", "date_month")]
    + [(f"non_negative:{c}", f"{c} < 0", "fail") for c in (*_COUNTS, "establishments_estimated", "places_estimated", "staff_employed")]
    + [(f"range:{c}", f"not {c} between 0 and 100", "fail") for c in quality.PERCENTAGES]
    + [(f"range:{c}", f"not {c} between 0 and 1", "fail") for p in _SHARES for c in p]
    + [(f"shares_sum:{a}", f"abs({a} + {b} - 1) > 1e-6", "fail") for a, b in _SHARES]
    + [
        ("total:travellers", "travellers_total <> travellers_domestic + travellers_foreign", "fail"),
        ("total:overnight_stays", "overnight_stays_total <> overnight_stays_domestic + overnight_stays_foreign", "fail"),
        ("average_stay", f"abs(average_stay - ({P._DIV('overnight_stays_total', 'travellers_total')})) > 1e-6", "fail"),
        ("month_start", "day(date_month) <> 1", "fail"),
        ("month_id_matches", "month_id <> strftime(date_month, '%Y-%m')", "fail"),
        ("demand_present", "travellers_total is null and overnight_stays_total is null", "fail"),
        ("missing_supply", "occupancy_rate_pct is null", "warn"),
    ]
)


@query("gold_rule_checks", _check_sql(_GOLD_RULES, "gold"), "gold")
def _(spark, d):
    return quality.run(P.gold_table(spark, d), quality.gold_checks())


_FOLDS = P.CONFIG.folds
_SPLIT_RULES = (
    [(f"not_null:{c}", f"{s} is null", "fail") for c, s in (("territory_id", "territory_id"), ("target_month_id", "month_id"), ("target_date_month", "date_month"), ("evaluation_split", "evaluation_split"), ("data_quality_flag", "data_quality_flag"))]
    + [("allowed:evaluation_split", "evaluation_split not in ('train', " + ", ".join(f"'{f.name}'" for f in _FOLDS) + ")", "fail")]
    + [("allowed:data_quality_flag", "data_quality_flag not in ('ok', 'missing_target', 'missing_lag', 'insufficient_history', 'provisional_target', 'outlier_review')", "fail")]
    + [(f"window:{f.name}", f"evaluation_split = '{f.name}' and not date_month between date '{f.start}' and date '{f.end}'", "fail") for f in _FOLDS]
    + [(f"complete:{f.name}", f"evaluation_split <> '{f.name}' and date_month between date '{f.start}' and date '{f.end}'", "fail") for f in _FOLDS]
    + [("not_provisional_inside", "evaluation_split = 'provisional_monitoring' and not coalesce(is_provisional, false)", "fail")]
    + [("provisional_outside", "is_provisional and evaluation_split <> 'provisional_monitoring'", "fail"), ("train_after_folds", f"evaluation_split = 'train' and date_month >= date '{_FOLDS[0].start}'", "fail")]
)


@query("split_rule_checks", _check_sql(_SPLIT_RULES, "model"), "model")
def _(spark, d):
    return quality.run(P.model_table(spark, d), quality.model_checks(_FOLDS, "provisional_monitoring"))


# == exploration
@query("national_monthly", "select date_month, coalesce(cast(sum(travellers_total) as bigint), 0) as travellers_total, coalesce(cast(sum(overnight_stays_total) as bigint), 0) as overnight_stays_total from gold group by all", "gold")
def _(spark, d):
    return explore.national_monthly(P.gold_table(spark, d))


@query("annual_summary", "select year, coalesce(cast(sum(overnight_stays_total) as bigint), 0) as overnight_stays_total, count(distinct month_id) as months, bool_or(is_provisional) as any_provisional from gold group by year having count(distinct month_id) = 12", "gold")
def _(spark, d):
    return explore.annual_summary(P.gold_table(spark, d))


@query("covid_comparison", f"""select case when date_month < date '{SHOCK[0]}' then 'before' when date_month <= date '{SHOCK[1]}' then 'shock' else 'after' end as period, count(*) as months, avg(s) as mean_overnight_stays
    from (select date_month, coalesce(sum(overnight_stays_total), 0) as s from gold group by date_month) group by all""", "gold")
def _(spark, d):
    return explore.shock_comparison(P.gold_table(spark, d), SHOCK)


@query("seasonal_profile", "select month, avg(overnight_stays_total) as mean_overnight_stays, count(*) as rows from gold where not covid_period and not is_provisional group by month", "gold")
def _(spark, d):
    return explore.seasonal_profile(P.gold_table(spark, d))


@query("seasonal_profile_territory", "select month, avg(overnight_stays_total) as mean_overnight_stays, count(*) as rows from gold where not covid_period and not is_provisional and territory_id = 'T-03' group by month", "gold")
def _(spark, d):
    return explore.seasonal_profile(P.gold_table(spark, d), "T-03")


@query("ranking_year", "select territory_id, territory_name, cast(sum(overnight_stays_total) as bigint) as overnight_stays_total, avg(occupancy_rate_pct) as mean_occupancy_rate_pct from gold where year = 1997 group by all order by 3 desc nulls last, 1 limit 10", "gold")
def _(spark, d):
    return explore.ranking(P.gold_table(spark, d), 1997, 10)


@query("foreign_share_by_group", f"select *, {P._DIV('f_', 'd_ + f_').replace('f_', 'foreign_').replace('d_ ', 'domestic_ ')} as foreign_share from (select autonomous_community_id, cast(coalesce(sum(overnight_stays_domestic), 0) as bigint) as domestic_, cast(coalesce(sum(overnight_stays_foreign), 0) as bigint) as foreign_ from gold group by all)".replace("select *,", "select autonomous_community_id, domestic_ as domestic, foreign_ as \"foreign\",").replace("domestic_ + foreign_ > 0", "(domestic_ + foreign_) > 0").replace("/ domestic_ + foreign_", "/ (domestic_ + foreign_)"), "gold")
def _(spark, d):
    return explore.foreign_share(P.gold_table(spark, d), ["autonomous_community_id"])


_DESC = ["travellers_total", "overnight_stays_total"]


@query("describe_measures", " union all ".join(f"select '{c}' as measure, count({c}) as count, avg({c}) as mean, round(stddev_samp({c}), 6) as std, cast(min({c}) as double) as min, quantile_cont({c}, 0.25) as q25, quantile_cont({c}, 0.5) as q50, quantile_cont({c}, 0.75) as q75, cast(max({c}) as double) as max from gold" for c in _DESC), "gold")
def _(spark, d):
    return explore.describe(P.gold_table(spark, d), _DESC).withColumn("std", F.round("std", 6))


@query("pressure_correlation", "select count(*) as pairs, round(corr(cast(travellers_total as double), cast(overnight_stays_total as double)), 9) as correlation from gold where travellers_total is not null and overnight_stays_total is not null", "gold")
def _(spark, d):
    return explore.correlation(P.gold_table(spark, d), "travellers_total", "overnight_stays_total").withColumn("correlation", F.round("correlation", 9))


@query("peak_month", "select date_month, cast(s as bigint) as overnight_stays_total from (select date_month, coalesce(sum(overnight_stays_total), 0) as s from gold group by date_month) order by s desc, date_month limit 1", "gold")
def _(spark, d):
    return explore.peak_month(P.gold_table(spark, d))


@query("split_quality_counts", "select evaluation_split, data_quality_flag, count(*) as rows from model group by all", "model")
def _(spark, d):
    return explore.split_quality_counts(P.model_table(spark, d))


@query("latest_snapshot", """select territory_id, month_id, overnight_stays_yoy_change_pct from gold where overnight_stays_yoy_change_pct is not null
    and date_month = (select max(date_month) from gold where overnight_stays_yoy_change_pct is not null) order by 3 desc, 1 limit 10""", "gold")
def _(spark, d):
    return explore.latest_snapshot(P.gold_table(spark, d), 10)


@query("last_months", "select date_month, coalesce(cast(sum(travellers_total) as bigint), 0) as travellers_total, coalesce(cast(sum(overnight_stays_total) as bigint), 0) as overnight_stays_total from gold group by all order by 1 desc limit 12", "gold")
def _(spark, d):
    return explore.last_months(P.gold_table(spark, d), 12)


@query("table_summary", "select count(*) as rows, count(distinct territory_id) as territories, min(month_id) as first_month, max(month_id) as last_month, count(*) filter (where travellers_total is null) as null_travellers_total, count(*) filter (where occupancy_rate_pct is null) as null_occupancy_rate_pct from gold", "gold")
def _(spark, d):
    return explore.table_summary(P.gold_table(spark, d), "territory_id", "month_id", ["travellers_total", "occupancy_rate_pct"])


# == event stream
@query("latest_revision", "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def _(spark, d):
    """Last row of each key, the operator behind the micro-batch upkeep."""
    from tidepanel.streaming import latest_revision

    ranked = P.table(spark, d, "events").withColumn("v", F.struct("ts", "event_id"))
    return latest_revision(ranked, ["user_id", "event_type"], "v").select("user_id", "event_type", "event_id", "value")


# == machine learning
_NUM, _CAT, _BOOL = (list(x) for x in (P.CONFIG.numeric_features, P.CONFIG.categorical_features, P.CONFIG.boolean_features))


@query("ridge_backtest")
def _(spark, d):
    """All alphas on all folds, fitted on the rows up to each fold; solved by linear algebra, so without SQL."""
    p = ml.ridge_predictions(P.model_table(spark, d), list(P.CONFIG.folds[:4]), list(P.CONFIG.ridge_alphas), _NUM, _CAT, _BOOL)
    return evaluate.paired(p, ["model", "evaluation_split"])


@query("boosted_trees_backtest")
def _(spark, d):
    """300 rounds on all folds, a task a fold."""
    return evaluate.paired(ml.boosted_predictions(P.model_table(spark, d), list(P.CONFIG.folds[:4]), _NUM, _CAT, _BOOL), ["evaluation_split"])


from tidepanel.plans import seeded  # noqa: E402, F401  (registers the queries over seeded violations)
