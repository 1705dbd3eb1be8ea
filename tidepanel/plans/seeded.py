"""Gates and checks over tables with planted violations, so that neither side of a comparison is empty or constant."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import schemas
from tidepanel.operators import dims, features, gates, quality
from tidepanel.plans import catalog as C
from tidepanel.plans import proxy as P

_ADD = {
    "seeded_gold": (["gold"], """select * replace (case when month = 1 then -1 else travellers_total end as travellers_total, case when month = 7 then 150.0 else occupancy_rate_pct end as occupancy_rate_pct,
        case when month = 3 then average_stay + 1 else average_stay end as average_stay, case when month = 5 then overnight_stays_domestic + 1 else overnight_stays_domestic end as overnight_stays_domestic,
        case when month <> 4 then season end as season, case when month = 9 then 'odd' else data_status end as data_status, case when month = 11 then 'x' else month_id end as month_id) from gold"""),
    "seeded_model": (["model"], """select * replace (case when month = 7 then lag_1_overnight_stays + 1 else lag_1_overnight_stays end as lag_1_overnight_stays,
        case when month <> 2 then rolling_mean_3m_overnight_stays end as rolling_mean_3m_overnight_stays, case when month = 5 then coalesce(yoy_change_overnight_stays, 0) + 0.5 else yoy_change_overnight_stays end as yoy_change_overnight_stays,
        case when month = 8 then -5.0 else lag_1_places_estimated end as lag_1_places_estimated, case when month = 12 and evaluation_split = 'train' then 'test' else evaluation_split end as evaluation_split,
        case when month = 10 then 'odd' else data_quality_flag end as data_quality_flag) from model"""),
    "seeded_supply": (["supply"], """select territory_id, metric, month_id, case when month(month) = 2 then -value when month(month) = 7 then value * 3 else value end as value from supply
        union all select territory_id, metric, month_id, value from supply where month_id = '1997-03'"""),
    "seeded_territory": (["territory"], """select * replace (case when territory_id <> 'T-05' then territory_name end as territory_name, case when territory_id = 'T-07' then 'country' else territory_level end as territory_level) from territory
        union all select * from territory where territory_id in ('T-03', 'T-04')"""),
    "seeded_calendar": (["calendar"], """select month_id, case when month_id = '1996-01' then date_month + 1 else date_month end as date_month from calendar where month_id not in ('1997-03', '1998-05')
        union all select month_id, date_month from calendar where month_id = '1999-02'"""),
}
P._PARTS |= {k: v for k, v in _ADD.items()}


def when(column: str, condition: str, value) -> dict:
    return {column: F.when(F.expr(condition), value).otherwise(F.col(column))}


def gold(spark, d):
    c = F.col
    return P.gold_table(spark, d).withColumns(
        when("travellers_total", "month = 1", F.lit(-1).cast("bigint")) | when("occupancy_rate_pct", "month = 7", F.lit(150.0)) | when("average_stay", "month = 3", c("average_stay") + 1)
        | when("overnight_stays_domestic", "month = 5", c("overnight_stays_domestic") + 1) | when("season", "month = 4", F.lit(None)) | when("data_status", "month = 9", F.lit("odd")) | when("month_id", "month = 11", F.lit("x"))
    )


def model(spark, d, table=None):
    c = F.col
    return (P.model_table(spark, d) if table is None else table).withColumns(
        when("lag_1_overnight_stays", "month = 7", c("lag_1_overnight_stays") + 1) | when("rolling_mean_3m_overnight_stays", "month = 2", F.lit(None))
        | when("yoy_change_overnight_stays", "month = 5", F.coalesce("yoy_change_overnight_stays", F.lit(0.0)) + 0.5) | when("lag_1_places_estimated", "month = 8", F.lit(-5.0))
        | when("evaluation_split", "month = 12 and evaluation_split = 'train'", F.lit("test")) | when("data_quality_flag", "month = 10", F.lit("odd"))
    )


@C.query("gold_gate_seeded", C._check_sql(C._GOLD_RULES, "seeded_gold"), "seeded_gold")
def _(spark, d):
    return quality.run(gold(spark, d), quality.gold_checks())


_FIELDS = [f for f in schemas.GOLD if f.name in C._GOLD]
_VALUES = (
    [(f"not_null:{f.name}", f"{f.name} is null", "fail") for f in _FIELDS if not f.nullable]
    + [(f"allowed:{f.name}", f"{f.name} not in ({', '.join(repr(x) for x in f.allowed)})", "fail") for f in _FIELDS if f.allowed]
    + [(f"minimum:{f.name}", f"{f.name} < {f.low}", "fail") for f in _FIELDS if f.low is not None]
    + [(f"maximum:{f.name}", f"{f.name} > {f.high}", "fail") for f in _FIELDS if f.high is not None]
)


@C.query("schema_contract_checks", "select * from (values ('column_count', 'PASS', 'fail', 0::bigint), ('column_names', 'PASS', 'fail', 0), ('column_order', 'PASS', 'fail', 0), ('column_types', 'FAIL', 'fail', 1)) v(\"check\", status, severity, violations) union all " + C._check_sql(_VALUES, "seeded_gold"), "seeded_gold")
def _(spark, d):
    return quality.schema_contract(gold(spark, d).select(*(f.name for f in _FIELDS)).withColumn("year", F.col("year").cast("int")), _FIELDS)


@C.query("model_gate_seeded", C._check_sql(C._SPLIT_RULES, "seeded_model"), "seeded_model")
def _(spark, d):
    return quality.run(model(spark, d), quality.model_checks(P.CONFIG.folds, "provisional_monitoring"))


_IN_SQL = {"target_overnight_stays_total": "overnight_stays_total", "target_occupancy_rate_pct": "occupancy_rate_pct"}
_MODEL_VALUES = (
    [("forecast_horizon", "false", "fail"), ("territory_level", "territory_level <> 'province'", "fail")]
    + [(f"non_negative:{c}", f"{_IN_SQL.get(c, c)} < 0", "fail") for c in quality.MODEL_COUNTS]
    + [(f"range:{c}", f"not {_IN_SQL.get(c, c)} between 0 and 100", "fail") for c in quality.MODEL_PERCENT]
    + [(f"range:{c}", f"not {c} between 0 and 1", "fail") for c in quality.MODEL_SHARES]
    + [("shares_sum:lag_1", f"abs({quality.MODEL_SHARES[0]} + {quality.MODEL_SHARES[1]} - 1) > 1e-6", "fail"), ("month_id_matches", "month_id <> strftime(date_month, '%Y-%m')", "fail"), ("month_start", "day(date_month) <> 1", "fail")]
)


@C.query("model_value_checks", C._check_sql(_MODEL_VALUES, "seeded_model"), "seeded_model")
def _(spark, d):
    return quality.run(model(spark, d), quality.model_value_checks(traces=False))


_HISTORY = [n for _, _, n in features.LAGS] + ["rolling_mean_3m_overnight_stays", "rolling_mean_12m_overnight_stays", "yoy_change_overnight_stays"]
_BOTH = "(select " + ", ".join(f"m.{n} as {n}, s.{n} as s_{n}" for n in _HISTORY) + " from model m join seeded_model s using (territory_id, month_id))"


@C.query("temporal_integrity", C._check_sql([(f"recomputed:{n}", f"not coalesce({n} is not distinct from s_{n} or abs({n} - s_{n}) <= 1e-6, false)", "fail") for n in _HISTORY], _BOTH), "seeded_model")
def _(spark, d):
    """All lags, means and the yearly change, of which three are corrupted."""
    g = P.gold_table(spark, d)
    table = features.build(g, P.CONFIG.folds, run_id="run-1", version="1.0.0", created_at=P.CREATED)
    return quality.temporal_integrity(g, model(spark, d, table), features.LAGS)


def _status(rows: str) -> str:
    return f"select \"check\", case when violations = 0 then 'PASS' else 'FAIL' end as status, 'fail' as severity, cast(violations as bigint) as violations from ({rows})"


def _unique(keys: str, source: str, name: str = "unique_key") -> str:
    return f"select '{name}' as \"check\", coalesce(sum(n - 1), 0) as violations from (select count(*) as n from {source} group by {keys})"


@C.query("processed_gate", _status("""select 'not_empty' as "check", (count(*) = 0)::int as violations from seeded_supply union all select 'territory_count', abs(count(distinct territory_id) - 25) from seeded_supply
    union all select 'non_negative:value', count(*) filter (where value < 0) from seeded_supply union all select 'range:percent', count(*) filter (where metric like '%\\_pct' escape '\\' and not value between 0 and 100) from seeded_supply
    union all """ + _unique("territory_id, metric, month_id", "seeded_supply")), "seeded_supply")
def _(spark, d):
    s = P.supply(spark, d)
    seeded = s.withColumn("value", F.when(F.month("month") == 2, -F.col("value")).when(F.month("month") == 7, F.col("value") * 3).otherwise(F.col("value"))).unionByName(s.where("month_id = '1997-03'"))
    return gates.processed(seeded, ["territory_id", "metric", "month_id"], 25)


@C.query("territory_gate", _status("""select 'territory_count' as "check", abs(count(*) - 25) as violations from seeded_territory union all select 'not_null:territory_id', count(*) filter (where territory_id is null) from seeded_territory
    union all select 'not_null:territory_name', count(*) filter (where territory_name is null) from seeded_territory union all select 'not_null:territory_level', count(*) filter (where territory_level is null) from seeded_territory
    union all select 'territory_level', count(*) filter (where territory_level <> 'province') from seeded_territory union all """ + _unique("territory_id", "seeded_territory")), "seeded_territory")
def _(spark, d):
    t = P.territory(spark, d)
    seeded = t.withColumns(when("territory_name", "territory_id = 'T-05'", F.lit(None)) | when("territory_level", "territory_id = 'T-07'", F.lit("country"))).unionByName(t.where("territory_id in ('T-03', 'T-04')"))
    return gates.territories(seeded, 25)


@C.query("calendar_gate", _status("""select 'not_empty' as "check", (count(*) = 0)::int as violations from seeded_calendar union all select 'month_start', count(*) filter (where day(date_month) <> 1) from seeded_calendar
    union all select 'continuity', count(*) filter (where s <> 1) from (select year(date_month) * 12 + month(date_month) - lag(year(date_month) * 12 + month(date_month)) over (order by date_month) as s from seeded_calendar)
    union all """ + _unique("month_id", "seeded_calendar")), "seeded_calendar")
def _(spark, d):
    c = P.calendar(spark, d).select("month_id", "date_month")
    seeded = c.where("month_id not in ('1997-03', '1998-05')").withColumns(when("date_month", "month_id = '1996-01'", F.date_add("date_month", 1))).unionByName(c.where("month_id = '1999-02'"))
    return gates.calendar(seeded)


@C.query("joined_keys_gate", _status(_unique("territory_id, month_id, metric, residence", "(select * from demand union all select * from demand where month_id = '1998-04')", "unique_demand") + " union all " + _unique("territory_id, month_id, metric", "supply", "unique_supply")), "demand", "supply")
def _(spark, d):
    demand = P.demand(spark, d)
    return gates.joined_keys(demand.unionByName(demand.where("month_id = '1998-04'")), P.supply(spark, d))


@C.query("grid_keys_gate", _status(_unique("territory_id", "seeded_territory", "unique_territory") + " union all " + _unique("month_id", "seeded_calendar", "unique_month")), "seeded_territory", "seeded_calendar")
def _(spark, d):
    t, c = P.territory(spark, d), P.calendar(spark, d)
    return gates.grid_keys(t.unionByName(t.where("territory_id in ('T-03', 'T-04')")), c.unionByName(c.where("month_id = '1999-02'")))


FILES = ["20260101T101500Z_demand.csv", "20260417T235959Z_supply.csv", "notes.csv", "20261399T000000Z_bad.csv"]


@C.query("complete_months", "select month_id, date_month < (select date_trunc('month', max(try_strptime(left(f, 16), '%Y%m%dT%H%M%SZ'))) from (values " + ", ".join(f"('{f}')" for f in FILES) + ") v(f)) - interval 28 year as complete from calendar", "calendar")
def _(spark, d):
    """Months before the one in which the newest file was taken (28 years ago, as the orders are older)."""
    cutoff = dims.complete_before(C.values(spark, FILES), "raw")
    return P.calendar(spark, d).select("month_id", (F.col("date_month") < F.add_months(F.lit(cutoff), -28 * 12)).alias("complete"))


@C.query("gold_dataset_rules", """select "check", case when violations = 0 then 'PASS' when severity = 'warn' then 'WARN' else 'FAIL' end as status, severity, cast(violations as bigint) as violations from (
    select 'territory_count' as "check", 'fail' as severity, abs(count(distinct territory_id) - 24) as violations from seeded_gold union all select 'territory_level', 'fail', count(*) filter (where territory_level <> 'province') from seeded_gold
    union all select 'first_month', 'fail', (min(month_id) <> '1995-02')::int from seeded_gold
    union all select 'status_matches', 'fail', count(*) filter (where data_status <> case when is_provisional then 'provisional' else 'final_or_not_marked_provisional' end) from seeded_gold
    union all select 'context:price_index', 'warn', 1 union all select 'continuity', 'fail', count(*) from (select month_id from calendar where month_id <> '1996-11' except select month_id from seeded_gold))""", "seeded_gold", "calendar")
def _(spark, d):
    g = gold(spark, d)
    checks = [c for c in quality.gold_dataset_checks(24, "province", "1995-02") if not c.name.startswith("single_value")] + quality.context_unused(["price_index"])
    return quality.run(g, checks).unionByName(quality.missing_months(g, P.calendar(spark, d), ["1996-11"]))
