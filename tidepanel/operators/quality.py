"""Declarative checks: all row rules of a table are one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions import expr as X
from tidepanel.operators import panel

PERCENTAGES = "occupancy_rate_pct room_occupancy_rate_pct seasonality_index tourism_pressure_index weekend_occupancy_rate_pct".split()


@dataclass(frozen=True)
class Check:
    """``violations`` counts offending rows: an aggregate Column, 0 when all is well."""

    name: str
    violations: Column
    severity: str = "fail"


def rows_where(name: str, bad: Column, severity: str = "fail") -> Check:
    """NULL conditions never count."""
    return Check(name, F.count_if(bad), severity)


def not_null(*columns: str) -> list[Check]:
    return [rows_where(f"not_null:{x}", F.col(x).isNull()) for x in columns]


def non_negative(*columns: str) -> list[Check]:
    return [rows_where(f"non_negative:{x}", F.col(x) < 0) for x in columns]


def in_range(column: str, low: float, high: float, severity: str = "fail") -> Check:
    return rows_where(f"range:{column}", ~F.col(column).between(low, high), severity)


def allowed(column: str, values: list) -> Check:
    return rows_where(f"allowed:{column}", ~F.col(column).isin(*values))


def one_value(column: str) -> Check:
    return Check(f"single_value:{column}", F.abs(F.count_distinct(column) - 1))


def equal_within(name: str, actual: Column, expected: Column, tolerance: float = 1e-6) -> Check:
    return rows_where(name, ~X.same_within(actual, expected, tolerance))


def run(df: DataFrame, checks: list[Check]) -> DataFrame:
    """(check, status, severity, violations): PASS, or WARN or FAIL by severity."""
    one = df.agg(*(F.coalesce(c.violations, F.lit(0)).cast("bigint").alias(f"v{i}") for i, c in enumerate(checks)))
    rows = F.array(*(F.struct(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), F.col(f"v{i}").alias("violations")) for i, c in enumerate(checks)))
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    status = F.when(F.col("violations") == 0, "PASS").when(F.col("severity") == "warn", "WARN").otherwise("FAIL")
    return out.select("check", status.alias("status"), "severity", "violations")


def unique_key(df: DataFrame, keys: list[str], name: str = "unique_key") -> DataFrame:
    n = panel.duplicate_keys(df, keys).withColumnRenamed("duplicate_rows", "violations")
    return n.select(F.lit(name).alias("check"), F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"), F.lit("fail").alias("severity"), F.col("violations").cast("bigint").alias("violations"))


@dataclass(frozen=True)
class Field:
    """What a column of a contract must be; NULLs are no value to test, unless not nullable."""

    name: str
    type: T.DataType
    nullable: bool = True
    allowed: tuple = ()
    low: float | None = None
    high: float | None = None


def field_checks(fields: list[Field]) -> list[Check]:
    out = not_null(*(f.name for f in fields if not f.nullable))
    out += [allowed(f.name, list(f.allowed)) for f in fields if f.allowed]
    out += [rows_where(f"minimum:{f.name}", F.col(f.name) < f.low) for f in fields if f.low is not None]
    return out + [rows_where(f"maximum:{f.name}", F.col(f.name) > f.high) for f in fields if f.high is not None]


def schema_contract(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Column count, names, order and types from the schema; then values, unless names differ."""
    have, want = df.schema, T.StructType([T.StructField(f.name, f.type) for f in fields])
    found = [
        ("column_count", abs(len(have) - len(want))),
        ("column_names", len(set(have.names) ^ set(want.names))),
        ("column_order", sum(a != b for a, b in zip(have.names, want.names))),
        ("column_types", sum(have[n].dataType != want[n].dataType for n in want.names if n in have.names)),
    ]
    rows = [(n, "PASS" if v == 0 else "FAIL", "fail", v) for n, v in found]
    structure = df.sparkSession.createDataFrame(rows, "check string, status string, severity string, violations bigint")
    return structure if found[1][1] else structure.unionByName(run(df, field_checks(fields)))


def missing_pairs(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """(territory_id, month_id) of the full domain that the table lacks."""
    domain = panel.base_grid(df.select("territory_id").distinct(), calendar.select("month_id").distinct())
    return domain.join(df.select("territory_id", "month_id"), ["territory_id", "month_id"], "left_anti")


def orphans(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Keys without a dimension row (EXCEPT DISTINCT)."""
    return df.select(key).where(F.col(key).isNotNull()).subtract(dimension.select(key))


def documented(missing: DataFrame, allowed_months: DataFrame) -> DataFrame:
    return missing.select("month_id").intersect(allowed_months.select("month_id"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL count and percentage of each column, in one pass."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(x).isNull()).alias(x) for x in columns))
    rows = F.array(*(F.struct(F.lit(x).alias("column"), F.col(x).alias("nulls")) for x in columns))
    out = one.select("n", F.explode(rows).alias("r"))
    return out.select("r.column", F.col("r.nulls").alias("nulls"), F.when(F.col("n") > 0, F.col("r.nulls") * 100.0 / F.col("n")).alias("null_pct"))


def gold_checks() -> list[Check]:
    c = F.col
    counts = [f"{m}_{s}" for m in ("travellers", "overnight_stays") for s in ("total", "domestic", "foreign")]
    ratio = X.safe_divide("overnight_stays_total", "travellers_total")
    shares = [(f"domestic_{m}_share", f"foreign_{m}_share") for m in ("travellers", "overnight_stays")]
    return [
        *not_null("territory_id", "month_id", "date_month"),
        *non_negative(*counts, "establishments_estimated", "places_estimated", "staff_employed"),
        *(in_range(x, 0, 100) for x in PERCENTAGES),
        *(in_range(x, 0, 1) for pair in shares for x in pair),
        *(rows_where(f"shares_sum:{a}", F.abs(c(a) + c(b) - 1) > 1e-6) for a, b in shares),
        rows_where("total:travellers", c("travellers_total") != c("travellers_domestic") + c("travellers_foreign")),
        rows_where("total:overnight_stays", c("overnight_stays_total") != c("overnight_stays_domestic") + c("overnight_stays_foreign")),
        rows_where("average_stay", F.abs(c("average_stay") - ratio) > 1e-6),
        rows_where("month_start", F.dayofmonth("date_month") != 1),
        rows_where("month_id_matches", c("month_id") != X.month_id("date_month")),
        rows_where("demand_present", ~X.any_present("travellers_total", "overnight_stays_total")),
        rows_where("missing_supply", c("occupancy_rate_pct").isNull(), "warn"),
    ]


def model_checks(folds, provisional: str) -> list[Check]:
    c = F.col
    inside = [rows_where(f"window:{f.name}", (c("evaluation_split") == f.name) & ~c("target_date_month").between(F.lit(f.start), F.lit(f.end))) for f in folds]
    outside = [rows_where(f"complete:{f.name}", (c("evaluation_split") != f.name) & c("target_date_month").between(F.lit(f.start), F.lit(f.end))) for f in folds]
    return [
        *not_null("territory_id", "target_month_id", "target_date_month", "evaluation_split", "data_quality_flag"),
        allowed("evaluation_split", ["train", *(f.name for f in folds)]),
        allowed("data_quality_flag", ["ok", "missing_target", "missing_lag", "insufficient_history", "provisional_target", "outlier_review"]),
        *inside,
        *outside,
        rows_where("provisional_outside", c("is_provisional") & (c("evaluation_split") != provisional)),
        rows_where("not_provisional_inside", (c("evaluation_split") == provisional) & ~F.coalesce("is_provisional", F.lit(False))),
        rows_where("train_after_folds", (c("evaluation_split") == "train") & (c("target_date_month") >= F.lit(folds[0].start))),
    ]


MODEL_COUNTS = (
    ["target_overnight_stays_total"] + [f"lag_{k}_overnight_stays" for k in (1, 3, 12)] + [f"rolling_mean_{k}m_overnight_stays" for k in (3, 12)]
    + [f"lag_{k}_average_stay" for k in (1, 12)] + [f"lag_1_{x}" for x in ("places_estimated", "establishments_estimated", "staff_employed")]
)
MODEL_PERCENT = ["target_occupancy_rate_pct", "lag_1_occupancy_rate_pct", "lag_12_occupancy_rate_pct", "lag_1_weekend_occupancy_rate_pct"]
MODEL_SHARES = [f"lag_1_{x}_overnight_stays_share" for x in ("domestic", "foreign")]
TRACES = ["source_snapshot_id", "pipeline_run_id", "data_version", "created_at"]


def model_value_checks(territories: int | None = None, level: str = "province", traces: bool = True) -> list[Check]:
    """Horizon, level, ranges, share pairs, dates and traceability of the modelling table."""
    c = F.col
    out = [
        rows_where("forecast_horizon", c("forecast_horizon") != 1),
        rows_where("territory_level", c("territory_level") != level),
        *non_negative(*MODEL_COUNTS),
        *(in_range(x, 0, 100) for x in MODEL_PERCENT),
        *(in_range(x, 0, 1) for x in MODEL_SHARES),
        rows_where("shares_sum:lag_1", F.abs(c(MODEL_SHARES[0]) + c(MODEL_SHARES[1]) - 1) > 1e-6),
        rows_where("month_id_matches", c("target_month_id") != X.month_id("target_date_month")),
        rows_where("month_start", F.dayofmonth("target_date_month") != 1),
    ]
    if territories is not None:
        out.append(Check("territory_count", F.abs(F.count_distinct("territory_id") - territories)))
    return out + ([*not_null(*TRACES), *map(one_value, TRACES)] if traces else [])


def gold_dataset_checks(territories: int, level: str, first_month: str) -> list[Check]:
    """Facts about the whole table: territories, level, first month, provisional marks, unused context."""
    return [
        Check("territory_count", F.abs(F.count_distinct("territory_id") - territories)),
        rows_where("territory_level", F.col("territory_level") != level),
        Check("first_month", F.when(F.min("month_id") == first_month, 0).otherwise(1)),
        rows_where("status_matches", F.col("data_status") != X.data_status("is_provisional")),
        *map(one_value, ["source_snapshot_id", "demand_snapshot_id", "supply_snapshot_id", "pipeline_run_id", "data_version"]),
    ]


def context_unused(columns: list[str]) -> list[Check]:
    """Placeholders without a value are a warning."""
    return [Check(f"context:{x}", F.when(F.count(x) == 0, 1).otherwise(0), "warn") for x in columns]


def missing_months(df: DataFrame, calendar: DataFrame, documented_months: list[str]) -> DataFrame:
    """Months of the calendar without a row, but for the documented ones, as a check."""
    gone = calendar.select("month_id").subtract(df.select("month_id")).where(~F.col("month_id").isin(*documented_months) if documented_months else F.lit(True))
    n = gone.agg(F.count("*").alias("violations"))
    return n.select(F.lit("continuity").alias("check"), F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"), F.lit("fail").alias("severity"), "violations")


def recomputed(gold: DataFrame, lags: list[tuple[str, int, str]], windows: tuple[int, ...] = (3, 12), value: str = "overnight_stays_total") -> DataFrame:
    """All lags, complete-window means and the change from lag 13 to lag 1, apart from the windows that made them.

    Each source row goes to the months after it on which it bears, and one aggregation by
    territory and month picks them up: no join, whatever the number of lags.
    """
    measures = sorted({m for m, _, _ in lags} | {value})
    ahead = sorted({k for _, k, _ in lags} | set(range(1, max(windows) + 1)) | {1, 13})
    k = F.col("_k")
    rows = gold.select("territory_id", "date_month", *(F.col(m).cast("double").alias(m) for m in measures), F.explode(F.array(*map(F.lit, ahead))).alias("_k"))
    at = lambda m, n: F.max(F.when(k == n, F.col(m)))
    inside = lambda w: F.when(k.between(1, w), F.col(value))
    out = rows.groupBy("territory_id", F.expr("add_months(date_month, _k)").alias("target_date_month")).agg(
        *(at(m, n).alias(f"_{name}") for m, n, name in lags),
        *(F.when(F.count(inside(w)) == w, F.avg(inside(w))).alias(f"_rolling_mean_{w}m_overnight_stays") for w in windows),
        X.pct_change_nonzero(at(value, 1), at(value, 13)).alias("_yoy_change_overnight_stays"),
    )
    return out


def temporal_integrity(gold: DataFrame, model: DataFrame, lags: list[tuple[str, int, str]], windows: tuple[int, ...] = (3, 12), tolerance: float = 1e-6) -> DataFrame:
    """Every historical feature of ``model`` against ``recomputed``, in one join."""
    names = [n for _, _, n in lags] + [f"rolling_mean_{w}m_overnight_stays" for w in windows] + ["yoy_change_overnight_stays"]
    both = model.join(recomputed(gold, lags, windows), ["territory_id", "target_date_month"], "left")
    return run(both, [equal_within(f"recomputed:{n}", F.col(n), F.col(f"_{n}"), tolerance) for n in names])


def exit_code(results: DataFrame) -> int:
    return int(results.where("status = 'FAIL'").limit(1).count() > 0)
