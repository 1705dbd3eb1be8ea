"""Scenarios of the panel operators: gaps, windows, ratios, ranks, pressure, splits."""

from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.config import Fold, PanelConfig
from tidepanel.functions import expr as X
from tidepanel.operators import dims, evaluate, explore, features, gold, panel, quality

MONTHLY = "territory_id string, date_month date, overnight_stays_total double"


def monthly(spark, rows):
    return spark.createDataFrame([(t, date(2024, m, 1), float(v) if v is not None else None) for t, m, v in rows], MONTHLY)


@pytest.fixture(scope="module")
def source(spark):
    return monthly(spark, [("A", 1, 10), ("A", 2, 20), ("A", 3, 30), ("A", 5, 50)])


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("A", date(2024, m, 1)) for m in (4, 5, 6)], "territory_id string, target_date_month date")


def column(df, key, value):
    return {r[key].month if isinstance(r[key], date) else r[key]: r[value] for r in df.collect()}


def test_lag_is_the_exact_month(source, targets):
    got = column(panel.calendar_lag_join(targets, source, "overnight_stays_total", 1, "lag"), "target_date_month", "lag")
    assert got == {4: 30, 5: None, 6: 50}


def test_gap_is_not_zero(source):
    df = source.withColumn("month_index", X.month_index("date_month"))
    got = column(df.withColumn("lag", panel.calendar_lag("overnight_stays_total", 1)), "date_month", "lag")
    assert got == {1: None, 2: 10, 3: 20, 5: None}


def test_mean_needs_every_month(source, targets):
    got = column(panel.calendar_mean_join(targets, source, "overnight_stays_total", 3, "m"), "target_date_month", "m")
    assert got == {4: 20, 5: None, 6: None}


def test_mean_leaves_the_target_out(spark, source, targets):
    more = source.unionByName(monthly(spark, [("A", 4, 1000)]))
    assert column(panel.calendar_mean_join(targets, more, "overnight_stays_total", 3, "m"), "target_date_month", "m")[4] == 20
    df = more.withColumn("month_index", X.month_index("date_month"))
    assert column(df.withColumn("m", panel.calendar_mean("overnight_stays_total", 3)), "date_month", "m")[4] == 20


def test_window_equals_join(spark):
    rows = [(t, m, 7 * m + k) for k, t in enumerate("ABC") for m in range(1, 13) if (m + k) % 4]
    df = monthly(spark, rows).withColumn("month_index", X.month_index("date_month"))
    for k in (1, 3, 12):
        w = df.select("territory_id", F.col("date_month").alias("target_date_month"), panel.calendar_lag("overnight_stays_total", k).alias("w"))
        both = panel.calendar_lag_join(w, df, "overnight_stays_total", k, "j")
        assert both.where("not (w <=> j)").count() == 0
        w = df.select("territory_id", F.col("date_month").alias("target_date_month"), panel.calendar_mean("overnight_stays_total", k).alias("w"))
        assert panel.calendar_mean_join(w, df, "overnight_stays_total", k, "j").where("not (w <=> j)").count() == 0


def test_changes(spark):
    df = spark.createDataFrame([(120.0, 100.0), (50.0, 0.0), (None, 20.0), (5.0, -10.0)], "c double, p double")
    got = [tuple(r) for r in df.select(X.pct_change_nonzero("c", "p"), X.pct_change_positive("c", "p"), X.safe_divide("c", "p")).collect()]
    assert got == [(20.0, 20.0, 1.2), (None, None, None), (None, None, None), (-150.0, None, None)]


def test_spanish_numbers_and_names(spark):
    rows = [("9.220", 9220.0), ("45,73", 45.73), (" 1.234,5\t", 1234.5), (".", None), ("..", None), ("", None), ("n/a", None), (None, None)]
    df = spark.createDataFrame(rows, "raw string, want double").select("want", X.spanish_number("raw").alias("got"))
    assert all(r.want == r.got for r in df.collect())
    t = spark.createDataFrame([("38 Santa Cruz de Tenerife ",), ("Total",)], "t string").select(X.territory_code("t"), X.territory_name("t")).collect()
    assert [tuple(r) for r in t] == [("38", "Santa Cruz de Tenerife"), (None, None)]


def test_percentile_rank_equals_pandas(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 3.0, None, 1.0, 9.0]
    pdf = pd.DataFrame({"m": ["x"] * 6 + ["y"] * 3, "v": values, "i": range(9)})
    df = spark.createDataFrame([(m, v, i) for m, v, i in zip(pdf.m, values, pdf.i)], "m string, v double, i long")
    got = {r.i: r.r for r in df.select("i", panel.percentile_rank_average("v", ["m"]).alias("r")).collect()}
    want = pdf.groupby("m").v.rank(pct=True, method="average") * 100
    assert all((got[i] is None and pd.isna(w)) or abs(got[i] - w) < 1e-12 for i, w in want.items())


def test_pressure_needs_all_parts(spark):
    rows = [("2024-08", 70.0, 12.0, 5.0, 75.0), ("2024-08", 65.0, 10.0, None, 70.0), ("2024-08", 80.0, 15.0, 8.0, 85.0)]
    df = spark.createDataFrame(rows, "month_id string, occupancy_rate_pct double, overnight_stays_per_place double, overnight_stays_yoy_change_pct double, weekend_occupancy_rate_pct double")
    got = [r.tourism_pressure_index for r in gold.with_pressure(df).orderBy("overnight_stays_per_place").collect()]
    assert got == [None, 65.5, 90.5]


def test_weighted_score_and_clip(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (120.0, -5.0)], "a double, b double")
    got = [tuple(r) for r in df.select(X.weighted_available_score([(F.col("a"), 0.6), (F.col("b"), 0.4)]), X.clip("a", 0, 100), X.clip("b", 0)).collect()]
    assert got[0] == (1.0, 1.0, None) and got[1] == (None, None, None) and got[2] == (pytest.approx(70.0), 100.0, 0.0)


def test_totals_need_both_residences(spark):
    rows = [("A", "2024-01", "travellers", "domestic", 3.0), ("A", "2024-01", "travellers", "foreign", 4.0), ("A", "2024-02", "travellers", "domestic", 3.0)]
    long = spark.createDataFrame([(*r, False) for r in rows], "territory_id string, month_id string, metric string, residence string, value double, is_provisional boolean")
    got = column(gold.demand_wide(long), "month_id", "travellers_total")
    assert got == {"2024-01": 7, "2024-02": None}


def test_split_later_fold_wins_and_flags(spark):
    folds = (Fold("validation_1", date(2024, 1, 1), date(2024, 6, 1)), Fold("test", date(2024, 6, 1), date(2024, 9, 1)))
    df = spark.createDataFrame([(date(2023, 12, 1),), (date(2024, 5, 1),), (date(2024, 6, 1),), (date(2024, 10, 1),)], "d date")
    assert [r[0] for r in df.select(features.evaluation_split("d", folds)).collect()] == ["train", "validation_1", "test", "train"]
    assert folds[0].train_end == date(2023, 12, 1) and folds[1].train_end == date(2024, 5, 1)
    base = {c: 1.0 for c in features.CORE}
    rows = [("A", date(2023, 1, 1), 1.0, False, None), ("A", date(2023, 6, 1), None, False, 1.0), ("A", date(2024, 2, 1), 1.0, False, None), ("A", date(2024, 3, 1), 1.0, False, 1.0), ("A", date(2024, 4, 1), 1.0, True, None)]
    df = spark.createDataFrame(rows, "territory_id string, d date, overnight_stays_total double, is_provisional boolean, lag_3_overnight_stays double")
    df = df.withColumns({k: F.lit(v) for k, v in base.items() if k != "lag_3_overnight_stays"})
    got = [r[0] for r in df.select(features.quality_flag("d").alias("f"), "d").orderBy("d").collect()]
    assert got == ["insufficient_history", "missing_target", "missing_lag", "ok", "provisional_target"]


def test_lag_family_is_one_window_sort(spark):
    names = {c for c, _, _ in features.LAGS}
    df = spark.createDataFrame([("A", date(2024, 1, 1), *[1.0] * len(names))], "territory_id string, date_month date, " + ", ".join(f"{n} double" for n in sorted(names)))
    plan = features.with_history(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 1 and "EvalPython" not in plan


def test_calendar_and_coverage(spark):
    dates = spark.createDataFrame([(date(2005, 1, 1),), (date(2026, 5, 1),)], "m date")
    cal = dims.calendar_dimension(dates, F.min("m"), F.max("m"), ("2020-03-01", "2021-12-01"), "2026-05-01", "now")
    assert cal.count() == 257 and tuple(panel.continuity(cal).first()) == (257, 0, 0)
    row = cal.where("month_id = '2020-07'").first()
    assert (row.season, row.is_summer, row.covid_period, row.quarter, row.is_easter_period) == ("summer", True, True, 3, None)
    got = [r[0] for r in spark.createDataFrame([(0.95,), (0.8,), (0.5,), (0.49,)], "r double").select(X.coverage_class("r")).collect()]
    assert got == ["high", "medium", "low", "insufficient"]


def test_checks_find_seeded_violations(spark):
    df = spark.createDataFrame([(1, -1.0, "a"), (2, 200.0, "b"), (None, None, "a")], "k int, v double, s string")
    checks = [*quality.not_null("k"), *quality.non_negative("v"), quality.in_range("v", 0, 100), quality.allowed("s", ["a"]), quality.one_value("s"), quality.rows_where("warned", F.col("v") > 100, "warn"), quality.rows_where("clean", F.col("v") > 1e6)]
    got = {r.check: (r.status, r.violations) for r in quality.run(df, checks).collect()}
    assert got == {"not_null:k": ("FAIL", 1), "non_negative:v": ("FAIL", 1), "range:v": ("FAIL", 2), "allowed:s": ("FAIL", 1), "single_value:s": ("FAIL", 1), "warned": ("WARN", 1), "clean": ("PASS", 0)}
    assert quality.exit_code(quality.run(df, checks)) == 1 and quality.exit_code(quality.run(df, checks[-2:])) == 0
    assert quality.unique_key(df.unionByName(df), ["k"]).first().violations == 3


def test_metrics_and_selection(spark):
    df = spark.createDataFrame([("a", 10.0, 12.0), ("a", 0.0, 0.0), ("b", 0.0, 1.0)], "evaluation_split string, actual double, prediction double")
    got = {r.split: r for r in evaluate.metrics_with_overall(evaluate.with_errors(df)).collect()}
    assert got["a"].mae == 1 and got["a"].wape_pct == 20 and got["b"].wape_pct is None and got["overall"].rows == 3 and got["a"].mean_bias == 1
    assert evaluate.select_model({"baseline": 5.0, "x": 4.9, "y": 6.0}) == "x" and evaluate.select_model({"baseline": 5.0, "x": 5.0}) == "baseline"
    with pytest.raises(ValueError):
        PanelConfig(numeric_features=("a", "a"))


def test_prediction_assertions(spark):
    cols = "territory_id string, target_month_id string, evaluation_split string, actual double, model_prediction double"
    good = spark.createDataFrame([("A", "2024-01", "test", 1.0, 1.0)], cols)
    evaluate.assert_predictions(good, ["test"])
    for bad in (good.unionByName(good), good.withColumn("model_prediction", F.lit(-1.0)), good.withColumn("actual", F.lit(None).cast("double"))):
        with pytest.raises(AssertionError):
            evaluate.assert_predictions(bad, ["test"])


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        panel.require_columns(df, ["k", "missing"])
    with pytest.raises(ValueError):
        panel.require_unique(df, ["k"])
    assert panel.first_per_key(df, ["k"], ["v"]).first().v == "a"
    assert explore.correlation(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None)], "a double, b double"), "a", "b").first().pairs == 2
