"""Forecast metrics, paired comparisons, selection and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.config import Fold
from tidepanel.functions import expr as X


def evaluable() -> Column:
    """Target and lag 12 known, target not provisional."""
    return X.all_present("target_overnight_stays_total", "lag_12_overnight_stays") & ~F.coalesce("is_provisional", F.lit(False))


def train_rows(model: DataFrame, fold: Fold) -> DataFrame:
    return model.where((F.col("target_date_month") <= F.lit(fold.train_end)) & evaluable())


def fold_rows(model: DataFrame, fold: Fold) -> DataFrame:
    return model.where((F.col("evaluation_split") == fold.name) & evaluable())


def baseline_forecast(model: DataFrame, splits: list[str]) -> DataFrame:
    """Seasonal-naive predictions with their errors."""
    df = model.where(F.col("evaluation_split").isin(*splits) & evaluable())
    return with_errors(df.withColumns({"actual": F.col("target_overnight_stays_total"), "prediction": F.col("lag_12_overnight_stays")}))


def with_errors(df: DataFrame) -> DataFrame:
    error = F.col("prediction") - F.col("actual")
    return df.withColumns({"error": error, "absolute_error": F.abs(error), "squared_error": error * error})


def metric_columns(actual: str = "actual", prediction: str = "prediction", prefix: str = "") -> list[Column]:
    """rows-free metrics; bias is prediction minus actual, WAPE in percent of absolute actuals."""
    e = F.col(prediction) - F.col(actual)
    total = F.sum(F.abs(F.col(actual)))
    return [
        F.avg(F.abs(e)).alias(f"{prefix}mae"),
        F.sqrt(F.avg(e * e)).alias(f"{prefix}rmse"),
        F.when(total != 0, F.sum(F.abs(e)) / total * 100).alias(f"{prefix}wape_pct"),
        F.avg(e).alias(f"{prefix}mean_bias"),
    ]


def metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    keyed = df
    for k in keys:
        keyed = keyed.where(F.col(k).isNotNull())
    return keyed.groupBy(*keys).agg(F.count("*").alias("rows"), *metric_columns())


def metrics_with_overall(df: DataFrame, split: str = "evaluation_split") -> DataFrame:
    """By split, and over all of them in one pass (the overall row includes the test split)."""
    out = df.rollup(split).agg(F.count("*").alias("rows"), *metric_columns())
    return out.withColumn("split", F.coalesce(split, F.lit("overall"))).drop(split)


def in_order(spark: SparkSession, df: DataFrame, splits: list[str], column: str = "split") -> DataFrame:
    """Rows for the listed splits in that order; a split without rows is a row of NULLs."""
    listed = spark.createDataFrame([(i, s) for i, s in enumerate(splits)], f"position int, {column} string")
    return listed.join(F.broadcast(df), column, "left")  # ``df`` has a row a split


def coverage(model: DataFrame, splits: list[str]) -> DataFrame:
    """Rows, known targets, known lags, provisional and evaluable rows by split."""
    return model.where(F.col("evaluation_split").isin(*splits)).groupBy("evaluation_split").agg(
        F.count("*").alias("rows"),
        F.count("target_overnight_stays_total").alias("with_target"),
        F.count("lag_12_overnight_stays").alias("with_lag_12"),
        F.count_if(F.coalesce("is_provisional", F.lit(False))).alias("provisional"),
        F.count_if(evaluable()).alias("evaluable"),
    )


def pooled(predictions: DataFrame, splits: list[str]) -> DataFrame:
    """By model over all the splits together, and the baseline once."""
    p = predictions.where(F.col("evaluation_split").isin(*splits))
    models = p.groupBy("model").agg(F.count("*").alias("rows"), *metric_columns("actual", "model_prediction"))
    keys = ["territory_id", "target_month_id", "evaluation_split"]
    once = p.groupBy(*keys).agg(F.first("actual").alias("actual"), F.first("baseline_prediction").alias("prediction"))
    return models.unionByName(once.agg(F.lit("baseline").alias("model"), F.count("*").alias("rows"), *metric_columns()))


def paired(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline and model metrics side by side, with the improvement in MAE."""
    both = predictions.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        *metric_columns("actual", "baseline_prediction", "baseline_"),
        *metric_columns("actual", "model_prediction", "model_"),
    )
    return both.withColumns({
        "mae_improvement_pct": X.improvement_pct("baseline_mae", "model_mae"),
        "model_improves": F.col("model_mae") < F.col("baseline_mae"),
    })


def comparison(metric_rows: DataFrame, baseline: str, model: str) -> DataFrame:
    """Metrics by split of two models in one row each, from a long metric table."""
    side = lambda name, p: metric_rows.where(F.col("model") == name).select("evaluation_split", F.col("mae").alias(f"{p}_mae"), F.col("rmse").alias(f"{p}_rmse"))
    out = side(baseline, "baseline").join(side(model, "model"), "evaluation_split")
    return out.withColumns({
        "mae_improvement_pct": X.improvement_pct("baseline_mae", "model_mae"),
        "rmse_improvement_pct": X.improvement_pct("baseline_rmse", "model_rmse"),
    })


def promotion(predictions: DataFrame, validation: list[str], test: str, minimum_pct: float = 5.0) -> DataFrame:
    """Three rules and their conjunction: pooled validation, test, and most territories."""
    split = F.col("evaluation_split")
    part = lambda cond, name, pred: F.avg(F.when(cond, F.abs(F.col(pred) - F.col("actual")))).alias(name)
    val = split.isin(*validation)
    one = predictions.agg(
        part(val, "vb", "baseline_prediction"), part(val, "vm", "model_prediction"),
        part(split == test, "tb", "baseline_prediction"), part(split == test, "tm", "model_prediction"),
    )
    by = paired(predictions.where(split == test), ["territory_id"]).agg(F.count("*").alias("territories"), F.count_if("model_improves").alias("territories_improved"))
    v, t = X.improvement_pct("vb", "vm"), X.improvement_pct("tb", "tm")
    return one.crossJoin(by).select(
        v.alias("validation_improvement_pct"),
        t.alias("test_improvement_pct"),
        "territories",
        "territories_improved",
        F.coalesce(v >= minimum_pct, F.lit(False)).alias("validation_pass"),
        F.coalesce(t >= minimum_pct, F.lit(False)).alias("test_pass"),
        (F.col("territories_improved") * 2 > F.col("territories")).alias("majority_pass"),
    ).withColumn("promoted", F.col("validation_pass") & F.col("test_pass") & F.col("majority_pass"))


def split_metrics(predictions: DataFrame, validation: list[str]) -> DataFrame:
    """(model, evaluation_split, rows, metrics) of every model and the baseline, and over the validation splits pooled."""
    side = lambda name, column: F.struct(name.alias("model"), F.col(column).alias("prediction"))
    keys = ["territory_id", "target_month_id", "evaluation_split"]
    models = predictions.select(*keys, "actual", side(F.col("model"), "model_prediction").alias("s"))
    once = predictions.groupBy(*keys).agg(F.first("actual").alias("actual"), F.first("baseline_prediction").alias("baseline_prediction"))
    both = models.unionByName(once.select(*keys, "actual", side(F.lit("baseline"), "baseline_prediction").alias("s"))).select("evaluation_split", "actual", "s.*")
    pooled_rows = F.array(F.col("evaluation_split"), F.when(F.col("evaluation_split").isin(*validation), "validation_pooled"))
    return metrics(both.withColumn("evaluation_split", F.explode(F.array_compact(pooled_rows))), ["model", "evaluation_split"])


def select_model(pooled_mae: dict[str, float], baseline: str = "baseline") -> str:
    """Best candidate by pooled MAE if it improves on the baseline at all, else the baseline."""
    candidates = {k: v for k, v in pooled_mae.items() if k != baseline and v is not None}
    if not candidates:
        return baseline
    best = min(sorted(candidates), key=candidates.get)
    return best if candidates[best] < pooled_mae[baseline] else baseline


def assert_predictions(predictions: DataFrame, splits: list[str]) -> None:
    """Splits complete, keys unique, values known and not negative; raises otherwise."""
    row = predictions.agg(
        F.collect_set("evaluation_split").alias("splits"),
        F.count_if(~X.all_present("actual", "model_prediction")).alias("missing"),
        F.count_if(F.col("model_prediction") < 0).alias("negative"),
    ).first()
    keys = ["territory_id", "target_month_id", "evaluation_split", *(["model"] if "model" in predictions.columns else [])]
    repeated = predictions.groupBy(*keys).count().where("count > 1").limit(1).count()
    if set(row["splits"]) != set(splits) or row["missing"] or row["negative"] or repeated:
        raise AssertionError(f"predictions: {row.asDict()}, repeated keys: {bool(repeated)}")
