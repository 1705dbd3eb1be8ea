"""Regression candidates over expanding folds.

``Ridge`` fits one model of any size with ``pyspark.ml``. A back-test fits many small ones:
a fold has a few thousand rows, which more years and not more data make longer, so that
each fold is a task that fits all its candidates, and the folds run side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.config import Fold
from tidepanel.functions import expr as X
from tidepanel.operators import evaluate
from tidepanel.operators.boosting import Boosting
from tidepanel.sources.report import slug

KEYS = "evaluation_split target_date_month target_month_id territory_id territory_name".split()


def prepared(df: DataFrame, numeric: list[str], categorical: list[str], boolean: list[str] = []) -> DataFrame:
    """Booleans as 0/1 (NULL is 0), categories with 'missing', numbers as doubles without NaN."""
    casts = {x: F.coalesce(F.col(x), F.lit(False)).cast("int").cast("double") for x in boolean}
    casts |= {x: F.coalesce(F.col(x).cast("string"), F.lit("missing")) for x in categorical}
    casts |= {x: X.known(F.col(x).cast("double")) for x in numeric if x not in boolean}
    return df.withColumns(casts)


def encoder(categorical: list[str]) -> list:
    """One-hot stages in which a category unseen in training is all zeros."""
    index = StringIndexer(inputCols=categorical, outputCols=[f"{x}_i" for x in categorical], handleInvalid="keep")
    return [index, OneHotEncoder(inputCols=[f"{x}_i" for x in categorical], outputCols=[f"{x}_v" for x in categorical], dropLast=True)]


class Ridge:
    """min RSS + alpha |w|^2 over median-imputed, indicated, standardised features.

    Medians are exact, standard deviations those of the population, and a missing
    indicator exists for the features that have NULLs in training.
    """

    def __init__(self, numeric: list[str], categorical: list[str], alpha: float):
        self.numeric, self.categorical, self.alpha = list(numeric), list(categorical), alpha

    def _design(self, df: DataFrame) -> DataFrame:
        out = df
        for x in self.numeric:
            out = out.withColumn(f"{x}_f", (F.coalesce(F.col(x), F.lit(self.median[x])) - self.mean[x]) / self.scale[x])
        for x in self.indicated:
            out = out.withColumn(f"{x}_m", (F.col(x).isNull().cast("double") - self.mean[f"{x}?"]) / self.scale[f"{x}?"])
        return out

    def fit(self, train: DataFrame, label: str = "actual") -> Ridge:
        med = train.agg(*(F.percentile(x, 0.5).alias(x) for x in self.numeric), *(F.count_if(F.col(x).isNull()).alias(f"{x}?") for x in self.numeric)).first()
        self.median = {x: med[x] if med[x] is not None else 0.0 for x in self.numeric}
        self.indicated = [x for x in self.numeric if med[f"{x}?"]]
        filled = [(x, F.coalesce(F.col(x), F.lit(self.median[x]))) for x in self.numeric] + [(f"{x}?", F.col(x).isNull().cast("double")) for x in self.indicated]
        stats = train.agg(
            *(F.avg(e).alias(f"m{i}") for i, (_, e) in enumerate(filled)), *(F.stddev_pop(e).alias(f"s{i}") for i, (_, e) in enumerate(filled)),
            F.stddev_pop(label).alias("sy"), F.count("*").alias("n"),
        ).first()
        self.mean = {n: stats[f"m{i}"] for i, (n, _) in enumerate(filled)}
        self.scale = {n: stats[f"s{i}"] or 1.0 for i, (n, _) in enumerate(filled)}
        inputs = [f"{x}_f" for x in self.numeric] + [f"{x}_m" for x in self.indicated] + [f"{x}_v" for x in self.categorical]
        linear = LinearRegression(
            labelCol=label, featuresCol="features", predictionCol="model_prediction_raw", solver="normal", elasticNetParam=0.0, standardization=False,
            regParam=self.alpha * (stats["sy"] or 1.0) / stats["n"],
        )
        stages = (encoder(self.categorical) if self.categorical else []) + [VectorAssembler(inputCols=inputs, outputCol="features"), linear]
        self.model = Pipeline(stages=stages).fit(self._design(train))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._design(df))


def _named(predicted: DataFrame, name: Column) -> DataFrame:
    """Clipped at zero; the raw prediction is kept."""
    return predicted.select(
        *KEYS, name.alias("model"), "actual", F.col("lag_12_overnight_stays").alias("baseline_prediction"),
        "model_prediction_raw", X.clip("model_prediction_raw", low=0).alias("model_prediction"),
    )


def _rows(model: DataFrame, numeric: list[str], categorical: list[str], boolean: list[str]) -> DataFrame:
    return prepared(model.where(evaluate.evaluable()), numeric, categorical, boolean).withColumn("actual", F.col("target_overnight_stays_total"))


def _by_fold(model: DataFrame, folds: list[Fold], numeric: list[str], categorical: list[str], boolean: list[str], predict) -> DataFrame:
    """``predict(train, rest)`` of each fold's past and rows, a task a fold; it returns (model, raw predictions) pairs."""
    df = _rows(model, numeric, categorical, boolean)
    roles = [F.when(F.col("target_date_month") <= F.lit(f.train_end), F.struct(F.lit(f.name).alias("fold"), F.lit(True).alias("train"))) for f in folds]
    roles += [F.when(F.col("evaluation_split") == f.name, F.struct(F.lit(f.name).alias("fold"), F.lit(False).alias("train"))) for f in folds]
    kept, more = [*KEYS, "actual", "lag_12_overnight_stays"], [*numeric, *categorical]
    used = df.withColumn("role", F.explode(F.array_compact(F.array(*roles)))).select(*dict.fromkeys([*kept, *more]), "role.*")

    def run(rows):
        rows = rows.sort_values(["territory_id", "target_date_month"])
        train, rest = rows[rows["train"]], rows[~rows["train"]]
        if not len(rest):
            return rest[kept].assign(model_name="", model_prediction_raw=0.0)
        if not len(train):
            raise ValueError(f"{rest['fold'].iloc[0]}: no training rows")
        return pd.concat([rest[kept].assign(model_name=name, model_prediction_raw=raw) for name, raw in predict(train, rest)])

    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", model_name string, model_prediction_raw double"
    return _named(used.groupBy("fold").applyInPandas(run, schema), F.col("model_name"))


def _one_hot(train: pd.DataFrame, part: pd.DataFrame, categorical: list[str]) -> list[np.ndarray]:
    """A column for each category that the training rows have: an unseen one is all zeros."""
    return [(part[c] == v).to_numpy(float) for c in categorical for v in sorted(train[c].unique())]


def ridge_predictions(model: DataFrame, folds: list[Fold], alphas: list[float], numeric: list[str], categorical: list[str], boolean: list[str] = []) -> DataFrame:
    """Every alpha on every fold: ``Ridge`` in closed form, all alphas of a fold from one eigen-decomposition."""

    def predict(train, rest):
        x = {k: train[k].to_numpy(float) for k in numeric}
        median = {k: float(np.nanmedian(v)) if not np.isnan(v).all() else 0.0 for k, v in x.items()}
        indicated = [k for k in numeric if np.isnan(x[k]).any()]

        def design(part):
            cols = [np.where(np.isnan(v), median[k], v) for k, v in ((k, part[k].to_numpy(float)) for k in numeric)]
            return np.column_stack([*cols, *(np.isnan(part[k].to_numpy(float)).astype(float) for k in indicated)])

        scaled = design(train)
        mean, scale = scaled.mean(axis=0), scaled.std(axis=0)
        scale[scale == 0] = 1.0
        full = lambda part: np.column_stack([(design(part) - mean) / scale, *_one_hot(train, part, categorical)])
        a, y = full(train), train["actual"].to_numpy(float)
        center = a.mean(axis=0)
        values, vectors = np.linalg.eigh((a - center).T @ (a - center))
        right, b = vectors.T @ ((a - center).T @ (y - y.mean())), full(rest) - center
        return [(slug("ridge", alpha), b @ (vectors @ (right / (np.maximum(values, 0.0) + alpha))) + y.mean()) for alpha in alphas]

    return _by_fold(model, folds, numeric, categorical, boolean, predict)


def boosted_predictions(
    model: DataFrame, folds: list[Fold], numeric: list[str], categorical: list[str], boolean: list[str] = [], name: str = "boosted_trees", **settings
) -> DataFrame:
    """Boosted trees on every fold, fitted on the fold's past."""

    def predict(train, rest):
        matrix = lambda part: np.column_stack([*(part[k].to_numpy(float) for k in numeric), *_one_hot(train, part, categorical)])
        return [(name, Boosting(**settings).fit(matrix(train), train["actual"].to_numpy(float)).predict(matrix(rest)))]

    return _by_fold(model, folds, numeric, categorical, boolean, predict)
