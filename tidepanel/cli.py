"""Command line: the steps from raw files to a promoted model, over a working folder."""

from __future__ import annotations

import argparse
import json
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel import schemas, session
from tidepanel.config import load_yaml
from tidepanel.functions import expr as X
from tidepanel.operators import dims, evaluate, explore, features, gates, gold, ml, normalize, panel, quality
from tidepanel.sources import io, report

STEPS = "download normalize dimensions gold validate features validate-model evaluate select final".split()
FEATURES = ["covid_period", "is_christmas_period", "is_summer", "quarter", "year", *features.HISTORY]
BOOLEAN = ["covid_period", "is_christmas_period", "is_summer"]
CATEGORICAL = ["territory_id", "month"]
KEYS = {"2073": ["territory_id", "metric", "residence", "month_id"], "2070": ["territory_id", "metric", "month_id"]}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidepanel")
    p.add_argument("step", choices=STEPS)
    p.add_argument("--source", choices=[*io.SOURCES, "all"], default="all")
    p.add_argument("--config", required=True, help="YAML with metrics, residences, units, territories and folds")
    p.add_argument("--folder", required=True)
    return p


class Run:
    """One step over a working folder."""

    def __init__(self, args: argparse.Namespace):
        self.args, self.spark = args, session.build()
        self.y, self.root = load_yaml(args.config), args.folder.rstrip("/")
        self.cfg = from_yaml_keys(self.y)
        self.now, self.run_id = datetime.now(timezone.utc).isoformat(), str(uuid.uuid4())
        self.folds = [f for f in self.cfg.folds if not f.name.startswith("provisional")]
        self.validation = [f.name for f in self.cfg.validation]

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def sources(self) -> list[str]:
        return [s for s in io.SOURCES if self.args.source in (s, "all")]

    def table(self, *parts: str, columns: list[str] | None = None) -> DataFrame:
        return io.read_table(self.spark, self.path(*parts), columns)

    def gated(self, df: DataFrame, name: str, order: list[str], check, single: bool = False) -> DataFrame:
        """Write, check what was written, and only then replace the last table."""
        staged = self.path("_staged", name)
        io.write_parquet(df, staged, order, single)
        gates.enforce(check(self.spark.read.parquet(staged)), name)
        io.replace(self.spark, staged, self.path(name))
        return self.spark.read.parquet(self.path(name))

    def summary(self, df: DataFrame, territory: str, month: str, columns: list[str]) -> None:
        print(explore.table_summary(df, territory, month, columns).first().asDict())

    # == steps
    def download(self) -> int:
        urls = self.y.get("urls", {})
        Path(self.path("raw")).mkdir(parents=True, exist_ok=True)
        for s in self.sources():
            source = io.SOURCES[s] if s not in urls else io.Source(s, io.SOURCES[s].name, io.SOURCES[s].provider, urls[s], io.SOURCES[s].label, io.SOURCES[s].parameters)
            file = io.download(source, self.path("raw"))
            io.append_log(self.spark, self.path("download_log"), source, file)
            print(f"{source.source_id}: {file.name}, {file.stat().st_size} bytes")
        return 0

    def normalize(self) -> int:
        territories = self.y.get("territories")
        for s in self.sources():
            columns = normalize.DEMAND_COLUMNS if s == "2073" else normalize.SUPPLY_COLUMNS
            path = io.latest_snapshot(self.spark, self.path("raw"), f"*_{io.SOURCES[s].label}.csv")
            digest = self.spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
            long = normalize.normalize(
                io.read_raw_csv(self.spark, path), columns, self.y[f"metrics_{s}"], self.y["residences"] if s == "2073" else None, self.y["units"],
                str(self.cfg.provisional_start), file_name=path.rsplit("/", 1)[-1], source_id=s, table_id=int(s), snapshot_id=digest, processed_at=self.now,
            )
            n = territories or long.agg(F.count_distinct("territory_id")).first()[0]
            done = self.gated(long, f"processed/{s}", ["territory_id", "metric", "month"], lambda df: gates.processed(df, KEYS[s], n))
            self.summary(done, "territory_id", "month_id", ["value"])
        return 0

    def processed(self) -> tuple[DataFrame, DataFrame]:
        return self.table("processed", "2073"), self.table("processed", "2070")

    def dimensions(self) -> int:
        demand, supply = self.processed()
        both = demand.unionByName(supply)
        cutoff = self.y.get("complete_before") or dims.complete_before(both.select("source_file_name").distinct(), "source_file_name")
        if cutoff is None:
            raise ValueError("no snapshot's name has a time: set complete_before")
        cal = dims.calendar_dimension(both, F.min("month"), F.max("month"), tuple(map(str, self.cfg.shock)), str(cutoff), self.now)
        cal = self.gated(cal, "calendar", ["month_id"], gates.calendar, single=True)
        source = both.select("territory_id", F.col("province_name").alias("territory_name"), F.col("province_code").alias("source_territory_code"), F.col("province_name").alias("source_territory_name")).distinct()
        community = self.y.get("communities", {})
        names = ("autonomous_community_id", "autonomous_community_name")
        source = source.withColumns({n: X.lookup("source_territory_code", {k: v[i] for k, v in community.items()}) if community else F.lit(None).cast("string") for i, n in enumerate(names)})
        n = self.y.get("territories") or source.select("territory_id").distinct().count()
        self.gated(dims.territory_dimension(source, demand, cal.count(), self.now), "territory", ["territory_id"], lambda df: gates.territories(df, n), single=True)
        return 0

    def gold(self) -> int:
        demand, supply = self.processed()
        ids = [panel.require_single(d, "source_snapshot_id", f"processed/{s}") for d, s in ((demand, "2073"), (supply, "2070"))]
        territory = self.table("territory").drop("is_rural_tourism_available", "first_available_month", "last_available_month", "generated_at_utc")
        calendar = self.table("calendar").drop("generated_at_utc")
        gates.enforce(gates.grid_keys(territory, calendar).unionByName(gates.joined_keys(demand, supply)), "inputs of the fact table")
        df = gold.build(demand, supply, territory, calendar, demand_snapshot=ids[0], supply_snapshot=ids[1], run_id=self.run_id, version="1.0.0", created_at=self.now)
        done = self.gated(df, "gold", ["territory_id", "month_id"], gates.facts)
        io.write_csv(done, self.path("gold_csv"))
        removed = territory.count() * calendar.count() - done.count()
        print(f"rows without a demand measure, left out: {removed}")
        self.summary(done, "territory_id", "month_id", ["travellers_total", "occupancy_rate_pct"])
        return 0

    def validate(self) -> int:
        facts, calendar = self.table("gold"), self.table("calendar")
        contract = quality.schema_contract(facts, schemas.GOLD)
        sections: dict = {"Contract": contract}
        if not contract.where("check = 'column_names' and status = 'FAIL'").isEmpty():
            report.write_report(self.path("quality.md"), "Fact table checks", sections)
            return 1
        territory = self.table("territory")
        checks = [*quality.gold_checks(), *quality.gold_dataset_checks(territory.count(), "province", calendar.agg(F.min("month_id")).first()[0]), *quality.context_unused(list(gold.CONTEXT))]
        results = quality.run(facts, checks).unionByName(quality.unique_key(facts, gold.KEY)).unionByName(quality.missing_months(facts, calendar, self.y.get("missing_months", [])))
        lost = [quality.orphans(facts, dimension, key).agg(F.lit(f"orphans:{key}").alias("check"), F.when(F.count("*") == 0, "PASS").otherwise("FAIL").alias("status"), F.lit("fail").alias("severity"), F.count("*").alias("violations")) for dimension, key in ((territory, "territory_id"), (calendar, "month_id"))]
        results = results.unionByName(lost[0]).unionByName(lost[1])
        if Path(self.path("download_log")).exists():
            snapshots = self.processed()[0].select("source_snapshot_id").unionByName(self.processed()[1].select("source_snapshot_id"))
            results = results.unionByName(io.traced(self.spark, snapshots, io.read_log(self.spark, self.path("download_log")), self.path("raw")))
        missing = quality.missing_pairs(facts, calendar)
        coverage = missing.agg(F.lit("territory_months").alias("check"), F.when(F.count("*") == 0, "PASS").otherwise("WARN").alias("status"), F.lit("warn").alias("severity"), F.count("*").alias("violations"))
        sections |= {"Checks": results.unionByName(coverage), "Missing values": quality.missingness(facts, gold.COLUMNS)}
        report.write_report(self.path("quality.md"), "Fact table checks", sections)
        io.write_csv(missing, self.path("missing_territory_months"))
        return max(quality.exit_code(contract), quality.exit_code(results))

    def features(self) -> int:
        df = features.build(self.table("gold", columns=gold.COLUMNS), self.cfg.folds, run_id=self.run_id, version="1.0.0", created_at=self.now)
        provisional = next((f.name for f in self.cfg.folds if f.name.startswith("provisional")), "provisional_monitoring")
        done = self.gated(df, "model", ["territory_id", "target_month_id"], lambda x: gates.modelling(x, self.cfg.folds, provisional))
        self.summary(done, "territory_id", "target_month_id", ["target_overnight_stays_total"])
        return 0

    def validate_model(self) -> int:
        model, facts = self.table("model"), self.table("gold")
        contract = quality.schema_contract(model, schemas.MODEL)
        sections: dict = {"Contract": contract}
        failed = quality.exit_code(contract)
        if contract.where("check = 'column_names' and status = 'FAIL'").isEmpty():
            provisional = next((f.name for f in self.cfg.folds if f.name.startswith("provisional")), "provisional_monitoring")
            results = quality.run(model, [*quality.model_value_checks(self.table("territory").count()), *quality.model_checks(self.cfg.folds, provisional)])
            results = results.unionByName(quality.unique_key(model, ["territory_id", "target_month_id", "forecast_horizon"])).unionByName(quality.temporal_integrity(facts, model, features.LAGS))
            sections |= {"Checks": results, "Splits and flags": explore.split_quality_counts(model)}
            failed = max(failed, quality.exit_code(results))
        report.write_report(self.path("model_quality.md"), "Modelling table checks", sections)
        return failed

    def model(self) -> DataFrame:
        """The modelling table with every column that a model reads."""
        return self.table("model", columns=features.COLUMNS)

    def evaluate(self) -> int:
        names = [f.name for f in self.folds]
        forecast = evaluate.baseline_forecast(self.model(), names).withColumns({"season": X.season("month"), "month_of_year": F.col("month")})
        by_split = evaluate.metrics_with_overall(forecast)
        io.write_csv(by_split, self.path("baseline_metrics"), decimals=6)
        for key in ("territory_id", "month_of_year", "season"):
            io.write_csv(evaluate.metrics(forecast, [key]), self.path(f"baseline_metrics_{key}"), decimals=6)
        report.write_report(self.path("evaluation.md"), "Seasonal-naive back-test", {"By split": evaluate.in_order(self.spark, by_split, [*names, "overall"]), "Coverage": evaluate.coverage(self.model(), names), "By season": evaluate.metrics(forecast, ["season"])})
        return 0

    def predictions(self, folds, alphas: list[float], boosted: bool) -> DataFrame:
        model = self.model()
        parts = [ml.ridge_predictions(model, folds, alphas, FEATURES, CATEGORICAL, BOOLEAN)] if alphas else []
        parts += [ml.boosted_predictions(model, folds, FEATURES, CATEGORICAL, BOOLEAN, **self.y.get("boosting", {}))] if boosted else []
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def select(self) -> int:
        """Every candidate on the validation folds; the best by pooled error if it beats the baseline."""
        folds = list(self.cfg.validation)
        io.write_parquet(self.predictions(folds, [float(a) for a in self.y.get("ridge_alphas", self.cfg.ridge_alphas)], True), self.path("selection_predictions"), ["model", "territory_id", "target_month_id"])
        p = self.table("selection_predictions")
        evaluate.assert_predictions(p, self.validation)
        metrics = session.stored(evaluate.split_metrics(p, self.validation), "metrics")
        io.write_csv(metrics.orderBy("model", "evaluation_split"), self.path("selection_metrics"), decimals=6)
        pooled = metrics.where("evaluation_split = 'validation_pooled'")
        mae = {r.model: r.mae for r in pooled.select("model", "mae").collect()}
        chosen = evaluate.select_model(mae)
        raw_negative = p.groupBy("model").agg(F.count_if(F.col("model_prediction_raw") < 0).alias("negative_before_clipping"))
        Path(self.path("selection.json")).write_text(json.dumps({"model": chosen, "mae": mae}, sort_keys=True), encoding="utf-8")
        report.write_report(self.path("selection.md"), "Model selection", {"Chosen": chosen, "Pooled over the validation folds": pooled.orderBy("mae"), "By fold": metrics.where("evaluation_split <> 'validation_pooled'").orderBy("model", "evaluation_split"), "Negative predictions": raw_negative})
        print(f"chosen: {chosen}")
        return 0

    def final(self) -> int:
        """The chosen candidate on all folds, the test included, and the rules of promotion."""
        chosen = json.loads(Path(self.path("selection.json")).read_text(encoding="utf-8"))["model"]
        if chosen == "baseline":
            report.write_report(self.path("final.md"), "Final evaluation", {"Outcome": "no candidate beats the baseline, which stays"})
            return 0
        alphas = [a for a in map(float, self.y.get("ridge_alphas", self.cfg.ridge_alphas)) if report.slug("ridge", a) == chosen]
        io.write_parquet(self.predictions(self.folds, alphas, not alphas), self.path("final_predictions"), ["evaluation_split", "territory_id", "target_month_id"])
        p = self.table("final_predictions")
        evaluate.assert_predictions(p, [f.name for f in self.folds])
        metrics = session.stored(evaluate.split_metrics(p, self.validation), "metrics")
        comparison = evaluate.comparison(metrics, "baseline", chosen)
        test = p.where("evaluation_split = 'test'")
        by_territory = evaluate.paired(test, ["territory_id", "territory_name"])
        by_month = evaluate.paired(test.withColumn("month", F.month("target_date_month")), ["month"])
        promotion = evaluate.promotion(p, self.validation, "test", self.cfg.minimum_improvement_pct)
        io.write_csv(metrics.orderBy("evaluation_split", "model"), self.path("final_metrics"), decimals=6)
        io.write_csv(by_territory.orderBy("territory_id"), self.path("final_test_by_territory"), decimals=6)
        io.write_csv(by_month.orderBy("month"), self.path("final_test_by_month"), decimals=6)
        report.write_report(self.path("final.md"), f"Final evaluation of {chosen}", {"Promotion": promotion, "By split": comparison.orderBy("evaluation_split"), "Best and worst territories": explore.best_and_worst(by_territory.drop("territory_name"), 5), "Test by month": by_month.orderBy("month")})
        print(promotion.first().asDict())
        return 0


def main(argv: list[str] | None = None) -> int:
    run = Run(parser().parse_args(argv))
    try:
        return getattr(run, run.args.step.replace("-", "_"))()
    except gates.GateError as stopped:
        print(stopped)
        return 1


def from_yaml_keys(y: dict):
    from datetime import date

    from tidepanel.config import Fold, PanelConfig

    folds = tuple(Fold(n, date.fromisoformat(str(s)), date.fromisoformat(str(e))) for n, (s, e) in y.get("folds", {}).items())
    return PanelConfig(folds=folds, provisional_start=date.fromisoformat(str(y.get("provisional_start", "2025-06-01"))))


if __name__ == "__main__":
    raise SystemExit(main())
