"""Files, normalisation end to end, and the regression candidates."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel import cli
from tidepanel.operators import ml, normalize
from tidepanel.operators.boosting import Boosting, edges
from tidepanel.sources import io, report
from tidepanel.streaming import follow, latest_revision

HEAD = "Provincias con mayor número de pernoctaciones;Viajeros y pernoctaciones;Residencia;Periodo;Total"
SUPPLY_HEAD = "Provincias con mayor número de pernoctaciones;Establecimientos y personal empleado (plazas);Periodo;Total"


def test_raw_to_long(spark, tmp_path):
    f = tmp_path / "20260101T101500Z_demand_2073.csv"
    f.write_text("﻿" + HEAD + "\n38 Santa Cruz;Viajero;Residentes en España;2026M05;1.234\n38 Santa Cruz;Viajero;Residentes en el Extranjero;2026M04;..\n", encoding="utf-8")
    (tmp_path / "20250101T101500Z_demand_2073.csv").write_text(HEAD + "\n")
    path = io.latest_snapshot(spark, str(tmp_path), "*_demand_2073.csv")
    assert path.endswith("20260101T101500Z_demand_2073.csv")
    raw = io.read_raw_csv(spark, path)
    assert raw.columns == HEAD.split(";")
    args = dict(provisional_start="2026-05-01", file_name=f.name, source_id="2073", table_id=2073, snapshot_id="h", processed_at="now")
    maps = ({"Viajero": "travellers"}, {"Residentes en España": "domestic", "Residentes en el Extranjero": "foreign"}, {"travellers": "people"})
    long = normalize.normalize(raw, normalize.DEMAND_COLUMNS, *maps, **args)
    assert long.columns == normalize.LONG_COLUMNS
    got = {r.month_id: (r.territory_id, r.residence, r.value, r.value_missing, r.quality_flag, r.data_status, r.unit) for r in long.collect()}
    assert got == {
        "2026-05": ("ES-PROV-38", "domestic", 1234.0, False, "ok", "provisional", "people"),
        "2026-04": ("ES-PROV-38", "foreign", None, True, "missing_value", "final_or_not_marked_provisional", "people"),
    }
    assert normalize.gates(long, ["territory_id", "metric", "residence", "month_id"], 1) == {"territories": 0, "negative": 0, "percent_range": 0, "duplicate_keys": 0}
    with pytest.raises(ValueError, match="source_metric"):
        normalize.normalize(raw, normalize.DEMAND_COLUMNS, {}, maps[1], maps[2], **args)
    bad = raw.withColumn("Periodo", F.lit("2026M13"))
    with pytest.raises(ValueError, match="source_period"):
        normalize.normalize(bad, normalize.DEMAND_COLUMNS, *maps, **args)
    digest = {r.file_name: r.file_hash for r in io.fingerprints(spark, str(tmp_path)).collect()}
    assert digest[f.name] == io.sha256_file(f)


def test_download_log_and_guards(spark, tmp_path):
    page = tmp_path / "page.csv"
    page.write_text("<html>" + "x;" * 400)
    with pytest.raises(ValueError):
        io.validate_download(page)
    data = tmp_path / "data.csv"
    data.write_text("a;b\n" + "1;2\n" * 200)
    source = io.Source("1", "n", "p", data.as_uri(), "lab")
    (tmp_path / "raw").mkdir()
    got = io.download(source, tmp_path / "raw")
    assert got.read_bytes() == data.read_bytes() and not list((tmp_path / "raw").glob("*.part"))
    for _ in range(2):
        io.append_log(spark, str(tmp_path / "log"), source, got)
    log = io.read_log(spark, str(tmp_path / "log"))
    assert log.count() == 2 and log.first().file_hash == io.sha256_file(data)
    ids = spark.createDataFrame([(io.sha256_file(data),), ("unknown",)], "source_snapshot_id string")
    assert [r[0] for r in io.unregistered(ids, log).collect()] == ["unknown"]
    with pytest.raises(ValueError):
        io.validate_download(next(tmp_path.glob("raw/*")), least=10**6)


def test_sinks_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, date(2024, 1, 1)), (2, None, None)], "k int, v double, d date")
    io.write_csv(df, str(tmp_path / "c"), decimals=6)
    text = next((tmp_path / "c").glob("*.csv")).read_text().split()
    assert text == ["k,v,d", "1,2.500000,2024-01-01", "2,,"] or text == ["k,v,d", '1,2.500000,2024-01-01', '2,"",""']
    io.write_parquet(df, str(tmp_path / "p"), ["k"], single=True)
    assert io.read_table(spark, str(tmp_path / "p"), ["k"]).count() == 2
    with pytest.raises(ValueError):
        io.read_table(spark, str(tmp_path / "p"), ["zzz"])
    report.write_report(tmp_path / "r.md", "T", {"S": df, "N": report.spanish(1234.5)})
    assert "| 1 | 2.500000 | 2024-01-01 |" in (tmp_path / "r.md").read_text() and "1.234,50" in (tmp_path / "r.md").read_text()
    assert report.slug("ridge", 0.01) == "ridge_alpha_0_01"


def test_micro_batches(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "k string, published int, v double")
    df.write.parquet(str(tmp_path / "in"))
    q = follow(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), ["k"], "published", str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = latest_revision(spark.read.parquet(str(tmp_path / "out")), ["k"], "published").collect()
    assert sorted((r.k, r.v) for r in got) == [("a", 2.0), ("b", 3.0)]


def ridge_closed_form(x, y, alpha):
    x = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ (y - y.mean()))
    return x @ w + y.mean()


@pytest.mark.parametrize("alpha", [0.1, 100.0])
def test_ridge_equals_the_closed_form(spark, alpha):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) * [1, 10, 100]
    y = x @ [3.0, -1.0, 0.2] + rng.normal(size=60) + 50
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    rows[4] = (None, *rows[4][1:])
    df = spark.createDataFrame(rows, "a double, b double, c double, actual double")
    got = [r.model_prediction_raw for r in ml.Ridge(["a", "b", "c"], [], alpha).fit(df).transform(df).collect()]
    missing = np.zeros(60)
    missing[4] = 1
    x[4, 0] = np.median(np.delete(x[:, 0], 4))
    want = ridge_closed_form(np.column_stack([x, missing]), y, alpha)
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-6


def test_the_grid_equals_single_fits(spark):
    from tidepanel.config import Fold

    fold = Fold("test", date(2023, 1, 1), date(2023, 12, 1))
    rng = np.random.default_rng(8)
    rows = [(t, t, f"{y}-{m:02d}", date(y, m, 1), "train" if y < 2023 else "test", float(m * 3 + 10 * (t == "B") + rng.normal()), float(m), False, m) for t in "AB" for y in range(2020, 2024) for m in range(1, 13)]
    names = "territory_id string, territory_name string, target_month_id string, target_date_month date, evaluation_split string, target_overnight_stays_total double, lag_12_overnight_stays double, is_provisional boolean, month int"
    df = spark.createDataFrame(rows, names)
    got = {(r.model, r.territory_id, r.target_month_id): r.model_prediction_raw for r in ml.ridge_predictions(df, [fold], [0.1, 100.0], ["lag_12_overnight_stays"], ["territory_id"]).collect()}
    assert len(got) == 48
    prepared = ml._rows(df, ["lag_12_overnight_stays"], ["territory_id"], [])
    for alpha in (0.1, 100.0):
        one = ml.Ridge(["lag_12_overnight_stays"], ["territory_id"], alpha).fit(prepared.where("evaluation_split = 'train'"))
        for r in one.transform(prepared.where("evaluation_split = 'test'")).collect():
            assert abs(got[report.slug("ridge", alpha), r.territory_id, r.target_month_id] - r.model_prediction_raw) < 1e-9


def test_unseen_category_is_all_zeros(spark):
    train = spark.createDataFrame([("x", 1.0, 1.0), ("y", 2.0, 2.0), ("x", 3.0, 1.5), ("y", 4.0, 3.0)], "c string, a double, actual double")
    model = ml.Ridge(["a"], ["c"], 1.0).fit(train)
    row = model.transform(spark.createDataFrame([("new", 2.0)], "c string, a double")).first()
    assert math.isfinite(row.model_prediction_raw) and row["c_v"].numNonzeros() == 0


def raw_files(raw, years=3, spoil=""):
    raw.mkdir()
    demand, supply = [HEAD], [SUPPLY_HEAD]
    for k in range(12 * years):
        y, m = divmod(k, 12)
        for code, size in (("01 Araba", 10), ("38 Tenerife", 30)):
            p = f"{2022 + y}M{m + 1:02d}"
            for metric in ("Viajero", "Pernoctaciones"):
                for res in ("Residentes", "Extranjero"):
                    demand.append(f"{code};{metric};{res};{p};{size + k % 12}.{100 + 13 * (k % 7)}{spoil}")
            supply += [f"{code};{n};{p};{10 + k % 7},5" for n in NAMES]
    (raw / "20260105T000000Z_demand_2073.csv").write_text("\n".join(demand) + "\n", encoding="utf-8")
    (raw / "20260217T000000Z_supply_2070.csv").write_text("\n".join(supply) + "\n", encoding="utf-8")


NAMES = {"establecimientos": "establishments_estimated", "plazas": "places_estimated", "ocupacion": "occupancy_rate_pct", "fin de semana": "weekend_occupancy_rate_pct", "habitaciones": "room_occupancy_rate_pct", "personal": "staff_employed"}


def config_file(tmp_path):
    config = tmp_path / "c.yml"
    config.write_text(
        "metrics_2073: {Viajero: travellers, Pernoctaciones: overnight_stays}\nresidences: {Residentes: domestic, Extranjero: foreign}\nunits: {travellers: people}\n"
        "metrics_2070: {" + ", ".join(f"{a}: {b}" for a, b in NAMES.items()) + "}\nprovisional_start: 2024-09-01\ncommunities: {'01': [PV, Euskadi], '38': [CN, Canarias]}\nterritories: 2\n"
        "folds: {validation_1: [2023-07-01, 2023-10-01], validation_2: [2023-11-01, 2024-02-01], test: [2024-03-01, 2024-08-01], provisional_monitoring: [2024-09-01, 2024-12-01]}\n"
        "ridge_alphas: [1.0, 100.0]\nboosting: {iterations: 20, min_leaf: 2}\n",
        encoding="utf-8",
    )
    return config


def step(name, config, folder):
    return cli.main([name, "--config", str(config), "--folder", str(folder)])


def test_command_line_end_to_end(spark, tmp_path):
    raw_files(tmp_path / "origin")
    config = config_file(tmp_path)
    with config.open("a") as f:
        f.write(f"urls: {{'2073': '{(tmp_path / 'origin/20260105T000000Z_demand_2073.csv').as_uri()}', '2070': '{(tmp_path / 'origin/20260217T000000Z_supply_2070.csv').as_uri()}'}}\n")
    assert [step(s, config, tmp_path) for s in cli.STEPS] == [0] * len(cli.STEPS)
    facts = spark.read.parquet(str(tmp_path / "gold"))
    assert facts.count() == 72 and (tmp_path / "gold_csv").exists() and not list((tmp_path / "_staged").glob("*/*.parquet"))
    flags = {r.data_quality_flag: r["count"] for r in spark.read.parquet(str(tmp_path / "model")).groupBy("data_quality_flag").count().collect()}
    assert flags == {"insufficient_history": 24, "ok": 40, "provisional_target": 8}
    assert "overall" in (tmp_path / "evaluation.md").read_text() and "snapshot_hash | PASS" in (tmp_path / "quality.md").read_text()
    assert "recomputed:lag_12_overnight_stays | PASS" in (tmp_path / "model_quality.md").read_text()
    selected = spark.read.parquet(str(tmp_path / "selection_predictions"))
    assert {r[0] for r in selected.select("model").distinct().collect()} == {"ridge_alpha_1", "ridge_alpha_100", "boosted_trees"}
    assert selected.where("evaluation_split = 'test'").count() == 0 and selected.count() == 3 * 16
    assert (tmp_path / "final.md").exists()
    # a file that changed since it was logged
    (file,) = (tmp_path / "raw").glob("*_demand_2073.csv")
    file.write_text(file.read_text() + "\n")
    assert step("validate", config, tmp_path) == 1 and "snapshot_hash | FAIL" in (tmp_path / "quality.md").read_text()


def test_gates_stop_a_build(spark, tmp_path):
    config = config_file(tmp_path)
    raw_files(tmp_path / "raw", years=1, spoil=",5")
    assert [step(s, config, tmp_path) for s in ("normalize", "dimensions")] == [0, 0]
    with pytest.raises(Exception, match="not a whole number"):
        step("gold", config, tmp_path)
    assert not (tmp_path / "gold").exists()
    # complete months end with the month of the newest file
    assert spark.read.parquet(str(tmp_path / "calendar")).where("complete_month_available").count() == 12
    long = spark.read.parquet(str(tmp_path / "processed/2073"))
    long.withColumn("value", F.floor("value").cast("double")).write.parquet(str(tmp_path / "whole"))
    long = spark.read.parquet(str(tmp_path / "whole"))
    for bad, match in ((long.withColumn("source_snapshot_id", F.when(F.col("month_number") == 1, "other").otherwise("one")), "distinct values"), (long.unionByName(long.limit(1)), None)):
        bad.write.mode("overwrite").parquet(str(tmp_path / "processed/2073"))
        if match:
            with pytest.raises(ValueError, match=match):
                step("gold", config, tmp_path)
        else:
            assert step("gold", config, tmp_path) == 1
        assert not (tmp_path / "gold").exists()
    long.write.mode("overwrite").parquet(str(tmp_path / "processed/2073"))
    assert step("gold", config, tmp_path) == 0
    (tmp_path / "raw/20260105T000000Z_demand_2073.csv").write_text(HEAD + "\n01 Araba;Viajero;Residentes;2022M01;-5\n")
    assert step("normalize", config, tmp_path) == 1
    assert spark.read.parquet(str(tmp_path / "processed/2073")).count() == long.count()


# == boosting
def test_boosting_equals_greedy_search():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    x[rng.random((60, 3)) < 0.1] = np.nan
    y = np.nan_to_num(x[:, 0], nan=2) * 3 + np.nan_to_num(x[:, 1], nan=9) + rng.normal(size=60)
    got = Boosting(iterations=1, rate=1.0, leaves=4, min_leaf=5, l2=1.0).fit(x, y).predict(x)
    g, parts = y.mean() - y, [np.arange(60)]

    def best(rows):
        out = (0.0, None)
        score = lambda r: g[r].sum() ** 2 / (len(r) + 1)
        for k in range(3):
            known = np.unique(x[rows, k][~np.isnan(x[rows, k])])
            for cut in known:
                for missing in (False, True):
                    left = np.where(np.isnan(x[rows, k]), missing, x[rows, k] <= cut)
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) >= 5 and score(a) + score(b) - score(rows) > out[0] + 1e-9:
                        out = (score(a) + score(b) - score(rows), (a, b))
        return out

    while len(parts) < 4:
        found = [best(r) for r in parts]
        k = max(range(len(parts)), key=lambda i: found[i][0])
        if found[k][1] is None:
            break
        parts[k : k + 1] = found[k][1]
    want = np.empty(60)
    for r in parts:
        want[r] = y.mean() - g[r].sum() / (len(r) + 1)
    assert np.allclose(got, want) and len(parts) == 4


def test_boosting_learns_and_bins():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 4))
    x[::9, 2] = np.nan
    y = np.where(x[:, 0] > 0.3, 5.0, -5.0) + 2 * np.sin(x[:, 1]) + np.isnan(x[:, 2]) * 3
    fitted = Boosting().fit(x[:1500], y[:1500])
    assert np.abs(fitted.predict(x[1500:]) - y[1500:]).mean() < 0.3 and all(len(c) <= 254 for c in fitted.cuts)
    assert edges(np.array([1.0, 3.0, np.nan])).tolist() == [2.0] and edges(np.array([np.nan])).tolist() == []
    assert Boosting().fit(x[:10], np.ones(10)).predict(x[:3]).tolist() == [1.0, 1.0, 1.0]


def test_boosted_folds_see_their_past_only(spark):
    from tidepanel.config import Fold

    folds = [Fold("validation_1", date(2023, 1, 1), date(2023, 6, 1)), Fold("test", date(2023, 7, 1), date(2023, 12, 1))]
    rows = [(t, t, f"{y}-{m:02d}", date(y, m, 1), "train" if y < 2023 else "validation_1" if m < 7 else "test", float(m + 10 * (t == "B") + (1000 if (y, m) >= (2023, 7) else 0)), float(m), False, t, m) for t in "AB" for y in range(2018, 2024) for m in range(1, 13)]
    names = "territory_id string, territory_name string, target_month_id string, target_date_month date, evaluation_split string, target_overnight_stays_total double, lag_12_overnight_stays double, is_provisional boolean, kind string, month int"
    p = ml.boosted_predictions(spark.createDataFrame(rows, names), folds, ["lag_12_overnight_stays"], ["kind"], iterations=60, min_leaf=2).collect()
    assert len(p) == 24 and all(r.model_prediction < 100 for r in p)
    assert np.mean([abs(r.model_prediction - r.actual) for r in p if r.evaluation_split == "validation_1"]) < 1.5
