"""Raw statistics to the typed long table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.operators.panel import require_columns

TERRITORY, PERIOD, VALUE = "Provincias con mayor número de pernoctaciones", "Periodo", "Total"
_SHARED = {TERRITORY: "source_territory", PERIOD: "source_period", VALUE: "source_value_raw"}
DEMAND_COLUMNS = _SHARED | {"Viajeros y pernoctaciones": "source_metric"} | {"Residencia": "source_residence"}
SUPPLY_COLUMNS = _SHARED | {"Establecimientos y personal empleado (plazas)": "source_metric"}
LONG_COLUMNS = (
    "territory_id territory_level country_code province_code province_name metric source_metric residence source_residence month_id month year "
    "month_number value unit source_value_raw value_missing quality_flag data_status is_provisional source_id source_table_id source_file_name "
    "source_snapshot_id processed_at_utc"
).split()


def renamed(raw: DataFrame, mapping: dict[str, str]) -> DataFrame:
    require_columns(raw, list(mapping), "raw file")
    return raw.select(*(F.col(f"`{a}`").alias(b) for a, b in mapping.items()))


def unmapped(df: DataFrame, source: str, target: str) -> list[str]:
    """Distinct source categories without a code."""
    return sorted(r[0] for r in df.where(F.col(target).isNull() & F.col(source).isNotNull()).select(source).distinct().collect())


def malformed_periods(df: DataFrame, column: str = "source_period") -> DataFrame:
    return df.where(~F.coalesce(X.is_period(column), F.lit(False))).select(column).distinct()


def add_territory(df: DataFrame) -> DataFrame:
    code = X.territory_code("source_territory")
    return df.withColumns({
        "province_code": code,
        "province_name": X.territory_name("source_territory"),
        "territory_id": F.concat(F.lit("ES-PROV-"), code),
        "territory_level": F.lit("province"),
        "country_code": F.lit("ES"),
    })


def add_time(df: DataFrame, provisional_start: str) -> DataFrame:
    return (
        df.withColumn("month", X.period_month("source_period"))
        .withColumns({
            "month_id": X.month_id("month"),
            "year": F.year("month").cast("smallint"),
            "month_number": F.month("month").cast("tinyint"),
            "is_provisional": F.col("month") >= F.lit(provisional_start).cast("date"),
        })
    )


def add_lineage(df: DataFrame, file_name: str, source_id: str, table_id: int, snapshot_id: str, processed_at: str) -> DataFrame:
    """Lineage literals (made once on the driver) and the missing-value flags."""
    missing = F.col("value").isNull()
    return df.withColumns({
        "value_missing": missing,
        "quality_flag": F.when(missing, "missing_value").otherwise("ok"),
        "data_status": X.data_status("is_provisional"),
        "source_id": F.lit(source_id),
        "source_table_id": F.lit(table_id).cast("bigint"),
        "source_file_name": F.lit(file_name),
        "source_snapshot_id": F.lit(snapshot_id),
        "processed_at_utc": F.lit(processed_at),
    })


def normalize(raw: DataFrame, columns: dict[str, str], metrics: dict[str, str], residences: dict[str, str] | None, units: dict[str, str], provisional_start: str, **lineage) -> DataFrame:
    """Raw strings to the 25-column long table; unmapped categories and bad periods raise."""
    df = add_time(add_territory(renamed(raw, columns)), provisional_start)
    df = df.withColumn("metric", X.lookup(X.trimmed("source_metric"), metrics))
    if residences is None:
        df = df.withColumns({"residence": F.lit(None).cast("string"), "source_residence": F.lit(None).cast("string")})
    else:
        df = df.withColumn("residence", X.lookup(X.trimmed("source_residence"), residences))
    df = df.withColumns({"value": X.spanish_number("source_value_raw"), "unit": X.lookup("metric", units)})
    for source, target in (("source_metric", "metric"), ("source_territory", "territory_id")) + ((("source_residence", "residence"),) if residences else ()):
        if bad := unmapped(df, source, target):
            raise ValueError(f"{source}: no code for {bad[:20]}")
    if bad := [r[0] for r in malformed_periods(df).collect()]:
        raise ValueError(f"source_period: malformed {bad[:20]}")
    return add_lineage(df, **lineage).select(*LONG_COLUMNS)


def gates(long: DataFrame, keys: list[str], territories: int) -> dict[str, int]:
    """Violations of the long table's rules, in one pass over rows and one over keys."""
    pct = F.col("metric").endswith("_pct") & ~F.col("value").between(0, 100)
    row = long.agg(
        F.abs(F.count_distinct("territory_id") - territories).alias("territories"),
        F.count_if(F.col("value") < 0).alias("negative"),
        F.count_if(pct).alias("percent_range"),
    ).first()
    repeated = long.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
    return row.asDict() | {"duplicate_keys": repeated}


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
