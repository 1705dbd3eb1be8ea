"""The queries against DuckDB on the smallest tables, where those are present."""

import math
from pathlib import Path

import pytest

from tidepanel.plans import catalog, proxy

SF = "/root/testdata/sf0.001"
NAMES = ["metrics_by_split", "gold_rule_checks", "modeling_table", "tourism_pressure_index", "paired_metrics_by_territory", "missing_territory_months", "territory_parse", "latest_revision", "temporal_integrity", "schema_contract_checks", "processed_gate", "calendar_gate", "pct_rank_avg", "supply_wide_pivot"]


def norm(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else float(f"{v:.10g}") if isinstance(v, float) else v


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cur = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted(([norm(r[names.index(c)]) for c in sorted(names)] for r in cur.fetchall()), key=str)
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(([norm(r[c]) for c in sorted(names)] for r in df.collect()), key=str)
    assert sorted(df.columns) == sorted(names) and got == want


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 70


def test_entry_survives_without_the_optional_part():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert proxy.CONFIG.folds[0].name == "validation_1"
