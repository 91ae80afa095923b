"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import datetime
import json
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from evenkeel.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLE = catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def rows(columns, values):
    return sorted(json.dumps([plain(v) for _, v in sorted(zip(columns, r))], default=str) for r in values)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    want = db.execute(ORACLE[name])
    assert got == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", ["balanced_extrema", "balanced_factor_sensitivity", "bootstrap_factor_intervals", "bootstrap_outside_markers"])
def test_runs_are_derived_once(spark, monkeypatch, name):
    """The estimates and their replicates read one table of runs, not two derivations of it."""
    derived, outcome_runs = [], catalog.outcome_runs
    monkeypatch.setattr(catalog, "outcome_runs", lambda *a: derived.append(a) or outcome_runs(*a))
    catalog.queries()[name](spark, SF)
    assert len(derived) == 1


def test_registry(spark):
    assert set(ORACLE) <= set(catalog.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
