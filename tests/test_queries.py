"""Every query with SQL against DuckDB on the smallest tables; the others must give rows; plans must stay as meant."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from parchmint.plans import more, proofs, registry  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("<NA>", "NaT"):
        return "-"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, str(DATA)).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "score", "fields"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """Search never shuffles, scans read few columns, nothing is a cross join."""
    d = str(DATA)
    search = _plan(registry.search_fuzzy(spark, d))
    assert search.count("Exchange") <= 1 and "BatchEvalPython" not in search and "ArrowEvalPython" not in search
    assert "ReadSchema: struct<p_size" in _plan(registry.level_histogram(spark, d))
    for name in ("unreferenced_pages", "merged_backup", "folder_totals", "duplicate_images", "history_by_month"):
        p = _plan(registry.queries()[name](spark, d))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
