"""Every core query with SQL against DuckDB on the smallest tables; the rest must run with a stable schema."""

from pathlib import Path

import pytest

from tests.verify import rows_of
from tidewatch.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    assert rows_of(registry.queries()[name](spark, sf).toPandas()) == rows_of(con.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    assert df.columns and len(df.collect()) >= 0


def test_no_core_module_imports_the_optional_subpackage():
    root = Path(__file__).resolve().parents[1] / "tidewatch"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tidewatch.llm" not in p.read_text(), p
