"""Every registered query against its DuckDB oracle (the driver's check,
here on the smallest scale so the suite stays quick)."""
import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_check import digest
from schema_check import DUCK, SPARK
from rewardlake.plans.catalog import QUERIES
from rewardlake.sources.tables import TABLES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "advantage" in df.columns


@pytest.mark.parametrize("name", [n for n in NAMES if n in E.oracle_sql()])
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.sql(E.oracle_sql()[name])
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert len(srows) == len(orows)
    assert digest(df.columns, srows)[0] == digest(res.columns, orows)[0]
    spark_types = {f.name: SPARK.get(type(f.dataType).__name__) for f in df.schema.fields}
    duck_types = {c: DUCK.get(str(t)) for c, t in zip(res.columns, res.types)}
    assert spark_types == duck_types
