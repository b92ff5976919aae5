"""Every registered query equals its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck
from ridgeline.plans.catalog import QUERIES
from ridgeline.plans.oracle import ORACLE

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, sf_small, name):
    ok, msg = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], sf_small)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["user_no", "name", "birth_year"]


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "date": "DATE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", NAMES)
def test_column_types_match_oracle(spark, con, sf_small, name):
    df = E.queries()[name](spark, sf_small)
    got = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
           for f in df.schema.fields}
    rel = con.sql(E.oracle_sql()[name])
    want = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert got == want


@pytest.fixture(scope="module")
def empty_dir(tmp_path_factory, sf_small):
    """Every base table with its real schema and no rows."""
    import pyarrow.parquet as pq

    from ridgeline.sources.tables import BASE_TABLES

    d = tmp_path_factory.mktemp("empty-tables")
    for t in BASE_TABLES:
        pq.write_table(pq.read_table(f"{sf_small}/{t}.parquet").slice(0, 0), str(d / f"{t}.parquet"))
    return str(d)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle_on_empty_tables(spark, empty_dir, name):
    ok, msg = compare(spark, duck(empty_dir), name, E.queries()[name], E.oracle_sql()[name], empty_dir)
    assert ok, msg
