"""The corpus queries against DuckDB, and that all of them are registered."""

from __future__ import annotations

import pytest
from test_oracle import SF, canonical, duck  # noqa: F401

import __spark_entry__ as entry
from sonoframe.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and "doc_id" in df.columns


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
