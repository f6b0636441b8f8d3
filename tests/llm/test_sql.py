"""Queries whose SQL gives the same rows."""

import pytest

from brindle.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted([tuple(r[c] for c in columns) for r in df.collect()], key=str) == sorted([tuple(r[i] for i in at) for r in found.fetchall()], key=str)
