"""Every query with SQL gives what DuckDB gives on the same tables."""

import pytest
from comparing import rows_of

from mnemoria.catalogue import ORACLES, QUERIES
from mnemoria.catalogue.registry import LITERAL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(LITERAL))
def test_literal_rows(spark, duck, data, name):
    f, sql = LITERAL[name]
    got, want = f(spark, data).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {n for n in QUERIES if n.startswith("ablation_")}))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
