"""Every core query against the SQL that states its result, and every other one for rows and schema."""

import pytest
from compare import DATA, spark_rows, sql_rows

from frameloom.plans import catalogue

CORE = catalogue.core()


@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_matches_sql(spark, name):
    df = CORE.queries[name](spark, DATA)
    assert spark_rows(df) == sql_rows(CORE.sql[name], df.columns)


@pytest.mark.parametrize("name", sorted(set(CORE.queries) - set(CORE.sql)))
def test_runs(spark, name):
    df = CORE.queries[name](spark, DATA)
    assert df.columns
    assert df.count() >= 0
