import pytest

import __spark_entry__ as entry
from tests.compare import same
from tidewheel.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(name, spark, sf, duck):
    same(catalogue.QUERIES[name](spark, sf), duck, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(name, spark, sf):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["t", "x", "trend"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
