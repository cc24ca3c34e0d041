import pytest

from pagelog.plans import registry
from tests.duck import same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), sf_dir, registry.ORACLE[name])


def test_entry_points():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
