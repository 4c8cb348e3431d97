import pytest
from dirt import dirty_tables

from tessella.plans import catalogue


@pytest.fixture(scope="module")
def dirty(spark, small, tmp_path_factory):
    return dirty_tables(spark, small, tmp_path_factory.mktemp("dirty"))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_on_dirty_tables(spark, dirty, name):
    df = catalogue.queries()[name](spark, dirty)
    assert df.count() == len(df.collect())
