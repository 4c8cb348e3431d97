import pytest
from dirt import dirty_tables

from tessella.llm import queries


@pytest.fixture(scope="module")
def dirty(spark, small, tmp_path_factory):
    return dirty_tables(spark, small, tmp_path_factory.mktemp("dirty"))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_on_dirty_tables(spark, dirty, name):
    df = queries.queries()[name](spark, dirty)
    rows = df.collect()
    assert df.count() == len(rows)
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
