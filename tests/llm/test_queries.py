import pytest
from oracle import compare, connection

from tessella.llm import queries

COLUMNS = {
    "p1_found": ["tbl", "row_id", "defect"], "p2_found": ["page_id", "line_no"], "p3_found": ["record_id"], "p4_found": ["page_id_a", "page_id_b"], "p5_found": ["record_id", "lang_code"],
    "p6_found": ["site", "line_key"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "category"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_on_whole_tables(spark, small, name):
    df = queries.queries()[name](spark, small)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert df.count() == df.distinct().count()
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    compare(queries.queries()[name](spark, small), connection(small), queries.oracle_sql()[name])
