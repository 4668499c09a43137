"""Queries of this subpackage against their SQL on the smallest tables."""

import pytest

from catalens.llm import oracle, queries
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.queries(), oracle.oracle_sql()

#: No SQL: alignments, seeded placements, tokenizers, graph search, a fitted model. Plain versions are in the other tests.
WITHOUT_SQL = {"op3_decontaminate", "op4_shards", "op6_tokens", "op7_mixing", "op8_tokencount", "op9_nndescent", "op10_quality"}


def test_which_queries_have_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", ORACLES)
def test_query_equals_oracle(spark, key):
    ours = QUERIES[key](spark, SF_DIR).toArrow()
    with connect(SF_DIR) as tables:
        theirs = tables.sql(ORACLES[key]).to_arrow_table()
    assert difference(ours, theirs) is None
    assert ours.num_rows > 0
