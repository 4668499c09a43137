"""Every query of the library proper against its SQL oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from catalens.bindings import oracle, queries
from tests.compare import connect, difference

SF_DIR, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, ORACLES = queries.queries(), oracle.oracle_sql()
# Their floors are numbers of rows that no group of the smallest tables has.
WITH_HIGH_FLOORS = {"q03_genre_stats", "q03_genre_revenue", "q04_language_rating", "l_language_rating"}


@pytest.fixture(scope="module")
def tables():
    connections = {folder: connect(folder) for folder in (SF_DIR, LARGER)}
    yield connections
    for con in connections.values():
        con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", QUERIES)
def test_query_equals_oracle(spark, tables, key):
    folder = LARGER if key in WITH_HIGH_FLOORS else SF_DIR
    ours = QUERIES[key](spark, folder).toArrow()
    theirs = tables[folder].sql(ORACLES[key]).to_arrow_table()
    assert difference(ours, theirs) is None
    assert ours.num_rows > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["genre", "movie_count", "avg_rating"]


def test_totals_agree(spark):
    """The invariants of the published tables hold here too."""

    def table(key):
        return QUERIES[key](spark, SF_DIR).toPandas()

    total = table("summary_kpis").total_movies[0]
    assert table("eda_yearly_trend").movie_count.sum() == total
    assert table("eda_monthly_releases").movie_count.sum() == total
    summary = table("cleaning_summary").iloc[0]
    assert summary.dropped_rows == summary.raw_rows - summary.clean_rows
