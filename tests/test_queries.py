"""Every registered query against its SQL counterpart."""

import duckdb
import pytest

import __spark_entry__ as registry
from tidewire.plans.oracle import ORACLES
from tidewire.plans.queries import REGISTERED

# Stored vectors are 32-bit floats, and recall is no table; see test_search_stored.py and
# test_quantised.py.
TESTED_OTHERWISE = {"search_stored", "search_stored_filtered", "knn_lsh_recall", "knn_codes_recall"}

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def database(tables):
    connection = duckdb.connect()
    for name in TABLE_NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    return connection


def test_every_query_of_the_library_has_sql_or_a_test_of_its_own():
    assert set(ORACLES) == set(REGISTERED) - TESTED_OTHERWISE
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, tables, database, name):
    result = registry.queries()[name](spark, tables)
    columns = sorted(result.columns)
    ours = sorted(repr(tuple(row[c] for c in columns)) for row in result.collect())
    assert ours
    cursor = database.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = [dict(zip(names, row)) for row in cursor.fetchall()]
    assert ours == sorted(repr(tuple(row[c] for c in columns)) for row in theirs)


def test_entry_is_the_flagship(spark):
    rows = registry.entry(spark)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows.count() > 0
