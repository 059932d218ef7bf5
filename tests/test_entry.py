import pytest

import __spark_entry__ as entry
from marginalia.plans import corpus, knowledge, notes, runs, search, upkeep, vault


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted({**corpus.QUERIES, **knowledge.QUERIES, **notes.QUERIES, **search.QUERIES, **upkeep.QUERIES, **vault.QUERIES, **runs.QUERIES}))
def test_query_runs(spark, data, name):
    df = entry.queries()[name](spark, data)
    assert df.columns and df.count() >= 0
