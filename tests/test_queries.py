import pytest

from arbora.plans import corpus, problems, repair, treebank
from tests.side_by_side import same

_ALL = {**problems.QUERIES, **treebank.QUERIES, **corpus.QUERIES, **repair.QUERIES}
_SQL = {**problems.SQL, **treebank.SQL, **corpus.SQL, **repair.SQL}


@pytest.mark.parametrize("name", sorted(_ALL))
def test_query_equals_sql(spark, name):
    same(spark, _ALL[name], _SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(_ALL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
