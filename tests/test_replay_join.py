from arbora.plans import treebank
from tests.side_by_side import SF, same


def test_sentences_are_not_broadcast(spark):
    """Sentences are joined to their splits without passing through the driver, however small the planner takes them to be."""
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, "1b")
    try:
        same(spark, treebank.oracle_replay, treebank.SQL["oracle_replay"])
        plan = treebank.oracle_replay(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(limit)
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
