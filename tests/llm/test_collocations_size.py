"""The joins of parts and of longer phrases at size: exploded rows aren't broadcast."""

from braidwork.llm import collocations as C


def test_exploded_rows_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, "a b c d. a b c", "en", None, 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = C.collocations(docs)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 1  # the totals, a row a language
    assert plan.count("SortMergeJoin") >= 2
