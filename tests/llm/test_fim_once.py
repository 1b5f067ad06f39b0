"""Fill-in-middle splits a text as few times as it can."""

from pyspark.sql import functions as F

from meterlake.llm import fim


def test_a_short_text_is_split_once(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    out = fim.fim_transform(df).select(fim.fim_restored(F.col("output"), F.col("form")).alias("back"), "*")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # The pieces of a short text, those of a long one's stretches and of its two cuts, and the parts of an output.
    assert plan.count("split(") <= 5, plan
