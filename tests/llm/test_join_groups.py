from pyspark.sql import functions as F

from cadenza.llm.common import join_groups, words


def test_hot_and_cold_groups(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 1000, "hot").otherwise((F.col("id") % 300).cast("string")).alias("g"))
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = join_groups(rows, groups, "g", "n", 3000)
    assert got.count() == 3000 and set(got.columns) == {"id", "g", "n", "least"}
    assert got.filter("g = 'hot'").agg(F.max("n"), F.max("least")).first() == (1000, 0)
    assert got.filter("g != 'hot' and id % 300 != cast(g as int)").count() == 0


def test_words(spark):
    got = spark.createDataFrame([(None,), ("",), (" \t\n\x0b",), ("a  b\x0bc\xa0d",)], "text string").select(words("text").alias("n")).collect()
    assert [r.n for r in got] == [0, 0, 0, 3]
