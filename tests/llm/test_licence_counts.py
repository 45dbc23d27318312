from pyspark.sql import functions as F

from lorespark.llm import licences


def test_terms_are_counted_in_their_row(spark):
    rows = spark.createDataFrame([(1, "b a b c a b".split()), (2, []), (3, ["x"])], "i int, w array<string>").select("i", F.explode(licences.counted(F.col("w"))).alias("x"))
    assert sorted(map(tuple, rows.select("i", "x.*").collect())) == [(1, "a", 2), (1, "b", 3), (1, "c", 1), (3, "x", 1)]
