import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.functions.vectors import dot
from lorespark.operators import products, retrieval, search

V = "vec_id bigint, embedding array<float>"


@pytest.fixture
def vectors(spark, monkeypatch):
    """Rows over several cells: random ones, copies of one vector, and some with NaN, a null, no values or another size."""
    monkeypatch.setattr(products, "CELL", (40, 3))
    monkeypatch.setattr(products, "ALL", (40, 3))
    monkeypatch.setattr(products, "PRODUCTS", 60)
    made = np.random.default_rng(7).normal(size=(200, 8)).astype("float32")
    rows = [(i, x.tolist()) for i, x in enumerate(made)] + [(i, made[0].tolist()) for i in range(300, 360)]
    return spark.createDataFrame(rows + [(400, [math.nan] * 8), (401, [None] * 8), (402, None), (403, [1.0]), (404, [0.0] * 8)], V)


def test_cells_give_the_products_of_all_pairs(spark, vectors):
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = vectors.crossJoin(queries).where(F.size("embedding") == F.size("q")).withColumn("score", dot(F.col("embedding"), F.col("q"))).where("score is not null")
    pairs.createOrReplaceTempView("all_pairs")
    text = lambda df: sorted(map(repr, df.collect()))
    assert text(products.scored(vectors, queries, "vec_id", least=0.5).select("query_id", "vec_id", "score")) == text(pairs.where("score >= 0.5").select("query_id", "vec_id", "score"))
    top = "select query_id, rank, vec_id, s as score from (select *, row_number() over (partition by query_id order by s desc, vec_id) as rank from (select *, {} as s from all_pairs)) where rank <= 7"
    assert text(retrieval.vector_topk(vectors, queries, 7)) == text(spark.sql(top.format("round(score, 4) + 0.0")))
    few = products.scored(vectors, queries, "vec_id", k=7)
    assert few.count() < pairs.count() / 3  # pairs that cannot count become no rows
    found = search.best(few, 7, key="vec_id").select("query_id", "rank", "vec_id", "score")
    assert text(found) == text(spark.sql(top.format("score")))


def test_rounding_is_sparks(spark):
    x = [0.00005, 0.00015, 1.00005, 2.67485, -0.00005, 0.123449999999, 1e300, 12345678.12345, math.inf]
    x += (np.random.default_rng(1).integers(-20000, 20000, 500) / 20000).tolist()
    got = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(F.round("v", 4) + F.lit(0.0)).collect()
    assert products.half_up(np.array(x), 4).tolist() == [r[0] for r in got]
