import pytest
from pyspark.sql import functions as F

from gridtide.operators.rank import ranked


@pytest.mark.parametrize("count", [0, 1, 1000])
def test_places_follow_the_order(spark, count):
    rows = spark.range(count).selectExpr("id", "id % 7 AS k", "'x' AS __task", "1 AS `a b`").repartition(5)
    found = ranked(rows, [F.col("k").desc(), F.col("id").asc()], "Place").collect()
    wanted = sorted(range(count), key=lambda i: (-(i % 7), i))
    assert [r["id"] for r in sorted(found, key=lambda r: r["Place"])] == wanted
    assert sorted(r["Place"] for r in found) == list(range(1, count + 1))


def test_a_hot_value_is_ranked_by_the_rest_of_the_order(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 9, id % 100) AS k").repartition(8)
    found = {r["id"]: r["Rank"] for r in ranked(rows, [F.col("k").asc(), F.col("id").asc()]).collect()}
    wanted = sorted(found, key=lambda i: (9 if i % 3 == 0 else i % 100, i))
    assert [found[i] for i in wanted] == list(range(1, 5001))
