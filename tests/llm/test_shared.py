import pytest
from pyspark.sql import functions as F

from quern.llm import _shared


@pytest.mark.parametrize("most", [100_000, 0])
def test_rows_are_looked_up_alike_with_and_without_a_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(_shared, "BROADCAST_ROWS", most)
    left = spark.range(1000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id") % 5).alias("key"))
    right = spark.createDataFrame([(7, "seven"), (1, "one"), (None, "none")], "key long, name string")
    found = _shared.looked_up(left, right, ["key"], F.hash("row"))
    assert found.count() == 1000 and found.where("name = 'seven'").count() == 666 and sorted(found.columns) == ["key", "name", "row"]
    assert _shared.looked_up(left, right, ["key"], F.hash("row"), "inner").count() == found.where("name IS NOT NULL").count()
