import pytest
from pyspark.sql import functions as F

from glossweave.llm._shared import free, smallest


@pytest.mark.parametrize("n", [40, 4000])
def test_smallest_is_that_of_all_rows(spark, n):
    rows = spark.range(n).withColumn("h", F.xxhash64("id"))
    got = smallest(rows, F.col("h"), ["id"], 50, n).to_pylist()
    want = sorted(rows.collect(), key=lambda r: (r.h % (1 << 40), r.id))[:50]
    assert [r["id"] for r in got] == [r.id for r in want]
    same = spark.range(n).withColumn("h", F.lit((1 << 40) - 1))  # all above any bound
    assert smallest(same, F.col("h"), ["id"], 5, n).num_rows == 5


def test_free():
    assert free(["A", "__x"], "a") == "a_" and free(["__X"], "__x") == "__x_" and free([], "k") == "k"
