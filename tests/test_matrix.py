from pyspark.sql import functions as F

from credence.functions import matrix
from credence.plans import catalog


def test_three_matrices(spark):
    got = {(r.i, r.j): r.value for r in catalog.matrix_product(spark, "").collect()}
    assert [got[i, j] for i in range(3) for j in range(3)] == [4, 2, -4, -1, 1, 2, 1, 1, 0]


def test_array_form(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "v array<double>")
    two = df.select(matrix.assigned(F.col("v"), 2, 2).alias("m"))
    row = two.select(matrix.height(F.col("m")).alias("h"), matrix.width(F.col("m")).alias("w"), matrix.entry(F.col("m"), 1, 0).alias("x"), matrix.resized(F.col("m"), 3, 1, 9.0).alias("r")).first()
    assert (row.h, row.w, row.x, row.r) == (2, 2, 3.0, [[1.0], [3.0], [9.0]])
    assert df.select(matrix.assigned(F.col("v"), 2, 3).alias("m")).first().m is None
