import math

from pyspark.sql import functions as F

from peakforge.functions import activations as A


def test_gelu_to_double_precision(spark):
    xs = [*[i / 7 - 9 for i in range(127)], 0.0, 1e-300, -1e300, math.inf, None]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", A.gelu(F.col("x")).alias("y"), A.error_function(F.col("x")).alias("e")).collect()
    for r in rows:
        if r.x is None:
            assert r.y is None
        elif r.x == math.inf:
            assert r.y == math.inf and r.e == 1
        else:
            assert abs(r.e - math.erf(r.x)) < 1e-15 and abs(r.y - r.x * 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) <= 1e-14 * max(1, abs(r.x))
