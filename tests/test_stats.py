from pyspark.sql import functions as F

from trackloom.functions import stats as X


def test_signed_rank_of_more_pairs_than_a_long_can_cube(spark):
    half = 850_000
    d = spark.range(2 * half).select(F.lit("k").alias("k"), F.lit(0).alias("a"), F.when(F.col("id") < half, 1).otherwise(-2).alias("b"))
    r = X.signed_rank(d, ["k"], "a", "b").first()
    n, w = 2 * half, half * (half + 1) / 2
    z = (w - n * (n + 1) / 4) / (n * (n + 1) * (2 * n + 1) / 24) ** 0.5
    assert (r["n"], r["helped"], r["hurt"], r["w_plus"]) == (n, half, half, w) and abs(r["z"] / z - 1) < 1e-12
