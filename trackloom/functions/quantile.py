"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.plans.cut import cut
from trackloom.plans.joins import join_checked


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median", *, slack: float = 0.004, accuracy: int = 1000) -> DataFrame:
    """(keys, out, n): the exact median of the non-null, non-NaN values; the mean of the middle two for an even count.

    A mergeable sketch brackets the median; only values inside the bracket (under 1 % of a group, ties
    counted once) are ranked, so no task holds a group.  Groups without values do not appear.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    probe = F.percentile_approx("v", F.array(F.lit(0.5 - slack), F.lit(0.5 + slack)), accuracy)
    br = cut(v.groupBy(*keys).agg(F.count("*").alias("n"), probe.alias("p")).select(*keys, "n", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi")))
    near = join_checked(v, br, keys)
    kept = F.when(F.col("v") < F.col("lo"), F.lit(None)).otherwise(F.col("v"))
    near = near.where("v <= hi").groupBy(*keys, "n", kept.alias("v")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first())
    near = near.withColumn("r", F.sum("c").over(upto))
    pick = lambda rank: F.min(F.when(F.col("r") > rank, F.col("v")))
    a, b = F.expr("(n - 1) div 2"), F.expr("n div 2")
    return near.groupBy(*keys, "n").agg(pick(a).alias("a"), pick(b).alias("b")).select(*keys, ((F.col("a") + F.col("b")) / 2).alias(out), "n")
