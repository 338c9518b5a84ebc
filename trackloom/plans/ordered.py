"""Runs, argmins, as-of and range joins, ordered folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.plans.joins import null_safe_join


def first_by(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of each key in a total order: the rank window keeps one row per key and partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: str | Column, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def runs(df: DataFrame, keys: Sequence[str], order: str, value: str, *, max_gap: int | None = None, out: str = "run") -> DataFrame:
    """Numbers the maximal stretches of equal ``value``; a step of more than ``max_gap`` also starts a new one."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.lag(value).over(w).isNull() | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    if max_gap is not None:
        new = new | (F.col(order) - F.lag(order).over(w) > max_gap)
    return df.withColumn("_new", new.cast("long")).withColumn(out, F.sum("_new").over(w)).drop("_new")


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, *, direction: str = "backward", tolerance: int | None = None, take: Sequence[str] = ()) -> DataFrame:
    """Left rows with the columns ``take`` and the time ``r_<on>`` of the last (next, nearest) right row; of two equally near the earlier.

    One union and one or two windows, so both sides are shuffled once; times within ``by`` must be unique on the right.
    """
    packed = F.struct(F.col(on).alias("t"), *(F.col(c) for c in take))
    a = left.withColumn("_side", F.lit(1)).withColumn("_r", F.lit(None).cast(right.select(packed.alias("s")).schema[0].dataType))
    b = right.select(*by, on, packed.alias("_r")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    back = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.col(on).desc(), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_p", F.last("_r", ignorenulls=True).over(back)) if direction != "forward" else both.withColumn("_p", F.lit(None).cast(both.schema["_r"].dataType))
    both = both.withColumn("_n", F.last("_r", ignorenulls=True).over(ahead)) if direction != "backward" else both.withColumn("_n", F.lit(None).cast(both.schema["_r"].dataType))
    dp, dn = F.col(on) - F.col("_p.t"), F.col("_n.t") - F.col(on)
    pick = F.when(F.col("_n").isNull() | (dp <= dn), F.col("_p")).otherwise(F.col("_n"))
    out = both.where("_side = 1").withColumn("_m", pick)
    if tolerance is not None:
        out = out.withColumn("_m", F.when(F.abs(F.col("_m.t") - F.col(on)) <= tolerance, F.col("_m")))
    return out.select(*left.columns, F.col("_m.t").alias(f"r_{on}"), *(F.col(f"_m.{c}").alias(c) for c in take))


def range_join(points: DataFrame, spans: DataFrame, by: Sequence[str], point: str, lo: str, hi: str, bucket: int, how: str = "inner") -> DataFrame:
    """Points inside [lo, hi] of the same key: spans are exploded into buckets, so the join is an equi-join on (by, bucket)."""
    div = lambda c: F.expr(f"({c} - pmod({c}, {bucket}L)) div {bucket}L")
    s = spans.where(f"{lo} <= {hi}").withColumn("_b", F.explode(F.sequence(div(lo), div(hi))))
    p = points.withColumn("_b", div(point))
    keep = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*by, "_b"]] + [F.col(f"p.{point}").between(F.col(f"s.{lo}"), F.col(f"s.{hi}"))]
    cond = keep[0]
    for k in keep[1:]:
        cond = cond & k
    if how in ("left_semi", "left_anti"):
        return p.alias("p").join(s.alias("s"), cond, how).drop("_b")
    extra = [F.col(f"s.{c}") for c in spans.columns if c not in by]
    return p.alias("p").join(s.alias("s"), cond, how).select(*(F.col(f"p.{c}") for c in points.columns), *extra)


def cumulative(value: str | Column, keys: Sequence[str], *order: str | Column) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value).over(w)


def prefix_sums(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column], *ties: str, descending: bool = False, buckets: int = 128) -> DataFrame:
    """Adds running sums in order within each key, inclusive, without giving a key to one task.

    Sketched quantiles of the order column cut every key into buckets; sums run inside the buckets and the totals of
    the buckets before are added, so a task holds a bucket.  Rows with a null order are dropped.
    """
    d = df.where(F.col(order).isNotNull())
    cuts = d.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []
    b = F.size(F.filter(F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    d = d.withColumn("_b", -b if descending else b)
    by = F.desc(order) if descending else F.col(order)
    w = Window.partitionBy(*keys, "_b").orderBy(by, *ties).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({n: F.sum(c).over(w) for n, c in sums.items()} | {f"_{n}": c for n, c in sums.items()})
    t = d.groupBy(*keys, "_b").agg(*(F.sum(f"_{n}").alias(f"_t{n}") for n in sums))
    t = t.select(*keys, "_b", *(F.coalesce(F.sum(f"_t{n}").over(before), F.lit(0)).alias(f"_t{n}") for n in sums))
    j = null_safe_join(d, t, [*keys, "_b"])
    return j.withColumns({n: F.col(n) + F.col(f"_t{n}") for n in sums}).drop("_b", *(f"_{n}" for n in sums), *(f"_t{n}" for n in sums))
