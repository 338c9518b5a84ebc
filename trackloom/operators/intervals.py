"""Merging overlapping intervals into periods and listing the gaps between them.

The mergeable state is a sorted list of disjoint intervals, kept as rows.  Leaves of the reduction tree are blocks of start
values; a leaf is merged by one linear pass.  Only the furthest end of a block goes up the tree: levels of ``FAN`` blocks
are added until no entity has more than ``FAN`` rows at the top, and the furthest end of everything before comes back down
to each block, which drops the intervals it reaches.  What is left are the starts of the periods; the complement of the
lists are the gaps, and a period ends where everything before the next start does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.plans.cut import cut
from trackloom.plans.joins import null_safe_join

BLOCK, FAN = 4096, 4096


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, *, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(keys, kind, f0, f1): kind 'span' for maximal covered periods, 'gap' for the holes between spans of one entity.

    Both ends belong to an interval; one that starts right after another's end continues it.  Intervals with
    a null end or start, or end before start, are ignored; null keys form an entity of their own.  Repeated,
    nested and tied intervals collapse.  An empty input gives no rows.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("s <= e")
    rows = rows.groupBy(*ks, "s").agg(F.max("e").alias("e")).withColumn("b", _above("s", block))
    leaf = cut(_leaves(rows, ks))
    before = _from_others(leaf.groupBy(*ks, "b").agg(F.max("e").alias("v")), ks, F.max, fan, earlier=True)
    # everything before an interval ends at the furthest end of the earlier blocks or at the interval before it in its block
    reach = null_safe_join(leaf, before, [*ks, "b"], "left").withColumn("reach", F.greatest("v", "p"))
    starts = cut(reach.where("reach is null or s - 1 > reach").select(*ks, "b", "s", "reach"))
    after = _from_others(starts.groupBy(*ks, "b").agg(F.min("reach").alias("v")), ks, F.min, fan, earlier=False)
    inside = Window.partitionBy(*ks, "b").orderBy("s")
    ends = null_safe_join(starts, after, [*ks, "b"], "left").withColumn("e", F.coalesce(F.lead("reach").over(inside), "v"))
    # the last period of an entity ends where the entity does
    none = F.lit(None).cast("long")
    last = starts.select(*ks, "s", none.alias("e")).unionByName(leaf.select(*ks, none.alias("s"), "e")).groupBy(*ks).agg(F.max("s").alias("s"), F.max("e").alias("e"))
    spans = ends.where("e is not null").select(*ks, F.lit("span").alias("kind"), F.col("s").alias("f0"), F.col("e").alias("f1"))
    spans = spans.unionByName(last.select(*ks, F.lit("span").alias("kind"), F.col("s").alias("f0"), F.col("e").alias("f1")))
    gaps = starts.where("reach is not null").select(*ks, F.lit("gap").alias("kind"), (F.col("reach") + 1).alias("f0"), (F.col("s") - 1).alias("f1"))
    out = spans.unionByName(gaps)
    return out.select(*(F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)), "kind", "f0", "f1")


def _above(c: str, block: int) -> Column:
    return F.expr(f"({c} - pmod({c}, {block}L)) div {block}L")


def _leaves(rows: DataFrame, ks: Sequence[str]) -> DataFrame:
    """The sorted disjoint list of each block, one row an interval, with the end p of the interval before it."""
    inside = Window.partitionBy(*ks, "b").orderBy("s")
    rows = rows.withColumn("far", F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("n", F.sum((F.col("far").isNull() | (F.col("s") - 1 > F.col("far"))).cast("int")).over(inside))
    return rows.groupBy(*ks, "b", "n").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("far", "s").alias("p"))


def _from_others(some: DataFrame, ks: Sequence[str], fold, fan: int, *, earlier: bool) -> DataFrame:
    """(keys, b, v): ``fold`` of v over all earlier (later) blocks of the entity, for each block that has any."""
    frame = (Window.unboundedPreceding, -1) if earlier else (1, Window.unboundedFollowing)
    most = some.groupBy(*ks).count().agg(F.max("count")).first()[0] or 0
    if most <= fan:
        return some.withColumn("v", fold("v").over(Window.partitionBy(*ks).orderBy("b").rowsBetween(*frame))).where("v is not null")
    some = cut(some.withColumn("up", _above("b", fan)))
    mine = fold("v").over(Window.partitionBy(*ks, "up").orderBy("b").rowsBetween(*frame))
    upper = _from_others(some.groupBy(*ks, F.col("up").alias("b")).agg(fold("v").alias("v")), ks, fold, fan, earlier=earlier).withColumnsRenamed({"b": "up", "v": "o"})
    pick = F.greatest if earlier else F.least
    both = null_safe_join(some.withColumn("v", mine), upper, [*ks, "up"], "left").withColumn("v", pick("v", "o"))
    return both.where("v is not null").select(*ks, "b", "v")
