"""Nearest record in time of the same entity, by expanding rings.

The right side is reduced to one row per (entity, time) and packed into the finest buckets once; wider buckets are
runs of whole finest ones.  A ring of width w joins a left time with its own and the two adjacent buckets, which hold
every right row at most w away; a match at most w away is therefore the nearest and is accepted.  The rest goes on with
twice the width, until it reaches the tolerance.  No finest bucket holds more rows than it has time steps, and no ring
more of them than its width, whatever the input's skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.plans.cut import cut


def _bucket(t: str, w: int) -> Column:
    return F.expr(f"({t} - pmod({t}, {w}L)) div {w}L")


def ring_widths(tolerance: int, first: int) -> list[int]:
    out = [max(1, min(first, tolerance or 1))]
    while out[-1] < tolerance:
        out.append(2 * out[-1])
    return out


def nearest_in_time(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, by: Sequence[str], time: str, tolerance: int, first: int = 3) -> DataFrame:
    """(left_id, right_id, distance) of every left row with a right row at most ``tolerance`` away.

    Of equally near right rows the earlier wins, on the same time the smaller id.  Rows with a null time,
    entity or id match nothing; a NaN cannot occur in an integer time.  Repeated rows give one result row;
    a left id at two times gives one row for each match.  Empty inputs give no rows.  Only the named columns
    are read, so others may clash.
    """
    keys = [f"k{i}" for i in range(len(by))]
    take = lambda df, i: df.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col(time).cast("long").alias("t"), F.col(i).alias("id")).dropna()
    ids = take(left, left_id).distinct()
    widths = ring_widths(tolerance, first)
    r = take(right, right_id).groupBy(*keys, "t").agg(F.min("id").alias("rid"))
    r = r.groupBy(*keys, _bucket("t", widths[0]).alias("f")).agg(F.collect_list(F.struct(F.col("t").alias("rt"), "rid")).alias("l"))
    r, todo, found = cut(r), cut(ids.select(*keys, "t").distinct()), []
    for n, w in enumerate(widths):
        probe = todo.withColumn("b", F.explode(F.array(*(_bucket("t", w) + i for i in (-1, 0, 1)))))
        wide = r.select(*keys, _bucket("f", 2**n).alias("b"), "l")
        near = F.transform("l", lambda x: F.struct(F.abs(F.col("t") - x["rt"]).alias("d"), x["rt"].alias("rt"), x["rid"].alias("rid")))
        best = F.array_min(F.filter(near, lambda x: x["d"] <= w))
        hit = probe.join(wide, [*keys, "b"], "left").groupBy(*keys, "t").agg(F.min(best).alias("m"))
        last = n == len(widths) - 1
        hit = hit if last else cut(hit)
        found.append(hit.where("m is not null"))
        todo = hit.where("m is null").drop("m")
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    out = ids.join(pairs, [*keys, "t"]).where(F.col("m.d") <= tolerance)
    return out.select(F.col("id").alias(left_id), F.col("m.rid").alias(right_id), F.col("m.d").alias("distance")).distinct()
