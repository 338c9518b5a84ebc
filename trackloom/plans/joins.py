"""Joins whose strategy follows a checked size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def against(few: DataFrame, all_: DataFrame, condition: Column | None = None, *, block: int = 1000) -> DataFrame:
    """A small stated set of rows held against every row of a table, broadcast in blocks of a fixed size."""
    n = few.count()
    if n <= block:
        return all_.join(F.broadcast(few), condition) if condition is not None else all_.crossJoin(F.broadcast(few))
    parts = -(-n // block)
    whole = few.withColumn("_part", F.ntile(parts).over(Window.orderBy(*few.columns[:1])))
    out = None
    for i in range(1, parts + 1):
        one = F.broadcast(whole.where(F.col("_part") == i).drop("_part"))
        j = all_.join(one, condition) if condition is not None else all_.crossJoin(one)
        out = j if out is None else out.unionByName(j)
    return out


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys equal each other; the keys come from the left side."""
    named = right.select(*(F.col(k).alias(f"_j_{k}") for k in on), *(c for c in right.columns if c not in on))
    match = [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in on]
    return left.join(named, match, how).drop(*(f"_j_{k}" for k in on))


def join_checked(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", *, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Null-safe join; ``small`` is broadcast only if counting stops at or below ``limit`` rows, else AQE splits skewed keys."""
    if small.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    return null_safe_join(big, small, on, how)
