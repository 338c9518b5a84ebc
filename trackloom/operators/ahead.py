"""Runs that were not made: candidate places of attackers off the ball, their values, and the runs they made instead; model inputs."""

from __future__ import annotations

from collections.abc import Callable
from math import cos, pi, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import pitch as P
from trackloom.plans.ordered import first_by

#: Directions and rings of the candidate runs; fixed values.
DIRECTIONS, RINGS = 8, (0.5, 1.0)


def targets(x: str, y: str, *, radius: float, length: float = P.LENGTH, width: float = P.WIDTH) -> Column:
    """Array of (i, x, y): where a player could run, on two rings of eight directions, kept on the pitch."""
    at = [(ring * radius * cos(2 * pi * k / DIRECTIONS), ring * radius * sin(2 * pi * k / DIRECTIONS)) for ring in RINGS for k in range(DIRECTIONS)]
    on = lambda v, most: F.greatest(F.least(v, F.lit(most)), F.lit(0.0))
    return F.array(*(F.struct(F.lit(i).alias("i"), on(F.col(x) + dx, length).alias("x"), on(F.col(y) + dy, width).alias("y")) for i, (dx, dy) in enumerate(at)))


def best_runs(players: DataFrame, value: Callable[[Column, Column], Column], *, radius: float) -> DataFrame:
    """(players' columns, baseline, best, gain, dx, dy): the candidate place worth most, none if staying is worth as much; ties go to the first candidate.

    ``value`` gives the worth of a place as an expression of the row, so everything stays in one projection.
    """
    here = value(F.col("pitch_x"), F.col("pitch_y"))
    scored = F.transform(targets("pitch_x", "pitch_y", radius=radius), lambda c: F.struct(value(c["x"], c["y"]).alias("v"), (-c["i"]).alias("o"), c["x"].alias("x"), c["y"].alias("y")))
    d = players.withColumn("baseline", here).withColumn("_b", F.array_max(scored))
    moved = F.col("_b.v") > F.col("baseline")
    dx, dy = F.when(moved, F.col("_b.x") - F.col("pitch_x")).otherwise(0.0), F.when(moved, F.col("_b.y") - F.col("pitch_y")).otherwise(0.0)
    far = F.sqrt(dx * dx + dy * dy)
    unit = lambda v: F.when(far > 1e-9, v / far).otherwise(0.0)
    best = F.greatest("_b.v", "baseline")
    return d.select(*players.columns, "baseline", best.alias("best"), (best - F.col("baseline")).alias("gain"), unit(dx).alias("dx"), unit(dy).alias("dy"))


def actual_runs(players: DataFrame, mates: DataFrame, *, horizon: int) -> DataFrame:
    """(chunk, frame, track_id, ax, ay): direction from each player to the nearest team-mate's place ``horizon`` frames later, the lower track of two."""
    later = mates.select("chunk", (F.col("frame") - horizon).alias("frame"), "team", F.col("track_id").alias("q"), F.col("pitch_x").alias("qx"), F.col("pitch_y").alias("qy"))
    j = players.join(later, ["chunk", "frame", "team"]).withColumn("_d", P.distance("pitch_x", "pitch_y", "qx", "qy"))
    n = first_by(j, ["chunk", "frame", "track_id"], "_d", "q")
    unit = lambda v: F.when(F.col("_d") > 1e-9, v / F.col("_d")).otherwise(0.0)
    return n.select("chunk", "frame", "track_id", unit(F.col("qx") - F.col("pitch_x")).alias("ax"), unit(F.col("qy") - F.col("pitch_y")).alias("ay"))


def run_quality(best: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """(keys, runs, potential, agreement): mean gain of the best runs, and how far the runs made went the same way."""
    j = best.join(actual, ["chunk", "frame", "track_id"], "left")
    same = F.when((F.col("dx") != 0) | (F.col("dy") != 0), F.col("dx") * F.col("ax") + F.col("dy") * F.col("ay"))
    return j.groupBy(*keys).agg(F.count("*").alias("runs"), F.avg("gain").alias("potential"), F.avg(same).alias("agreement"))


def rescaled(x: Column, y: Column, length: float, width: float) -> tuple[Column, Column]:
    """A place on a pitch of the given size on the 120 x 80 grid of the models."""
    return x * 120 / length, y * 80 / width


def parsed_frames(df: DataFrame, key: str, doc: str) -> DataFrame:
    """(key, i, x, y, teammate, actor, keeper) of freeze-frames given as JSON lists of {location, teammate, actor, keeper}; missing flags count as team-mate only."""
    kind = "array<struct<location: array<double>, teammate: boolean, actor: boolean, keeper: boolean>>"
    d = df.select(key, F.posexplode(F.from_json(doc, kind)).alias("i", "p"))
    flag = lambda c, other: F.coalesce(F.col(f"p.{c}"), F.lit(other)).alias(c)
    return d.select(key, "i", F.get("p.location", 0).alias("x"), F.get("p.location", 1).alias("y"), flag("teammate", True), flag("actor", False), flag("keeper", False))


def node_features(nodes: DataFrame, *, fast: float = 10.0) -> DataFrame:
    """Nodes (x, y on the 120 x 80 grid, vx, vy, turn, teammate, actor, keeper, ball_x, ball_y, observed) with ``feat`` and ``mask``, eleven numbers each; what is unknown is 0 in both."""
    moving, turned, ball = F.col("vx").isNotNull() & F.col("vy").isNotNull(), F.col("turn").isNotNull(), F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull()
    far = F.sqrt((F.col("x") - F.col("ball_x")) ** 2 + (F.col("y") - F.col("ball_y")) ** 2) / (120.0**2 + 80.0**2) ** 0.5
    always, flag = F.lit(True), lambda c: F.col(c).cast("double")
    parts = [
        (F.col("x") / 120, always), (F.col("y") / 80, always), (F.col("vx") / fast, moving), (F.col("vy") / fast, moving), (F.sin("turn"), turned), (F.cos("turn"), turned),
        (flag("teammate"), always), (flag("actor"), always), (flag("keeper"), always), (far, ball), (flag("observed"), always)]
    return nodes.withColumns({"feat": F.array(*(F.when(ok, v).otherwise(0.0) for v, ok in parts)), "mask": F.array(*(F.when(ok, 1.0).otherwise(0.0) for _, ok in parts))})


def per_opponent_possession(kpi: Column, share: Column) -> Column:
    """A measure that accrues while the opponent has the ball, over the opponent's share; null where the own share is not in [0, 1)."""
    return F.when((share >= 0) & (share < 1), kpi / (1 - share))
