"""Attack directions, team shape and their fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from trackloom.functions import pitch as P

PLAYERS = "role IN ('player', 'goalkeeper') AND pitch_x IS NOT NULL AND pitch_y IS NOT NULL"


def attack_directions(pos: DataFrame) -> DataFrame:
    """(chunk, team, dir): a keeper who stands below halfway attacks upwards; of two teams with the same sign the one whose keeper was seen more often keeps it."""
    k = pos.where(PLAYERS).where("role = 'goalkeeper'").groupBy("chunk", "team").agg(F.expr("percentile(pitch_x, 0.5)").alias("m"), F.count("*").alias("n"))
    sign = F.when(F.col("m") < P.LENGTH / 2, 1).otherwise(-1)
    w = Window.partitionBy("chunk").orderBy(F.desc("n"), "team")
    k = k.withColumn("sign", sign).withColumn("strong", F.first("sign").over(w)).withColumn("place", F.row_number().over(w))
    return k.select("chunk", "team", F.when((F.col("place") > 1) & (F.col("sign") == F.col("strong")), -F.col("sign")).otherwise(F.col("sign")).alias("dir"))


def directions_from_ball(pos: DataFrame, ball: DataFrame, radius_m: float = 4.0) -> DataFrame:
    """(chunk, team, dir): the team that holds the ball farther up on average attacks upwards; both teams must have held it."""
    from trackloom.operators.possession import nearest_player

    held = nearest_player(ball, pos.where(PLAYERS)).where(F.col("dist_m") <= radius_m).where("team >= 0")
    m = held.groupBy("chunk", "team").agg(F.avg("x").alias("m"))
    w = Window.partitionBy("chunk")
    m = m.withColumn("k", F.row_number().over(w.orderBy(F.desc("m"), "team"))).withColumn("n", F.count("*").over(w))
    return m.where("n = 2").select("chunk", "team", F.when(F.col("k") == 1, 1).otherwise(-1).alias("dir"))


def complete_directions(dirs: DataFrame, teams: DataFrame) -> DataFrame:
    """A team without a direction gets the opposite of the other's."""
    t = teams.select("chunk", "team").distinct().join(dirs, ["chunk", "team"], "left")
    other = F.sum("dir").over(Window.partitionBy("chunk"))
    return t.select("chunk", "team", F.coalesce("dir", -other).cast("int").alias("dir")).where("dir is not null")


def attacking_team(pos: DataFrame) -> DataFrame:
    """(chunk, frame, team): the ball carrier's team where one is marked, else the team whose players stand farther up."""
    p = pos.where(PLAYERS)
    mean = p.groupBy("chunk", "frame", "team").agg(F.avg("pitch_x").alias("m"), F.max(F.coalesce("is_actor", F.lit(False))).alias("has"))
    w = Window.partitionBy("chunk", "frame").orderBy(F.desc("has"), F.desc("m"), "team")
    return mean.withColumn("k", F.row_number().over(w)).where("k = 1").select("chunk", "frame", "team")


def hull(points: np.ndarray) -> float:
    """Area of the convex hull; the bounding box of a degenerate set, 0 below three points."""
    if len(points) < 3:
        return 0.0
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return float(np.prod(np.ptp(points, axis=0)))

    def chain(ps: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(chain(pts) + chain(pts[::-1]))
    nxt = np.roll(ring, -1, axis=0)
    area = abs(float((ring[:, 0] * nxt[:, 1] - ring[:, 1] * nxt[:, 0]).sum())) / 2
    return area or float(np.prod(np.ptp(points, axis=0)))


@pandas_udf(DoubleType())
def hull_area(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([hull(np.column_stack([x, y])) for x, y in zip(xs, ys, strict=True)], dtype=float)


def lane_shares(y: str = "pitch_y") -> list[Column]:
    inside = F.count(P.lane(y))
    return [F.try_divide(F.count(F.when(P.lane(y) == i, 1)), inside).alias(f"lane{i}") for i in range(5)]


def frame_shapes(pos: DataFrame, dirs: DataFrame | None = None, *, min_team: int = 4) -> DataFrame:
    """One row per (chunk, frame, team) with at least ``min_team`` players: centre, extent, spread, compactness, hull, lane shares and advance.

    Population deviations; compactness is the mean distance to the centre; the keeper does not count for the advance, which is null
    without a direction.
    """
    p = pos.where(PLAYERS).where("team >= 0")
    p = p.join(dirs, ["chunk", "team"], "left") if dirs is not None else p.withColumn("dir", F.lit(None).cast("int"))
    w = Window.partitionBy("chunk", "frame", "team")
    p = p.withColumn("far", P.distance("pitch_x", "pitch_y", F.avg("pitch_x").over(w), F.avg("pitch_y").over(w)))
    ax = F.when(F.col("role") == "player", P.advance("pitch_x", "dir"))
    g = p.groupBy("chunk", "frame", "team").agg(
        F.count("*").alias("n"), F.avg("pitch_x").alias("cx"), F.avg("pitch_y").alias("cy"),
        (F.max("pitch_y") - F.min("pitch_y")).alias("width"), (F.max("pitch_x") - F.min("pitch_x")).alias("length"),
        F.stddev_pop("pitch_x").alias("sd_x"), F.stddev_pop("pitch_y").alias("sd_y"), F.avg("far").alias("compactness"),
        *lane_shares(), F.avg(ax).alias("advance"), F.percentile(ax, 0.2).alias("line"), F.avg((ax > P.FINAL_THIRD).cast("double")).alias("high"),
        F.collect_list("pitch_x").alias("_xs"), F.collect_list("pitch_y").alias("_ys"))
    return g.where(F.col("n") >= min_team).withColumn("area", hull_area("_xs", "_ys")).drop("_xs", "_ys")


def fingerprint(shapes: DataFrame, *keys: str) -> DataFrame:
    """Means of the per-frame metrics, with the number of frames."""
    skip = {"chunk", "frame", "team", "n", *keys}
    return shapes.groupBy(*keys).agg(F.count("*").alias("frames"), F.avg("n").alias("players"), *(F.avg(c).alias(c) for c in shapes.columns if c not in skip))


def style_indices(shares: DataFrame) -> DataFrame:
    """Wing, half-space and left-right bias of lane shares."""
    return shares.withColumns({"wing": F.col("lane0") + F.col("lane4"), "half_space": F.col("lane1") + F.col("lane3"), "bias": F.col("lane0") + F.col("lane1") - F.col("lane3") - F.col("lane4")})


def near_mate(pos: DataFrame, *, min_team: int = 4) -> DataFrame:
    """(team, connectivity): mean distance to the nearest team-mate, per frame, then per team."""
    p = pos.where(PLAYERS).where("team >= 0").select("chunk", "frame", "team", "track_id", "pitch_x", "pitch_y")
    w = Window.partitionBy("chunk", "frame", "team")
    p = p.withColumn("n", F.count("*").over(w)).where(F.col("n") >= min_team)
    q = p.select("chunk", "frame", "team", F.col("track_id").alias("t2"), F.col("pitch_x").alias("x2"), F.col("pitch_y").alias("y2"))
    d = p.join(q, ["chunk", "frame", "team"]).where("track_id <> t2").groupBy("chunk", "frame", "team", "track_id").agg(F.min(P.distance("pitch_x", "pitch_y", "x2", "y2")).alias("d"))
    return d.groupBy("chunk", "frame", "team").agg(F.avg("d").alias("d")).groupBy("team").agg(F.avg("d").alias("connectivity"))


def keeper_metrics(pos: DataFrame, dirs: DataFrame) -> DataFrame:
    """(team, gk_advance, gk_lateral): median advance and sample deviation of y."""
    k = pos.where(PLAYERS).where("role = 'goalkeeper'").join(dirs, ["chunk", "team"])
    return k.groupBy("team").agg(F.percentile(P.advance("pitch_x", "dir"), 0.5).alias("gk_advance"), F.stddev_samp("pitch_y").alias("gk_lateral"))


def marginal_distance(pos: DataFrame) -> DataFrame:
    """(distance): one-dimensional Wasserstein distance between the teams' x, plus that of y, from merged cumulative shares."""
    p = pos.where(PLAYERS).where("team IN (0, 1)")
    v = p.select("team", F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("pitch_x").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("pitch_y").alias("v")))).alias("s")).select("team", "s.*")
    c = v.groupBy("axis", "v").agg(*(F.count(F.when(F.col("team") == t, 1)).alias(f"n{t}") for t in (0, 1)))
    w, total = Window.partitionBy("axis").orderBy("v"), Window.partitionBy("axis")
    gap = F.abs(F.sum("n0").over(w) / F.sum("n0").over(total) - F.sum("n1").over(w) / F.sum("n1").over(total))
    return c.select(gap.alias("g"), (F.lead("v").over(w) - F.col("v")).alias("d")).agg(F.sum(F.col("g") * F.col("d")).alias("distance"))
