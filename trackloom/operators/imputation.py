"""Off-camera positions: defensive lines, role offsets, holds, lines and decays between sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import pitch as P
from trackloom.operators.shape import PLAYERS

FRAME = ["chunk", "frame"]


def debias_slope(lines: DataFrame, x: str, y: str, *, cap: float = 4.0) -> DataFrame:
    """(slope) of a least-squares line over the capped predictor."""
    return lines.agg(F.regr_slope(F.col(y).cast("double"), F.least(F.col(x).cast("double"), F.lit(cap))).alias("slope"))


def role_offsets(tracks: DataFrame, roles: DataFrame) -> DataFrame:
    """(team, slot, dx, dy, n): mean place of each role relative to its team's visible centre, the player left out."""
    w = Window.partitionBy(*FRAME, "team")
    p = tracks.where(PLAYERS).join(roles, ["chunk", "track_id"]).withColumn("_n", F.count("*").over(w)).where("_n > 1")
    rest = lambda c: (F.sum(c).over(w) - F.col(c)) / (F.col("_n") - 1)
    p = p.withColumns({"_dx": F.col("pitch_x") - rest("pitch_x"), "_dy": F.col("pitch_y") - rest("pitch_y")})
    return p.groupBy("team", "slot").agg(F.avg("_dx").alias("dx"), F.avg("_dy").alias("dy"), F.count("*").alias("n"))


def impute_roles(pos: DataFrame, roles: DataFrame, offsets: DataFrame) -> DataFrame:
    """(chunk, frame, team, slot, x, y) of a chunk's roles missing in a frame: the visible centre plus the role's offset."""
    seen = pos.where(PLAYERS).join(roles, ["chunk", "track_id"])
    centre = seen.groupBy(*FRAME, "team").agg(F.avg("pitch_x").alias("cx"), F.avg("pitch_y").alias("cy"))
    slots = roles.join(pos.select("chunk", "track_id", "team").distinct(), ["chunk", "track_id"]).where("team >= 0").select("chunk", "team", "slot").distinct()
    want = centre.join(slots, ["chunk", "team"]).join(seen.select(*FRAME, "team", "slot").distinct(), [*FRAME, "team", "slot"], "left_anti")
    j = want.join(offsets, ["team", "slot"])
    x, y = P.clamp(F.col("cx") + F.col("dx"), F.col("cy") + F.col("dy"), tol=1e6)
    return j.select(*FRAME, "team", "slot", x.alias("x"), y.alias("y"))


def between_sightings(rows: DataFrame, keys: list[str], t: str, value: str, visible: str) -> DataFrame:
    """Rows with last and next visible time and value of their key."""
    w = Window.partitionBy(*keys).orderBy(t)
    s = F.when(F.col(visible), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    # a frame that shrinks from the left is evaluated anew for each row, so the next sighting is the last one in reverse order
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.desc(t)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_p", F.last(s, ignorenulls=True).over(back)).withColumn("_n", F.last(s, ignorenulls=True).over(ahead)).select(
        *rows.columns, F.col("_p.t").alias("t_last"), F.col("_p.v").alias("v_last"), F.col("_n.t").alias("t_next"), F.col("_n.v").alias("v_next"))


def baselines(b: DataFrame, t: str, value: str, visible: str) -> DataFrame:
    """Hidden rows with time since seen and the errors of holding the last value and of the line to the next."""
    line = F.when(F.col("t_next").isNull(), F.col("v_last")).otherwise(F.col("v_last") + (F.col("v_next") - F.col("v_last")) * F.try_divide(F.col(t) - F.col("t_last"), F.col("t_next") - F.col("t_last")))
    h = b.where(~F.col(visible) & F.col("v_last").isNotNull())
    return h.withColumns({"tsls": F.col(t) - F.col("t_last"), "hold_err": F.abs(F.col(value) - F.col("v_last")), "line_err": F.abs(F.col(value) - line)})


def horizon(tsls: Column, edges: tuple[float, ...] = (25, 75, 125, 250)) -> Column:
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(tsls <= edges[i], F.lit(i)).otherwise(out)
    return out


def horizon_stats(errors: DataFrame, err: str, bucket: str) -> DataFrame:
    """(bucket, n, rmse, p50, p90)."""
    return errors.groupBy(bucket).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col(err) * F.col(err))).alias("rmse"), F.percentile(err, 0.5).alias("p50"), F.percentile(err, 0.9).alias("p90"))


def k_step_velocity(rows: DataFrame, keys: list[str], t: str, value: str, *, k: int, fps: float, cap: float = 12.0) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(t)
    v = (F.col(value) - F.lag(value, k).over(w)) * fps / (F.col(t) - F.lag(t, k).over(w))
    return rows.withColumn("_v", v).withColumn("v", F.when(F.col("_v").isNotNull(), F.greatest(F.least("_v", F.lit(cap)), F.lit(-cap)))).drop("_v")


def decayed(base: Column, v0: Column, seconds: Column, tau: Column | float) -> Column:
    """Position after an exponentially dying velocity."""
    tau = F.lit(tau) if isinstance(tau, float) else tau
    return base + v0 * tau * (1 - F.exp(-seconds / tau))


def best_tau(samples: DataFrame, grid: list[float]) -> DataFrame:
    """(tau, rmse) with the least squared error; samples carry base, v0, seconds, truth."""
    g = samples.withColumn("tau", F.explode(F.array(*(F.lit(float(x)) for x in grid))))
    e = F.col("truth") - decayed(F.col("base"), F.coalesce("v0", F.lit(0.0)), F.col("seconds"), F.col("tau"))
    s = g.groupBy("tau").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    return s.agg(F.min(F.struct("rmse", "tau")).alias("b")).select("b.tau", "b.rmse")


def smooth_camera(ball: DataFrame, *, half: int = 12) -> DataFrame:
    """(chunk, frame, cam): centred moving average of the ball's x."""
    w = Window.partitionBy("chunk").orderBy("frame").rowsBetween(-half, half)
    return ball.select(*FRAME, F.avg("x").over(w).alias("cam"))


def visibility_runs(rows: DataFrame, keys: list[str], t: str, step: int) -> DataFrame:
    """(keys, f0, f1, n): maximal stretches of visible rows one step apart."""
    w = Window.partitionBy(*keys).orderBy(t)
    g = rows.withColumn("_g", F.col(t) - step * F.row_number().over(w))
    return g.groupBy(*keys, "_g").agg(F.min(t).alias("f0"), F.max(t).alias("f1"), F.count("*").alias("n")).drop("_g")


def emit_policy(r90: Column, anchor: Column, limit: Column, seen: Column) -> Column:
    """What to report for a hidden player: the model where it is sure, the anchor where that is, else nothing."""
    return F.when(seen, "observed").when(r90 <= limit, "model").when(anchor <= limit, "anchor").otherwise("abstain")


def attack_signs(rows: DataFrame, keys: list[str], slot: str, x: str) -> DataFrame:
    """(keys, sign): +1 if the slot farthest from halfway on average stands below it."""
    m = rows.groupBy(*keys, slot).agg(F.avg(x).alias("m"))
    far = m.groupBy(*keys).agg(F.max(F.struct(F.abs(F.col("m") - P.LENGTH / 2).alias("d"), F.col(slot).alias("s"), F.col("m").alias("m"))).alias("b"))
    return far.select(*keys, F.when(F.col("b.m") < P.LENGTH / 2, 1).otherwise(-1).alias("sign"))
