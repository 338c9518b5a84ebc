"""Smoothed tracks, velocities, run targets, ball linking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import pitch as P
from trackloom.operators.shape import PLAYERS
from trackloom.plans.joins import null_safe_join
from trackloom.plans.matches import kind
from trackloom.plans.ordered import asof

KEY = ["chunk", "track_id"]
#: Weights of the least-squares parabola through five points, at its first, second and middle point.
_EDGE0, _EDGE1, _MID = (31, 9, -3, -5, 3), (9, 13, 12, 6, -5), (-3, 12, 17, 12, -3)


def _parabola(c: str, w) -> Column:
    at = lambda k: F.lag(c, -k).over(w)
    fit = lambda weights, ks: sum((at(k) * x for k, x in zip(ks, weights, strict=True)), F.lit(0.0)) / 35
    n, i = F.col("_n"), F.col("_i")
    return (
        F.when(n < 5, F.col(c)).when(i == 1, fit(_EDGE0, range(5))).when(i == 2, fit(_EDGE1, range(-1, 4)))
        .when(i == n, fit(_EDGE0[::-1], range(-4, 1))).when(i == n - 1, fit(_EDGE1[::-1], range(-3, 2))).otherwise(fit(_MID, range(-2, 3)))
    )


def build_tracks(pos: DataFrame, *, fps: float = 25.0, step: int = 5, gap_steps: int = 3, cap: float = 10.0) -> DataFrame:
    """Player rows with x_s, y_s (a quadratic over five samples), vx, vy, speed.

    Velocity is the second-order difference over uneven times, one-sided at a track's end, null at its start and after gaps of more than
    ``gap_steps`` steps, and scaled down to ``cap`` m/s.  Tracks under five samples are not smoothed.
    """
    w, whole = Window.partitionBy(*KEY).orderBy("frame"), Window.partitionBy(*KEY)
    t = pos.where(PLAYERS).withColumn("_n", F.count("*").over(whole)).withColumn("_i", F.row_number().over(w))
    t = t.withColumns({"x_s": _parabola("pitch_x", w), "y_s": _parabola("pitch_y", w)})
    before, after = (F.col("frame") - F.lag("frame").over(w)) / fps, (F.lead("frame").over(w) - F.col("frame")) / fps
    t = t.withColumns({"_a": before, "_b": after})
    a, b = F.col("_a"), F.col("_b")

    def slope(c: str) -> Column:
        prev, nxt = F.lag(c).over(w), F.lead(c).over(w)
        inner = (a * a * nxt + (b * b - a * a) * F.col(c) - b * b * prev) / (a * b * (a + b))
        return F.when(a.isNull() | (a * fps > gap_steps * step), None).when(b.isNull(), (F.col(c) - prev) / a).otherwise(inner)

    t = t.withColumns({"_u": slope("x_s"), "_v": slope("y_s")})
    raw = F.sqrt(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v"))
    scale = F.when(raw > cap, cap / raw).otherwise(1.0)
    return t.withColumns({"vx": F.col("_u") * scale, "vy": F.col("_v") * scale, "speed": F.when(raw > cap, cap).otherwise(raw)}).drop("_n", "_i", "_a", "_b", "_u", "_v")


def run_targets(tracks: DataFrame, *, horizon: int, tolerance: int) -> DataFrame:
    """Each row with its own track's nearest row ``horizon`` frames later, if within the tolerance."""
    t = tracks.select(*KEY, "frame", "x_s", "y_s")
    aim = t.select(*KEY, F.col("frame").alias("f0"), F.col("x_s").alias("x0"), F.col("y_s").alias("y0"), (F.col("frame") + horizon).alias("frame"))
    j = asof(aim, t, KEY, "frame", direction="nearest", tolerance=tolerance, take=["x_s", "y_s"]).where("r_frame is not null")
    return j.select(*KEY, F.col("f0").alias("frame"), (F.col("x_s") - F.col("x0")).alias("dx"), (F.col("y_s") - F.col("y0")).alias("dy"))


def physical_profile(tracks: DataFrame) -> DataFrame:
    """(team, zone shares, p99, mean): shares of walking, jogging, running and sprinting speeds."""
    s = F.col("speed")
    return tracks.where("speed is not null").groupBy("team").agg(
        F.avg((s < 2).cast("double")).alias("walk"), F.avg(s.between(2, 3.999999999).cast("double")).alias("jog"), F.avg(((s >= 4) & (s < 7)).cast("double")).alias("run"),
        F.avg((s >= 7).cast("double")).alias("sprint"), F.percentile("speed", 0.99).alias("p99"), F.avg("speed").alias("mean_speed"))


def synchrony(tracks: DataFrame, *, slow: float = 0.5, least: int = 3) -> DataFrame:
    """(team, synchrony): length of the mean unit velocity per frame, averaged per chunk, then over chunks."""
    m = tracks.where(F.col("speed") > slow).groupBy("chunk", "frame", "team").agg(F.count("*").alias("n"), F.avg(F.col("vx") / F.col("speed")).alias("ux"), F.avg(F.col("vy") / F.col("speed")).alias("uy"))
    m = m.where(F.col("n") >= least).withColumn("r", F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy")))
    return m.groupBy("chunk", "team").agg(F.avg("r").alias("r")).groupBy("team").agg(F.avg("r").alias("synchrony"))


def link_points(frames: np.ndarray, xs: np.ndarray, ys: np.ndarray, *, fps: float, cap: float, max_gap: int, step: int | None = None) -> list[tuple[int, float, float, bool]]:
    """One path through candidates sorted by frame: each frame's candidate nearest the constant-velocity forecast, if reachable.

    After more than ``max_gap`` steps without one it starts anew at the first candidate; shorter holes are filled linearly.
    """
    marks = np.unique(frames)
    if step is None:
        step = (int(np.median(np.diff(marks))) if len(marks) > 1 else 1) or 1
    path: list[tuple[int, float, float]] = []
    velocity = np.zeros(2)
    for f in marks:
        own = slice(np.searchsorted(frames, f, "left"), np.searchsorted(frames, f, "right"))
        here = np.column_stack([xs[own], ys[own]])
        if not path or f - path[-1][0] > max_gap * step:
            path.append((int(f), *here[0]))
            velocity = np.zeros(2)
            continue
        dt = (f - path[-1][0]) / fps
        was = np.array(path[-1][1:])
        off = np.hypot(*(here - (was + velocity * dt)).T)
        best = int(off.argmin())
        if off[best] > cap * dt + 1e-6:
            continue
        velocity = (here[best] - was) / dt
        speed = float(np.hypot(*velocity))
        if speed > cap:
            velocity *= cap / speed
        path.append((int(f), *here[best]))
    out: list[tuple[int, float, float, bool]] = []
    for i, (f, x, y) in enumerate(path):
        if i:
            g, u, v = path[i - 1]
            n = (f - g) // step
            if 1 < n <= max_gap:
                out += [(g + k * step, u + k / n * (x - u), v + k / n * (y - v), False) for k in range(1, n)]
        out.append((f, x, y, True))
    return out


def link_ball(detections: DataFrame, *, fps: float = 50.0, cap: float = 40.0, max_gap: int = 8) -> DataFrame:
    """(chunk, frame, x, y, observed) from candidates (chunk, frame, x, y, conf); a frame's candidates are taken by falling conf, then x, y.

    The path starts anew after any hole of more than ``max_gap`` steps, so a chunk is cut at the holes between its frames
    and each stretch is linked on its own.
    """
    d = detections.select("chunk", "frame", "x", "y", "conf").where("frame IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    w = Window.partitionBy("chunk").orderBy("frame")
    f = d.select("chunk", "frame").distinct().withColumn("gap", F.col("frame") - F.lag("frame").over(w))
    step = f.groupBy("chunk").agg(F.greatest(F.floor(F.coalesce(F.percentile("gap", 0.5), F.lit(1.0))).cast("long"), F.lit(1)).alias("step"))
    f = null_safe_join(f, step, ["chunk"]).withColumn("part", F.sum((F.coalesce("gap", F.lit(0)) > max_gap * F.col("step")).cast("int")).over(w)).drop("gap")
    d = null_safe_join(d, f, ["chunk", "frame"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "conf", "x", "y"], ascending=[True, False, True, True])
        rows = link_points(pdf["frame"].to_numpy(), pdf["x"].to_numpy(), pdf["y"].to_numpy(), fps=fps, cap=cap, max_gap=max_gap, step=int(pdf["step"].iloc[0]))
        out = pd.DataFrame(rows, columns=["frame", "x", "y", "observed"])
        out.insert(0, "chunk", pdf["chunk"].iloc[0])
        return out

    return d.groupBy("chunk", "part").applyInPandas(run, f"{kind(d, 'chunk')}, frame long, x double, y double, observed boolean")


def fill_gaps(path: DataFrame, *, step: int, max_gap: int) -> DataFrame:
    """Linear points in the holes of 2 to ``max_gap`` steps of a path."""
    w = Window.partitionBy("chunk").orderBy("frame")
    p = path.withColumns({"f1": F.lead("frame").over(w), "x1": F.lead("x").over(w), "y1": F.lead("y").over(w)})
    n = F.expr(f"(f1 - frame) div {step}")
    last = F.when((n > 1) & (n <= max_gap), n - 1).otherwise(0)
    p = p.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    u = F.when(F.col("k") > 0, F.col("k") / F.col("n")).otherwise(0.0)
    lerp = lambda a, b: F.when(F.col("k") == 0, F.col(a)).otherwise(F.col(a) + u * (F.col(b) - F.col(a)))
    return p.select("chunk", (F.col("frame") + F.col("k") * step).alias("frame"), lerp("x", "x1").alias("x"), lerp("y", "y1").alias("y"), (F.col("k") == 0).alias("observed"))


def receivers(pos: DataFrame, *, most: int = 75) -> DataFrame:
    """Consecutive carrier rows of one team and two tracks at most ``most`` frames apart."""
    w = Window.partitionBy("chunk").orderBy("frame", "track_id")
    a = pos.where("is_actor").select("chunk", "frame", "team", F.col("track_id").alias("passer"), F.lead("frame").over(w).alias("f1"), F.lead("team").over(w).alias("t1"), F.lead("track_id").over(w).alias("receiver"))
    return a.where((F.col("t1") == F.col("team")) & (F.col("receiver") != F.col("passer")) & (F.col("f1") - F.col("frame") <= most)).drop("t1")


def advance_of(df: DataFrame, dirs: DataFrame) -> DataFrame:
    return df.join(dirs, ["chunk", "team"]).withColumn("ax", P.advance("pitch_x", "dir"))
