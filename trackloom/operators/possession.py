"""Who holds the ball, passes, turnovers, spells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import pitch as P
from trackloom.plans.matches import kind
from trackloom.plans.ordered import first_by, range_join, runs


def nearest_player(ball: DataFrame, players: DataFrame) -> DataFrame:
    """Ball rows with the nearest player of the same frame; of equally near ones the smaller track."""
    j = ball.join(players.select("chunk", "frame", F.col("track_id").alias("carrier"), "team", "pitch_x", "pitch_y"), ["chunk", "frame"])
    j = j.withColumn("dist_m", P.distance("pitch_x", "pitch_y", "x", "y"))
    best = j.groupBy("chunk", "frame", "x", "y").agg(F.min(F.struct("dist_m", "carrier", "team")).alias("b"))
    return best.select("chunk", "frame", "x", "y", "b.carrier", "b.team", "b.dist_m")


def assign_possession(ball: DataFrame, players: DataFrame, *, radius_m: float = 2.0, debounce: int = 1) -> DataFrame:
    """(chunk, frame, carrier, team, dist_m) where someone is within the radius; runs of one team shorter than ``debounce`` are dropped."""
    p = nearest_player(ball, players).where(F.col("dist_m") <= radius_m).select("chunk", "frame", "carrier", "team", "dist_m")
    return drop_short_runs(p, debounce) if debounce > 1 else p


def drop_short_runs(poss: DataFrame, n: int) -> DataFrame:
    r = runs(poss, ["chunk"], "frame", "team")
    return r.withColumn("_n", F.count("*").over(Window.partitionBy("chunk", "run"))).where(F.col("_n") >= n).drop("run", "_n")


def cheapest_path(cost: np.ndarray, penalty: float) -> np.ndarray:
    """State per step with least summed cost, ``penalty`` for every change; ties go to the lower state."""
    n, k = cost.shape
    best, back = cost[0].copy(), np.zeros((n, k), int)
    move = penalty * (1 - np.eye(k))
    for i in range(1, n):
        ways = best[:, None] + move
        back[i] = ways.argmin(0)
        best = cost[i] + ways.min(0)
    path = np.zeros(n, int)
    path[-1] = int(best.argmin())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def smooth_possession(ball: DataFrame, players: DataFrame, *, radius_m: float = 2.0, penalty_m: float = 1.5, block: int = 20_000) -> DataFrame:
    """Possession whose team sequence minimises the distances to each team's nearest player plus a cost per change.

    Frames count where the nearest player is within the radius; the carrier is the chosen team's nearest player, however far.
    Where one team is nearer by more than two changes cost, every cheapest path holds it, so a chunk is cut there, about
    every ``block`` frames, and the parts are solved apart with the cut frame in both.
    """
    j = ball.join(players.where("team >= 0").select("chunk", "frame", F.col("track_id").alias("carrier"), "team", "pitch_x", "pitch_y"), ["chunk", "frame"])
    j = j.withColumn("d", P.distance("pitch_x", "pitch_y", "x", "y"))
    per = j.groupBy("chunk", "frame", "team").agg(F.min(F.struct("d", "carrier")).alias("m"))
    rows = per.groupBy("chunk", "frame").agg(*(F.first(F.when(F.col("team") == t, F.col("m")), ignorenulls=True).alias(f"m{t}") for t in (0, 1)))
    rows = rows.select("chunk", "frame", *(F.col(f"m{t}.{c}").alias(f"{c}{t}") for t in (0, 1) for c in ("d", "carrier"))).where(F.least("d0", "d1") <= radius_m)
    sure = F.abs(F.coalesce("d0", F.lit(1e6)) - F.coalesce("d1", F.lit(1e6))) > 2 * penalty_m
    rows = rows.withColumns({"_s": sure, "_b": F.expr(f"(frame - pmod(frame, {block}L)) div {block}L")})
    first_sure = F.row_number().over(Window.partitionBy("chunk", "_b", "_s").orderBy("frame")) == 1
    rows = rows.withColumn("_cut", F.col("_s") & first_sure)
    rows = rows.withColumn("part", F.sum(F.col("_cut").cast("int")).over(Window.partitionBy("chunk").orderBy("frame")))
    both = F.when(F.col("_cut"), F.array(F.col("part") - 1, F.col("part"))).otherwise(F.array("part"))
    rows = rows.withColumn("_own", F.col("part")).withColumn("part", F.explode(both)).select("chunk", "frame", "part", "_own", "d0", "d1", "carrier0", "carrier1")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        state = cheapest_path(pdf[["d0", "d1"]].fillna(1e6).to_numpy(), penalty_m)
        pick = lambda a, b: np.where(state == 0, pdf[a], pdf[b])
        out = pd.DataFrame({"chunk": pdf["chunk"], "frame": pdf["frame"], "carrier": pick("carrier0", "carrier1"), "team": state, "dist_m": pick("d0", "d1")})
        return out[(pdf["_own"] == pdf["part"]).to_numpy()].dropna(subset=["carrier"]).astype({"carrier": "int64", "team": "int32"})

    return rows.groupBy("chunk", "part").applyInPandas(run, f"{kind(rows, 'chunk')}, frame long, carrier long, team int, dist_m double")


def passes(poss: DataFrame, players: DataFrame, *, max_gap: int = 22) -> DataFrame:
    """Consecutive possession rows of one team and two carriers at most ``max_gap`` frames apart, with both places."""
    w = Window.partitionBy("chunk").orderBy("frame")
    n = poss.select("chunk", "frame", "team", F.col("carrier").alias("from_id"), F.lead("frame").over(w).alias("f_to"), F.lead("team").over(w).alias("t_to"), F.lead("carrier").over(w).alias("to_id"))
    n = n.where((F.col("t_to") == F.col("team")) & (F.col("to_id") != F.col("from_id")) & (F.col("f_to") - F.col("frame") <= max_gap)).drop("t_to")
    at = lambda f, i, x, y: players.select("chunk", F.col("frame").alias(f), F.col("track_id").alias(i), F.col("pitch_x").alias(x), F.col("pitch_y").alias(y))
    n = n.join(at("frame", "from_id", "x0", "y0"), ["chunk", "frame", "from_id"]).join(at("f_to", "to_id", "x1", "y1"), ["chunk", "f_to", "to_id"])
    return n.withColumn("length_m", P.distance("x0", "y0", "x1", "y1"))


def pass_edges(p: DataFrame) -> DataFrame:
    return p.groupBy("team", "from_id", "to_id").agg(F.count("*").alias("weight"))


def pass_nodes(p: DataFrame, players: DataFrame) -> DataFrame:
    """(team, track_id, touches, mean place) of everyone who gave or got a pass."""
    ends = p.select("team", F.explode(F.array("from_id", "to_id")).alias("track_id")).groupBy("team", "track_id").agg(F.count("*").alias("touches"))
    where = players.groupBy("team", "track_id").agg(F.avg("pitch_x").alias("x"), F.avg("pitch_y").alias("y"))
    return ends.join(where, ["team", "track_id"])


def turnovers(poss: DataFrame, ball: DataFrame) -> DataFrame:
    """Consecutive possession rows of two teams, placed by the ball at the later; dropped where the ball is missing."""
    w = Window.partitionBy("chunk").orderBy("frame")
    t = poss.select("chunk", "frame", F.lag("team").over(w).alias("lost_team"), F.col("team").alias("won_team")).where("lost_team <> won_team")
    return t.join(ball.select("chunk", "frame", "x", "y"), ["chunk", "frame"])


def spells(poss: DataFrame, *, max_gap: int | None = None) -> DataFrame:
    """(chunk, team, f0, f1, samples) of maximal runs of one team."""
    r = runs(poss, ["chunk"], "frame", "team", max_gap=max_gap)
    return r.groupBy("chunk", "run", "team").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.count("*").alias("samples")).drop("run")


def transition_table(turn: DataFrame, ball: DataFrame, players: DataFrame, dirs: DataFrame, *, window: int = 125, press_m: float = 5.0) -> DataFrame:
    """Per turnover: first frame in the window at which a loser is within ``press_m`` of the ball, threat gained by the winner, high regain."""
    t = turn.withColumn("lo", F.col("frame") + 1).withColumn("hi", F.col("frame") + window).withColumnRenamed("frame", "f0").withColumnsRenamed({"x": "tx", "y": "ty"})
    seen = range_join(ball, t, ["chunk"], "frame", "lo", "hi", 250)
    near = seen.join(players.select("chunk", "frame", F.col("team").alias("lost_team"), "pitch_x", "pitch_y"), ["chunk", "frame", "lost_team"])
    press = near.where(P.distance("pitch_x", "pitch_y", "x", "y") <= press_m).groupBy("chunk", "f0").agg(F.min("frame").alias("pressed_at"))
    last = seen.groupBy("chunk", "f0").agg(F.max(F.struct("frame", "x", "y")).alias("z"))
    out = t.join(press, ["chunk", "f0"], "left").join(last, ["chunk", "f0"], "left").join(dirs.withColumnRenamed("team", "won_team"), ["chunk", "won_team"], "left")
    gain = P.threat(P.advance("z.x", "dir"), "z.y") - P.threat(P.advance("tx", "dir"), "ty")
    return out.select("chunk", F.col("f0").alias("frame"), "lost_team", "won_team", (F.col("pressed_at") - F.col("f0")).alias("recovery"), gain.alias("gain"), (P.advance("tx", "dir") > P.FINAL_THIRD).alias("high"))


def transition_metrics(table: DataFrame) -> DataFrame:
    """(team, won, lost, counterpress_rate, mean_recovery, counter_threat, high_regains)."""
    both = table.select(F.col("lost_team").alias("team"), F.lit(0).alias("won"), F.col("recovery"), F.lit(None).cast("double").alias("gain"), F.lit(False).alias("high")).unionByName(
        table.select(F.col("won_team").alias("team"), F.lit(1).alias("won"), F.lit(None).cast("long").alias("recovery"), "gain", "high"))
    lost = F.count(F.when(F.col("won") == 0, 1))
    return both.where("team >= 0").groupBy("team").agg(
        F.sum("won").alias("won"), lost.alias("lost"), F.try_divide(F.count("recovery"), lost).alias("counterpress_rate"), F.avg("recovery").alias("mean_recovery"),
        F.avg("gain").alias("counter_threat"), F.count(F.when(F.col("high"), 1)).alias("high_regains"))


def regain_curve(turn: DataFrame, poss: DataFrame, *, fps: float = 25.0, windows: tuple[int, ...] = (3, 4, 5, 6, 8)) -> DataFrame:
    """(team, losses, regain_<t>s): share of losses after which the team holds the ball again within t seconds."""
    t = turn.select("chunk", F.col("frame").alias("f0"), "lost_team", (F.col("frame") + 1).alias("lo"), (F.col("frame") + int(max(windows) * fps)).alias("hi"))
    back = range_join(poss.select("chunk", "frame", "team"), t, ["chunk"], "frame", "lo", "hi", 250).where("team = lost_team").groupBy("chunk", "f0").agg(F.min("frame").alias("back"))
    d = (F.col("back") - F.col("f0")) / fps
    j = t.join(back, ["chunk", "f0"], "left")
    return j.groupBy(F.col("lost_team").alias("team")).agg(F.count("*").alias("losses"), *(F.avg(F.coalesce(d <= w, F.lit(False)).cast("double")).alias(f"regain_{w}s") for w in windows))


def ppda(poss: DataFrame, p: DataFrame, players: DataFrame, dirs: DataFrame, *, press_m: float = 3.0, zone: float = 0.6) -> DataFrame:
    """(team, passes_allowed, pressures, ppda) of the pressing team: the opponent's passes from its own zone per frame in which its carrier there is pressed."""
    inside = lambda x: P.advance(x, "dir") <= zone * P.LENGTH
    allowed = p.join(dirs, ["chunk", "team"]).where(inside("x0")).groupBy("team").agg(F.count("*").alias("passes_allowed"))
    c = poss.join(players.select("chunk", "frame", F.col("track_id").alias("carrier"), F.col("pitch_x").alias("cx"), F.col("pitch_y").alias("cy")), ["chunk", "frame", "carrier"]).join(dirs, ["chunk", "team"]).where(inside("cx"))
    o = players.select(F.col("chunk").alias("c2"), F.col("frame").alias("f2"), F.col("team").alias("t2"), "pitch_x", "pitch_y")
    near = (F.col("chunk") == F.col("c2")) & (F.col("frame") == F.col("f2")) & (F.col("team") != F.col("t2")) & (P.distance("pitch_x", "pitch_y", "cx", "cy") <= press_m)
    pressed = c.join(o, near, "left_semi").groupBy("team").agg(F.count("*").alias("pressures"))
    j = allowed.join(pressed, "team", "full").select((1 - F.col("team")).alias("team"), F.coalesce("passes_allowed", F.lit(0)).alias("passes_allowed"), F.coalesce("pressures", F.lit(0)).alias("pressures"))
    return j.withColumn("ppda", F.try_divide("passes_allowed", "pressures"))


def carrier_filled(poss: DataFrame, frames: DataFrame) -> DataFrame:
    """All frames with the last team that held the ball."""
    j = frames.select("chunk", "frame").distinct().join(poss.select("chunk", "frame", "team"), ["chunk", "frame"], "left")
    w = Window.partitionBy("chunk").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return j.select("chunk", "frame", F.last("team", ignorenulls=True).over(w).alias("team"))


def first_of_frame(poss: DataFrame) -> DataFrame:
    return first_by(poss.where("team >= 0"), ["chunk", "frame"], "dist_m", "carrier")
