"""Phases, pressing, lines, overloads, threat, control, set pieces, attacks and score states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import pitch as P
from trackloom.operators.shape import PLAYERS
from trackloom.plans.matches import kind
from trackloom.plans.ordered import range_join, runs

FRAME = ["chunk", "frame"]


def ball_phases(ball: DataFrame, poss: DataFrame, pos: DataFrame, dirs: DataFrame, *, build: float = 35.0, progress: float = 70.0, high: float = 61.0, mid: float = 44.0) -> DataFrame:
    """(chunk, frame, team, phase, in_possession): the holder by the ball's advance, the other side by its own line, the 20th percentile of at least three outfield players."""
    h = poss.join(ball.select(*FRAME, "x", "y"), FRAME).join(dirs, ["chunk", "team"]).withColumn("ax", P.advance("x", "dir"))
    own = h.select(*FRAME, "team", F.when(F.col("ax") <= build, "build_up").when(F.col("ax") <= progress, "progression").otherwise("final_third").alias("phase"), F.lit(True).alias("in_possession"))
    line = pos.where(PLAYERS).where("role = 'player'").join(dirs, ["chunk", "team"]).groupBy(*FRAME, "team").agg(F.count("*").alias("n"), F.percentile(P.advance("pitch_x", "dir"), 0.2).alias("line")).where("n >= 3")
    d = h.select(*FRAME, (1 - F.col("team")).alias("team")).join(line, [*FRAME, "team"])
    other = d.select(*FRAME, "team", F.when(F.col("line") >= high, "high_press").when(F.col("line") >= mid, "mid_block").otherwise("low_block").alias("phase"), F.lit(False).alias("in_possession"))
    return own.unionByName(other)


def four_phases(poss: DataFrame, *, window: int = 125) -> DataFrame:
    """(chunk, frame, team, phase) of both teams: within the window after a change the winner is in trans_pos and the loser in trans_neg, else in_poss or out_poss; the first spell has no change."""
    w = Window.partitionBy("chunk").orderBy("frame")
    p = poss.select(*FRAME, F.col("team").alias("hold"), F.lag("team").over(w).alias("was"))
    p = p.withColumn("flip", F.last(F.when(F.col("hold") != F.col("was"), F.struct(F.col("frame").alias("f"), F.col("hold").alias("won"), F.col("was").alias("lost"))), ignorenulls=True).over(w))
    p = p.withColumn("team", F.explode(F.array(F.lit(0), F.lit(1))))
    near = F.col("frame") - F.col("flip.f") <= window
    phase = F.when(near & (F.col("team") == F.col("flip.won")), "trans_pos").when(near & (F.col("team") == F.col("flip.lost")), "trans_neg").when(F.col("team") == F.col("hold"), "in_poss").otherwise("out_poss")
    return p.select(*FRAME, "team", phase.alias("phase"))


def by_phase(labels: DataFrame, shapes: DataFrame, metrics: list[str], *keys: str) -> DataFrame:
    j = labels.join(shapes, [*FRAME, "team"])
    return j.groupBy("team", *keys).agg(F.count("*").alias("frames"), *(F.avg(c).alias(c) for c in metrics))


def pressing(ball: DataFrame, poss: DataFrame, tracks: DataFrame, *, react: float = 0.7, control: float = 1.0, top: float = 7.0, steep: float = 3.0, ref: float = 1.5) -> DataFrame:
    """(team, pressing_intensity, press_frames) of the defending side: mean chance that at least one defender reaches the ball in time.

    Time to the ball counts a reaction, the distance beyond control range at top speed, and a penalty for running the other way.
    """
    c = poss.join(ball.select(*FRAME, "x", "y"), FRAME).select(*FRAME, F.col("team").alias("holder"), "x", "y")
    d = c.join(tracks, FRAME).where("team <> holder AND team >= 0")
    dx, dy = F.col("x") - F.col("x_s"), F.col("y") - F.col("y_s")
    dist = F.sqrt(dx * dx + dy * dy)
    cos = F.try_divide(F.col("vx") * dx + F.col("vy") * dy, F.col("speed") * dist)
    t = react + F.coalesce(1.5 - 0.5 * cos, F.lit(1.0)) * F.greatest(F.lit(0.0), dist - control) / top
    d = d.withColumn("miss", F.log1p(-F.least(1 / (1 + F.exp(-steep * (ref - t))), F.lit(1 - 1e-12))))
    f = d.groupBy(*FRAME, "team").agg((1 - F.exp(F.sum("miss"))).alias("p"))
    return f.groupBy("team").agg(F.avg("p").alias("pressing_intensity"), F.count("*").alias("press_frames"))


def line_gap(ball: DataFrame, poss: DataFrame, players: DataFrame, dirs: DataFrame) -> DataFrame:
    """(chunk, frame, team, diff): the ball's advance beyond the opponents' line (80th percentile of at least three on the holder's axis)."""
    h = poss.join(ball.select(*FRAME, "x", "y"), FRAME).join(dirs, ["chunk", "team"]).select(*FRAME, "team", "dir", P.advance("x", "dir").alias("ax"))
    o = h.join(players.select(*FRAME, (1 - F.col("team")).alias("team"), "pitch_x"), [*FRAME, "team"])
    g = o.groupBy(*FRAME, "team", "ax").agg(F.count("*").alias("n"), F.percentile(P.advance("pitch_x", "dir"), 0.8).alias("line")).where("n >= 3")
    return g.select(*FRAME, "team", (F.col("ax") - F.col("line")).alias("diff"))


def line_breaks(gap: DataFrame, *, band: float = 5.0, between: int = 25) -> DataFrame:
    """(team, line_breaks, in_poss_frames): the ball goes from clearly before to clearly behind the line; a crossing too soon after the last leaves the state armed."""
    g = gap.groupBy("chunk", "team").agg(F.array_sort(F.collect_list(F.struct("frame", "diff"))).alias("l"), F.count("*").alias("frames"))
    fold = f"""aggregate(l, named_struct('n', 0L, 'armed', false, 'last', -1000000000L), (a, x) ->
      CASE WHEN x.diff < -{band}D THEN named_struct('n', a.n, 'armed', true, 'last', a.last)
           WHEN x.diff > {band}D AND a.armed AND x.frame - a.last >= {between} THEN named_struct('n', a.n + 1L, 'armed', false, 'last', x.frame) ELSE a END)"""
    return g.withColumn("n", F.expr(fold)["n"]).groupBy("team").agg(F.sum("n").alias("line_breaks"), F.sum("frames").alias("in_poss_frames"))


def overload(ball: DataFrame, poss: DataFrame, players: DataFrame, *, radius: float = 12.0) -> DataFrame:
    """(team, mean_overload, overload_share, frames) of the holder: its players minus the opponents within the radius of the ball."""
    c = poss.select(*FRAME, F.col("team").alias("holder")).join(ball.select(*FRAME, "x", "y"), FRAME).join(players, FRAME)
    near = P.distance("pitch_x", "pitch_y", "x", "y") <= radius
    f = c.groupBy(*FRAME, "holder").agg((F.count(F.when(near & (F.col("team") == F.col("holder")), 1)) - F.count(F.when(near & (F.col("team") == 1 - F.col("holder")), 1))).alias("o"))
    return f.groupBy(F.col("holder").alias("team")).agg(F.avg("o").alias("mean_overload"), F.avg((F.col("o") >= 1).cast("double")).alias("overload_share"), F.count("*").alias("frames"))


def verticality(ball: DataFrame, poss: DataFrame, dirs: DataFrame, *, least: int = 10) -> DataFrame:
    """(team, verticality, spells): goalward progress over path length, summed over spells of at least ``least`` samples."""
    s = runs(poss.join(ball.select(*FRAME, "x", "y"), FRAME).join(dirs, ["chunk", "team"], "left"), ["chunk"], "frame", "team").withColumn("ax", P.advance("x", "dir"))
    w = Window.partitionBy("chunk", "run").orderBy("frame")
    s = s.withColumn("step", P.distance(F.lag("ax").over(w), F.lag("y").over(w), "ax", "y"))
    g = s.where("dir is not null").groupBy("chunk", "run", "team").agg(F.count("*").alias("n"), (F.max_by("ax", "frame") - F.min_by("ax", "frame")).alias("fwd"), F.sum("step").alias("path")).where(F.col("n") >= least)
    return g.groupBy("team").agg(F.try_divide(F.sum(F.greatest("fwd", F.lit(0.0))), F.sum("path")).alias("verticality"), F.count("*").alias("spells"))


LANES, THIRDS = ("left_wing", "left_halfspace", "centre", "right_halfspace", "right_wing"), ("def", "mid", "att")


def lane_occupation(players: DataFrame, dirs: DataFrame) -> DataFrame:
    """Shares of the five lanes, the final third and the fifteen lane-third cells per team, seen in attack direction; outliers count in edge bins."""
    p = players.join(dirs, ["chunk", "team"]).select("team", P.lane(P.across("pitch_y", "dir"), clip=True).alias("l"), P.third(P.advance("pitch_x", "dir")).alias("t"))
    share = lambda c: F.avg(c.cast("double"))
    cells = [share((F.col("l") == i) & (F.col("t") == j)).alias(f"{a}_{b}") for i, a in enumerate(LANES) for j, b in enumerate(THIRDS)]
    return p.groupBy("team").agg(share(F.col("l").isin(1, 3)).alias("halfspace_share"), share(F.col("l").isin(0, 4)).alias("wing_share"), share(F.col("l") == 2).alias("centre_share"), share(F.col("t") == 2).alias("final_third_share"), *cells)


def threat_created(ball: DataFrame, poss: DataFrame, dirs: DataFrame) -> DataFrame:
    """(team, xt_created, n_moves): summed gains in threat between adjacent ball rows of one holder; a row without a holder breaks the chain."""
    b = ball.join(poss.select(*FRAME, "team"), FRAME, "left").join(dirs, ["chunk", "team"], "left").withColumn("v", P.threat(P.advance("x", "dir"), "y"))
    w = Window.partitionBy("chunk").orderBy("frame")
    d = F.col("v") - F.lag("v").over(w)
    b = b.withColumn("gain", F.when((F.lag("team").over(w) == F.col("team")) & (d > 0), d)).where("gain is not null")
    return b.groupBy("team").agg(F.sum("gain").alias("xt_created"), F.count("*").alias("n_moves"))


def control_cells(tracks: DataFrame, *, nx: int = 21, ny: int = 14, sigma: float = 9.0, ahead: float = 0.5) -> DataFrame:
    """(chunk, frame, gx, gy, control): team 0's share of Gaussian influence at each grid point, of frames with at least three players a side."""
    p = tracks.where("team IN (0, 1)").select(*FRAME, "team", (F.col("pitch_x") + F.coalesce("vx", F.lit(0.0)) * ahead).alias("px"), (F.col("pitch_y") + F.coalesce("vy", F.lit(0.0)) * ahead).alias("py"))
    ok = p.groupBy(*FRAME).agg(F.count(F.when(F.col("team") == 0, 1)).alias("a"), F.count(F.when(F.col("team") == 1, 1)).alias("b")).where("a >= 3 AND b >= 3").select(*FRAME)
    p = p.join(ok, FRAME)
    g = p.groupBy(*FRAME).agg(F.collect_list(F.struct("team", "px", "py")).alias("p"))
    gx, gy = (v.ravel() for v in np.meshgrid(np.linspace(0, P.LENGTH, nx), np.linspace(0, P.WIDTH, ny)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                lists = part.column("p")
                ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                flat = lists.flatten()
                team, px, py = (flat.field(c).to_numpy(zero_copy_only=False)[:, None] for c in ("team", "px", "py"))
                inf = np.exp(-((gx - px) ** 2 + (gy - py) ** 2) / (2 * sigma * sigma))
                own, all_ = (np.add.reduceat(v, ends[:-1], axis=0) for v in (inf * (team == 0), inf))
                n = part.num_rows
                cols = [part.column(c).take(pa.array(np.repeat(np.arange(n), len(gx)))) for c in FRAME]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.tile(gx, n)), pa.array(np.tile(gy, n)), pa.array((own / (all_ + 1e-9)).ravel())], [*FRAME, "gx", "gy", "control"])

    return g.mapInArrow(run, f"{kind(g, 'chunk')}, frame long, gx double, gy double, control double")


def space_control(cells: DataFrame, dirs: DataFrame) -> DataFrame:
    """(team, space_control, attacking_control); team 1's zone is everything outside team 0's attacking third."""
    d0 = dirs.where("team = 0").select("chunk", "dir")
    c = cells.join(d0, "chunk", "left").withColumn("dir", F.coalesce("dir", F.lit(1)))
    edge = 2 * P.LENGTH / 3
    mine = F.when(F.col("dir") > 0, F.col("gx") > edge).otherwise(F.col("gx") < P.LENGTH - edge)
    f = c.groupBy(*FRAME).agg(F.avg("control").alias("s"), F.avg(F.when(mine, F.col("control"))).alias("a0"), F.avg(F.when(~mine, 1 - F.col("control"))).alias("a1"))
    t = F.explode(F.array(F.struct(F.lit(0).alias("team"), F.col("s").alias("s"), F.col("a0").alias("a")), F.struct(F.lit(1).alias("team"), (1 - F.col("s")).alias("s"), F.col("a1").alias("a"))))
    return f.select(t.alias("t")).groupBy("t.team").agg(F.avg("t.s").alias("space_control"), F.avg("t.a").alias("attacking_control"))


def controlled_threat(cells: DataFrame, dirs: DataFrame) -> DataFrame:
    """(team, controlled_threat, threat_share, frames): control times threat summed over the grid."""
    d0 = dirs.where("team = 0").select("chunk", "dir")
    c = cells.join(d0, "chunk", "left").withColumn("dir", F.coalesce("dir", F.lit(1)))
    ax = P.advance("gx", "dir")
    f = c.groupBy(*FRAME).agg(F.sum(F.col("control") * P.threat(ax, "gy")).alias("t0"), F.sum((1 - F.col("control")) * P.threat(P.LENGTH - ax, "gy")).alias("t1"))
    total = F.col("t0") + F.col("t1") + 1e-9
    t = F.explode(F.array(*(F.struct(F.lit(i).alias("team"), F.col(f"t{i}").alias("t"), (F.col(f"t{i}") / total).alias("s")) for i in (0, 1))))
    return f.select(t.alias("t")).groupBy("t.team").agg(F.avg("t.t").alias("controlled_threat"), F.avg("t.s").alias("threat_share"), F.count("*").alias("frames"))


def set_piece(x: str, y: str, *, corner: float = 3.0, touch: float = 1.5, six: float = 5.5, half: float = 9.16) -> Column:
    ex, ey = F.least(F.col(x), P.LENGTH - F.col(x)), F.least(F.col(y), P.WIDTH - F.col(y))
    return F.when((ex <= corner) & (ey <= corner), "corner").when(ey <= touch, "throw_in").when((ex <= six) & (F.abs(F.col(y) - P.WIDTH / 2) <= half), "goal_kick").otherwise("free_kick")


def set_pieces(ball: DataFrame, *, fps: float = 25.0, gap: int = 50, settle: float = 6.0) -> DataFrame:
    """(chunk, frame, type, x, y, gap_frames): the first ball row after a long hole, unless it flies."""
    w = Window.partitionBy("chunk").orderBy("frame")
    b = ball.withColumn("gap_frames", F.col("frame") - F.lag("frame").over(w)).withColumn("speed", P.distance(F.lag("x").over(w), F.lag("y").over(w), "x", "y") * fps / F.col("gap_frames"))
    return b.where((F.col("gap_frames") > gap) & (F.col("speed") <= settle)).select(*FRAME, set_piece("x", "y").alias("type"), "x", "y", "gap_frames")


def set_piece_summary(pieces: DataFrame) -> DataFrame:
    """(total, reliable, candidate, corner, throw_in, goal_kick, free_kick), all zero for no pieces."""
    n = lambda t: F.count(F.when(F.col("type") == t, 1))
    return pieces.agg(F.count("*").alias("total"), (n("corner") + n("throw_in") + n("goal_kick")).alias("reliable"), n("free_kick").alias("candidate"), *(n(t).alias(t) for t in ("corner", "throw_in", "goal_kick", "free_kick")))


def attack_label(n: Column, start: Column, entry: Column, *, many: int = 6, slow: float = 15.0, few: int = 2) -> Column:
    """Kind of an attack from its passes, starting advance and seconds to the final third."""
    sustained = (n >= many) | (entry > slow)
    return (
        F.when(start >= P.FINAL_THIRD, "high_start").when(entry.isNotNull(), F.when(sustained, "sustained_build_up").when(n <= few, "direct").otherwise("fast_transition"))
        .when(start.isNotNull() | (n > 0), F.when(n >= many, "sustained").otherwise("fast"))
    )


def attacks(spells: DataFrame, passes: DataFrame, ball: DataFrame, dirs: DataFrame, *, fps: float = 25.0) -> DataFrame:
    """Spells with their passes, start, entry into the final third and label."""
    s = spells.withColumn("lo", F.col("f0")).withColumn("hi", F.col("f1"))
    n = range_join(passes.select("chunk", "frame", F.col("team").alias("pt")), s, ["chunk"], "frame", "lo", "hi", 500).where("pt = team").groupBy("chunk", "f0").agg(F.count("*").alias("n_passes"))
    b = range_join(ball.select(*FRAME, "x"), s, ["chunk"], "frame", "lo", "hi", 500).join(dirs, ["chunk", "team"]).withColumn("ax", P.advance("x", "dir"))
    g = b.groupBy("chunk", "f0").agg(F.min_by("ax", "frame").alias("start_ac"), F.min(F.when(F.col("ax") >= P.FINAL_THIRD, F.col("frame"))).alias("at"))
    j = spells.join(n, ["chunk", "f0"], "left").join(g, ["chunk", "f0"], "left").withColumn("n_passes", F.coalesce("n_passes", F.lit(0)))
    entry = (F.col("at") - F.col("f0")) / fps
    return j.select("chunk", "team", "f0", "f1", "n_passes", "start_ac", entry.alias("entry_s"), attack_label(F.col("n_passes"), F.col("start_ac"), entry).alias("label"))


def attack_mix(a: DataFrame) -> DataFrame:
    """(team, n_attack, share of each label among the labelled)."""
    n = F.count("label")
    names = ("high_start", "sustained_build_up", "direct", "fast_transition", "sustained", "fast")
    return a.groupBy("team").agg(n.alias("n_attack"), *(F.try_divide(F.count(F.when(F.col("label") == k, 1)), n).alias(k) for k in names))


def block_frames(ball: DataFrame, poss: DataFrame, pos: DataFrame, dirs: DataFrame, *, slope: float = -5.62) -> DataFrame:
    """Per possession frame the other team's line (mean of its four deepest outfielders, corrected for missing ones), spread along the attack and gap to the ball."""
    o = pos.where(PLAYERS).where("role = 'player'").join(dirs, ["chunk", "team"]).withColumn("ax", P.advance("pitch_x", "dir"))
    g = o.groupBy(*FRAME, "team").agg(F.count("*").alias("n"), F.stddev_pop("ax").alias("sd"), F.slice(F.array_sort(F.collect_list("ax")), 1, 4).alias("deep"))
    raw = F.expr("aggregate(deep, 0D, (a, v) -> a + v)") / F.size("deep")
    g = g.select(*FRAME, F.col("team").alias("def_team"), (raw + slope * (4 - F.least("n", F.lit(4)))).alias("line_m"), F.when(F.col("n") >= 3, F.col("sd")).alias("vspread_m"))
    d = dirs.select("chunk", F.col("team").alias("def_team"), "dir")
    h = poss.select(*FRAME, (1 - F.col("team")).alias("def_team")).join(ball.select(*FRAME, "x"), FRAME).join(d, ["chunk", "def_team"]).withColumn("ball_adv_m", P.advance("x", "dir"))
    j = h.join(g, [*FRAME, "def_team"], "left")
    return j.select(*FRAME, "def_team", "line_m", "vspread_m", "ball_adv_m", (F.col("ball_adv_m") - F.col("line_m")).alias("ball_to_block_m"), F.col("line_m").isNotNull().alias("usable"))


def block_spells(frames: DataFrame, *, least: int = 5, low: float = 33.0, high: float = 50.0) -> DataFrame:
    """Runs of one defending team with enough usable frames, their median line and class; only a change of team ends one."""
    r = runs(frames, ["chunk"], "frame", "def_team")
    g = r.groupBy("chunk", "run", "def_team").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.count("*").alias("n_frames"), F.count("line_m").alias("n_usable"), F.percentile("line_m", 0.5).alias("median_line_m")).where(F.col("n_usable") >= least).drop("run")
    return g.withColumn("block_class", F.when(F.col("median_line_m") < low, "low").when(F.col("median_line_m") >= high, "high").otherwise("mid"))


def block_summary(frames: DataFrame, spells: DataFrame) -> DataFrame:
    """(def_team, frames, usable_frames, coverage, bias_m, line_m, vspread_m, ball_to_block_m, spells, low, mid, high): means over usable frames, and the classes' shares of the spells' usable frames.

    bias_m is how much further up the ball is in usable frames than in the others.
    """
    use, not_ = (lambda c: F.avg(F.when(F.col("usable"), F.col(c)))), (lambda c: F.avg(F.when(~F.col("usable"), F.col(c))))
    f = frames.groupBy("def_team").agg(
        F.count("*").alias("frames"), F.count(F.when(F.col("usable"), 1)).alias("usable_frames"), F.avg(F.col("usable").cast("double")).alias("coverage"), (use("ball_adv_m") - not_("ball_adv_m")).alias("bias_m"),
        *(use(c).alias(c) for c in ("line_m", "vspread_m", "ball_to_block_m")))
    share = lambda c: F.try_divide(F.sum(F.when(F.col("block_class") == c, F.col("n_usable")).otherwise(0)), F.sum("n_usable")).alias(c)
    return f.join(spells.groupBy("def_team").agg(F.count("*").alias("spells"), share("low"), share("mid"), share("high")), "def_team", "left")


def score_states(points: DataFrame, goals: DataFrame, *, stoppage: float = 2700.0) -> DataFrame:
    """Points (match, half, t_s) with the goals of both sides so far: those of the first half count in the second, a goal at exactly t counts."""
    both = points.withColumn("_p", F.lit(1)).unionByName(goals.select("match", "half", "t_s", F.col("ours").cast("int").alias("ours"), F.lit(0).alias("_p")), allowMissingColumns=True)
    w = Window.partitionBy("match").orderBy("half", "t_s", "_p").rowsBetween(Window.unboundedPreceding, 0)
    n = lambda v: F.sum(F.when((F.col("_p") == 0) & (F.col("ours") == v), 1).otherwise(0)).over(w)
    s = both.withColumns({"gf": n(1), "ga": n(0)}).where("_p = 1").drop("_p", "ours")
    state = F.when(F.col("gf") == F.col("ga"), "level").when(F.col("gf") > F.col("ga"), "leading").otherwise("chasing")
    return s.withColumn("state", state).withColumn("scoreline", F.concat_ws("-", F.col("gf").cast("string"), F.col("ga").cast("string"))).withColumn("stoppage", F.col("t_s") > stoppage)


def score_segments(goals: DataFrame, ends: DataFrame) -> DataFrame:
    """(match, half, t0_s, t1_s): spans between goals, from 0 to the half's end."""
    b = ends.select("match", "half", F.lit(0.0).alias("t0_s"), F.col("t_end")).unionByName(goals.join(ends, ["match", "half"]).select("match", "half", F.col("t_s").cast("double").alias("t0_s"), "t_end"))
    w = Window.partitionBy("match", "half").orderBy("t0_s")
    return b.withColumn("t1_s", F.coalesce(F.lead("t0_s").over(w), F.col("t_end").cast("double"))).drop("t_end")


def chunk_offsets(chunks: DataFrame) -> DataFrame:
    """(half, chunk, offset_s): running sum of the durations before a chunk."""
    w = Window.partitionBy("half").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset_s", F.coalesce(F.sum("duration_s").over(w), F.lit(0.0)))


def snapshots(goals: DataFrame, matches: DataFrame, *, step: int = 1) -> DataFrame:
    """(match, minute, perspective, diff) for minutes 0..90 and both sides; only goals strictly before a minute count."""
    g = matches.select("match", F.explode(F.sequence(F.lit(0), F.lit(90), F.lit(step))).alias("minute"))
    t = goals.select(F.col("match").alias("m2"), F.floor(F.col("t_s") / 60).cast("int").alias("gm"), F.when(F.col("ours") == 1, 1).otherwise(-1).alias("side"))
    per = t.groupBy("m2", "gm").agg(F.sum("side").alias("side"))
    both = g.withColumn("_p", F.lit(0)).unionByName(per.select(F.col("m2").alias("match"), F.col("gm").alias("minute"), "side", F.lit(1).alias("_p")), allowMissingColumns=True)
    w = Window.partitionBy("match").orderBy("minute", "_p").rowsBetween(Window.unboundedPreceding, 0)
    s = both.withColumn("diff", F.coalesce(F.sum("side").over(w), F.lit(0))).where("_p = 0")
    return s.select("match", "minute", F.explode(F.array(F.struct(F.lit("home").alias("side"), F.col("diff").alias("d")), F.struct(F.lit("away").alias("side"), (-F.col("diff")).alias("d")))).alias("p")).select("match", "minute", F.col("p.side").alias("perspective"), F.col("p.d").cast("long").alias("diff"))


def phases_by_state(labels: DataFrame, shapes: DataFrame, states: DataFrame, metric: str) -> DataFrame:
    """(team, phase, state, frames, metric): mean shape by phase and score state of the frame."""
    j = labels.join(shapes.select(*FRAME, "team", metric), [*FRAME, "team"]).join(states.select(*FRAME, "state"), FRAME)
    return j.groupBy("team", "phase", "state").agg(F.count("*").alias("frames"), F.avg(metric).alias(metric))


def event_minutes(events: DataFrame, doc: str, *, kinds: tuple[str, ...]) -> DataFrame:
    """(match, minute, kind, side): goals and cards of JSON event lists [{minute, type, home}]."""
    schema = "array<struct<minute:int,type:string,home:boolean>>"
    e = events.select("match", F.explode(F.from_json(doc, schema)).alias("e")).where(F.col("e.type").isin(*kinds))
    return e.select("match", "e.minute", F.col("e.type").alias("kind"), F.when(F.col("e.home"), 1).otherwise(-1).alias("side"))
