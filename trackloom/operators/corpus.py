"""Analytics over many matches: channels and progression, coverage, events without sight, labels cut short."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import pitch as P
from trackloom.plans.ordered import range_join

FRAME = ["chunk", "frame"]


def three(value: Column, edges: tuple[float, float], names: tuple[str, str, str]) -> Column:
    return F.when(value < edges[0], names[0]).when(value < edges[1], names[1]).otherwise(names[2])


def ball_channels(ball: DataFrame, poss: DataFrame, dirs: DataFrame) -> DataFrame:
    """(chunk, frame, team, ax, ay, channel, zone): held ball samples in the holder's attack direction."""
    j = poss.select(*FRAME, "team").join(ball.select(*FRAME, "x", "y"), FRAME).join(dirs, ["chunk", "team"])
    j = j.withColumns({"ax": P.advance("x", "dir"), "ay": P.across("y", "dir")})
    return j.select(*FRAME, "team", "ax", "ay", three(F.col("ay"), (22.67, 45.33), ("left", "centre", "right")).alias("channel"), three(F.col("ax"), (35.0, 70.0), ("own", "middle", "final")).alias("zone"))


def progression(frames: DataFrame, *, gap: int = 25, step_m: float = 25.0) -> DataFrame:
    """(team, channel, samples, forward_m, entries) of all three channels: forward metres and entries into the final third over short steps of one holder."""
    w = Window.partitionBy("chunk").orderBy("frame")
    f = frames.withColumns({"f1": F.lead("frame").over(w), "t1": F.lead("team").over(w), "a1": F.lead("ax").over(w), "y1": F.lead("ay").over(w)})
    ok = (F.col("t1") == F.col("team")) & (F.col("f1") - F.col("frame") <= gap) & (F.sqrt((F.col("a1") - F.col("ax")) ** 2 + (F.col("y1") - F.col("ay")) ** 2) <= step_m)
    g = f.groupBy("team", "channel").agg(F.count("*").alias("samples"), F.sum(F.when(ok, F.greatest(F.col("a1") - F.col("ax"), F.lit(0.0))).otherwise(0.0)).alias("forward_m"), F.count(F.when(ok & (F.col("ax") < P.FINAL_THIRD) & (F.col("a1") >= P.FINAL_THIRD), 1)).alias("entries"))
    all_ = frames.select("team").distinct().select("team", F.explode(F.array(*(F.lit(c) for c in ("left", "centre", "right")))).alias("channel"))
    return all_.join(g, ["team", "channel"], "left").na.fill(0)


def sign_p(k: int, n: int) -> float:
    """Exact two-sided p of k successes in n fair tries."""
    if not n:
        return 1.0
    m = min(k, n - k)
    return min(1.0, 2 * sum(comb(n, i) for i in range(m + 1)) / 2**n)


def coverage_profile(seen: DataFrame, estimated: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, observed, estimated) over the union of the keys, zero where absent."""
    a = seen.groupBy(*keys).agg(F.count("*").alias("observed"))
    b = estimated.groupBy(*keys).agg(F.count("*").alias("estimated"))
    return a.join(b, keys, "full").na.fill(0, ["observed", "estimated"])


def sight_gaps(rows: DataFrame, alive: DataFrame, *, step: int, least: int) -> DataFrame:
    """(chunk, track_id, f0, f1): holes in a track during all of which at least ``least`` tracks were alive."""
    w = Window.partitionBy("chunk", "track_id").orderBy("frame")
    g = rows.select("chunk", "track_id", "frame", F.lead("frame").over(w).alias("nxt")).where(F.col("nxt") - F.col("frame") > step)
    g = g.select("chunk", "track_id", (F.col("frame") + step).alias("f0"), (F.col("nxt") - step).alias("f1"))
    n = range_join(alive.select("chunk", "frame", "n"), g, ["chunk"], "frame", "f0", "f1", 200).groupBy("chunk", "track_id", "f0", "f1").agg(F.min("n").alias("least"), F.count("*").alias("k"))
    return n.where((F.col("least") >= least) & (F.col("k") == (F.col("f1") - F.col("f0")) / step + 1)).select("chunk", "track_id", "f0", "f1")


def second_deepest(rows: DataFrame, ax: str) -> DataFrame:
    """(chunk, frame, team, line): second smallest advance."""
    return rows.groupBy(*FRAME, "team").agg(F.try_element_at(F.array_sort(F.collect_list(ax)), F.lit(2)).alias("line"))


def noise_floor(rows: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """(noise): root mean square deviation from the midpoint of equally spaced neighbours, over root 1.5."""
    w = Window.partitionBy(*keys).orderBy(t)
    d = F.col(value) - (F.lag(value).over(w) + F.lead(value).over(w)) / 2
    even = (F.col(t) - F.lag(t).over(w)) == (F.lead(t).over(w) - F.col(t))
    return rows.select(F.when(even, d).alias("d")).agg((F.sqrt(F.avg(F.col("d") * F.col("d"))) / F.sqrt(F.lit(1.5))).alias("noise"))


def regain_labels(losses: DataFrame, poss: DataFrame, ball: DataFrame, *, within: int, hole: int) -> DataFrame:
    """(chunk, frame, label): 1 if the loser holds the ball again within the window, 0 if not, null where the ball's track breaks first."""
    w = Window.partitionBy("chunk").orderBy("frame")
    cut = ball.select("chunk", F.col("frame").alias("cut"), F.lead("frame").over(w).alias("nxt")).where(F.col("nxt").isNull() | (F.col("nxt") - F.col("cut") > hole))
    span = losses.select("chunk", F.col("frame").alias("f0"), "lost_team", F.col("frame").alias("lo"), (F.col("frame") + within).alias("hi"))
    c = range_join(cut.select("chunk", "cut"), span, ["chunk"], "cut", "lo", "hi", 250).groupBy("chunk", "f0").agg(F.min("cut").alias("cut"))
    r = range_join(poss.select("chunk", "frame", "team"), span, ["chunk"], "frame", "lo", "hi", 250).where("team = lost_team AND frame > f0").groupBy("chunk", "f0").agg(F.min("frame").alias("back"))
    j = span.join(c, ["chunk", "f0"], "left").join(r, ["chunk", "f0"], "left")
    label = F.when(F.col("back").isNotNull() & (F.col("cut").isNull() | (F.col("back") <= F.col("cut"))), 1).when(F.col("cut").isNotNull(), None).otherwise(0)
    return j.select("chunk", F.col("f0").alias("frame"), label.alias("label"))


def poststratified(values: DataFrame, weights: DataFrame, stratum: str) -> DataFrame:
    """(mean): strata means weighted by given shares, over the strata that were seen."""
    m = values.groupBy(stratum).agg(F.avg("value").alias("m"))
    return m.join(weights, stratum).agg((F.sum(F.col("m") * F.col("weight")) / F.sum("weight")).alias("mean"))


def holding_time(poss: DataFrame) -> DataFrame:
    """(team, frames): time between possession rows goes to the holder, or is halved where the holder changes."""
    w = Window.partitionBy("chunk").orderBy("frame")
    p = poss.select("team", (F.lead("frame").over(w) - F.col("frame")).alias("d"), F.lead("team").over(w).alias("n")).where("d IS NOT NULL")
    share = F.when(F.col("n") == F.col("team"), F.array(F.struct(F.col("team").alias("t"), F.col("d").cast("double").alias("d")))).otherwise(F.array(F.struct(F.col("team").alias("t"), (F.col("d") / 2).alias("d")), F.struct(F.col("n").alias("t"), (F.col("d") / 2).alias("d"))))
    return p.select(F.explode(share).alias("s")).groupBy(F.col("s.t").alias("team")).agg(F.sum("s.d").alias("frames"))


def dominant_share(pairs: DataFrame, gt: str, n: str) -> DataFrame:
    """(gt, share, herfindahl) of the matches of each true identity."""
    p = pairs.withColumn("_p", F.col(n) / F.sum(n).over(Window.partitionBy(gt)))
    return p.groupBy(gt).agg(F.max("_p").alias("share"), F.sum(F.col("_p") * F.col("_p")).alias("herfindahl"))


def territory(anchors: DataFrame, *, floor: float = 3.0) -> DataFrame:
    """(player, half, mx, my, sx, sy): a missing half takes the other one's, turned by 180 degrees."""
    g = anchors.groupBy("player", "half").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("sx"), F.greatest(F.stddev_pop("y"), F.lit(floor)).alias("sy"))
    both = g.select("player").distinct().select("player", F.explode(F.array(F.lit(1), F.lit(2))).alias("half"))
    o = g.select("player", (3 - F.col("half")).alias("half"), *(F.col(c).alias(f"o_{c}") for c in ("mx", "my", "sx", "sy")))
    j = both.join(g, ["player", "half"], "left").join(o, ["player", "half"], "left")
    return j.select("player", "half", F.coalesce("mx", P.LENGTH - F.col("o_mx")).alias("mx"), F.coalesce("my", P.WIDTH - F.col("o_my")).alias("my"), F.coalesce("sx", "o_sx").alias("sx"), F.coalesce("sy", "o_sy").alias("sy"))


def reachable_anchor_flags(cand: DataFrame, anchors: DataFrame, *, fps: float = 25.0, top: float = 9.0, within: int = 125) -> DataFrame:
    """(event_id, player, excluded): a candidate is out if an anchor of its own sits in the same frame or too far to run."""
    a = anchors.select("chunk", F.col("frame").alias("fa"), "player", F.col("x").alias("xa"), F.col("y").alias("ya"))
    c = cand.withColumns({"lo": F.col("frame") - within, "hi": F.col("frame") + within})
    j = range_join(a, c.withColumnsRenamed({"player": "cp", "chunk": "cc"}).withColumn("chunk", F.col("cc")), ["chunk"], "fa", "lo", "hi", 250).where("player = cp")
    far = P.distance("xa", "ya", "x", "y") > top * F.abs(F.col("fa") - F.col("frame")) / fps + 2.0
    f = j.groupBy("event_id", F.col("cp").alias("player")).agg(F.max((F.col("fa") == F.col("frame")) | far).alias("excluded"))
    return cand.select("event_id", "player").join(f, ["event_id", "player"], "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))
