"""Cleaning and per-frame flags of position tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import pitch as P
from trackloom.operators.shape import PLAYERS
from trackloom.plans.matches import kind
from trackloom.plans.ordered import first_by, range_join

FRAME = ["chunk", "frame"]


def clamp_positions(pos: DataFrame) -> DataFrame:
    x, y = P.clamp("pitch_x", "pitch_y")
    return pos.withColumns({"pitch_x": x, "pitch_y": y})


def plausible_frames(pos: DataFrame, *, least: int = 3, span_m: float = 5.0) -> DataFrame:
    """(chunk, frame, plausible): enough clamped players, spread over one axis."""
    p = clamp_positions(pos).withColumn("in", F.expr(PLAYERS))
    x, y = (F.when(F.col("in"), F.col(c)) for c in ("pitch_x", "pitch_y"))
    wide = F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y)) >= span_m
    return p.groupBy(*FRAME).agg(((F.count(x) >= least) & F.coalesce(wide, F.lit(False))).alias("plausible"))


def reject_frames(pos: DataFrame, *, least: int = 3, span_m: float = 5.0) -> DataFrame:
    """Frames with too few or too bunched players lose every coordinate, the ball's too."""
    w = Window.partitionBy(*FRAME)
    x, y = (F.when(F.expr(PLAYERS), F.col(c)) for c in ("pitch_x", "pitch_y"))
    ok = (F.count(x).over(w) >= least) & (F.greatest(F.max(x).over(w) - F.min(x).over(w), F.max(y).over(w) - F.min(y).over(w)) >= span_m)
    pos = pos.withColumn("_ok", ok)
    return pos.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in ("pitch_x", "pitch_y")}).drop("_ok")


def smooth_positions(pos: DataFrame, *, half: int = 2) -> DataFrame:
    """Centred rolling median of a track's coordinates; a null stays null and the ball is left alone."""
    w = Window.partitionBy("chunk", "track_id").orderBy("frame").rowsBetween(-half, half)
    one = F.expr("role IN ('player', 'goalkeeper')")
    return pos.withColumns({c: F.when(one & F.col(c).isNotNull(), F.percentile(F.when(one, F.col(c)), 0.5).over(w)).otherwise(F.col(c)) for c in ("pitch_x", "pitch_y")})


def flag_actor(pos: DataFrame, ball: DataFrame, *, most_m: float = 3.0) -> DataFrame:
    """Rows with is_actor: the nearest player of the frame, if near enough to the ball."""
    d = pos.where(PLAYERS).join(ball, FRAME).withColumn("d", P.distance("pitch_x", "pitch_y", "x", "y"))
    best = first_by(d, FRAME, "d", "track_id").where(F.col("d") <= most_m).select(*FRAME, "track_id", F.lit(True).alias("is_actor"))
    return pos.join(best, [*FRAME, "track_id"], "left").withColumn("is_actor", F.coalesce("is_actor", F.lit(False)))


def flag_keeper(pos: DataFrame, *, depth: float = 16.5) -> DataFrame:
    """Rows with is_keeper: per team and frame the detected keeper nearest its goal, else the outermost player inside the box.

    The team whose players stand nearer x = 0 on average defends that goal; of equal teams the smaller number.
    """
    p = pos.where(PLAYERS)
    mean = first_by(p.groupBy(*FRAME, "team").agg(F.avg("pitch_x").alias("m")), FRAME, "m", "team").select(*FRAME, F.col("team").alias("low"))
    p = p.join(mean, FRAME).withColumn("goal", F.when(F.col("team") == F.col("low"), 0.0).otherwise(P.LENGTH))
    p = p.withColumn("off", F.abs(F.col("pitch_x") - F.col("goal"))).withColumn("gk", (F.col("role") == "goalkeeper").cast("int"))
    k = first_by(p, [*FRAME, "team"], F.desc("gk"), "off", "track_id").where((F.col("gk") == 1) | (F.col("off") <= depth))
    k = k.select(*FRAME, "track_id", F.lit(True).alias("is_keeper"))
    return pos.join(k, [*FRAME, "track_id"], "left").withColumn("is_keeper", F.coalesce("is_keeper", F.lit(False)))


def shot_type(n: Column, spread: Column, *, live: int = 8, wide: float = 1000.0, few: int = 4) -> Column:
    return F.when(n <= 0, "graphic").when((n >= live) & (spread >= wide), "live_wide").when(n <= few, "close_up").otherwise("replay_or_other")


def frame_signals(pos: DataFrame, **kw) -> DataFrame:
    """Per frame with a player: counts, spreads in the image, calibration, shot type."""
    one, seen = F.expr("role IN ('player', 'goalkeeper')"), F.expr(PLAYERS)
    spread = lambda c: (F.max(F.when(one, F.col(c))) - F.min(F.when(one, F.col(c)))).alias(c.replace("image_", "") + "_spread")
    g = pos.groupBy(*FRAME).agg(F.count(F.when(one, 1)).alias("n_det"), F.count(F.when(seen, 1)).alias("n_pitch"), spread("image_x"), spread("image_y"), F.min_by("calib_error_m", "track_id").alias("calib_error_m"))
    g = g.where("n_det > 0").withColumns({"calibrated": F.col("calib_error_m") <= 2.0, "ge6": F.col("n_pitch") >= 6})
    return g.withColumn("shot_type", shot_type(F.col("n_det"), F.col("x_spread"), **kw))


def on_grid(signals: DataFrame, step: int) -> DataFrame:
    """Every frame of the sampling grid between a chunk's ends; frames without detections are graphics."""
    ends = signals.groupBy("chunk").agg(F.min("frame").alias("a"), F.max("frame").alias("z"))
    grid = ends.select("chunk", F.explode(F.sequence("a", "z", F.lit(step).cast("long"))).alias("frame"))
    j = grid.join(signals.select(*FRAME, "n_det", "shot_type"), FRAME, "left")
    return j.select(*FRAME, F.coalesce("n_det", F.lit(0)).cast("long").alias("n_det"), F.coalesce("shot_type", F.lit("graphic")).alias("shot_type"))


def class_shares(labels: DataFrame) -> DataFrame:
    """(shot_type, share) of the four classes, zero where absent."""
    names = labels.sparkSession.createDataFrame([(n,) for n in ("live_wide", "close_up", "replay_or_other", "graphic")], "shot_type string")
    total = labels.agg(F.count("*").alias("total"))
    c = labels.groupBy("shot_type").agg(F.count("*").alias("k"))
    return names.join(F.broadcast(c), "shot_type", "left").join(F.broadcast(total)).select("shot_type", F.coalesce(F.try_divide("k", "total"), F.lit(0.0)).alias("share"))


def wide_score(pos: DataFrame, *, width: float = 1920.0, least: int = 10) -> DataFrame:
    """(chunk, frame, score): players times the deviation of their place in the image; 0 below ``least``."""
    g = pos.where("role IN ('player', 'goalkeeper')").groupBy(*FRAME).agg(F.count("*").alias("n"), F.stddev_pop("image_x").alias("sd"))
    return g.select(*FRAME, F.when(F.col("n") >= least, F.col("n") * F.col("sd") / width).otherwise(0.0).alias("score"))


def tactical_frames(pos: DataFrame, *, fps: float = 25.0, least: int = 10) -> DataFrame:
    """One row per frame: counts, calibration, and of accepted frames both teams' centres and extents."""
    seen = F.expr(PLAYERS)
    cols = [F.count(F.when(seen, 1)).alias("n_onpitch"), F.avg("calib_error_m").alias("mean_calib_error_m")]
    for t in (0, 1):
        mine = seen & (F.col("team") == t)
        x, y = F.when(mine, F.col("pitch_x")), F.when(mine, F.col("pitch_y"))
        cols += [F.count(x).alias(f"n_team{t}"), F.avg(x).alias(f"team{t}_cx"), F.avg(y).alias(f"team{t}_cy"), (F.max(x) - F.min(x)).alias(f"team{t}_length"), (F.max(y) - F.min(y)).alias(f"team{t}_width")]
    ball = F.expr("role = 'ball' AND pitch_x IS NOT NULL AND pitch_y IS NOT NULL")
    cols += [F.max(F.when(ball, F.col("pitch_x"))).alias("ball_x"), F.max(F.when(ball, F.col("pitch_y"))).alias("ball_y")]
    g = pos.groupBy(*FRAME).agg(*cols).withColumn("accepted", F.col("n_onpitch") >= least).withColumn("time_s", F.col("frame") / fps)
    keep = {"chunk", "frame", "n_onpitch", "mean_calib_error_m", "accepted", "time_s"}
    return g.withColumns({c: F.when(F.col("accepted"), F.col(c)) for c in g.columns if c not in keep})


def freeze_frames(pos: DataFrame, *, least: int = 10) -> DataFrame:
    """One nested row per frame with enough players, on a 120 x 80 grid, players by track."""
    p = pos.where(PLAYERS)
    node = F.struct("track_id", "team", (F.col("pitch_x") * 120 / P.LENGTH).alias("x"), (F.col("pitch_y") * 80 / P.WIDTH).alias("y"), (F.col("role") == "goalkeeper").alias("keeper"))
    return p.groupBy(*FRAME).agg(F.array_sort(F.collect_list(node)).alias("players")).where(F.size("players") >= least)


def orient(frames: DataFrame, attackers: DataFrame) -> DataFrame:
    """Turns a freeze-frame by 180 degrees where the attackers stand in the lower half."""
    f = frames.join(attackers.select(*FRAME, F.col("team").alias("att")), FRAME)
    mine = F.expr("filter(players, p -> p.team = att)")
    f = f.withColumn("mean", F.expr("aggregate(filter(players, p -> p.team = att), 0D, (a, p) -> a + p.x)") / F.size(mine))
    flip = F.expr("transform(players, p -> named_struct('track_id', p.track_id, 'team', p.team, 'x', 120 - p.x, 'y', 80 - p.y, 'keeper', p.keeper))")
    return f.withColumn("players", F.when(F.col("mean") < 60, flip).otherwise(F.col("players"))).drop("mean")


def exploded(frames: DataFrame) -> DataFrame:
    return frames.select(*FRAME, F.explode("players").alias("p")).select(*FRAME, "p.*")


def camera_segments(pos: DataFrame, *, least: float = 0.3) -> DataFrame:
    """(chunk, frame, segment): a new one where the Jaccard similarity to the frame before falls below ``least``."""
    w = Window.partitionBy("chunk").orderBy("frame")
    s = pos.groupBy(*FRAME).agg(F.collect_set("track_id").alias("ids")).withColumn("was", F.lag("ids").over(w))
    sim = F.size(F.array_intersect("ids", "was")) / F.size(F.array_union("ids", "was"))
    s = s.withColumn("cut", F.when(F.col("was").isNull(), 0).otherwise((sim < least).cast("int")))
    return s.select(*FRAME, F.sum("cut").over(w).alias("segment"))


def geometry_yield(pos: DataFrame, *, least: int = 6) -> DataFrame:
    """(chunk, share): share of frames with a detection that have enough placed players."""
    g = pos.groupBy(*FRAME).agg((F.count(F.when(F.expr(PLAYERS), 1)) >= least).cast("double").alias("ok"))
    return g.groupBy("chunk").agg(F.avg("ok").alias("share"))


def strongest_peaks(peaks: DataFrame, keys: list[str], *, gap: int) -> DataFrame:
    """Greedy suppression along time: by falling confidence (then earlier) a peak stays if no kept one is within ``gap``.

    Peaks farther apart than ``gap`` cannot touch each other, so a key is first cut into clusters at such holes and
    each cluster is folded on its own, whatever the key's size.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    p = peaks.select(*keys, "frame", "conf").withColumn("_new", F.coalesce((F.col("frame") - F.lag("frame").over(w) > gap).cast("int"), F.lit(1)))
    p = p.withColumn("_c", F.sum("_new").over(w))
    g = p.groupBy(*keys, "_c").agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("neg"), "frame"))).alias("l"))
    kept = F.expr(f"aggregate(l, cast(array() as array<struct<neg:double,frame:bigint>>), (a, x) -> IF(exists(a, k -> abs(k.frame - x.frame) <= {gap}), a, array_append(a, named_struct('neg', cast(x.neg as double), 'frame', cast(x.frame as bigint)))))")
    return g.select(*keys, F.explode(kept).alias("_k")).select(*keys, "_k.frame", (-F.col("_k.neg")).alias("conf"))


def live_segments(grid: DataFrame, *, merge: int, pad: int) -> DataFrame:
    """(chunk, f0, f1) of true stretches of ``is_live``, merged over holes of at most ``merge`` frames, then padded."""
    w = Window.partitionBy("chunk").orderBy("frame")
    s = grid.withColumn("_new", F.coalesce(F.col("is_live") != F.lag("is_live").over(w), F.lit(True)).cast("int")).withColumn("r", F.sum("_new").over(w))
    s = s.where("is_live").groupBy("chunk", "r").agg(F.min("frame").alias("a"), F.max("frame").alias("z"))
    v = Window.partitionBy("chunk").orderBy("a")
    s = s.withColumn("_new", F.coalesce(F.col("a") - F.lag("z").over(v) > merge, F.lit(True)).cast("int")).withColumn("q", F.sum("_new").over(v))
    return s.groupBy("chunk", "q").agg((F.min("a") - pad).alias("f0"), (F.max("z") + pad).alias("f1")).drop("q")


def in_segments(points: DataFrame, segments: DataFrame, *, bucket: int = 500) -> DataFrame:
    return range_join(points, segments, ["chunk"], "frame", "f0", "f1", bucket, "left_semi")


def _recalibrations(period: int):
    """Batches of (chunk, frame, forced) in order, with the decision at each frame; only the last recalibration is carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, since, began = None, None, False
        for b in batches:
            go = []
            for chunk, frame, forced in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not began or (chunk != now and (chunk == chunk or now == now)):
                    now, since, began = chunk, None, True
                # forced may be unknown, as its drift may be
                here = True if forced or since is None or frame - since >= period else forced
                since = frame if here else since
                go.append(here)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(go, pa.bool_())], ["chunk", "frame", "recalibrate"])

    return run


def camera_jobs(frames: DataFrame, *, period: int, drift: float) -> DataFrame:
    """(chunk, frame, recalibrate): when a period has passed since the last one, the drift is too large, or on a cut; the first frame always."""
    f = frames.select("chunk", F.col("frame").cast("long").alias("frame"), "drift", "is_cut").repartition("chunk").sortWithinPartitions("chunk", "frame", "drift", "is_cut")
    f = f.select("chunk", "frame", ((F.col("drift") > drift) | F.col("is_cut")).alias("forced"))
    return f.mapInArrow(_recalibrations(period), f"{kind(frames, 'chunk')}, frame long, recalibrate boolean")
