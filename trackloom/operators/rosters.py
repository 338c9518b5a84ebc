"""Who is who: shirt-number classes, players on the pitch, roster assignment, keepers' sides, duplicate tracks, frame-by-frame association."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import pitch as P
from trackloom.operators.association import hungarian, modal
from trackloom.plans.ordered import first_by

#: Usual place along the pitch of keepers, defenders, midfielders and forwards, from 0 at the own goal to 1; fixed values.
EXPECTED = {"G": 0.05, "D": 0.30, "M": 0.55, "F": 0.82}
#: Weight of the place, cost of an unknown place, of a keeper's mismatch, of another number, and from which a pair stays open; fixed values.
PLACE_WEIGHT, UNKNOWN_PLACE, KEEPER_VETO, INFEASIBLE, OPEN = 0.25, 0.5, 10.0, 1e6, 0.90
#: Tens class of a number of one digit; fixed value.
NO_TENS = 10
#: Least distance from the halfway line and share of rows in a penalty area of a keeper; fixed values.
KEEPER_X, KEEPER_SHARE = 36.0, 0.90


def number_class(label: Column) -> Column:
    """Class of a shirt number: 0 for -1 (illegible), the number itself for 1 to 99, null for anything else."""
    return F.when(label == -1, 0).when(label.between(1, 99), label.cast("int"))


def class_number(cls: Column) -> Column:
    return F.when(cls == 0, -1).otherwise(cls)


def digits(label: Column) -> Column:
    """(tens, units, legible) of a shirt number; an illegible one has placeholders, anything else is null."""
    tens = F.when(label >= 10, F.floor(label / 10)).otherwise(NO_TENS).cast("int")
    made = F.struct(tens.alias("tens"), (label % 10).cast("int").alias("units"), F.lit(1).alias("legible"))
    none = F.struct(F.lit(NO_TENS).alias("tens"), F.lit(0).alias("units"), F.lit(0).alias("legible"))
    return F.when(label == -1, none).when(label.between(1, 99), made)


def from_digits(tens: Column, units: Column) -> Column:
    return F.when(tens == NO_TENS, units).otherwise(tens * 10 + units)


def on_roster(probs: Column, roster: Column) -> Column:
    """Class probabilities with the numbers nobody wears taken out and the rest scaled to one; class 0 stays."""
    kept = F.transform(probs, lambda p, i: F.when((i == 0) | F.array_contains(roster, i), p).otherwise(0.0))
    total = F.aggregate(kept, F.lit(0.0), lambda a, p: a + p)
    return F.when(total > 0, F.transform(kept, lambda p: p / total)).otherwise(kept)


def halves_played(substitute: Column, minutes: Column) -> Column:
    """(first, second): whether a starter (from the kick-off) or substitute (until the end) was on in each half."""
    on = F.coalesce((minutes > 0) & ~F.isnan(minutes.cast("double")), F.lit(False))
    begin = F.when(substitute, F.greatest(90.0 - minutes, F.lit(0.0))).otherwise(0.0)
    end = F.when(substitute, 90.0).otherwise(minutes)
    return F.struct((on & (begin < 45) & (end > 0)).alias("first"), (on & (begin < 90) & (end > 45)).alias("second"))


def off_pitch(candidates: DataFrame, minutes: DataFrame, windows: DataFrame, *, slack: float = 5.0) -> DataFrame:
    """Candidates (query, player) with ``off``: provably not on the pitch at the query's minute; unknown players may be."""
    j = candidates.join(minutes.select("query", "minute"), "query", "left").join(windows.select("player", "unused", "on_from", "on_to"), "player", "left")
    out = F.col("unused") | (F.col("minute") + slack < F.col("on_from")) | (F.col("minute") - slack > F.col("on_to"))
    return j.withColumn("off", F.coalesce(out, F.lit(False))).drop("minute", "unused", "on_from", "on_to")


def place_cost(position: Column, u: Column) -> Column:
    """Distance of a group's mean place from where its position usually is; unknown positions count as midfield."""
    usual = F.lit(EXPECTED["M"])
    for k, v in EXPECTED.items():
        usual = F.when(position == k, v).otherwise(usual)
    return F.when(u.isNull(), UNKNOWN_PLACE).otherwise(F.abs(u - usual))


def roster_costs(players: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grp, player, cost) of each pair of one key: players (player, shirt, position), groups (grp, number, u, keeper)."""
    j = groups.join(players, keys)
    jersey = F.when(F.col("number").isNull(), 0.5).otherwise(0.0)
    veto = (F.col("position") == "G") != F.col("keeper")
    cost = F.when(F.col("number").isNotNull() & (F.col("number") != F.col("shirt")), INFEASIBLE).when(veto, KEEPER_VETO + jersey).otherwise(jersey + PLACE_WEIGHT * place_cost(F.col("position"), F.col("u")))
    return j.select(*keys, "grp", "player", cost.alias("cost"))


def assign_roster(players: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grp, player, cost, confidence, reason) of every group: the cheapest assignment, where an open player or group costs ``OPEN``.

    Groups without a player are 'no_candidate' if nobody has their number, else 'low_confidence'.  One key's squad is one task.
    """
    costs = roster_costs(players, groups, keys)
    kind = {f.name: f.dataType.simpleString() for f in costs.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, p = np.sort(pdf["grp"].unique()), np.sort(pdf["player"].unique())
        big = np.full((len(g) + len(p), len(g) + len(p)), INFEASIBLE)
        big[np.searchsorted(g, pdf["grp"]), np.searchsorted(p, pdf["player"])] = pdf["cost"]
        big[np.arange(len(g)), len(p) + np.arange(len(g))] = OPEN
        big[len(g) + np.arange(len(p)), np.arange(len(p))] = OPEN
        big[len(g) :, len(p) :] = 0.0
        rows = [(g[i], p[j], big[i, j]) for i, j in hungarian(big) if i < len(g) and j < len(p) and big[i, j] < OPEN]
        out = pd.DataFrame(rows, columns=["grp", "player", "cost"])
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    picked = costs.groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {kind[c]}" for c in [*keys, "grp", "player", "cost"]))
    worn = players.select(*keys, F.col("shirt").alias("number")).distinct().withColumn("worn", F.lit(True))
    j = groups.join(picked, [*keys, "grp"], "left").join(worn, [*keys, "number"], "left").join(players.select(*keys, "player", "position"), [*keys, "player"], "left")
    votes = 1.0 - F.pow(F.lit(0.5), F.least(F.greatest("votes", F.lit(0)), F.lit(12)))
    sure = F.when(F.col("u").isNull(), votes).otherwise(0.85 * votes + 0.15 * (1.0 - place_cost(F.col("position"), F.col("u"))))
    reason = F.when(F.col("player").isNotNull(), "assigned").when(F.col("number").isNull() | F.col("worn"), "low_confidence").otherwise("no_candidate")
    return j.select(*keys, "grp", "player", "cost", F.when(F.col("player").isNotNull(), F.round(sure, 3)).alias("confidence"), reason.alias("reason"))


def keeper_sides(rows: DataFrame) -> DataFrame:
    """(chunk, track_id, role, side): tracks by their commonest role; where a half has no keeper, its deepest keeper-like player becomes one; a keeper's side is his half.

    Place is measured from the halfway line; ties of depth go to the lower track.
    """
    x = F.col("pitch_x") - P.LENGTH / 2
    box = (F.least("pitch_x", P.LENGTH - F.col("pitch_x")) <= 16.5) & (F.abs(F.col("pitch_y") - P.WIDTH / 2) <= 20.16)
    t = rows.groupBy("chunk", "track_id").agg(F.percentile(x, 0.5).alias("mx"), F.avg(box.cast("double")).alias("pen"))
    t = t.join(modal(rows, ["chunk", "track_id"], "role"), ["chunk", "track_id"]).withColumn("half", F.signum("mx"))
    none = ~F.bool_or(F.col("role") == "goalkeeper").over(Window.partitionBy("chunk", "half"))
    like = none & (F.col("half") != 0) & (F.col("role") == "player") & (F.abs("mx") >= KEEPER_X) & (F.col("pen") >= KEEPER_SHARE)
    t = t.withColumn("like", like)
    deepest = F.row_number().over(Window.partitionBy("chunk", "half", "like").orderBy(F.desc(F.abs("mx")), "track_id")) == 1
    t = t.withColumn("role", F.when(F.col("like") & deepest, "goalkeeper").otherwise(F.col("role")))
    return t.select("chunk", "track_id", "role", F.when(F.col("role") == "goalkeeper", F.when(F.col("mx") < 0, "left").otherwise("right")).alias("side"))


def sides_by_depth(rows: DataFrame) -> DataFrame:
    """(chunk, left_team, margin): the team whose players stand further left on average; team 0 and margin 0 if one has none."""
    m = rows.where("role = 'player' AND pitch_x IS NOT NULL AND NOT isnan(pitch_x)").groupBy("chunk").agg(*(F.avg(F.when(F.col("team") == t, F.col("pitch_x"))).alias(f"m{t}") for t in (0, 1)))
    both = F.col("m0").isNotNull() & F.col("m1").isNotNull()
    return m.select("chunk", F.when(both & (F.col("m0") > F.col("m1")), 1).otherwise(0).alias("left_team"), F.when(both, F.abs(F.col("m1") - F.col("m0"))).otherwise(0.0).alias("margin"))


def duplicates(pairs: DataFrame, *, overlap: int, median_m: float, same_team: bool = True, cosine: float | None = None) -> DataFrame:
    """Pairs of tracks that are one person twice: together often enough, near enough, alike if both have a vector."""
    keep = (F.col("overlap") >= overlap) & (F.col("median_d") <= median_m)
    if same_team:
        keep = keep & F.col("same_team")
    if cosine is not None:
        keep = keep & F.coalesce(F.isnan("cosine") | (F.col("cosine") >= cosine), F.lit(True))
    return pairs.where(keep)


def absorbed(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows with duplicate tracks under their strongest member (most rows, then confidence, then lower track); of two rows of one frame the stronger track's stays.

    Only the tracks of one chunk's pairs go to one task, never its rows.
    """
    rank = rows.groupBy("chunk", "track_id").agg(F.count("*").alias("n"), F.avg("conf").alias("c"))
    ends = pairs.select("chunk", "a", "b")
    r = lambda s: rank.select("chunk", F.col("track_id").alias(s), F.struct((-F.col("n")).alias("n"), (-F.col("c")).alias("c")).alias(f"r{s}"))
    ranked = ends.join(r("a"), ["chunk", "a"]).join(r("b"), ["chunk", "b"]).select("chunk", "a", "b", "ra.n", "ra.c", F.col("rb.n").alias("n2"), F.col("rb.c").alias("c2"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = {**dict(zip(pdf["a"], zip(pdf["n"], pdf["c"], pdf["a"]), strict=True)), **dict(zip(pdf["b"], zip(pdf["n2"], pdf["c2"], pdf["b"]), strict=True))}
        up = {t: t for t in order}

        def top(t: int) -> int:
            while up[t] != t:
                up[t] = t = up[up[t]]
            return t

        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            x, y = sorted((top(a), top(b)), key=order.get)
            up[y] = x
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "track_id": list(up), "winner": [top(t) for t in up]})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    won = ranked.groupBy("chunk").applyInPandas(run, f"chunk {kinds['chunk']}, track_id {kinds['track_id']}, winner {kinds['track_id']}")
    j = rows.join(won, ["chunk", "track_id"], "left").join(rank, ["chunk", "track_id"]).withColumn("_w", F.coalesce("winner", "track_id"))
    first = first_by(j, ["chunk", "_w", "frame"], F.desc("n"), F.desc("c"), "track_id")
    return first.withColumn("track_id", F.col("_w")).select(*rows.columns)


def _overlap(a: np.ndarray, b: np.ndarray, grow: float) -> np.ndarray:
    """Intersection over union of boxes (x0, y0, x1, y1) widened by a share of their size on each side."""

    def wide(z: np.ndarray) -> np.ndarray:
        pad = grow * np.stack([z[:, 2] - z[:, 0], z[:, 3] - z[:, 1]], axis=1)
        return np.concatenate([z[:, :2] - pad, z[:, 2:] + pad], axis=1)

    a, b = wide(a)[:, None], wide(b)[None]
    side = np.clip(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0, None)
    both = side[..., 0] * side[..., 1]
    area = lambda z: (z[..., 2] - z[..., 0]) * (z[..., 3] - z[..., 1])
    return both / np.maximum(area(a) + area(b) - both, 1e-9)


def _linked(frames: np.ndarray, boxes: np.ndarray, grow: float, step: float, rounds: int, lost: int) -> np.ndarray:
    """Track number of each box, frames ascending: tracks keep their last box, rounds widen the boxes, what is left begins a track."""
    out, last, seen = np.zeros(len(frames), np.int64), np.zeros((0, 4)), np.zeros(0, np.int64)
    at = np.flatnonzero(np.diff(frames, prepend=frames[0] - 1))
    for rows in np.split(np.arange(len(frames)), at[1:]):
        live, free = np.flatnonzero(frames[rows[0]] - seen <= lost), rows
        for r in range(rounds):
            if not len(live) or not len(free):
                break
            like = _overlap(last[live], boxes[free], grow + r * step)
            hits = [(i, j) for i, j in hungarian(np.where(like > 0, 1 - like, 1e6)) if like[i, j] > 0]
            for i, j in hits:
                out[free[j]], last[live[i]], seen[live[i]] = live[i], boxes[free[j]], frames[rows[0]]
            live, free = np.delete(live, [i for i, _ in hits]), np.delete(free, [j for _, j in hits])
        out[free] = len(last) + np.arange(len(free))
        last, seen = np.concatenate([last, boxes[free]]), np.concatenate([seen, np.full(len(free), frames[rows[0]])])
    return out


def associate(boxes: DataFrame, *, grow: float = 0.3, step: float = 0.2, rounds: int = 2, lost: int = 30) -> DataFrame:
    """(chunk, frame, det, track) of boxes (x0, y0, x1, y1), frame by frame without a motion model.

    No track outlives ``lost`` frames without a box, so chunks are cut wherever that many pass without any, and a task
    holds one such stretch.  Tracks are numbered from 1 by stretch and order of creation.
    """
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}
    fr = boxes.select("chunk", "frame").distinct()
    w = Window.partitionBy("chunk").orderBy("frame")
    cut = F.coalesce(F.col("frame") - F.lag("frame").over(w) > lost, F.lit(True))
    fr = fr.withColumn("part", F.sum(cut.cast("long")).over(w))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "det"])
        t = _linked(pdf["frame"].to_numpy(), pdf[["x0", "y0", "x1", "y1"]].to_numpy(float), grow, step, rounds, lost)
        return pd.DataFrame({"chunk": pdf["chunk"], "part": pdf["part"], "frame": pdf["frame"], "det": pdf["det"], "t": t})

    parts = boxes.join(fr, ["chunk", "frame"]).select("chunk", "part", "frame", "det", "x0", "y0", "x1", "y1")
    got = parts.groupBy("chunk", "part").applyInPandas(run, f"chunk {kinds['chunk']}, part long, frame {kinds['frame']}, det {kinds['det']}, t long")
    n = got.groupBy("chunk", "part").agg((F.max("t") + 1).alias("n"))
    before = n.select("chunk", "part", (F.sum("n").over(Window.partitionBy("chunk").orderBy("part")) - F.col("n")).alias("base"))
    return got.join(before, ["chunk", "part"]).select("chunk", "frame", "det", (F.col("base") + F.col("t") + 1).alias("track"))
