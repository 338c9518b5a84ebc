"""Players and teams over chunks and matches: geometry, involvement, tendencies, forecasts, eras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import pitch as P
from trackloom.operators.shape import PLAYERS
from trackloom.plans.ordered import first_by, top_k


def global_ids(pos: DataFrame) -> DataFrame:
    """Frames and tracks made unique over chunks by the chunk's ordinal; the ordinals come from the distinct chunks only."""
    ids = pos.select("chunk").distinct().withColumn("_o", F.dense_rank().over(Window.orderBy("chunk")) - 1)
    return pos.join(ids, "chunk").withColumns({"frame": F.col("_o") * 10_000_000 + F.col("frame"), "track_id": F.col("_o") * 1_000_000 + F.col("track_id")}).drop("_o")


def align_by_goal(pos: DataFrame) -> DataFrame:
    """(chunk, team, aligned): team 0 is the one whose keeper's median x is smaller; of equals the smaller number."""
    k = pos.where(PLAYERS).where("role = 'goalkeeper'").groupBy("chunk", "team").agg(F.percentile("pitch_x", 0.5).alias("m"))
    return k.select("chunk", "team", (F.row_number().over(Window.partitionBy("chunk").orderBy("m", "team")) - 1).alias("aligned"))


def oriented(pos: DataFrame, dirs: DataFrame) -> DataFrame:
    """Trusted rows turned to attack upwards."""
    j = pos.where(PLAYERS).join(dirs, ["chunk", "team"])
    return j.withColumns({"ox": P.advance("pitch_x", "dir"), "oy": P.across("pitch_y", "dir")})


def player_geometry(o: DataFrame, key: str, *, fps: float = 25.0, least: int = 50) -> DataFrame:
    """(key, mean place, spreads, final-third share, frames, minutes, trusted)."""
    frames = F.count_distinct(F.struct("chunk", "frame"))
    g = o.groupBy(key).agg(
        F.avg("ox").alias("mx"), F.avg("oy").alias("my"), F.stddev_pop("ox").alias("sx"), F.stddev_pop("oy").alias("sy"),
        F.avg((F.col("ox") >= P.FINAL_THIRD).cast("double")).alias("final_third"), frames.alias("frames"))
    return g.withColumns({"radial": F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2), "minutes": F.col("frames") / fps / 60, "trusted": F.col("frames") >= least})


def involvement(ledger: DataFrame, roster: DataFrame) -> DataFrame:
    """Each roster player's passes, touches and share of its team's touches; those without any count zero."""
    g = ledger.groupBy("player").agg(F.count(F.when(F.col("kind") == "pass", 1)).alias("passes"), F.count("*").alias("touches"))
    j = roster.join(g, "player", "left").select("player", "team", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("passes", "touches")))
    return j.withColumn("share", F.try_divide(F.col("touches"), F.sum("touches").over(Window.partitionBy("team"))))


def cross_match(geometry: DataFrame, key: str, *, least: int = 2) -> DataFrame:
    """Players seen in enough matches, with means over them."""
    return geometry.groupBy(key).agg(F.count_distinct("match").alias("matches"), *(F.avg(c).alias(c) for c in ("mx", "my", "final_third"))).where(F.col("matches") >= least)


def by_era(geometry: DataFrame, key: str, first_manager: str) -> DataFrame:
    """(key, metric per era, delta): every manager but the first one's, none included, makes the second era."""
    e = geometry.withColumn("era", F.when(F.col("manager") == first_manager, "a").otherwise("b"))
    p = e.groupBy(key).pivot("era", ["a", "b"]).agg(F.avg("mx"))
    return p.withColumn("delta", F.col("b") - F.col("a"))


def tendencies(shapes: DataFrame, metrics: list[str], *, least: int = 20) -> DataFrame:
    """(chunk, team, metrics) of chunks with enough frames."""
    return shapes.groupBy("chunk", "team").agg(F.count("*").alias("frames"), *(F.avg(c).alias(c) for c in metrics)).where(F.col("frames") >= least)


def marginals(samples: DataFrame, metric: str, *, interval: float = 0.8) -> DataFrame:
    """(team, mean, sd, low, high, n): a forecast from a team's own samples, with its central interval."""
    a = (1 - interval) / 2
    q = F.percentile(metric, F.array(F.lit(a), F.lit(1 - a)))
    return samples.groupBy("team").agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("sd"), q[0].alias("low"), q[1].alias("high"), F.count(metric).alias("n"))


def opponents(samples: DataFrame, metric: str, out: str) -> DataFrame:
    """Samples with the other team's metric of the same chunk."""
    o = samples.select("chunk", (1 - F.col("team")).alias("team"), F.col(metric).alias(out))
    return samples.join(o, ["chunk", "team"])


def forecast(fit: DataFrame, at: Column) -> DataFrame:
    """(tendency, mean, low, high) one residual deviation around a fitted line (slope, intercept, resid)."""
    m = F.col("intercept") + F.col("slope") * at
    return fit.select("tendency", m.alias("mean"), (m - F.col("resid")).alias("low"), (m + F.col("resid")).alias("high"))


def fit_lines(obs: DataFrame, x: str, ys: list[str]) -> DataFrame:
    """(tendency, slope, intercept, resid, n) of a line for each tendency; the mean where x does not vary."""
    n = F.count("*")
    long = obs.select(F.col(x).alias("x"), F.explode(F.array(*(F.struct(F.lit(y).alias("tendency"), F.col(y).cast("double").alias("y")) for y in ys))).alias("s")).select("x", "s.*")
    vary = F.var_pop("x") > 1e-12
    g = long.groupBy("tendency").agg(F.when(vary, F.regr_slope("y", "x")).otherwise(0.0).alias("slope"), F.when(vary, F.regr_intercept("y", "x")).otherwise(F.avg("y")).alias("intercept"), n.alias("n"))
    r = long.join(g, "tendency").groupBy("tendency").agg(F.stddev_pop(F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")).alias("resid"))
    return g.join(r, "tendency")


def pair_share(df: DataFrame, metric: str) -> DataFrame:
    """(key, team, share) of two teams' sum; null where missing or zero."""
    w = Window.partitionBy("chunk")
    return df.select("chunk", "team", F.when(F.count(metric).over(w) == 2, F.try_divide(F.col(metric), F.sum(metric).over(w))).alias("share"))


def ledger(events: DataFrame, poss: DataFrame, *, offsets: tuple[int, ...] = (-15, -10, -5, 0, 5), most_m: float = 3.0, step: int = 5) -> DataFrame:
    """Events (event_id, chunk, frame) with team and carrier at the best of a few frames around, snapped to the grid; null if nobody was near enough."""
    e = events.withColumn("_g", F.bround(F.col("frame") / step).cast("long") * step).withColumn("at", F.explode(F.array(*(F.col("_g") + o for o in offsets))))
    p = poss.select("chunk", F.col("frame").alias("at"), "team", "carrier", "dist_m")
    j = e.join(p, ["chunk", "at"], "left").withColumn("_d", F.when(F.col("dist_m") <= most_m, F.col("dist_m")))
    best = first_by(j, ["event_id"], F.col("_d").asc_nulls_last(), "at")
    ok = F.col("_d").isNotNull()
    return best.select("event_id", "chunk", "frame", *(F.when(ok, F.col(c)).alias(c) for c in ("at", "team", "carrier")))


def gate_counts(ledger: DataFrame) -> DataFrame:
    """(half, team, events, named) per half and over the match."""
    return ledger.rollup("half").agg(F.count("*").alias("events"), F.count("team").alias("named")).select(F.coalesce("half", F.lit("match")).alias("half"), "events", "named")


def vote_attributes(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows whose values become their key's commonest; of equals the one seen first."""
    out = rows
    for v in values:
        c = rows.where(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.count("*").alias("_n"), F.min("frame").alias("_f"))
        best = first_by(c, keys, F.desc("_n"), "_f", v).select(*keys, F.col(v).alias(f"_{v}"))
        out = out.join(best, keys, "left").withColumn(v, F.coalesce(f"_{v}", v)).drop(f"_{v}")
    return out


def crop_votes(crops: DataFrame, *, least_conf: float, least: int) -> DataFrame:
    """(track_id, number, votes, conf): numbers read surely on enough crops; the top one by summed confidence."""
    c = crops.where(F.col("conf") >= least_conf).where("number >= 0").groupBy("track_id", "number").agg(F.count("*").alias("votes"), F.avg("conf").alias("conf"), F.sum("conf").alias("_s")).where(F.col("votes") >= least)
    return first_by(c, ["track_id"], F.desc("_s"), "number").drop("_s")


def roster_maps(roster: DataFrame) -> DataFrame:
    """(number, teams, names): who may wear a number."""
    return roster.groupBy("number").agg(F.array_sort(F.collect_set("team")).alias("teams"), F.array_sort(F.collect_set("name")).alias("names"))


def pair_features(rows: DataFrame, *, least: int = 2) -> DataFrame:
    """(chunk, a, b, overlap, median_d, same_team) of tracks of one chunk seen in the same frames."""
    a = rows.select("chunk", "frame", F.col("track_id").alias("a"), F.col("team").alias("ta"), F.col("pitch_x").alias("xa"), F.col("pitch_y").alias("ya"))
    b = rows.select("chunk", "frame", F.col("track_id").alias("b"), F.col("team").alias("tb"), F.col("pitch_x").alias("xb"), F.col("pitch_y").alias("yb"))
    j = a.join(b, ["chunk", "frame"]).where("a < b").withColumn("d", P.distance("xa", "ya", "xb", "yb"))
    return j.groupBy("chunk", "a", "b").agg(F.count("*").alias("overlap"), F.percentile("d", 0.5).alias("median_d"), F.bool_and(F.col("ta") == F.col("tb")).alias("same_team")).where(F.col("overlap") >= least)


def penalty_share(rows: DataFrame, *keys: str) -> DataFrame:
    inside = (F.least("pitch_x", P.LENGTH - F.col("pitch_x")) <= 16.5) & (F.abs(F.col("pitch_y") - P.WIDTH / 2) <= 20.16)
    return rows.groupBy(*keys).agg(F.avg(inside.cast("double")).alias("share"))


def submission(rows: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, doc): the frame's rows as a JSON array in centred coordinates."""
    item = F.struct("track_id", "team", F.round(F.col("pitch_x") - P.LENGTH / 2, 3).alias("x"), F.round(F.col("pitch_y") - P.WIDTH / 2, 3).alias("y"))
    return rows.join(images, ["chunk", "frame"]).groupBy("image_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("doc"))


def receiver_candidates(passes: DataFrame, players: DataFrame) -> DataFrame:
    """(chunk, frame, from_id, cand, dist, is_receiver): the passer's team-mates of the frame."""
    p = passes.select("chunk", "frame", "team", "from_id", "to_id", "x0", "y0")
    j = p.join(players.select("chunk", "frame", "team", F.col("track_id").alias("cand"), "pitch_x", "pitch_y"), ["chunk", "frame", "team"]).where("cand <> from_id")
    return j.select("chunk", "frame", "from_id", "cand", P.distance("x0", "y0", "pitch_x", "pitch_y").alias("dist"), (F.col("cand") == F.col("to_id")).alias("is_receiver"))


def top_k_rate(cands: DataFrame, *order: str | Column, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """(k, rate): share of events whose true candidate is among the first k."""
    r = top_k(cands, ["chunk", "frame", "from_id"], max(ks), *order).groupBy("chunk", "frame", "from_id").agg(F.min(F.when(F.col("is_receiver"), F.col("rank"))).alias("r"))
    return r.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(F.col("r") <= k, F.lit(False)).alias("ok")) for k in ks))).alias("s")).groupBy("s.k").agg(F.avg(F.col("s.ok").cast("double")).alias("rate"))


def group_split(df: DataFrame, key: str, *, test: float, seed: int = 0) -> DataFrame:
    """Rows with is_test, whole groups on one side, by a hash of the key."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_003)) / 1_000_003
    return df.withColumn("is_test", u < test)


def evenly_spaced(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """At most k rows of each key, evenly spaced in order (a sampling operator)."""
    w, whole = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    d = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole))
    slot = F.floor(F.col("_i") * k / F.col("_n"))
    before = F.floor((F.col("_i") - 1) * k / F.col("_n"))
    return d.where((F.col("_i") == 0) | (slot != before)).drop("_i", "_n")


def lines_of_words(words: DataFrame, key: str, at: str, tol: float) -> DataFrame:
    """Words with the number of their line: a new one where the next lies more than ``tol`` further."""
    w = Window.partitionBy(key).orderBy(at)
    return words.withColumn("line", F.sum(F.coalesce((F.col(at) - F.lag(at).over(w) > tol).cast("int"), F.lit(0))).over(w))


def rating_at(queries: DataFrame, ratings: DataFrame) -> DataFrame:
    """Queries (name, day) with the rating valid on the day."""
    r = ratings.select("name", F.col("from_day"), "to_day", "rating")
    return queries.join(r, "name").where("day BETWEEN from_day AND to_day").drop("from_day", "to_day")


def cross_validate(a: DataFrame, b: DataFrame, key: str, metrics: list[str], *, tolerance: float) -> DataFrame:
    """(key, metric, primary, secondary, flagged): relative differences beyond the tolerance."""
    long = lambda d, n: d.select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(n)) for m in metrics))).alias("s")).select(key, "s.*")
    j = long(a, "primary").join(long(b, "secondary"), [key, "metric"], "full")
    return j.withColumn("flagged", F.abs(F.col("primary") - F.col("secondary")) > tolerance * F.abs(F.col("primary")))
