"""Claims, permutation tests, distances between maps, reconstructed lines, pressing after losses."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from trackloom.functions import pitch as P
from trackloom.functions.text import NUMBER, SKIP, TOLERANCE
from trackloom.operators.imputation import between_sightings
from trackloom.operators.shape import PLAYERS
from trackloom.plans.cut import cut
from trackloom.plans.joins import join_checked
from trackloom.plans.ordered import range_join

FRAME = ["chunk", "frame"]


def claims_with(claims: DataFrame, tag: str | None = None, status: str | None = None) -> DataFrame:
    out = claims if tag is None else claims.where(F.array_contains("tags", tag))
    return out if status is None else out.where(F.col("status") == status)


def dead_evidence(claims: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path) of evidence paths, anchors cut off, that no file has; web addresses are not checked."""
    e = claims.select("id", F.explode("evidence").alias("e")).where("NOT e LIKE 'http%'").select("id", F.trim(F.substring_index("e", "#", 1)).alias("path")).where("path <> ''")
    return e.join(files, "path", "left_anti").select("id", "path")


def _met(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of two units that pairs (ul, ur) names, columns suffixed _l and _r; within one unit each two rows meet once."""
    l, r = (rows.select(F.col("u").alias(f"u{s}"), *(F.col(x).alias(f"{x}_{s}") for x in rows.columns if x != "u")).join(pairs, f"u{s}") for s in ("l", "r"))
    return l.join(r, ["ul", "ur"]).where("id_l <> id_r AND (ul <> ur OR id_l < id_r)")


def _lesser() -> Column:
    """The tags of a claim below the one it is listed under: a pair belongs to the tag below which it shares none."""
    return F.array_sort(F.expr("filter(tags, x -> x < tag)")).alias("lesser")


def _packed(rows: DataFrame, keys: list[str], most: int = 64) -> DataFrame:
    """Numbered packs of at most ``most`` claims that are alike in the keys, so that what holds for a pair of packs is asked once and not for each pair of claims."""
    packs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "links"))).alias("_all"))
    packs = packs.select(*keys, F.explode(F.expr(f"transform(sequence(1, size(_all), {most}), i -> slice(_all, i, {most}))")).alias("claims"))
    # the numbers may differ when counted again
    return cut(packs.withColumn("n", F.monotonically_increasing_id()))


def _unpacked(packs: DataFrame, pairs: DataFrame, where: Column, reason: str) -> DataFrame:
    """(a, b, reason) of the claims, no link joining them, of two packs for which the condition holds, in units that pairs (ul, ur) names."""
    l, r = (packs.select(F.col("u").alias(f"u{s}"), *(F.col(x).alias(f"{x}_{s}") for x in packs.columns if x != "u")).join(pairs, f"u{s}") for s in ("l", "r"))
    m = l.join(r, ["ul", "ur"]).where("(ul <> ur OR n_l <= n_r) AND NOT arrays_overlap(lesser_l, lesser_r)").where(where)
    m = m.select((F.col("n_l") == F.col("n_r")).alias("same"), F.explode("claims_l").alias("l"), "claims_r").select("same", "l", F.explode("claims_r").alias("r"))
    m = m.where("l.id <> r.id AND (NOT same OR l.id < r.id) AND NOT array_contains(l.links, r.id) AND NOT array_contains(r.links, l.id)")
    return m.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"), F.lit(reason).alias("reason"))


def _units(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Rows with the unit u of about ``block`` rows of their key that they belong to."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_n"))
    return join_checked(rows, n, keys).withColumn("u", F.struct(*keys, F.expr("pmod(xxhash64(id), _n)").alias("k"))).drop("_n")


def _apart(x: str, y: str, ratio: float) -> Column:
    return F.abs(F.col(x) - F.col(y)) > ratio * F.greatest(F.abs(x), F.abs(y))


def _far_apart(c: DataFrame, ratio: float, block: int) -> DataFrame:
    """Pairs of a tag and unit whose values differ: value ranges of bounded units meet where their ends can differ enough."""
    c = c.where("unit IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)").withColumn("v", F.col("value").cast("double"))
    # up to 16 ranges even below the block, as one pair of units is one task's work
    ranges = F.expr(f"least(128, greatest(ceil(count(*) / {block}), least(16, ceil(count(*) / 1000))))")
    cuts = c.groupBy("tag", "unit").agg(ranges.alias("n"), F.percentile_approx("v", [i / 128 for i in range(1, 128)], 1000).alias("cuts")).withColumn("cuts", F.when(F.col("n") > 1, F.col("cuts")))
    at = F.coalesce(F.size(F.filter("cuts", lambda x: x <= F.col("v"))) * F.col("n"), F.lit(0))
    c = join_checked(c, cuts, ["tag", "unit"]).withColumn("range", F.when(F.col("cuts").isNull(), 0).otherwise(F.floor(at / 128))).drop("n", "cuts")
    # sketched cuts may differ when computed again
    c = cut(_units(c, ["tag", "unit", "range"], block).select("u", "id", "v", "value", "links", _lesser()))
    s = c.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    l, r = (s.select(F.col("u.tag"), F.col("u.unit"), F.col("u").alias(f"u{e}"), F.col("lo").alias(f"lo_{e}"), F.col("hi").alias(f"hi_{e}")) for e in ("l", "r"))
    # up to a ratio of 1 the difference beyond the bound is greatest at ends of the ranges
    some = F.lit(ratio > 1)
    for x in ("lo", "hi"):
        some = some | F.abs(f"{x}_l").eqNullSafe(float("inf")) | F.abs(f"{x}_r").eqNullSafe(float("inf"))
        for y in ("lo", "hi"):
            some = some | _apart(f"{x}_l", f"{y}_r", ratio)
    pairs = cut(l.join(r, ["tag", "unit"]).where("ul <= ur").where(some).select("ul", "ur"))
    return _unpacked(_packed(c, ["u", "value", "lesser"]), pairs, _apart("value_l", "value_r", ratio), "number")


def _alike(c: DataFrame, ratio: float, overlap: float, block: int) -> DataFrame:
    """Pairs of a tag whose word sets overlap and whose values do not differ: equal sets count once, and two overlapping sets share one of their rarest words."""
    c = c.where(F.size("w") > 0).withColumn("s", F.concat_ws(" ", F.array_sort("w")))
    sets = cut(c.select("s", "w").dropDuplicates(["s"]))
    each = sets.select("s", "w", F.explode("w").alias("word"))
    rank = each.groupBy("word").agg(F.count("*").alias("n"))
    ranked = each.join(rank, "word").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("r"))
    # of m words more than overlap * m are shared, so one of them is among all but that many of the rarest
    shared = F.greatest(F.floor(F.size("r") * F.lit(overlap) - 1e-9) + 1, F.lit(1))
    first = ranked.select("s", F.col("r.word").alias("w"), F.explode(F.slice("r.word", 1, F.greatest(F.size("r") - shared.cast("int") + 1, F.lit(0)))).alias("word"))
    first = cut(_units(cut(first.withColumnRenamed("s", "id")), ["word"], block))
    of = first.select("u").distinct()
    l, r = (of.select(F.col("u.word"), F.col("u").alias(f"u{e}")) for e in ("l", "r"))
    jac = F.try_divide(F.size(F.array_intersect("w_l", "w_r")), F.size(F.array_union("w_l", "w_r")))
    two = _met(first.select("u", "id", "w"), l.join(r, "word").where("ul <= ur").select("ul", "ur")).where(jac > overlap)
    alike = two.select(F.least("id_l", "id_r").alias("sl"), F.greatest("id_l", "id_r").alias("sr")).distinct()
    alike = cut(alike.union(sets.where(F.lit(overlap < 1)).select("s", "s")))
    c = _packed(_units(c.select("tag", "s", "id", "links", _lesser(), "unit", "value"), ["tag", "s"], block), ["u", "unit", "value", "lesser"])
    of = c.select("u").distinct()
    l, r = (of.select(F.col("u.tag").alias("tag"), F.col("u.s").alias(f"s{e}"), F.col("u").alias(f"u{e}")) for e in ("l", "r"))
    pairs = cut(alike.join(l, "sl").join(r, ["tag", "sr"]).where("sl <> sr OR ul <= ur").select("ul", "ur"))
    differ = F.coalesce((F.col("unit_l") == F.col("unit_r")) & ~F.isnan("value_l") & ~F.isnan("value_r") & _apart("value_l", "value_r", ratio), F.lit(False))
    return _unpacked(c, pairs, ~differ, "statement")


def contradictions(claims: DataFrame, *, ratio: float = 0.25, overlap: float = 0.6, block: int = 20_000) -> DataFrame:
    """(a, b, reason) of confirmed, unlinked claims that share a tag and differ in number, or say nearly the same.

    Claims meet in units of about ``block``, so that the pairs of a hot tag are spread over tasks, and only where
    their value ranges or word sets allow a finding.  A pair that shares several tags counts once, in the least of
    them, so the pairs, which grow with the square of the claims, are not shuffled unless ids repeat.
    """
    if overlap < 0:
        raise ValueError("overlap below 0 holds for every pair")
    words = F.array_distinct(F.filter(F.split(F.lower("statement"), r"[\s.,():\-]+"), lambda w: F.length(w) > 3))
    c = claims.where("status = 'confirmed'").select("id", "unit", "value", "links", words.alias("w"), F.array_distinct("tags").alias("tags")).withColumn("tag", F.explode("tags")).where("tag IS NOT NULL")
    # the steps are cut, as one plan of all of them takes more of the driver's memory than their rows
    c = cut(c)
    found = _far_apart(c, ratio, block).union(_alike(c, ratio, overlap, block))
    if claims.where("status = 'confirmed'").groupBy("id").count().where("count > 1").isEmpty():
        return found
    return found.groupBy("a", "b").agg(F.min("reason").alias("reason"))


def marked(text: Column, facts: list[tuple[str, float]], marker: str = "[?{}]") -> Column:
    """The text with every number that no fact (kind, value) backs put into the marker; a document's facts are a short list."""
    number, skip = re.compile(NUMBER), re.compile(SKIP)
    kinds = {"%": "pct", "m": "m", "metres": "m", "xg": "xg", "s": "s", "seconds": "s"}

    def one(t: str | None) -> str | None:
        if t is None:
            return None

        def swap(m: re.Match) -> str:
            unit = (m.group(2) or "").lower()
            if not unit and skip.search(t[max(0, m.start() - 12) : m.end() + 12]):
                return m.group(0)
            kind = kinds.get(unit, "count")
            if any(k == kind and abs(v - float(m.group(1))) <= TOLERANCE[kind] + 1e-12 for k, v in facts):
                return m.group(0)
            body = m.group(0)
            return marker.format(body.strip()) + body[len(body.rstrip()) :]

        return number.sub(swap, t)

    @pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(text)


def map_distance(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(distance): mean absolute difference over the cells both maps have."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    return j.agg(F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("distance"))


def nearest_label_accuracy(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """(n, accuracy): share of items whose nearest other item (a, b, d) has their label; ties go to the smaller id."""
    n = distances.where("a <> b").groupBy("a").agg(F.min(F.struct("d", "b"))["b"].alias("b"))
    j = n.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    return j.agg(F.count("*").alias("n"), F.avg((F.col("la") == F.col("lb")).cast("double")).alias("accuracy"))


def permutation_null(d: np.ndarray, labels: np.ndarray, *, rounds: int = 500, seed: int = 1) -> np.ndarray:
    """Nearest-label accuracy under shuffled labels, for a matrix that fits a task."""
    rng = np.random.default_rng(seed)
    m = d + np.diag(np.full(len(d), np.inf))
    near = m.argmin(1)
    return np.array([(p == p[near]).mean() for p in (rng.permutation(labels) for _ in range(rounds))])


def motif_scores(w: np.ndarray, *, rounds: int = 200, seed: int = 1) -> tuple[float, float]:
    """z of returning and of onward two-step walks against networks with the weights shuffled among the edges."""
    def walks(m: np.ndarray) -> np.ndarray:
        m = m * (1 - np.eye(len(m)))
        back = (m * m.T).sum()
        return np.array([back, (m @ m).sum() - back])

    rng, edges = np.random.default_rng(seed), np.argwhere((w > 0) & ~np.eye(len(w), dtype=bool))
    seen, vals = walks(w), w[tuple(edges.T)]
    null = []
    for _ in range(rounds):
        m = np.zeros_like(w)
        m[tuple(edges.T)] = rng.permutation(vals)
        null.append(walks(m))
    null_ = np.array(null)
    sd = null_.std(0)
    z = np.where(sd > 0, (seen - null_.mean(0)) / np.where(sd > 0, sd, 1), 0.0)
    return float(z[0]), float(z[1])


def earth_mover(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact mean cost of moving weighted points onto weighted points, squared distance, by successive cheapest paths; the root is returned."""
    cost = ((a[:, None] - b[None]) ** 2).sum(-1)
    n, m = cost.shape
    supply, demand = wa / wa.sum(), wb / wb.sum()
    flow = np.zeros((n, m))
    supply, demand = supply.copy(), demand.copy()
    while supply.sum() > 1e-12 and demand.sum() > 1e-12:
        du, dv = np.where(supply > 1e-12, 0.0, np.inf), np.full(m, np.inf)
        pu, pv = np.full(n, -1), np.full(m, -1)
        for _ in range(n + m):
            via = du[:, None] + cost
            best = via.argmin(0)
            new = via[best, np.arange(m)]
            better = new < dv - 1e-15
            dv[better], pv[better] = new[better], best[better]
            back = np.where(flow > 1e-15, dv[None] - cost, np.inf)
            bj = back.argmin(1)
            nu = back[np.arange(n), bj]
            up = nu < du - 1e-15
            du[up], pu[up] = nu[up], bj[up]
            if not better.any() and not up.any():
                break
        j = int(np.where(demand > 1e-12, dv, np.inf).argmin())
        path, i = [], int(pv[j])
        end = j
        amount = demand[j]
        while True:
            path.append((i, j, 1))
            if pu[i] < 0:
                amount = min(amount, supply[i])
                break
            k = int(pu[i])
            path.append((i, k, -1))
            amount = min(amount, flow[i, k])
            j, i = k, int(pv[k])
        for x, y, s in path:
            flow[x, y] += s * amount
        supply[i] -= amount
        demand[end] -= amount
    return float(np.sqrt(max((flow * cost).sum(), 0.0)))


def reconstructed_line(pos: DataFrame, dirs: DataFrame, back: DataFrame) -> DataFrame:
    """(chunk, frame, team, line): 20th percentile of the back line's advances, each track held or interpolated between its sightings."""
    t = pos.where(PLAYERS).join(back, ["chunk", "track_id"]).join(dirs, ["chunk", "team"]).select(*FRAME, "track_id", "team", P.advance("pitch_x", "dir").alias("ax"))
    tracks = t.select("chunk", "track_id", "team").distinct()
    grid = pos.select(*FRAME).distinct().join(tracks, "chunk").join(t.select(*FRAME, "track_id", "ax"), [*FRAME, "track_id"], "left").withColumn("seen", F.col("ax").isNotNull())
    b = between_sightings(grid, ["chunk", "track_id"], "frame", "ax", "seen")
    u = F.try_divide(F.col("frame") - F.col("t_last"), F.col("t_next") - F.col("t_last"))
    v = F.coalesce("ax", F.col("v_last") + (F.col("v_next") - F.col("v_last")) * u, "v_last", "v_next")
    return b.withColumn("v", v).groupBy(*FRAME, "team").agg(F.percentile("v", 0.2).alias("line"))


def press_after_loss(turn: DataFrame, ball: DataFrame, players: DataFrame, poss: DataFrame, dirs: DataFrame, *, window: int = 125, press_m: float = 4.57) -> DataFrame:
    """(chunk, frame, lost_team, pressed, regained) of losses outside the loser's own third: someone of it near the ball, and the ball back, within the window."""
    t = turn.join(dirs.withColumnRenamed("team", "lost_team"), ["chunk", "lost_team"]).where(P.advance("x", "dir") >= P.LENGTH / 3).select("chunk", F.col("frame").alias("f0"), "lost_team", (F.col("frame") + 1).alias("lo"), (F.col("frame") + window).alias("hi"))
    seen = range_join(ball.select(*FRAME, "x", "y"), t, ["chunk"], "frame", "lo", "hi", 250).join(players.select(*FRAME, F.col("team").alias("lost_team"), "pitch_x", "pitch_y"), [*FRAME, "lost_team"])
    near = seen.where(P.distance("pitch_x", "pitch_y", "x", "y") <= press_m).select("chunk", "f0").distinct().withColumn("pressed", F.lit(True))
    back = range_join(poss.select(*FRAME, "team"), t, ["chunk"], "frame", "lo", "hi", 250).where("team = lost_team").select("chunk", "f0").distinct().withColumn("regained", F.lit(True))
    j = t.join(near, ["chunk", "f0"], "left").join(back, ["chunk", "f0"], "left")
    return j.select("chunk", F.col("f0").alias("frame"), "lost_team", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("pressed", "regained")))


def role_centres(rows: DataFrame, roles: DataFrame) -> DataFrame:
    return rows.join(roles, ["chunk", "track_id"]).groupBy("chunk", "team", "slot").agg(F.avg("pitch_x").alias("cx"), F.avg("pitch_y").alias("cy"))


def relabelled(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(chunk, track_id, slot): the role centre of its team nearest to each track's mean place."""
    m = rows.groupBy("chunk", "team", "track_id").agg(F.avg("pitch_x").alias("mx"), F.avg("pitch_y").alias("my"))
    j = m.join(centres, ["chunk", "team"]).withColumn("d", P.distance("mx", "my", "cx", "cy"))
    return j.groupBy("chunk", "track_id").agg(F.min(F.struct("d", "slot"))["slot"].alias("slot"))


def offsets_counts(losses: DataFrame, counts: DataFrame, *, seconds: tuple[int, ...] = (0, 1, 2), fps: int = 25, tol: int = 12) -> DataFrame:
    """(chunk, frame, second, n): players counted nearest to a few moments after each loss, within the tolerance."""
    from trackloom.plans.ordered import asof

    aim = losses.select("chunk", F.col("frame").alias("f0"), F.explode(F.array(*(F.lit(s) for s in seconds))).alias("second")).withColumn("frame", F.col("f0") + F.col("second") * fps)
    return asof(aim, counts, ["chunk"], "frame", direction="nearest", tolerance=tol, take=["n"]).select("chunk", F.col("f0").alias("frame"), "second", "n")


def association_accuracy(pairs: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(assa): mean over matched detections of the overlap of their two identities (gt, pred, n) against their sizes."""
    j = pairs.join(gt.select("gt", F.col("n").alias("ng")), "gt").join(pred.select("pred", F.col("n").alias("np")), "pred")
    return j.agg((F.sum(F.col("n") * F.col("n") / (F.col("ng") + F.col("np") - F.col("n"))) / F.sum("n")).alias("assa"))


def frame_windows(df: DataFrame, size: int) -> DataFrame:
    """Rows with the number of their fixed-size frame window."""
    return df.withColumn("window", F.expr(f"(frame - pmod(frame, {size}L)) div {size}L"))


def facets(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables per team joined into one, their columns named after their family."""
    out = None
    for name, d in parts.items():
        d = d.select("team", *(F.col(c).alias(f"{name}_{c}") for c in d.columns if c != "team"))
        out = d if out is None else out.join(d, "team", "full")
    return out


def spell_counts(poss: DataFrame) -> DataFrame:
    """(team, spells)."""
    w = Window.partitionBy("chunk").orderBy("frame")
    p = poss.withColumn("_n", F.coalesce((F.lag("team").over(w) != F.col("team")).cast("int"), F.lit(1)))
    return p.groupBy("team").agg(F.sum("_n").alias("spells"))
