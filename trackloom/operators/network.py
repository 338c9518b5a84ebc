"""Passing networks, entropy maps of ball paths, formations."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import pitch as P
from trackloom.operators.association import hungarian
from trackloom.plans.matches import kind
from trackloom.plans.ordered import first_by, runs


def edge_stats(edges: DataFrame) -> DataFrame:
    """(team, nodes, edges, passes, density, reciprocity, asymmetry, top3, centralization) of weighted directed edges without loops."""
    e = edges.where("src <> dst").groupBy("team", "src", "dst").agg(F.sum("weight").alias("w"))
    both = e.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst")).groupBy("team", "a", "b").agg(F.count("*").alias("k"), F.sum("w").alias("s"), F.sum(F.when(F.col("src") == F.col("a"), F.col("w")).otherwise(-F.col("w"))).alias("d"))
    pairs = both.groupBy("team").agg(F.avg((F.col("k") == 2).cast("double")).alias("reciprocity"), (F.sum(F.abs("d")) / F.sum("s")).alias("asymmetry"))
    w = Window.partitionBy("team").orderBy(F.desc("w"), "src", "dst")
    r = e.withColumn("_r", F.row_number().over(w)).groupBy("team").agg(F.count("*").alias("edges"), F.sum("w").alias("passes"), (F.sum(F.when(F.col("_r") <= 3, F.col("w"))) / F.sum("w")).alias("top3"))
    s = e.select("team", F.explode(F.array(F.struct(F.col("src").alias("v"), "w"), F.struct(F.col("dst").alias("v"), "w"))).alias("x")).groupBy("team", "x.v").agg(F.sum("x.w").alias("s"))
    n = s.groupBy("team").agg(F.count("*").alias("nodes"), ((F.max("s") - F.avg("s")) / F.sum("s")).alias("centralization"))
    j = r.join(pairs, "team").join(n, "team")
    return j.select("team", "nodes", "edges", "passes", F.try_divide("edges", F.col("nodes") * (F.col("nodes") - 1)).alias("density"), "reciprocity", "asymmetry", "top3", "centralization")


def two_paths(edges: DataFrame) -> DataFrame:
    """(team, aba, abc): weights of two-step walks that return and that go on to a third player."""
    e = edges.where("src <> dst").groupBy("team", "src", "dst").agg(F.sum("weight").alias("w"))
    f = e.select("team", F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("w").alias("w2"))
    j = e.join(f, ["team", "dst"]).withColumn("p", F.col("w") * F.col("w2"))
    return j.groupBy("team").agg(F.sum(F.when(F.col("end") == F.col("src"), F.col("p")).otherwise(0)).alias("aba"), F.sum(F.when(F.col("end") != F.col("src"), F.col("p")).otherwise(0)).alias("abc"))


def betweenness(nodes: list, edges: dict[tuple, float]) -> dict:
    """Share of shortest paths through each node, an edge costing one over its weight; normalised for directed graphs."""
    out = dict.fromkeys(nodes, 0.0)
    nbrs: dict = {v: [] for v in nodes}
    for (a, b), w in edges.items():
        nbrs[a].append((b, 1.0 / w))
    for s in nodes:
        dist, paths, before, order = {}, {s: 1.0}, {v: [] for v in nodes}, []
        seen, heap = {s: 0.0}, [(0.0, 0, s, s)]
        tick = 0
        while heap:
            d, _, via, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for u, c in nbrs[v]:
                nd = d + c
                if u not in dist and nd < seen.get(u, np.inf) - 1e-12:
                    seen[u], paths[u], before[u] = nd, 0.0, []
                    tick += 1
                    heapq.heappush(heap, (nd, tick, v, u))
                if u not in dist and abs(nd - seen[u]) <= 1e-12:
                    paths[u] += paths[v]
                    before[u].append(v)
        need = dict.fromkeys(nodes, 0.0)
        for v in reversed(order):
            for p in before[v]:
                need[p] += paths[p] / paths[v] * (1 + need[v])
            if v != s:
                out[v] += need[v]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in out.items()}


def centrality(edges: DataFrame) -> DataFrame:
    """(team, node, betweenness); one team's network to a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = {(a, b): w for a, b, w in zip(pdf["src"], pdf["dst"], pdf["weight"], strict=True) if a != b}
        nodes = sorted({*(a for a, _ in e), *(b for _, b in e)})
        c = betweenness(nodes, e)
        return pd.DataFrame({"team": pdf["team"].iloc[0], "node": nodes, "betweenness": [c[v] for v in nodes]})

    g = edges.groupBy("team", "src", "dst").agg(F.sum("weight").cast("double").alias("weight"))
    return g.groupBy("team").applyInPandas(run, "team int, node long, betweenness double")


def per_second(ball: DataFrame, *, fps: int) -> DataFrame:
    """(chunk, t, x, y): per second the sample nearest to it, the earlier of two."""
    b = ball.withColumn("t", F.floor(F.col("frame") / fps + 0.5).cast("long")).withColumn("_d", F.abs(F.col("frame") - F.col("t") * fps))
    return first_by(b, ["chunk", "t"], "_d", "frame").select("chunk", "t", "frame", "x", "y")


def strings(seq: DataFrame, *, gap: int) -> DataFrame:
    """Possession strings: samples (chunk, t, team) of one team with holes of at most ``gap`` and no opponent between."""
    return runs(seq.where("team IS NOT NULL"), ["chunk"], "t", "team", max_gap=gap, out="string")


def windows(strs: DataFrame, *, length: int, nx: int, ny: int) -> DataFrame:
    """(team, start, end): cells at both ends of every ``length``-sample stretch of a string."""
    w = Window.partitionBy("chunk", "string").orderBy("t")
    c = strs.withColumn("start", P.cell("x", "y", nx, ny))
    return c.withColumn("end", F.lead("start", length - 1).over(w)).where("end IS NOT NULL").select("team", "start", "end")


def entropy_map(w: DataFrame, *, least: int) -> DataFrame:
    """(team, start, n, entropy): bits of the distribution of ends from each start cell."""
    c = w.groupBy("team", "start", "end").agg(F.count("*").alias("k"))
    t = c.withColumn("n", F.sum("k").over(Window.partitionBy("team", "start"))).where(F.col("n") >= least).withColumn("p", F.col("k") / F.col("n"))
    return t.groupBy("team", "start", "n").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def track_means(pos: DataFrame, dirs: DataFrame, *, least: int = 30) -> DataFrame:
    """(chunk, team, track_id, mx, my, keeper, n): mean place in attack direction of tracks seen often enough."""
    p = pos.where("role IN ('player', 'goalkeeper') AND pitch_x IS NOT NULL AND pitch_y IS NOT NULL").join(dirs, ["chunk", "team"])
    g = p.groupBy("chunk", "team", "track_id").agg(F.avg(P.advance("pitch_x", "dir")).alias("mx"), F.avg(P.across("pitch_y", "dir")).alias("my"), F.avg((F.col("role") == "goalkeeper").cast("double")).alias("k"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least).withColumn("keeper", F.col("k") > 0.5).drop("k")


#: Roles of the formations with their places in attack direction, in metres; fixed values.
FORMATIONS = {
    "4-3-3": "GK 5 34, LB 25 8, LCB 20 25, RCB 20 43, RB 25 60, LCM 45 20, CM 45 34, RCM 45 48, LW 75 12, ST 80 34, RW 75 56",
    "4-2-3-1": "GK 5 34, LB 25 8, LCB 20 25, RCB 20 43, RB 25 60, LDM 40 26, RDM 40 42, LAM 62 14, CAM 64 34, RAM 62 54, ST 82 34",
    "4-4-2": "GK 5 34, LB 25 8, LCB 20 25, RCB 20 43, RB 25 60, LM 50 10, LCM 48 28, RCM 48 40, RM 50 58, LST 78 27, RST 78 41",
    "3-5-2": "GK 5 34, LCB 20 18, CB 18 34, RCB 20 50, LWB 50 6, LCM 45 24, CM 45 34, RCM 45 44, RWB 50 62, LST 78 28, RST 78 40",
}


def template(name: str) -> list[tuple[str, float, float]]:
    return [(role, float(x), float(y)) for role, x, y in (slot.split() for slot in FORMATIONS[name].split(", "))]


def role_number(team: int, role: str) -> int:
    """The same number for a team's role everywhere: a hundred times the team, plus the role's place among all roles by name."""
    return team * 100 + sorted({r for n in FORMATIONS for r, _, _ in template(n)}).index(role)


def formations(means: DataFrame, names: tuple[str, ...] = tuple(FORMATIONS)) -> DataFrame:
    """(chunk, team, track_id, slot, formation, cost): the most seen keeper is the keeper, the ten most seen others take the other roles of the cheapest template.

    Without a keeper the eleven most seen tracks take all roles.  The cost is the mean distance without the keeper's; the first of equal templates wins.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "track_id"], ascending=[False, True]).reset_index(drop=True)
        first = pdf.index[pdf["keeper"]][:1]
        pool = pdf.drop(first).head(11 - len(first))
        best = None
        for name in names:
            slots = [s for s in template(name) if not len(first) or s[0] != "GK"]
            d = np.hypot(*(pool[[c]].to_numpy() - np.array([s[i] for s in slots])[None] for c, i in (("mx", 1), ("my", 2))))
            pairs = hungarian(d) if len(pool) else []
            cost = float(np.mean([d[i, j] for i, j in pairs])) if pairs else 0.0
            if best is None or cost < best[0]:
                best = (cost, name, [(pool["track_id"].iloc[i], slots[j][0]) for i, j in pairs])
        cost, name, picked = best
        picked = [(pdf["track_id"].iloc[i], "GK") for i in first] + picked
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "team": pdf["team"].iloc[0], "track_id": [t for t, _ in picked], "slot": [s for _, s in picked], "formation": name, "cost": cost})

    return means.groupBy("chunk", "team").applyInPandas(run, f"{kind(means, 'chunk')}, team int, track_id long, slot string, formation string, cost double")


def modal_formation(f: DataFrame) -> DataFrame:
    """(team, formation, chunks, cost): the commonest, of equals the cheaper."""
    c = f.select("chunk", "team", "formation", "cost").distinct().groupBy("team", "formation").agg(F.count("*").alias("chunks"), F.avg("cost").alias("cost"))
    return first_by(c, ["team"], F.desc("chunks"), "cost", "formation")


def sliced_embedding(pos: DataFrame, dirs: DataFrame, *, directions: int = 24, quantiles: int = 12, least: int = 4) -> DataFrame:
    """(chunk, frame, team, emb): quantiles of the team's places projected on evenly spaced directions, turned into attack direction and centred."""
    p = pos.where("role IN ('player', 'goalkeeper') AND pitch_x IS NOT NULL AND pitch_y IS NOT NULL").join(dirs, ["chunk", "team"])
    w = Window.partitionBy("chunk", "frame", "team")
    x, y = P.advance("pitch_x", "dir"), P.across("pitch_y", "dir")
    p = p.withColumns({"_x": x, "_y": y}).withColumns({"_x": F.col("_x") - F.avg("_x").over(w), "_y": F.col("_y") - F.avg("_y").over(w)})
    levels = [(i + 0.5) / quantiles for i in range(quantiles)]
    angles = [np.pi * i / directions for i in range(directions)]
    q = [F.percentile(F.col("_x") * float(np.cos(a)) + F.col("_y") * float(np.sin(a)), F.array(*(F.lit(v) for v in levels))) for a in angles]
    return p.groupBy("chunk", "frame", "team").agg(F.count("*").alias("n"), F.concat(*q).alias("emb")).where(F.col("n") >= least)


def kmeans_1d(values: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Centres of a deterministic one-dimensional k-means, seeded at quantiles."""
    centres = np.quantile(values, (np.arange(k) + 0.5) / k)
    for _ in range(rounds):
        near = np.abs(values[:, None] - centres[None]).argmin(1)
        new = np.array([values[near == i].mean() if (near == i).any() else centres[i] for i in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return np.sort(centres)
