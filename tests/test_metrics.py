"""Small fixtures with hand-computed results."""

import itertools
import random
import re

import numpy as np
import pytest

from trackloom.functions import pitch as P
from trackloom.functions import text as W
from trackloom.operators import association as A
from trackloom.operators import frames as C
from trackloom.operators import metrics as M
from trackloom.operators import network as N
from trackloom.operators import possession as O
from trackloom.operators import shape as S
from trackloom.operators import tracks as T
from trackloom.plans.ordered import asof, range_join

POS = "chunk long, frame long, track_id long, role string, team int, pitch_x double, pitch_y double"
BALL, POSS, DIRS = "chunk long, frame long, x double, y double", "chunk long, frame long, carrier long, team int, dist_m double", "chunk long, team int, dir int"


def pos(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], POS)


def ball(spark, rows):
    return spark.createDataFrame([(0, *map(float_, r)) for r in rows], BALL)


def float_(v):
    return v


def near(a, b):
    assert abs(a - b) < 1e-6, (a, b)


def test_lanes_and_shape(spark):
    p = pos(spark, [(0, i, "player", 0, 10.0, y) for i, y in enumerate((6.8, 20.4, 34.0, 47.6, 61.2))])
    r = S.frame_shapes(p).first()
    assert all(abs(r[f"lane{i}"] - 0.2) < 1e-12 for i in range(5))
    box = pos(spark, [(0, i, "player", 0, x, y) for i, (x, y) in enumerate(itertools.product((10.0, 30.0), (14.0, 54.0)))] + [(0, 9, "referee", -1, 1.0, 1.0), (0, 8, "player", 1, 1.0, 1.0)])
    rows = S.frame_shapes(box).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["width"], r["length"], r["cx"], r["cy"], r["team"]) == (40, 20, 20, 34, 0)
    near(r["area"], 800)
    assert r["advance"] is None


def test_lane_edges(spark):
    df = spark.createDataFrame([(68.0,), (-0.1,), (68.1,), (0.0,)], "y double").select(P.lane("y").alias("a"), P.lane("y", clip=True).alias("b"))
    assert [tuple(r) for r in df.collect()] == [(4, 4), (None, 0), (None, 4), (0, 0)]


def test_hull():
    assert S.hull(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]], float)) == 4
    assert S.hull(np.array([[0, 0], [1, 1]], float)) == 0
    assert S.hull(np.array([[0, 0], [1, 1], [2, 2]], float)) == 4


def test_clamp(spark):
    df = spark.createDataFrame([(-1.0, 68.5), (50.0, 71.0), (300.0, 30.0)], "x double, y double")
    assert [tuple(r) for r in df.select(*P.clamp("x", "y")).collect()] == [(0, 68), (None, None), (None, None)]


def test_advance(spark):
    df = spark.createDataFrame([(0.0, -1), (52.5, -1), (105.0, -1), (3.0, None)], "x double, d int").select(P.advance("x", "d").alias("a"))
    assert [r["a"] for r in df.collect()] == [105, 52.5, 0, None]


def test_directions(spark):
    p = pos(spark, [(0, 1, "goalkeeper", 0, 5.0, 30.0), (0, 2, "goalkeeper", 1, 100.0, 30.0)])
    assert {(r["team"], r["dir"]) for r in S.attack_directions(p).collect()} == {(0, 1), (1, -1)}
    p = pos(spark, [(i, 1, "goalkeeper", 1, 99.0, 30.0) for i in range(10)] + [(i, 2, "goalkeeper", 0, 95.0, 30.0) for i in range(2)])
    assert {(r["team"], r["dir"]) for r in S.attack_directions(p).collect()} == {(0, 1), (1, -1)}
    d = S.complete_directions(spark.createDataFrame([(0, 0, 1)], DIRS), spark.createDataFrame([(0, 0), (0, 1)], "chunk long, team int"))
    assert {(r["team"], r["dir"]) for r in d.collect()} == {(0, 1), (1, -1)}


def test_rolling_median(spark):
    p = pos(spark, [(i, 1, "player", 0, x, 1.0) for i, x in enumerate((10.0, 50.0, 11.0, 12.0, 13.0))] + [(1, 2, "ball", -1, 99.0, 1.0)])
    out = {(r["track_id"], r["frame"]): r["pitch_x"] for r in C.smooth_positions(p, half=1).collect()}
    assert out[1, 1] < 30 and out[2, 1] == 99
    p = pos(spark, [(i, 1, "player", 0, x, 1.0) for i, x in enumerate((10.0, 11.0, None, 13.0, 14.0))])
    assert {r["frame"]: r["pitch_x"] for r in C.smooth_positions(p, half=1).collect()}[2] is None


def test_keepers(spark):
    p = pos(spark, [(0, 1, "player", 0, 5.0, 30.0), (0, 2, "player", 0, 40.0, 30.0), (0, 3, "player", 1, 65.0, 30.0), (0, 4, "player", 1, 100.0, 30.0)])
    assert {r["track_id"] for r in C.flag_keeper(p).where("is_keeper").collect()} == {1, 4}
    p = pos(spark, [(0, 1, "player", 0, 40.0, 30.0), (0, 2, "player", 0, 55.0, 30.0), (0, 3, "player", 1, 60.0, 30.0), (0, 4, "player", 1, 75.0, 30.0)])
    assert C.flag_keeper(p).where("is_keeper").count() == 0
    p = pos(spark, [(0, 1, "goalkeeper", 0, 5.0, 30.0), (0, 2, "player", 0, 2.0, 30.0), (0, 3, "player", 1, 65.0, 30.0), (0, 4, "player", 1, 100.0, 30.0)])
    assert {r["track_id"] for r in C.flag_keeper(p).where("is_keeper").collect()} == {1, 4}


def test_actor(spark):
    p = pos(spark, [(0, 1, "player", 0, 50.0, 30.0), (0, 2, "player", 0, 51.0, 30.0)])
    assert [r["track_id"] for r in C.flag_actor(p, ball(spark, [(0, 50.2, 30.0)])).where("is_actor").collect()] == [1]


def test_reject_bunched_frames(spark):
    p = pos(spark, [(0, i, "player", 0, 10.0 * i, 6.0 * i) for i in range(10)] + [(1, i, "player", 0, 50.0 + i, 30.0) for i in range(4)] + [(1, 99, "ball", -1, 5.0, 5.0)])
    out = C.reject_frames(p, span_m=6.0)
    assert out.where("frame = 0 AND pitch_x IS NULL").count() == 0 and out.where("frame = 1 AND pitch_x IS NOT NULL").count() == 0


def test_link_outlier_and_gap():
    f = [i for i in range(0, 51, 5) if i != 25]
    x = [2.0 * i / 50 if i != 20 else 90.0 for i in f]
    out = {r[0]: r for r in T.link_points(np.array(f), np.array(x), np.full(len(f), 34.0), fps=50.0, cap=40.0, max_gap=8)}
    near(out[20][1], 0.8)
    near(out[25][1], 1.0)
    assert not out[25][3] and not out[20][3]


def test_link_starts_anew_after_a_long_gap():
    f = list(range(0, 21, 1)) + list(range(65, 76))
    x = [1.0] * 21 + [90.0] * 11
    out = T.link_points(np.array(f), np.array(x), np.full(len(f), 34.0), fps=50.0, cap=40.0, max_gap=8)
    assert {r[0] for r in out} == set(f)


def test_nearest_carrier(spark):
    p = pos(spark, [(0, 1, "player", 0, 10.4, 10.0), (5, 1, "player", 0, 50.0, 10.0)])
    got = O.assign_possession(ball(spark, [(0, 10.0, 10.0), (5, 10.0, 10.0)]), p).collect()
    assert [(r["frame"], r["carrier"]) for r in got] == [(0, 1)]


def test_short_runs_drop(spark):
    d = spark.createDataFrame([(0, i * 5, 1, t, 0.1) for i, t in enumerate((0, 0, 0, 1, 0, 0, 0))], POSS)
    got = O.drop_short_runs(d, 3).collect()
    assert len(got) == 6 and all(r["team"] == 0 for r in got)


def test_cheapest_path():
    assert O.cheapest_path(np.array([[1, 5], [1.2, 1], [1, 5.0]]), 1.5).tolist() == [0, 0, 0]
    assert O.cheapest_path(np.array([[1, 9], [1, 9], [9, 1], [9, 1], [9, 1.0]]), 1.5).tolist() == [0, 0, 1, 1, 1]
    rng = np.random.default_rng(0)
    for _ in range(50):
        c = rng.random((6, 2)) * 4
        want = min(itertools.product((0, 1), repeat=6), key=lambda s: sum(c[i, v] for i, v in enumerate(s)) + 1.5 * sum(a != b for a, b in zip(s, s[1:])))
        assert tuple(O.cheapest_path(c, 1.5)) == want


def test_smoothing_in_parts_equals_the_whole(spark):
    rng = random.Random(11)
    rows, balls = [], []
    for f in range(0, 1500, 5):
        balls.append((f, 50.0, 30.0))
        rows += [(f, 2 * i + t, "player", t, 50.0 + rng.uniform(-6, 6), 30.0 + rng.uniform(-6, 6)) for t in (0, 1) for i in range(2)]
    p, b = pos(spark, rows), ball(spark, balls)
    get = lambda block: sorted(tuple(r) for r in O.smooth_possession(b, p, radius_m=9.0, block=block).collect())
    whole = get(10**9)
    assert len(whole) > 250 and get(100) == whole and get(15) == whole


def test_linking_in_parts_equals_the_whole(spark):
    rng = random.Random(12)
    frames = sorted(f for f in rng.sample(range(0, 4000, 5), 300) if not 1000 < f < 1300)
    rows = [(0, f, 50 + f / 100 + rng.uniform(-1, 1) + (40 if rng.random() < 0.1 else 0), 30 + rng.uniform(-1, 1), 1.0) for f in frames for _ in range(rng.choice((1, 1, 2)))]
    df = spark.createDataFrame(rows, "chunk long, frame long, x double, y double, conf double")
    got = sorted((r["frame"], round(r["x"], 9), r["observed"]) for r in T.link_ball(df, fps=25.0).collect())
    rows.sort(key=lambda r: (r[1], r[2], r[3]))
    want = T.link_points(*(np.array([r[i] for r in rows]) for i in (1, 2, 3)), fps=25.0, cap=40.0, max_gap=8)
    assert got == sorted((f, round(x, 9), o) for f, x, _, o in want)


def test_passes_and_turnovers(spark):
    p = pos(spark, [(0, 1, "player", 0, 10.0, 10.0), (10, 2, "player", 0, 30.0, 10.0), (200, 5, "player", 1, 40.0, 10.0)])
    poss = spark.createDataFrame([(0, 0, 1, 0, 0.1), (0, 10, 2, 0, 0.1), (0, 200, 5, 1, 0.1)], POSS)
    got = O.passes(poss, p).collect()
    assert len(got) == 1 and got[0]["length_m"] == 20
    assert O.passes(poss, p, max_gap=5).count() == 0
    t = O.turnovers(poss, ball(spark, [(200, 7.0, 8.0)])).collect()
    assert [(r["frame"], r["lost_team"], r["won_team"], r["x"]) for r in t] == [(200, 0, 1, 7.0)]


def test_counterpress_and_high_regain(spark):
    poss = spark.createDataFrame([(0, f, 1, t, 0.1) for f, t in ((0, 0), (5, 0), (10, 1), (15, 1))], POSS)
    b = ball(spark, [(f, 10.0, 34.0) for f in (0, 5, 10, 15)])
    p = pos(spark, [(15, 7, "player", 0, 10.5, 34.0)])
    d = spark.createDataFrame([(0, 0, 1), (0, 1, -1)], DIRS)
    m = {r["team"]: r for r in O.transition_metrics(O.transition_table(O.turnovers(poss, b), b, p, d)).collect()}
    assert m[0]["counterpress_rate"] == 1 and m[0]["mean_recovery"] <= 5 and m[1]["won"] == 1 and m[1]["high_regains"] == 1


def test_regain_curve(spark):
    poss = spark.createDataFrame([(0, f, 1, t, 0.1) for f, t in ((0, 0), (10, 1), (60, 0))], POSS)
    b = ball(spark, [(f, 1.0, 1.0) for f in (0, 10, 60)])
    r = {x["team"]: x for x in O.regain_curve(O.turnovers(poss, b), poss, fps=50.0).collect()}
    assert r[0]["losses"] == 1 and r[0]["regain_3s"] == 1


def test_ball_phases(spark):
    p = pos(spark, [(0, i, "player", 1, 80.0 + i, 30.0) for i in range(4)])
    d = spark.createDataFrame([(0, 0, 1), (0, 1, -1)], DIRS)
    poss = spark.createDataFrame([(0, 0, 1, 0, 0.1)], POSS)
    got = {r["team"]: r["phase"] for r in M.ball_phases(ball(spark, [(0, 20.0, 34.0)]), poss, p, d).collect()}
    assert got[0] == "build_up" and got[1] == "low_block"


def test_four_phases(spark):
    poss = spark.createDataFrame([(0, f, 1, t, 0.1) for f, t in ((0, 0), (20, 1), (100, 1), (300, 1))], POSS)
    got = {(r["frame"], r["team"]): r["phase"] for r in M.four_phases(poss).collect()}
    assert got[20, 1] == got[100, 1] == "trans_pos" and got[20, 0] == "trans_neg"
    assert got[0, 0] == "in_poss" and got[0, 1] == "out_poss" and got[300, 1] == "in_poss" and got[300, 0] == "out_poss"


def test_overload(spark):
    p = pos(spark, [(f, i, "player", 0, 50.0 + i, 34.0) for f in range(5) for i in range(3)] + [(f, 9, "player", 1, 52.0, 34.0) for f in range(5)])
    poss = spark.createDataFrame([(0, f, 1, 0, 0.1) for f in range(5)], POSS)
    r = M.overload(ball(spark, [(f, 50.0, 34.0) for f in range(5)]), poss, p).first()
    assert (r["mean_overload"], r["overload_share"], r["frames"]) == (2, 1, 5)


def breaks(rows, band=5.0, between=25):
    n, armed, last = 0, False, -(10**9)
    for f, d in rows:
        if d < -band:
            armed = True
        elif d > band and armed and f - last >= between:
            n, armed, last = n + 1, False, f
    return n


def test_line_breaks_match_a_loop(spark):
    rng = random.Random(4)
    rows = [(0, f, t, rng.uniform(-15, 15)) for t in (0, 1) for f in range(0, 400, 5)]
    got = {r["team"]: r["line_breaks"] for r in M.line_breaks(spark.createDataFrame(rows, "chunk long, frame long, team int, diff double")).collect()}
    assert got == {t: breaks([(f, d) for _, f, u, d in rows if u == t]) for t in (0, 1)}


def test_verticality_and_set_pieces(spark):
    poss = spark.createDataFrame([(0, f, 1, 0, 0.1) for f in range(12)], POSS)
    d = spark.createDataFrame([(0, 0, 1)], DIRS)
    assert M.verticality(ball(spark, [(f, 10.0 + f, 34.0) for f in range(12)]), poss, d).first()["verticality"] > 0.9
    assert M.verticality(ball(spark, [(f, 10.0, 3.0 + f) for f in range(12)]), poss, d).first()["verticality"] < 0.1
    df = spark.createDataFrame([(1.0, 1.0), (50.0, 0.5), (2.0, 34.0), (60.0, 34.0)], "x double, y double").select(M.set_piece("x", "y").alias("t"))
    assert [r["t"] for r in df.collect()] == ["corner", "throw_in", "goal_kick", "free_kick"]
    got = M.set_pieces(ball(spark, [(0, 1.0, 1.0), (5, 1.0, 1.0), (200, 1.5, 1.5)])).collect()
    assert [(r["frame"], r["type"], r["gap_frames"]) for r in got] == [(200, "corner", 195)]
    assert M.set_piece_summary(M.set_pieces(ball(spark, []))).first()["total"] == 0


def test_score_states(spark):
    goals = spark.createDataFrame([(1, "h1", 2066.0, 0), (1, "h1", 2518.0, 0), (1, "h2", 739.0, 0)], "match long, half string, t_s double, ours int")
    pts = spark.createDataFrame([(1, "h1", 2050.0), (1, "h1", 2066.0), (1, "h1", 2600.0), (1, "h2", 10.0), (1, "h2", 800.0)], "match long, half string, t_s double")
    got = [(r["scoreline"], r["state"]) for r in M.score_states(pts, goals).orderBy("half", "t_s").collect()]
    assert got == [("0-0", "level"), ("0-1", "chasing"), ("0-2", "chasing"), ("0-2", "chasing"), ("0-3", "chasing")]


@pytest.mark.parametrize(("n", "gap", "want"), [([(100, 0.5), (110, 0.9), (118, 0.6), (400, 0.8)], 25, {110, 400}), ([(0, 0.9), (10, 0.5), (20, 0.8)], 15, {0, 20})])
def test_strongest_peaks(spark, n, gap, want):
    df = spark.createDataFrame([("a", f, c) for f, c in n], "k string, frame long, conf double")
    assert {r["frame"] for r in C.strongest_peaks(df, ["k"], gap=gap).collect()} == want


def test_peaks_match_a_loop(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), f, round(rng.random(), 3)) for f in rng.sample(range(3000), 300)]
    want = set()
    for k in "ab":
        kept = []
        for f, c in sorted(((f, c) for q, f, c in rows if q == k), key=lambda r: (-r[1], r[0])):
            if all(abs(f - g) > 12 for g in kept):
                kept.append(f)
        want |= {(k, f) for f in kept}
    got = C.strongest_peaks(spark.createDataFrame(rows, "k string, frame long, conf double"), ["k"], gap=12)
    assert {(r["k"], r["frame"]) for r in got.collect()} == want


def test_live_segments(spark):
    g = spark.createDataFrame([(0, f, f in (0, 5, 20, 25)) for f in range(0, 31, 5)], "chunk long, frame long, is_live boolean")
    rows = lambda **k: sorted((r["f0"], r["f1"]) for r in C.live_segments(g, **k).collect())
    assert rows(merge=15, pad=2) == [(-2, 27)] and rows(merge=5, pad=0) == [(0, 5), (20, 25)]


def test_shot_types(spark):
    rows = [(11, 1500.0), (11, 200.0), (4, 900.0), (6, 1500.0), (0, 0.0)]
    df = spark.createDataFrame(rows, "n int, s double")
    from pyspark.sql import functions as F

    assert [r["t"] for r in df.select(C.shot_type(F.col("n"), F.col("s")).alias("t")).collect()] == ["live_wide", "replay_or_other", "close_up", "replay_or_other", "graphic"]


def test_asof(spark):
    r = spark.createDataFrame([("a", f) for f in (100, 105, 110, 200)], "k string, frame long")
    left = spark.createDataFrame([("a", f) for f in (106, 108, 150)], "k string, frame long")
    got = lambda tol: [x["r_frame"] for x in asof(left, r, ["k"], "frame", direction="nearest", tolerance=tol).orderBy("frame").collect()]
    assert got(25) == [105, 110, None] and got(60) == [105, 110, 110]
    mid = spark.createDataFrame([("a", 155), ("b", 1)], "k string, frame long")
    assert {x["k"]: x["r_frame"] for x in asof(mid, r, ["k"], "frame", direction="nearest").collect()} == {"a": 110, "b": None}
    assert [x["r_frame"] for x in asof(left, r, ["k"], "frame", direction="forward").orderBy("frame").collect()] == [110, 110, 200]


def test_visibility_join(spark):
    runs = spark.createDataFrame([(0, 10, 20), (0, 40, 50), (1, 0, 5)], "k long, a long, z long")
    pts = spark.createDataFrame([(0, 9), (0, 10), (0, 20), (0, 30), (0, 45), (1, 3)], "k long, f long")
    assert {tuple(r) for r in range_join(pts, runs, ["k"], "f", "a", "z", 7, "left_semi").select("k", "f").collect()} == {(0, 10), (0, 20), (0, 45), (1, 3)}


def test_velocity(spark):
    p = pos(spark, [(i * 5, 1, "player", 0, 10 + 2 * i * 5 / 50, 34.0) for i in range(12)])
    v = {r["frame"]: r["vx"] for r in T.build_tracks(p, fps=50.0).collect()}
    assert v[0] is None and all(abs(v[i * 5] - 2) < 1e-9 for i in range(1, 12))
    t = T.build_tracks(p, fps=50.0)
    assert abs(T.run_targets(t, horizon=25, tolerance=5).where("frame = 10").first()["dx"] - 1.0) < 1e-9


def test_velocity_matches_numpy(spark):
    rng = np.random.default_rng(2)
    f = np.cumsum(rng.integers(1, 4, 40)) * 5
    x = np.cumsum(rng.normal(0, 0.2, 40)) + 50
    p = pos(spark, [(int(a), 1, "player", 0, float(b), 34.0) for a, b in zip(f, x)])
    got = T.build_tracks(p, fps=25.0).orderBy("frame").collect()
    xs = np.array([r["x_s"] for r in got])
    want = np.gradient(xs, f / 25)
    for r, w, gap in zip(got[1:], want[1:], np.diff(f)):
        assert (r["vx"] is None) == (gap > 15) and (r["vx"] is None or abs(r["vx"] - np.clip(w, -10, 10)) < 1e-9)


FRAG = [dict(seq="s", track_id=i + 1, start_frame=50 * i, end_frame=50 * i + 40, sx=10.0 + i, sy=30.0, ex=10.5 + i, ey=30.0, role="player", team=0) for i in range(3)]


def test_greedy_merge(spark):
    v = {1: [1.0, 0.0], 2: [0.99, 0.14], 3: [0.98, 0.2]}
    f = spark.createDataFrame([tuple(r.values()) for r in FRAG], "seq string, track_id long, start_frame long, end_frame long, sx double, sy double, ex double, ey double, role string, team int")
    s = [("s", a, b, float(np.dot(v[a], v[b]) / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))) for a, b in ((1, 2), (1, 3), (2, 3))]
    sims = spark.createDataFrame(s, "seq string, a long, b long, cosine double")
    assert {r["merged_id"] for r in A.greedy_merge(f, sims, threshold=0.9).collect()} == {1}
    assert {(r["track_id"], r["merged_id"]) for r in A.greedy_merge(f, sims, threshold=0.999999).collect()} == {(1, 1), (2, 2), (3, 3)}
    got = {(r["a"], r["b"]) for r in A.mergeable(f).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}
    far = f.withColumn("sx", f.sx + (f.track_id - 1) * 40)
    assert (1, 2) not in {(r["a"], r["b"]) for r in A.mergeable(far).collect()}


def test_overlap_slack():
    two = [dict(FRAG[0]), dict(FRAG[1], start_frame=40)]
    kw = dict(threshold=0.9, fps=25.0, top=9.0, slack=2.0)
    assert A.merge_chains(two, [(0.95, 0, 1)], **kw) == {1: 1, 2: 2}
    assert A.merge_chains(two, [(0.95, 0, 1)], overlap=1, **kw) == {1: 1, 2: 1}


def test_split_labels():
    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    x = np.array([a] * 10 + [b] * 10)
    assert A.split_labels(np.arange(20), x, eps=0.1, least=3, run=4).tolist() == [0] * 10 + [1] * 10
    y = np.array([a] * 10 + [b] * 2 + [a] * 8 + [b] * 8)
    assert A.split_labels(np.arange(28), y, eps=0.1, least=2, run=4).tolist() == [0] * 20 + [1] * 8


def test_hungarian_matches_brute_force():
    rng = np.random.default_rng(1)
    for n, m in ((3, 5), (5, 5), (4, 2), (1, 1)):
        for _ in range(20):
            c = rng.random((n, m))
            got = A.hungarian(c)
            small, big = min(n, m), max(n, m)
            best = min(sum(c[i, j] if n <= m else c[j, i] for i, j in enumerate(p)) for p in itertools.permutations(range(big), small))
            assert len(got) == small and abs(sum(c[i, j] for i, j in got) - best) < 1e-9


def test_betweenness():
    c = N.betweenness([1, 2, 3], {(1, 2): 1.0, (2, 3): 1.0, (3, 2): 1.0, (2, 1): 1.0})
    assert c[2] == 1 and c[1] == 0
    c = N.betweenness([1, 2, 3, 4], {(1, 2): 1.0, (2, 4): 1.0, (1, 3): 1.0, (3, 4): 1.0})
    assert abs(c[2] - 0.5 / 6) < 1e-12


def test_formation_recovery(spark):
    rng = random.Random(3)
    for name in ("4-3-3", "4-4-2", "3-5-2"):
        rows = [(0, 0, i, x + rng.uniform(-2, 2), y + rng.uniform(-2, 2), s == "GK", 100) for i, (s, x, y) in enumerate(N.template(name))]
        df = spark.createDataFrame(rows, "chunk long, team int, track_id long, mx double, my double, keeper boolean, n long")
        assert {r["formation"] for r in N.formations(df).collect()} == {name}


def test_kmeans_1d():
    v = np.concatenate([np.full(10, 1.0), np.full(10, 5.0), np.full(10, 9.0)])
    assert np.allclose(N.kmeans_1d(v, 3), [1, 5, 9])


def test_numbers_in_prose(spark):
    facts = spark.createDataFrame([("m", 36.2, "line", 1), ("pct", 51.9, "share", 1), ("count", 117.0, "passes", 1)], "kind string, fact double, label string, one int")
    from pyspark.sql import functions as F

    def unbacked(text):
        d = W.numbers(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").withColumn("one", F.lit(1))
        return sorted(r["value"] for r in W.check_numbers(d, facts, "id", ["one"]).where("NOT backed").collect())

    assert unbacked("The line stood at 36 m and the share was 52%, with 117 passes.") == []
    assert unbacked("A line of 88 m, 5.7 xG, 999 passes and 39% of the ball.") == [5.7, 39, 88, 999]
    assert unbacked("It ran 117 m.") == [117]
    assert unbacked("In 2019 the second half") == []


def test_each_number_is_judged_at_its_own_place(spark):
    rng = random.Random(8)
    bits = ["half-time ", "2059", "20", "9", "9 ", "9 9 9 9 9 9 9 9 ", " m", " %", ", ", "second ", " they ran and ran ", "7.5", "\n", "first"]
    texts = ["9 before half-time, and later in the match it was 9 again", "It was 2059 by then; much later they had 20 of them", "passes by the dozen: 9, and later still the second 9 of them", "", None, "7", "no number", *("".join(rng.choices(bits, k=12)) for _ in range(300))]
    number, skip = re.compile(W.NUMBER, re.ASCII), re.compile(W.SKIP, re.ASCII)
    want = {(k, i, float(m.group(1))) for k, t in enumerate(texts) for i, m in enumerate(number.finditer(t or "")) if m.group(2) or not skip.search(t[max(0, m.start() - 12) : m.end() + 12])}
    got = W.numbers(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")
    assert {(r["id"], r["i"], r["value"]) for r in got.collect()} == want
    assert {(0, 1, 9.0), (1, 1, 20.0), (2, 0, 9.0)} <= want and not {(0, 0, 9.0), (2, 1, 9.0)} & want


def test_json_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1.5, "c": [2, "x"]}, "d": true, "e": null}')], "id long, doc string")
    assert {(r["label"], r["value"]) for r in W.flatten_json(df, "id", "doc").collect()} == {("a.b", 1.5), ("a.c.0", 2.0)}


def test_deep_facts_are_kept(spark):
    deep = '{"a": ' * 9 + "[7, [[8]]]" + "}" * 9
    df = spark.createDataFrame([(1, deep), (2, '{"b": 1}'), (3, "{}"), (4, None)], "id long, doc string")
    path = ".".join("a" * 9)
    assert {tuple(r) for r in W.flatten_json(df, "id", "doc").collect()} == {(1, f"{path}.0", 7.0), (1, f"{path}.1.0.0", 8.0), (2, "b", 1.0)}
    assert W.flatten_json(df.limit(0), "id", "doc").count() == 0


def test_empty_inputs_give_typed_empty_outputs(spark):
    p, b, s, d = pos(spark, []), ball(spark, []), spark.createDataFrame([], POSS), spark.createDataFrame([], DIRS)
    for out in (S.frame_shapes(p), O.assign_possession(b, p), O.smooth_possession(b, p), O.turnovers(s, b), M.overload(b, s, p), M.line_breaks(M.line_gap(b, s, p, d)), M.lane_occupation(p, d), T.build_tracks(p), M.set_pieces(b), M.four_phases(s)):
        assert out.count() == 0 and out.columns
