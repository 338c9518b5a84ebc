import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import stats as X
from trackloom.operators import ahead as W
from trackloom.operators import geometry as G
from trackloom.operators import network as N
from trackloom.operators import rosters as S


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_number_classes_and_digits_round_trip(spark):
    df = spark.createDataFrame([(n,) for n in (-1, 1, 7, 10, 42, 99, 0, 100, None)], "n int")
    out = {r["n"]: r for r in df.select("n", S.number_class(F.col("n")).alias("c"), S.class_number(S.number_class(F.col("n"))).alias("back"), S.digits(F.col("n")).alias("d")).collect()}
    assert [out[n]["back"] for n in (-1, 1, 7, 10, 42, 99)] == [-1, 1, 7, 10, 42, 99]
    assert all(out[n]["c"] is None and out[n]["d"] is None for n in (0, 100, None))
    assert tuple(out[7]["d"]) == (10, 7, 1) and tuple(out[42]["d"]) == (4, 2, 1) and tuple(out[-1]["d"]) == (10, 0, 0)
    made = df.where("n BETWEEN 1 AND 99").withColumn("d", S.digits(F.col("n"))).withColumn("m", S.from_digits(F.col("d.tens"), F.col("d.units")))
    assert made.where("m <> n").count() == 0


def test_roster_mask_keeps_illegible_and_scales(spark):
    p = one(spark, S.on_roster(F.array(*(F.lit(v) for v in (0.1, 0.5, 0.2, 0.2))), F.array(F.lit(2), F.lit(77))))
    assert np.allclose(p, [1 / 3, 0, 2 / 3, 0])
    assert one(spark, S.on_roster(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(5)))) == [0, 0]


@pytest.mark.parametrize("sub,minutes,want", [(False, 90.0, (True, True)), (False, 30.0, (True, False)), (True, 20.0, (False, True)), (True, 60.0, (True, True)), (True, None, (False, False)), (False, float("nan"), (False, False)), (False, 0.0, (False, False))])
def test_halves_played(spark, sub, minutes, want):
    assert tuple(one(spark, S.halves_played(F.lit(sub), F.lit(minutes).cast("double")))) == want


def test_roster_assignment_is_the_cheapest_with_open_ends(spark):
    rng = random.Random(2)
    players = [(0, p, p + 1, rng.choice("GDMF")) for p in range(4)] + [(1, 9, 5, "M")]
    groups = [(0, g, rng.choice([None, 1, 2, 3, 40]), rng.choice([None, round(rng.random(), 2)]), rng.random() < 0.3, rng.randrange(5)) for g in range(4)] + [(2, 1, 7, 0.5, False, 1)]
    pl = spark.createDataFrame(players, "team int, player int, shirt int, position string")
    gr = spark.createDataFrame(groups, "team int, grp int, number int, u double, keeper boolean, votes int")
    cost = {(r["grp"], r["player"]): r["cost"] for r in S.roster_costs(pl, gr, ["team"]).collect() if r["team"] == 0}
    out = {(r["team"], r["grp"]): r for r in S.assign_roster(pl, gr, ["team"]).collect()}
    price = lambda pick: sum(cost[g, p] for g, p in pick) + S.OPEN * (8 - 2 * len(pick))
    best = min(price([(g, p) for g, p in zip(range(4), perm) if p >= 0]) for perm in itertools.product(range(-1, 4), repeat=4) if len({p for p in perm if p >= 0}) == sum(p >= 0 for p in perm))
    picked = [(g, out[0, g]["player"]) for g in range(4) if out[0, g]["player"] is not None]
    assert abs(price(picked) - best) < 1e-9 and len(out) == 5
    assert out[2, 1]["reason"] == "no_candidate" and out[2, 1]["confidence"] is None


def test_keepers_by_their_half(spark):
    rows = [(1, f, t, r, x, 34.0) for f in range(5) for t, r, x in ((1, "goalkeeper", 4.0), (2, "player", 3.0), (3, "player", 101.0), (4, "player", 99.0), (5, "player", 60.0))]
    out = {r["track_id"]: (r["role"], r["side"]) for r in S.keeper_sides(spark.createDataFrame(rows, "chunk long, frame long, track_id long, role string, pitch_x double, pitch_y double")).collect()}
    assert out == {1: ("goalkeeper", "left"), 2: ("player", None), 3: ("goalkeeper", "right"), 4: ("player", None), 5: ("player", None)}


def test_absorbing_chains_of_duplicates(spark):
    rows = [("c", f, t, 0.5) for t, fs in ((1, range(0, 4)), (2, range(2, 12)), (3, range(10, 14)), (4, range(20))) for f in fs]
    df = spark.createDataFrame(rows, "chunk string, frame long, track_id long, conf double")
    out = sorted((r["frame"], r["track_id"]) for r in S.absorbed(df, spark.createDataFrame([("c", 1, 2), ("c", 2, 3)], "chunk string, a long, b long")).collect())
    assert out == sorted([(f, 2) for f in range(14)] + [(f, 4) for f in range(20)])
    assert S.absorbed(df, spark.createDataFrame([], "chunk string, a long, b long")).count() == len(rows)


def test_association_follows_boxes_and_cuts_at_long_gaps(spark):
    at = lambda x, y: (float(x), float(y), x + 10.0, y + 20.0)
    rows = [("c", f, 0, *at(2 * f, 0)) for f in range(10)] + [("c", f, 1, *at(300 - 2 * f, 50)) for f in range(10) if f != 4] + [("c", 60, 0, *at(18, 0))]
    out = {(r["frame"], r["det"]): r["track"] for r in S.associate(spark.createDataFrame(rows, "chunk string, frame long, det int, x0 double, y0 double, x1 double, y1 double")).collect()}
    assert {out[f, 0] for f in range(10)} == {1} and {out[f, 1] for f in range(10) if f != 4} == {2} and out[60, 0] == 3
    assert S.associate(spark.createDataFrame([], "chunk string, frame long, det int, x0 double, y0 double, x1 double, y1 double")).count() == 0


def test_best_and_actual_runs(spark):
    p = spark.createDataFrame([("c", 0, 0, 1, 50.0, 34.0), ("c", 0, 0, 2, 105.0, 34.0)], "chunk string, frame long, team int, track_id long, pitch_x double, pitch_y double")
    best = W.best_runs(p, lambda x, y: x, radius=10.0)
    out = {r["track_id"]: r for r in best.collect()}
    assert (out[1]["gain"], out[1]["dx"], out[1]["dy"]) == (10.0, 1.0, 0.0) and (out[2]["gain"], out[2]["dx"]) == (0.0, 0.0)
    mates = spark.createDataFrame([("c", 75, 0, 8, 50.0, 40.0), ("c", 75, 0, 7, 70.0, 34.0)], "chunk string, frame long, team int, track_id long, pitch_x double, pitch_y double")
    q = W.run_quality(best, W.actual_runs(p, mates, horizon=75), "team").first()
    assert q["runs"] == 2 and q["potential"] == 5.0 and abs(q["agreement"]) < 1e-12


def test_node_features_mask_what_is_unknown(spark):
    n = spark.createDataFrame([(60.0, 40.0, None, 1.0, 0.0, True, False, False, None, None, True)], "x double, y double, vx double, vy double, turn double, teammate boolean, actor boolean, keeper boolean, ball_x double, ball_y double, observed boolean")
    r = W.node_features(n).first()
    assert r["feat"] == [0.5, 0.5, 0, 0, 0, 1, 1, 0, 0, 0, 1] and r["mask"] == [1, 1, 0, 0, 1, 1, 1, 1, 1, 0, 1]


def test_homography_leaves_outliers_out():
    rng = np.random.default_rng(1)
    h = np.array([[0.05, 0.01, 3.0], [0.002, 0.06, 2.0], [1e-5, 2e-5, 1.0]])
    src = rng.random((14, 2)) * [1900, 1000]
    dst = G.transform(h, src)
    dst[:3] += [[40, 0], [0, -30], [25, 25]]
    assert np.allclose(G.transform(G.sure_homography(src, dst), src[3:]), dst[3:], atol=1e-6)


def test_series_weights_and_first_samples():
    x = np.array([0.0, 1.0, 2.0, 50.0, 4.0, 5.0])
    seen, w = np.ones(6, bool), np.array([1, 1, 1, 1e6, 1, 1.0])
    assert abs(G.smooth_series(x, seen, meas=0.1, accel=0.1, weight=w)[3] - 3) < 0.1 < abs(G.smooth_series(x, seen, meas=0.1, accel=0.1)[3] - 3)


def test_roles_have_one_number_each():
    roles = {r for n in N.FORMATIONS for r, _, _ in N.template(n)}
    assert len({N.role_number(t, r) for t in (0, 1) for r in roles}) == 2 * len(roles) and all(len(N.template(n)) == 11 for n in N.FORMATIONS)


def test_poisson_weights_have_their_mean_and_tail(spark):
    w = [r["w"] for r in spark.range(200_000).select(X.poisson_weight("id").alias("w")).collect()]
    assert abs(np.mean(w) - 1) < 0.01 and abs(np.var(w) - 1) < 0.02 and max(w) > 5
