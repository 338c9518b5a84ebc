import itertools

import numpy as np
from pyspark.sql import functions as F

from trackloom.functions import stats as X
from trackloom.operators import geometry as G
from trackloom.operators import reports as Q


def test_numbers_are_marked(spark):
    df = spark.createDataFrame([("The line stood at 36 m, then 88 m and 5.7 xG.",), (None,), ("In 2019 it was 40 of 41.",)], "t string")
    got = [r["t"] for r in df.select(Q.marked(F.col("t"), [("m", 36.2), ("count", 40.5)]).alias("t")).collect()]
    assert got == ["The line stood at 36 m, then [?88 m] and [?5.7 xG].", None, "In 2019 it was 40 of 41."]


def test_contradictions(spark):
    rows = [(1, ["a"], "confirmed", "m", 10.0, [], "the line stands high today"), (2, ["a", "b"], "confirmed", "m", 20.0, [], "something else entirely"), (3, ["b"], "confirmed", "s", 9.0, [2], "something else entirely"), (4, ["a", "b"], "open", "m", 99.0, [], "x"), (5, ["a"], "confirmed", "k", 1.0, [], "line stands high today")]
    df = spark.createDataFrame(rows, "id long, tags array<string>, status string, unit string, value double, links array<long>, statement string")
    assert {tuple(r) for r in Q.contradictions(df).collect()} == {(1, 2, "number"), (1, 5, "statement")}


def test_contradictions_of_hot_tags_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    say = ["high line holds", "high line holds today", "press comes late", "late press comes after losses", "tiny", "", None, "wing play wide left flank", "wing play wide right flank"]
    vals = [0.0, -3.0, 1.0, 1.2, 9.0, 9.5, 40.0, None, float("nan"), float("inf")]
    rows = [(i, ["hot"] * (i % 3 > 0) + ["ab"[i % 2]] * (i % 5 > 0) + ["hot"] * (i % 7 == 0), "open" if i % 11 == 0 else "confirmed", ["m", "s", None][i % 7 % 3], vals[rng.integers(10)], [int(rng.integers(120))], say[rng.integers(9)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, tags array<string>, status string, unit string, value double, links array<long>, statement string")
    for ratio, overlap in ((0.25, 0.6), (0.9, 0.3), (0.1, 0.0), (0.15, 1.0)):
        want = set()
        for x, y in itertools.combinations([r for r in rows if r[2] == "confirmed"], 2):
            if not set(x[1]) & set(y[1]) or y[0] in x[5] or x[0] in y[5]:
                continue
            v, w = x[4], y[4]
            wx, wy = ({t for t in (z[6] or "").split() if len(t) > 3} for z in (x, y))
            # as in Spark, where NaN is above all numbers
            if x[3] and x[3] == y[3] and v is not None and w is not None and v == v and w == w and (v == w == float("inf") or abs(v - w) > ratio * max(abs(v), abs(w))):
                want.add((x[0], y[0], "number"))
            elif wx | wy and len(wx & wy) / len(wx | wy) > overlap:
                want.add((x[0], y[0], "statement"))
        for block in (4, 1000) if ratio == 0.25 else (4,):
            got = [tuple(r) for r in Q.contradictions(df, ratio=ratio, overlap=overlap, block=block).collect()]
            assert len(got) == len(set(got)) and set(got) == want, (ratio, overlap, block)


def test_contradictions_shuffle_no_pairs_and_count_repeated_ids_once(spark):
    rows = [(1, ["a", "b"], "confirmed", "m", 1.0, [], "the line stands high"), (2, ["b", "a"], "confirmed", "m", 9.0, [], "the line stands high"), (3, ["b"], "confirmed", "m", 9.0, [], "the line stands high")]
    schema = "id long, tags array<string>, status string, unit string, value double, links array<long>, statement string"
    want = [(1, 2, "number"), (1, 3, "number"), (2, 3, "statement")]
    found = Q.contradictions(spark.createDataFrame(rows, schema))
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == want
    assert sorted(map(tuple, Q.contradictions(spark.createDataFrame(rows * 2, schema)).collect())) == want


def _joined(node) -> int:
    """Rows that the joins of an executed plan gave."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _joined(node.executedPlan())
    if "QueryStage" in name:
        return _joined(node.plan())
    own = node.metrics().apply("numOutputRows").value() if name.endswith("Join") else 0
    return own + sum(_joined(node.children().apply(i)) for i in range(node.children().size()))


def test_contradictions_join_packs_of_like_claims_and_not_claims(spark):
    rows = [(i, ["a", "hot"] if i % 3 else ["hot"], "confirmed", "m", float(i % 4 // 2 * 9 + 1), [i + 1], "the line stands high") for i in range(1400)]
    found = Q.contradictions(spark.createDataFrame(rows, "id long, tags array<string>, status string, unit string, value double, links array<long>, statement string"))
    got = [tuple(r) for r in found.collect()]
    want = {(a, b, "number" if a % 4 // 2 != b % 4 // 2 else "statement") for a, b in itertools.combinations(range(1400), 2) if b != a + 1}
    assert len(got) == len(want) and set(got) == want
    assert 0 < _joined(found._jdf.queryExecution().executedPlan()) < len(got) / 1000


def test_contradictions_are_sought_over_single_tags(spark, tmp_path):
    parts = [(1, "old bolt", "A", "B1", 1), (6, "new ring", "A", "B2", 50), (9, "cold plate", "C", "B2", 2), (12, "blue cog", "D", "B9", 1)]
    spark.createDataFrame([(*p, 1.0) for p in parts], "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    from trackloom.queries_reports import QUERIES

    got = {tuple(r) for r in QUERIES["all_contradictions"](spark, str(tmp_path)).select("a", "b", "reason").collect()}
    assert got == {(1, 6, "number"), (6, 9, "number")}


def test_earth_mover_matches_permutations():
    rng = np.random.default_rng(0)
    for n in (2, 3, 5):
        a, b = rng.random((n, 3)), rng.random((n, 3))
        w = np.full(n, 1 / n)
        want = min(sum(((a[i] - b[j]) ** 2).sum() for i, j in enumerate(p)) / n for p in itertools.permutations(range(n)))
        assert abs(Q.earth_mover(a, w, b, w) - np.sqrt(want)) < 1e-9
    assert abs(Q.earth_mover(np.array([[0.0], [1.0]]), np.array([0.25, 0.75]), np.array([[0.0]]), np.array([1.0])) - np.sqrt(0.75)) < 1e-12


def test_motifs_and_permutations():
    w = np.zeros((4, 4))
    w[0, 1] = w[1, 0] = 9
    w[1, 2] = w[2, 3] = w[3, 0] = 1
    assert Q.motif_scores(w)[0] > 1
    x = np.concatenate([np.zeros(10), np.full(10, 50.0)]) + np.arange(20) * 0.01
    d = np.abs(x[:, None] - x[None])
    null = Q.permutation_null(d, np.repeat([0, 1], 10))
    assert 0.2 < null.mean() < 0.7


def test_homography_and_gaps(spark):
    h = np.array([[0.05, 0.01, 3.0], [0.002, 0.06, 2.0], [1e-5, 2e-5, 1.0]])
    rng = np.random.default_rng(1)
    src = rng.random((12, 2)) * [1900, 1000]
    dst = G.transform(h, src)
    assert np.allclose(G.transform(G.fit_homography(src, dst), src), dst, atol=1e-6)
    rows = [(0, f, i, float(a), float(b), float(c) if f != 5 else None, float(d) if f != 5 else None) for f in (0, 5, 10, 40) for i, ((a, b), (c, d)) in enumerate(zip(src, dst)) if f != 40 or i < 3]
    df = spark.createDataFrame(rows, "chunk long, frame long, track_id long, image_x double, image_y double, pitch_x double, pitch_y double")
    hs = G.frame_homographies(df)
    assert {r["frame"] for r in hs.collect()} == {0, 10}
    out = {r["track_id"]: r for r in G.projected(df, G.carried(df, hs, most=10)).where("frame = 5").collect()}
    for i, (x, y) in enumerate(dst):
        if -2 <= x <= 107 and -2 <= y <= 70:
            assert abs(out[i]["pitch_x"] - x) < 1e-3 and abs(out[i]["pitch_y"] - y) < 1e-3
    assert {r["frame"] for r in G.carried(df, hs, most=10).collect()} == {0, 5, 10}
    assert G.reprojection_error(df, hs).agg(F.max("error_m")).first()[0] < 1e-3


def test_smoothing_follows_a_line():
    t = np.arange(60)
    x = 2.0 * t + np.random.default_rng(2).normal(0, 1, 60)
    seen = (t % 7 != 3) & ~((t > 30) & (t < 36))
    s = G.smooth_series(x, seen, meas=1.0, accel=0.05)
    assert np.abs(s - 2 * t).mean() < np.abs(x - 2 * t).mean()


def test_bootstrap_is_centred(spark):
    df = spark.createDataFrame([(i % 40, float(i % 10)) for i in range(4000)], "b long, v double")
    r = X.block_bootstrap(df, "b", "v", replicates=300).agg(F.avg("mean"), F.stddev("mean")).first()
    assert abs(r[0] - 4.5) < 0.2 and r[1] > 0


def test_small_statistics(spark):
    df = spark.createDataFrame([(1, 0.9, True), (2, 0.8, False), (3, 0.7, True), (4, 0.1, False)], "i long, s double, y boolean")
    assert abs(X.roc_auc(df.withColumn("g", F.lit(1)), ["g"], "s", "y").first()["auc"] - 0.75) < 1e-12
    g = df.withColumn("g", F.lit(1))
    f = X.frontier(g, ["g"], "s", "y", "i")
    assert X.coverage_at(f, ["g"], 0.66).first()["coverage"] == 0.75 and X.coverage_at(f, ["g"], 1.1).first()["coverage"] == 0
    assert X.conformal_radius(df.withColumn("g", F.lit(1)), ["g"], "s", alpha=0.5).first()["k"] == 0.8
    assert X.conformal_radius(df.withColumn("g", F.lit(1)), ["g"], "s", alpha=0.01).first()["k"] == float("inf")
    p = spark.createDataFrame([(0.2, 0.3, 0.5, 2)], "a double, b double, c double, k int")
    assert abs(p.select(X.rps(["a", "b", "c"], "k").alias("r")).first()["r"] - (0.04 + 0.25) / 2) < 1e-12
