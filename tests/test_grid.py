import math

import numpy as np

from trackloom.operators.grid import SEG, regular_grid


def grid(spark, rows, schema="src string, frame long, v double", **kw):
    return regular_grid(spark.createDataFrame(rows, schema), ["src"], "frame", ["v"], 10, **kw)


def test_states_values_and_holes(spark):
    rows = [(s, f, k * math.sin(f / 40.0), "clash") for k, s in enumerate("abcdef", 1) for f in range(0, 3000, 7) if s != "a" or not 1000 <= f < 1200]
    rows += [("a", None, 1.0, ""), ("a", 5, None, ""), ("a", 6, float("nan"), ""), (None, 10, 2.0, ""), (None, 90, 3.0, "")]
    rows += rows[:30]
    out = {(r["src"], r["period"]): r for r in grid(spark, rows, "src string, frame long, v double, period string").collect()}
    mean = lambda src, p: [v for s, f, v, _ in rows if s == src and f is not None and f // 10 == p and v is not None and not math.isnan(v)]
    for p in range(300):
        seen, r = mean("a", p), out["a", p]
        if seen:
            assert r["state"] == "observed" and abs(r["v"] - np.mean(seen)) < 1e-9
        else:
            assert r["state"] == "filled" and abs(r["v"] - np.mean(mean("d", p)) / 4) < 0.15
    assert ("a", 300) not in out and [out[None, p]["state"] for p in range(1, 10)] == ["observed"] + ["unsupported"] * 7 + ["observed"]
    assert out[None, 5]["v"] is None


def test_whole_missing_segments_infinite_readings_and_empty(spark):
    far = SEG * 10 * 10_000
    out = grid(spark, [("a", 0, float("inf")), ("a", far, 1.0), ("a", -35, 2.0)], only_missing=True)
    assert out.count() == far // 10 - 1 + 3
    assert out.select("period").distinct().count() == out.count()
    assert grid(spark, []).count() == 0


def test_held_out_cells_of_sources_alike(spark):
    rng = np.random.default_rng(1)
    a, b = np.cumsum(rng.normal(0, 1, 400)), np.cumsum(rng.normal(0, 1, 400))
    w = rng.normal(0, 1, (20, 2)) + 1
    true = {(f"s{i}", t): w[i, 0] * a[t] + w[i, 1] * b[t] + 3 * i for i in range(20) for t in range(400)}
    # a gap of 150 periods over three segments in one source, and cells missing here and there in all
    held = {k for k in true if (k[0] == "s3" and 100 <= k[1] < 250) or (0 < k[1] < 399 and rng.random() < 0.1)}
    rows = [(s, t * 10, float(v)) for (s, t), v in true.items() if (s, t) not in held]
    out = {(r["src"], r["period"]): r for r in grid(spark, rows).collect()}
    assert {k for k, r in out.items() if r["state"] == "filled"} == held
    size = {s: np.std([v for (x, _), v in true.items() if x == s]) for s in {k[0] for k in true}}
    err = [(out[k]["v"] - true[k]) / size[k[0]] for k in held]
    assert np.sqrt(np.mean(np.square(err))) < 0.1
    own = [(true[k] - np.mean([true[x] for x in true if x[0] == k[0] and x not in held])) / size[k[0]] for k in held]
    assert np.sqrt(np.mean(np.square(err))) < 0.2 * np.sqrt(np.mean(np.square(own)))


def test_constant_sources_and_lone_sources(spark):
    rows = [(s, t * 10, 5.0) for s in "abcdef" for t in range(0, 90, 3 if s == "a" else 1)] + [("far", 100_000, 1.0), ("far", 100_200, 2.0)]
    out = {(r["src"], r["period"]): (r["state"], r["v"]) for r in grid(spark, rows).collect()}
    assert out["a", 1][0] == "filled" and abs(out["a", 1][1] - 5.0) < 1e-6
    assert out["far", 10_005] == ("unsupported", None)
