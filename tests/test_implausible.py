import numpy as np
import pyarrow as pa

from trackloom.functions import iforest
from trackloom.functions.quantile import exact_median
from trackloom.operators import implausible as M
from trackloom.operators.implausible import Field, implausible

FIELDS = [
    Field("pos", "x", "y", wrong="x < -10 or x > 115 or y < -10 or y > 78", possible="not (x < -10 or x > 115 or y < -10 or y > 78)", jump=(20.0, 12.0)),
    Field("err", "CASE WHEN c > -1E308D AND c < 1E308D THEN c END", wrong="c < 0", mad=12.0),
]
SCHEMA = "src string, frame long, x double, y double, c double, k0 string"


def walk(n, seed, src):
    rng = np.random.default_rng(seed)
    f = np.cumsum(rng.integers(1, 12, n))
    x, y = 50 + np.cumsum(rng.normal(0, 0.2, n)), 30 + np.cumsum(rng.normal(0, 0.2, n))
    c = np.abs(rng.normal(0.5, 0.05, n))
    cases = set()
    for at, k in ((30, 1), (75, 2), (130, 3)):
        x[at : at + k] += 30
        cases |= {("pos", int(v)) for v in f[at : at + k]}
    x[200:210], y[200:210] = x[200], y[200]
    cases |= {("pos", int(v)) for v in f[200:210]}
    x[250] = np.inf
    cases.add(("pos", int(f[250])))
    c[60], c[61] = 9.0, -1.0
    cases |= {("err", int(f[60])), ("err", int(f[61]))}
    c[100:108] = c[100]
    cases |= {("err", int(v)) for v in f[100:108]}
    x[290], c[291], c[292] = np.nan, np.nan, np.inf
    return [(src, int(a), float(b), float(d), float(e), "z") for a, b, d, e in zip(f, x, y, c)], {(src, *v) for v in cases}


def found(df, **kw):
    out = implausible(df, ["src"], "frame", "frame", FIELDS, flagged=True, **kw).collect()
    return {(r["src"], r["field"], r["row_key"]) for r in out}


def test_planted_cases_in_one_group_and_in_blocks(spark):
    rows, cases = [], set()
    for i, src in enumerate(["a", "b", None]):
        r, c = walk(400, i, src)
        rows += r
        cases |= c
    rows += rows[::7] + [("a", None, 1.0, 1.0, 1.0, ""), ("a", 1_000_000, None, 1.0, None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == cases
    assert found(df, block=64) == cases


def test_every_reading_has_a_score_and_empty_input(spark):
    rows, _ = walk(400, 9, "a")
    out = implausible(spark.createDataFrame(rows, SCHEMA), ["src"], "frame", "frame", FIELDS)
    assert out.where("field = 'pos'").count() == 399 and out.where("score is null").count() == 0
    assert implausible(spark.createDataFrame([], SCHEMA), ["src"], "frame", "frame", FIELDS).count() == 0


def test_block_size_changes_neither_scores_nor_flags(spark):
    rows = walk(400, 5, "a")[0] + walk(300, 6, "b")[0] + walk(400, 7, None)[0]
    # longer than any halo: impossible readings in a row, of which the usual movement takes no notice
    rows = [(s, f, 500.0 if s == "b" and 100 < f < 400 else x, y, c, k) for s, f, x, y, c, k in rows] + rows[::9]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, blocks = ({(r["src"], r["field"], r["row_key"]): r[4:] + (round(r["score"], 9),) for r in implausible(df, ["src"], "frame", "frame", FIELDS, block=b).collect()} for b in (8192, 32))
    assert len(whole) > 1900 and whole == blocks


def test_runs_longer_than_the_halo_in_blocks(spark):
    rows = [("a", i, 5.0 if 90 <= i < 110 or 200 <= i < 219 else i * 0.01) for i in range(400)]
    f = [Field("v", "x", min_run=20)]
    for block in (8192, 40):
        got = implausible(spark.createDataFrame(rows, "s string, t long, x double"), ["s"], "t", "t", f, block=block).where("frozen").collect()
        assert sorted(r["row_key"] for r in got) == list(range(90, 110))


def test_the_forest_decides(spark, monkeypatch):
    rows, cases = walk(400, 1, "a")
    df = spark.createDataFrame(rows, SCHEMA)
    spikes = {("a", "pos", r) for r in (x[1] for x in rows[30:31] + rows[75:77] + rows[130:133])} | {("a", "err", rows[60][1])}
    out = {(r["src"], r["field"], r["row_key"]): r["score"] for r in implausible(df, ["src"], "frame", "frame", FIELDS).collect()}
    assert min(out[k] for k in spikes) > np.quantile(list(out.values()), 0.9)
    part = M._small(FIELDS, ["k0"], [pa.string()], 12, True)
    x, y, c = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
    bad = (x < -10) | (x > 115) | (y < -10) | (y > 78)
    c = np.where(np.isfinite(c), c, np.nan)
    table = pa.table({"k0": pa.array(["a"] * 400), "o": pa.array([r[1] for r in rows]), "rk": pa.array([r[1] for r in rows]), "x0": x, "y0": y, "w0": bad, "p0": ~bad, "x1": c, "w1": c < 0, "p1": np.ones(400, bool)})
    found = lambda: {("a", r["field"], r["row_key"]) for r in part(table).to_pylist()}
    assert found() == cases
    monkeypatch.setattr(M.iforest, "score", lambda forest, x: np.full(len(x), 0.5))  # a forest that tells nothing
    assert found() == cases - spikes


def test_no_draw_of_readings_decides(spark):
    n = 4000
    h = np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    drawn = np.argsort((h ^ (h >> np.uint64(29))).astype(np.int64), kind="stable")[:1024]  # what the forest once came from
    v = np.random.default_rng(2).normal(0.5, 0.01, n)
    v[drawn] += 4.5
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "s string, t long, c double")
    off = np.abs(v - np.median(v))
    assert set(np.flatnonzero(off > 12 * np.median(off))) == set(drawn)
    for block in (8192, 512):
        out = implausible(df, ["s"], "t", "t", [Field("err", "c", mad=12.0)], flagged=True, block=block)
        assert {r["row_key"] for r in out.where("odd").collect()} == set(drawn)


def test_the_model_of_parts_is_that_of_all_readings():
    rng = np.random.default_rng(8)
    for n, width in ((1, 7), (2, 8), (70, 7), (3000, 8)):
        feat = np.abs(rng.lognormal(0, 1, (n, width))).astype(np.float32)
        feat[:, : width - 6] = rng.normal(-3, 40, (n, width - 6))
        feat[:, -1] = rng.integers(1, 3, n)
        whole, s = M.Model.fit(feat)
        parts = M.Model(width)
        for _ in range(M.ROUNDS):
            parts.tell(*M.Model.add([parts.ask(p) for p in np.array_split(feat, 5) if len(p)]))
        assert (parts.usual == whole.usual).all() and (parts.center == whole.center).all() and (parts.spread == whole.spread).all()
        assert parts.limit == whole.limit and parts.least == whole.least and (parts.score(feat) == s).all()
        assert np.allclose(whole.usual, np.sort(feat[:, -6:-1], axis=0)[(n - 1) // 2], rtol=1 / 128)


def test_forest_isolates_outliers():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    s = iforest.score(iforest.grow(x), x)
    assert s[-1] == s.max() and s[-1] > 0.6 and np.median(s) < 0.5
    assert np.isfinite(iforest.score(iforest.grow(np.zeros((1, 2))), np.zeros((1, 2)))).all()


def test_exact_median(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 3}", float(v)) for i, v in enumerate(np.concatenate([rng.lognormal(0, 3, 5000), np.repeat(2.5, 3000)]))]
    rows += [("h", 1.0), ("h", 2.0), ("n", None), ("n", float("nan")), (None, 7.0)]
    got = {r["g"]: (r["median"], r["n"]) for r in exact_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in ("g0", "g1", "g2", "h"):
        v = [b for a, b in rows if a == g]
        assert abs(got[g][0] - np.median(v)) < 1e-12 and got[g][1] == len(v)
    assert "n" not in got
