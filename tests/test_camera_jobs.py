import time

import numpy as np
from pyspark.sql import functions as F

from trackloom.operators import frames as C


def test_camera_jobs_match_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(c, int(f), [None, 1.0, 9.0, 11.0, float("nan")][rng.choice(5, p=[0.05, 0.5, 0.4, 0.03, 0.02])], bool(rng.random() < 0.02)) for c in ("a", "b", None) for f in np.cumsum(rng.integers(1, 40, 300))]
    rows += [("b", None, 1.0, False), ("a", rows[20][1], 50.0, False)]
    want = []
    for chunk in ("a", "b", None):
        since = None
        for _, f, drift, is_cut in sorted((r for r in rows if r[0] == chunk), key=lambda r: (r[1] is not None, r[1], r[2] is not None, r[2])):
            far = None if drift is None else drift > 10 or drift != drift
            go = True if since is None or f - since >= 50 or far or is_cut else far
            since = f if go else since
            want.append((chunk, f, go))
    got = [tuple(r) for r in C.camera_jobs(spark.createDataFrame(rows, "chunk string, frame long, drift double, is_cut boolean"), period=50, drift=10.0).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len({g for _, _, g in got}) == 3


def test_a_long_chunk_takes_time_in_proportion(spark):
    n = 300_000
    began = time.time()
    r = C.camera_jobs(spark.range(n).select(F.lit(0).alias("chunk"), (F.col("id") * 5).alias("frame"), F.lit(0.0).alias("drift"), F.lit(False).alias("is_cut")), period=50, drift=10.0).agg(F.count("*"), F.count_if("recalibrate")).first()
    assert tuple(r) == (n, n // 10) and time.time() - began < 30
