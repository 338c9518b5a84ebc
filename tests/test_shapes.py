import time

import numpy as np
from pyspark.sql import functions as F

from trackloom.operators import network as N
from trackloom.operators import shapes as H

DIRS = [(0, 0, 1), (0, 1, -1)]


def team(spark, frames):
    """A narrow team and a wide one, each with some noise, of 5 to 9 players."""
    p = spark.range(frames * 18).select(F.lit(0).alias("chunk"), (F.col("id") / 18).cast("long").alias("frame"), (F.col("id") % 18).alias("track_id"))
    noise = lambda c: F.pmod(F.xxhash64("frame", "track_id", F.lit(c)), F.lit(1000)) / 500.0
    p = p.withColumns({"role": F.lit("player"), "team": (F.col("track_id") % 2).cast("int"), "i": F.floor(F.col("track_id") / 2)})
    return p.where("i < 5 + frame % 5").withColumns({"pitch_x": 20 + F.col("i") * F.when(F.col("team") == 0, 1.0).otherwise(4.0) + noise("x"), "pitch_y": 10 + F.col("i") * F.when(F.col("team") == 0, 5.0).otherwise(1.0) + noise("y")})


def test_prototypes_are_a_fixed_point_over_all_embeddings(spark):
    pos, dirs = team(spark, 60), spark.createDataFrame(DIRS, "chunk int, team int, dir int")
    e = np.array([r["emb"] for r in N.sliced_embedding(pos, dirs).collect()])
    got = sorted(H.shape_prototypes(pos, dirs, 3, rounds=100, tolerance=0.0).collect())
    c = np.array([r["centre"] for r in got])
    near = ((e[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert len(got) == 3 and len(e) == 120
    for j, r in enumerate(got):
        assert abs(r["weight"] - (near == j).mean()) < 1e-12 and np.allclose(e[near == j].mean(axis=0), c[j], atol=1e-9)


def test_fewer_shapes_than_prototypes_and_none(spark):
    dirs = spark.createDataFrame(DIRS, "chunk int, team int, dir int")
    same = team(spark, 10).where("frame % 5 = 0").withColumns({"pitch_x": F.col("i") * 2.0, "pitch_y": F.col("i") * F.lit(3.0)}).where("team = 0")
    assert [r["weight"] for r in H.shape_prototypes(same, dirs, 4).collect()] == [1.0]
    assert H.shape_prototypes(same.where("false"), dirs, 4).count() == 0


def test_many_frames_take_little_time(spark):
    began = time.time()
    assert H.shape_prototypes(team(spark, 20_000), spark.createDataFrame(DIRS, "chunk int, team int, dir int"), 8).count() == 8
    assert time.time() - began < 90
