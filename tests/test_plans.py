import random

from pyspark.sql import functions as F

from trackloom.plans.cut import checkpoint_dir, cut
from trackloom.plans.joins import against, join_checked, null_safe_join
from trackloom.plans.ordered import prefix_sums, range_join, runs, top_k
from trackloom.sources import io


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_keep_nulls_on_either_side_of_the_limit(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), ("z", 3)], "k string, v int")
    b = spark.createDataFrame([("x", 10), (None, 20)], "k string, w int")
    for limit in (0, 100):
        got = {tuple(r) for r in join_checked(a, b, ["k"], "left", limit=limit).collect()}
        assert got == {("x", 1, 10), (None, 2, 20), ("z", 3, None)}
    assert {tuple(r) for r in null_safe_join(a, b, ["k"]).collect()} == {("x", 1, 10), (None, 2, 20)}


def test_a_small_set_meets_all_rows_in_blocks(spark):
    few, rows = spark.range(7).withColumnRenamed("id", "q"), spark.range(5)
    for block in (100, 2):
        assert against(few, rows, block=block).count() == 35
        assert against(few, rows, F.col("id") < F.col("q"), block=block).count() == sum(min(q, 5) for q in range(7))


def test_prefix_sums_match_a_loop(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), round(rng.gauss(0, 1), 1), i, rng.randrange(5)) for i in range(500)] + [("c", None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, o double, i int, v int")
    for down in (False, True):
        got = {(r["k"], r["i"]): (r["s"], r["n"]) for r in prefix_sums(df, ["k"], "o", {"s": F.col("v"), "n": F.lit(1)}, "i", descending=down, buckets=16).collect()}
        for k in "ab":
            s = n = 0
            for o, i, v in sorted(((o, i, v) for q, o, i, v in rows if q == k), key=lambda r: (-r[0] if down else r[0], r[1])):
                s, n = s + v, n + 1
                assert got[k, i] == (s, n)
        assert ("c", 1) not in got
    assert prefix_sums(df.limit(0), ["k"], "o", {"s": F.col("v")}).count() == 0


def test_range_joins_are_equi_joins(spark):
    p, s = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("t")), spark.range(50).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 3).alias("z"))
    out = range_join(p, s, ["k"], "t", "a", "z", 16)
    assert out.count() == 200
    text = plan(out)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    rows = [("c", i, 1, "player", 0, 1.0, 2.0) for i in range(10)]
    spark.createDataFrame(rows, "chunk string, frame long, track_id long, role string, team int, pitch_x double, pitch_y double").write.parquet(str(tmp_path / "p"))
    text = plan(io.read_positions(spark, str(tmp_path / "p")).where("role = 'ball'").select("frame"))
    assert "EqualTo(role,ball)" in text and "pitch_x" not in text.split("ReadSchema")[1]


def test_runs_and_top_k(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in ((0, "a"), (1, "a"), (2, "b"), (9, "b"), (10, None))], "k int, t long, v string")
    assert [r["run"] for r in runs(df, ["k"], "t", "v", max_gap=3).orderBy("t").collect()] == [1, 1, 2, 3, 4]
    assert [r["t"] for r in top_k(df, ["k"], 2, F.desc("t")).orderBy("rank").collect()] == [10, 9]


def test_lineage_is_cut_into_the_named_folder(spark):
    df = cut(spark.range(10).withColumn("x", F.col("id") * 2))
    assert checkpoint_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir")) or "cut" in checkpoint_dir(spark)
    assert df.count() == 10 and "Range" not in plan(df)
