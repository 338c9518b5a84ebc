from datetime import datetime, timedelta

from trackloom.streaming import frames as R

T0 = datetime(2025, 1, 1)
SCHEMA = "chunk long, frame long, team int, at timestamp"


def rows(spark, folder, parts):
    for i, p in enumerate(parts):
        spark.createDataFrame([(c, f, t, T0 + timedelta(seconds=f)) for c, f, t in p], SCHEMA).coalesce(1).write.parquet(f"{folder}/part{i}")
    import glob
    import os
    import shutil

    os.makedirs(f"{folder}/in")
    for i, _ in enumerate(parts):
        for j, f in enumerate(glob.glob(f"{folder}/part{i}/*.parquet")):
            shutil.copy(f, f"{folder}/in/{i}-{j}.parquet")
            os.utime(f"{folder}/in/{i}-{j}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    from pyspark.sql.types import _parse_datatype_string

    return R.arriving(spark, f"{folder}/in", _parse_datatype_string(SCHEMA), per_trigger=1)


def test_changes_across_batches(spark, tmp_path):
    s = rows(spark, str(tmp_path), [[(0, 0, 0), (0, 5, 0), (1, 0, 1)], [(0, 10, 1), (1, 5, 0)], [(0, 15, 1), (0, 20, 0)]])
    R.drain(R.possession_changes(s), "changes", str(tmp_path / "cp"))
    assert sorted(tuple(r) for r in spark.table("changes").collect()) == [(0, 10, 0, 1), (0, 20, 1, 0), (1, 5, 1, 0)]


def test_windows_sessions_and_late_rows(spark, tmp_path):
    s = rows(spark, str(tmp_path), [[(0, 0, 0), (0, 5, 0)], [(0, 400, 0), (0, 401, 0)], [(0, 402, 0)], [(0, 3, 0)]])
    R.drain(R.windowed_counts(s, time="at", keys=["chunk"], width="1 minute", late="30 seconds"), "counts", str(tmp_path / "a"), mode="update")
    assert [r["m"] for r in spark.sql("SELECT start, max(n) AS m FROM counts GROUP BY start ORDER BY start").collect()] == [2, 3]
    R.drain(R.sessions(s, time="at", keys=["chunk"], gap="1 minute", late="30 seconds"), "sess", str(tmp_path / "b"), mode="append")
    assert [r["n"] for r in spark.table("sess").collect()] == [2]


def test_repeats_drop_and_files_are_written_once(spark, tmp_path):
    s = rows(spark, str(tmp_path), [[(0, 0, 0), (0, 5, 0)], [(0, 5, 0), (0, 6, 1)]])
    R.drain_to(R.once_per_key(s, time="at", keys=["chunk", "frame"], late="1 hour"), str(tmp_path / "out"), str(tmp_path / "c"), partition_by=["chunk"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
