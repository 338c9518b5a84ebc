import datetime
import json

import pytest

from trackloom.sources import io

YAML = """
matches:
  m1: {teams: [A, B], aligned: a.parquet, manager: one, date: 2024-05-01}
  m2: {teams: [C, D], manager: two, date: nonsense}
  m3: {teams: [E, F], manager: one}
"""


def test_registry(spark):
    r = io.read_registry(spark, YAML)
    assert [x["match_id"] for x in io.by_manager(r, "one").collect()] == ["m1", "m3"]
    assert io.get_match(r, "m1").first()["date"] == datetime.date(2024, 5, 1) and io.get_match(r, "m2").first()["date"] is None
    with pytest.raises(KeyError, match="m1, m2, m3"):
        io.get_match(r, "x")


def test_positions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c1", 1, float("nan")), ("c2", 2, 3.0)], "chunk string, frame long, pitch_x double")
    io.write_positions(df, str(tmp_path / "p"))
    out = io.read_positions(spark, str(tmp_path / "p"))
    assert {(r["chunk"], r["frame"], r["pitch_x"], r["is_keeper"]) for r in out.collect()} == {("c1", 1, None, None), ("c2", 2, 3.0, None)}
    assert io.empty_positions(spark).count() == 0
    assert "PartitionFilters: [isnotnull(chunk" in out.where("chunk = 'c1'")._jdf.queryExecution().toString()


def test_clicks_and_wide_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("frame,x,y,visible\n5,1.5,2.5,1\n6,9,9,0\n")
    assert [tuple(r) for r in io.read_clicks(spark, str(tmp_path / "c.csv")).collect()] == [(5, 1.5, 2.5, 1), (6, None, None, 0)]
    (tmp_path / "w.csv").write_text(",,,Home,,Home,\n,,,11,,1,\nPeriod,Frame,Time [s],P11,,P1,\n1,1,0.04,0.5,0.5,,\n")
    got = [tuple(r) for r in io.read_wide(spark, str(tmp_path / "w.csv")).collect()]
    assert got == [(1, 1, 0.04, 0, 52.5, 34.0), (1, 1, 0.04, 1, None, None)]


def test_annotations_and_documents(spark, tmp_path):
    a = {"annotations": [{"image_id": "1", "track_id": 4, "attributes": {"role": "player", "team": "left", "jersey": "9"}, "bbox_pitch": {"x_bottom_middle": 1.0, "y_bottom_middle": 2.0}}, {"image_id": "1", "track_id": 5, "attributes": {"role": "ball"}}]}
    (tmp_path / "a.json").write_text(json.dumps(a))
    assert [tuple(r) for r in io.read_annotations(spark, str(tmp_path / "a.json")).collect()] == [("1", 4, "player", "left", "9", 1.0, 2.0)]
    io.write_document(spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "id long, v double"), str(tmp_path / "d"))
    assert sorted((d["id"], d["v"]) for d in io.read_documents(spark, str(tmp_path / "d")) if d["v"]) == [(3, 1.5)]
    assert len(io.read_documents(spark, str(tmp_path / "d"))) == 3


def test_parsers(spark):
    df = spark.createDataFrame([("1,234.5",), ("x",), (None,)], "v string").select(io.number("v").alias("n"))
    assert [r["n"] for r in df.collect()] == [1234.5, None, None]
    t = spark.createDataFrame([("In possession\nBuild Up 12.5% 30%\nLow Block 7 % 9%\nnothing",)], "t string")
    assert [tuple(r) for r in io.parse_percentages(t, "t").collect()] == [("Build Up", 12.5, 30.0), ("Low Block", 7.0, 9.0)]
    assert io.survivor_fields("t12_f340_2.png") == (12, 340, 2) and io.survivor_fields("x") is None
